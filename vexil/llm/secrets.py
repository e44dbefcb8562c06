"""Secret scan: fixed patterns, and sliding-window Shannon entropy over candidate strings.

DataFrame functions only.  Patterns (``assign``, ``access``, ``hex``) are found
leftmost and non-overlapping per kind; positions come from the lengths of what
lies between the matches.  Candidates for the method are runs of token
characters with a digit and a letter.  A window slides over a candidate; its
characters' counts are kept, 5 bits each, and at each step only those of the
character that leaves and of the one that enters change, and with them the sum
of c log2 c, from which the window's entropy follows.  A candidate is an ``entropy`` span if its best window reaches the threshold of its
character class, unless the allow list suppresses it or a pattern's span
overlaps it.

Running sums and bounds over a text's matches are taken in blocks of ``BLOCK``,
since a fold that appends to an array copies it each time; time is nearly in
proportion to a text's length and matches.

Spans are in code points, end exclusive.  Defined results: a null text counts as
empty and has no spans; null or repeated ids keep their rows; an empty table
gives an empty table; other columns are ignored by ``scan_secrets`` and kept by
``mask_secrets``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of the kinds, in the order in which kinds are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # AKIA and more, 18 characters at least
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{20,}"
KINDS = ["assign", "access", "hex", "entropy"]

# Least entropy (bits per character over a window) by character class.
WINDOW = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CLASSES = [(r"^[0-9a-fA-F-]+$", 3.0), (r"^[0-9a-z+/_=-]+$|^[0-9A-Z+/_=-]+$", 3.5), (r"", 3.7)]

# Candidates that are no secrets.
ALLOWED = [
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)example|sample|placeholder|dummy|xxxx|changeme",
    r"(?i)abcdefgh|01234567|12345678|qwertyui",
    r"^[A-Za-z]+([/_=-][A-Za-z]+)*[/_=-]*[0-9]{1,4}$",
    r"^([A-Za-z]+|[0-9]{1,4})([/_-]([A-Za-z]+|[0-9]{1,4}))+$",
]


#: Matches of one block of a running sum.
BLOCK = 64
#: Counts of 5 bits in one long.
COUNTS = 12


def _let(value: Column, use) -> Column:
    """use(value), the value computed once: a lambda's body computes what it refers to outside anew for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _blocks(items: Column) -> Column:
    last = F.floor((F.size(items) - 1) / F.lit(BLOCK)).cast("int")
    numbers = F.when(F.size(items) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))


def _running(items: Column, kind: str, zero: int, value, merge) -> Column:
    """array<struct<at, x>>: each item with what the values of the items before it merge to."""
    begin = lambda at, inner: F.struct(at.alias("at"), F.array().cast(f"array<{inner}>").alias("out"))
    more = lambda acc, v, x: F.struct(merge(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(x)).alias("out"))
    out = lambda acc: acc["out"]

    def within(block: Column, start: Column) -> Column:
        step = lambda acc, x: more(acc, value(x), F.struct(acc["at"].alias("at"), x.alias("x")))
        return F.aggregate(block, begin(start, f"struct<at:int,x:{kind}>"), step, out)

    def over(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda block: F.aggregate(block, F.lit(zero), lambda acc, x: merge(acc, value(x))))
        starts = F.aggregate(sums, begin(F.lit(zero), "int"), lambda acc, v: more(acc, v, acc["at"]), out)
        return F.flatten(F.zip_with(blocks, starts, within))

    return _let(items, lambda xs: _let(_blocks(xs), over))


_SPAN = "struct<start:int,kind:int,end:int>"


def _placed(found: Column, between: Column, kind: int) -> Column:
    """array<struct<start, kind, end>> of the matches, from what lies between them."""
    length = lambda x, c: F.length(x[c]).cast("int")
    steps = F.arrays_zip(found.alias("m"), F.slice(between, F.lit(1), F.size(found)).alias("p"))
    at = _running(steps, "struct<m:string,p:string>", 0, lambda x: length(x, "m") + length(x, "p"), lambda a, v: a + v)
    begin = lambda s: s["at"] + length(s["x"], "p")
    return F.transform(at, lambda s: F.struct(begin(s).alias("start"), F.lit(kind).alias("kind"), (begin(s) + length(s["x"], "m")).alias("end")))


def _clear(base: Column, spans: Column) -> Column:
    """The spans (of the last kind) that no span of base overlaps."""
    last, far = len(KINDS) - 1, 2**31 - 1
    ends = lambda x: F.when(x["kind"] < last, x["end"]).otherwise(F.lit(0))
    starts = lambda x: F.when(x["x"]["kind"] < last, x["x"]["start"]).otherwise(F.lit(far))
    before = _running(F.array_sort(F.concat(base, spans)), _SPAN, 0, ends, lambda a, v: F.greatest(a, v))
    after = _running(F.reverse(before), f"struct<at:int,x:{_SPAN}>", far, starts, lambda a, v: F.least(a, v))
    free = lambda y: (y["x"]["x"]["kind"] == last) & (y["x"]["at"] <= y["x"]["x"]["start"]) & (y["at"] >= y["x"]["x"]["end"])
    return F.array_sort(F.transform(F.filter(after, free), lambda y: y["x"]["x"]))


def _clogc(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def window_entropy(chars: Column, window: int = WINDOW) -> Column:
    """The largest entropy of the windows of an array of at least ``window`` characters of the alphabet; at most 31."""
    import math

    unit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), (i % COUNTS) * 5)
    count = lambda counts, i: F.call_function("shiftright", F.get(counts, F.floor(i / COUNTS).cast("int")), (i % COUNTS) * 5).bitwiseAND(F.lit(31)).cast("int")

    def changed(counts: Column, i: Column, by: int) -> Column:
        return F.transform(counts, lambda v, j: F.when(j == F.floor(i / COUNTS).cast("int"), v + F.lit(by) * unit(i)).otherwise(v))

    none = F.array(*[F.lit(0).cast("long") for _ in range(-(-len(ALPHABET) // COUNTS))])
    state = lambda counts, s, best: F.struct(counts.alias("counts"), s.alias("s"), best.alias("best"))

    def enter(acc: Column, i: Column) -> Column:
        n = count(acc["counts"], i)
        return state(changed(acc["counts"], i, 1), acc["s"] + _clogc(n + 1) - _clogc(n), acc["best"])

    def slide(acc: Column, pair: Column) -> Column:
        def entered(left: Column) -> Column:
            n, s = count(left["counts"], pair["new"]), left["s"]
            s = s + _clogc(n + 1) - _clogc(n)
            return state(changed(left["counts"], pair["new"], 1), s, F.least(acc["best"], s))

        n = count(acc["counts"], pair["old"])
        return _let(state(changed(acc["counts"], pair["old"], -1), acc["s"] - _clogc(n) + _clogc(n - 1), acc["best"]), entered)

    def over(at: Column) -> Column:
        first = F.aggregate(F.slice(at, 1, window), state(none, F.lit(0.0), F.lit(0.0)), enter)
        rest = F.greatest(F.size(at) - window, F.lit(0))
        pairs = F.arrays_zip(F.slice(at, F.lit(1), rest).alias("old"), F.slice(at, F.lit(window + 1), rest).alias("new"))
        begin = _let(first, lambda f: state(f["counts"], f["s"], f["s"]))
        return F.aggregate(pairs, begin, slide, lambda acc: acc["best"])

    least = _let(F.transform(chars, lambda c: F.call_function("locate", c, F.lit(ALPHABET)) - 1), over)
    return F.lit(math.log2(window)) - least / F.lit(float(window))


def _is_secret(token: Column) -> Column:
    enough = F.lit(CLASSES[-1][1])
    for pattern, bits in reversed(CLASSES[:-1]):
        enough = F.when(token.rlike(pattern), F.lit(bits)).otherwise(enough)
    test = F.lit(True)
    for pattern in ALLOWED:
        test = test & ~token.rlike(pattern)
    return test & (window_entropy(F.filter(F.split(token, ""), lambda c: c != "")) >= enough)


def _with_spans(docs: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """Adds arrays of spans ``base`` and ``found`` (entropy's), each sorted, to the columns kept and ``text``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(*keep, text.alias("__text"))
    # cheap tests first: few texts hold any
    gates = {"assign": r"(?i:word|passwd|secret|token|key)[\"']?\x20*[:=]", "access": r"AKIA[A-Z0-9]{14}", "hex": r"[0-9a-f]{16}", "entropy": CANDIDATE}
    df = df.select("*", *(F.col("__text").rlike(p).alias(f"__has_{k}") for k, p in gates.items()))
    none = F.array().cast("array<string>")
    whole = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, CANDIDATE)))
    df = df.select(
        *keep, "__text",
        *(F.when(F.col(f"__has_{k}"), F.regexp_extract_all("__text", F.lit(p), F.lit(0))).otherwise(none).alias(f"__m_{k}") for k, p in whole.items()),
        *(F.when(F.col(f"__has_{k}"), F.split("__text", p, -1)).otherwise(none).alias(f"__p_{k}") for k, p in whole.items()),
    )
    df = df.select(
        *keep, "__text", "__m_assign", "__m_entropy",
        *(F.when(F.size(f"__m_{k}") > 0, _placed(F.col(f"__m_{k}"), F.col(f"__p_{k}"), i)).alias(f"__s_{k}") for i, k in enumerate(KINDS)),
    )
    some = lambda k: F.coalesce(F.col(f"__s_{k}"), F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    # of the assignments only those whose value is long enough
    long = F.transform(
        F.filter(F.arrays_zip(F.col("__m_assign").alias("m"), some("assign").alias("s")), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 12),
        lambda x: x["s"],
    )
    df = df.select(*keep, "__text", "__m_entropy", some("entropy").alias("__c"), F.array_sort(F.concat(long, some("access"), some("hex"))).alias("base"))
    found = F.filter(F.arrays_zip(F.col("__m_entropy").alias("m"), F.col("__c").alias("s")), lambda x: _is_secret(x["m"]))
    df = df.select(*keep, "__text", "base", F.transform(found, lambda x: x["s"]).alias("__found"))
    found = F.when((F.size("__found") > 0) & (F.size("base") > 0), _clear(F.col("base"), F.col("__found"))).otherwise(F.col("__found"))
    return df.select(*keep, "__text", "base", found.alias("found"))


def _spelled(spans: Column) -> Column:
    name = lambda s: F.get(F.array(*map(F.lit, KINDS)), s["kind"])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, base, found): spans as array<struct<start, kind, end>>; kind is a position in KINDS."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _with_spans(rows, "text", "doc_id").select("doc_id", F.col("__text").alias("text"), "base", "found")


def mask_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, every span (overlapping ones as one) in the text replaced by the mask; null stays null."""
    columns = docs.columns
    other = [c for c in columns if c != text_col]
    rows = docs.select(*(F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(other)), F.col(f"`{text_col}`").alias("__original"))
    keep = [f"__k{i}" for i in range(len(other))] + ["__original"]
    text = F.col("__text")

    # every span with the furthest end before it; the text is cut block by block, since cutting counts from its start
    def over(spans: Column) -> Column:
        end = F.aggregate(spans, F.lit(0), lambda a, s: F.greatest(a, s["x"]["end"]))

        def block(blocks: Column) -> Column:
            first = F.concat(F.transform(blocks, lambda b: F.get(b, F.lit(0))["at"]), F.array(end))

            def piece(b: Column, i: Column) -> Column:
                at, to = F.get(b, F.lit(0))["at"], F.get(first, i + 1)
                gap = lambda part, s: F.concat(F.substring(part, s["at"] - at + 1, s["x"]["start"] - s["at"]), F.lit(mask))
                masked = lambda part: F.transform(b, lambda s: F.when(s["x"]["start"] >= s["at"], gap(part, s)).otherwise(F.lit("")))
                return F.array_join(_let(F.substring(text, at + 1, to - at), masked), "")

            return F.concat(F.array_join(F.transform(blocks, piece), ""), F.substring(text, end + 1, F.lit(2**31 - 1)))

        return _let(_blocks(spans), block)

    whole = _let(_running(F.array_sort(F.concat("base", "found")), _SPAN, 0, lambda x: x["end"], lambda a, v: F.greatest(a, v)), over)
    masked = F.when((F.size("base") > 0) | (F.size("found") > 0), whole).otherwise(F.col("__original"))
    found = _with_spans(rows, "__original", *keep)
    at = {c: F.col(f"__k{i}") for i, c in enumerate(other)} | {text_col: masked}
    return found.select(*(at[c].alias(c) for c in columns))


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    """All spans of every document."""
    scanned = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id",
        count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_spelled(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _spelled(F.array_sort(F.concat("base", "found"))).alias("spans"),
    )
