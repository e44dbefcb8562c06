"""URL filters: rules, and a path-template tree for what no rule fits.

DataFrame functions only.  Rules are ``allow`` or ``block`` with a host and a
path prefix; a rule fits its host and all subdomains, the longest wins (of
equally long ones the first listed).  URLs that a rule fits are the labelled
ones from which the tree learns.

Tree: per host and level by level, a path's segments are generalised by shape
(numbers and hex runs become wildcards); where a node, itself named by the
generalised segments above it, has many children for the distinct paths below
it, its children become one wildcard.  Below a node with a single path nothing
branches, and the rest is taken by shape.  There is no limit of depth.

Merging starts at the leaves: siblings are ordered by their share of blocked
URLs, and neighbours whose shares don't differ significantly (two-proportion
test) become one branch.  Where all siblings become one, it takes its parent's
place among that one's siblings, until nothing merges any more.  A branch without
labels counts what its labelled siblings count together.  A template is rejected
if its branch's smoothed labelled purity of ``block`` reaches ``reject``; smoothing
is towards the same branch of other hosts, and that towards all labelled URLs.

Joins that look up a node, template or path have the hot keys in a broadcast
table of at most ``_join.HOT`` rows; no other key then has more than 1 / HOT of
the rows.  Tables that a count shows to be small lie in few partitions, so that
the passes over levels and branches move no rows.

Defined results: a null URL, or one without ``://``, has an empty host and path,
no rule, and the verdict of the template of those; repeated and null ids keep
their rows; of a path that several rows have, each row counts; without labelled URLs everything is allowed; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vexil.llm import _join
from vexil.llm._store import settle

# The rules of op1.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


lookup = functools.partial(_join.lookup, counted=True)


def host_and_path(url: Column) -> tuple[Column, Column]:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    pattern = r"^([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(rest, pattern, 1), upper, upper.lower())
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, pattern, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        at, _, tail = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + tail)
        best = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def _shape(segment: Column) -> Column:
    low = F.lower(segment)
    return F.when(low.rlike("^[0-9a-f-]{16,}$"), F.lit("<hex>")).otherwise(F.regexp_replace(low, "[0-9]+", "<num>"))


def _templates(known: DataFrame, children: int, spread: float) -> DataFrame:
    """(host, path, n, label, template) of distinct paths (host, path, n, label, shapes)."""
    kept = ["host", "path", "n", "label"]
    ready = [known.where(F.size("shapes") == 0).select(*kept, F.lit("").alias("template"))]
    now, level = known.where(F.size("shapes") > 0).withColumn("prefix", F.lit("")), 0
    while True:
        segment = F.get("shapes", F.lit(level))
        kinds = now.groupBy("host", "prefix", segment.alias("segment")).agg(F.count(F.lit(1)).alias("paths"))
        nodes = kinds.groupBy("host", "prefix").agg(F.count(F.lit(1)).alias("k"), F.sum("paths").alias("paths"))
        nodes = settle(nodes.select("host", "prefix", ((F.col("k") >= children) & (F.col("k") >= spread * F.col("paths"))).alias("varies"), "paths"))
        join = lambda *parts: F.concat_ws("/", F.when(F.length("prefix") > 0, F.col("prefix")), *parts)
        here = lookup(now, nodes, ["host", "prefix"], "paths")
        alone, step = F.col("paths") == 1, F.when(F.col("varies"), F.lit("*")).otherwise(segment)
        rest = join(F.array_join(F.slice("shapes", level + 1, F.greatest(F.size("shapes") - level, F.lit(1))), "/"))
        here = settle(here.select(*kept, "shapes", F.when(alone, rest).otherwise(join(step)).alias("prefix"), (alone | (F.size("shapes") <= level + 1)).alias("done")))
        ready.append(here.where("done").select(*kept, F.col("prefix").alias("template")))
        now, level = here.where("not done").drop("done"), level + 1
        if now.isEmpty():
            break
    return functools.reduce(DataFrame.unionByName, ready)


def _grouped(units: DataFrame) -> DataFrame:
    """Units with g_bad and g_seen, what their group of similar siblings counts, and how many groups (g) and units (m) their parent has."""
    # siblings with the same counts are alike without a test; a parent has far fewer such classes than labelled URLs
    classes = units.groupBy("host", "up", "bad", "seen").agg(F.count(F.lit(1)).alias("m")).withColumn("labelled", F.col("seen") > 0)
    share = F.col("bad") / F.greatest(F.col("seen"), F.lit(1))
    order = Window.partitionBy("host", "up", "labelled").orderBy(share, "seen", "bad")
    last = lambda c: F.lag(c).over(order)
    pooled = (F.col("bad") + last("bad")) / (F.col("seen") + last("seen"))
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("seen") + 1 / last("seen")))
    differs = F.abs(share - last("bad") / last("seen")) > F.lit(1.96) * error
    classes = classes.withColumn("differs", F.when(F.col("labelled"), F.coalesce(differs, F.lit(False)).cast("int")))
    classes = classes.withColumn("part", F.sum("differs").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    family = Window.partitionBy("host", "up")
    alike = Window.partitionBy("host", "up", "labelled", "part")
    total = lambda c: F.sum(F.col(c) * F.col("m"))
    both = settle(classes.select(
        "host", "up", "bad", "seen", "m", F.sum("m").over(family).alias("units"), (F.coalesce(F.max("part").over(family), F.lit(-1)) + 1).alias("groups"),
        *(F.when(F.col("labelled"), total(c).over(alike)).otherwise(total(c).over(family)).alias(f"g_{c}") for c in ("bad", "seen")),
    ))
    return lookup(units, both, ["host", "up", "bad", "seen"], "m").drop("m")


def _branches(tally: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, template, node, hits) and (host, node, bad, seen, n, g_bad, g_seen): each template's branch, and what it counts."""
    above = lambda c: F.when(F.length(c) == 0, F.lit(None)).otherwise(F.regexp_replace(c, "/?[^/]*$", ""))
    node = F.col("template")
    units = tally.select("host", node.alias("node"), F.coalesce(above(node), F.lit("<none>")).alias("up"), "bad", "seen", "n")
    place = tally.select("host", "template", F.col("template").alias("node"), F.col("n").alias("hits"))
    while True:
        units = settle(_grouped(units))
        merged = (F.col("units") > 1) & (F.col("groups") <= 1) & (F.col("up") != "<none>")
        if units.where(merged).isEmpty():
            return place, units
        name = F.when(merged, F.concat("up", F.lit("/**"))).otherwise(F.col("node"))
        to = units.where(merged).select("host", "node", name.alias("to"), "n")
        place = lookup(place, to, ["host", "node"], "n").select("host", "template", F.coalesce("to", "node").alias("node"), "hits")
        up = F.when(merged, F.coalesce(above(F.col("up")), F.lit("<none>"))).otherwise(F.col("up"))
        place = settle(place)
        units = settle(units.select("host", name.alias("node"), up.alias("up"), "bad", "seen", "n").groupBy("host", "node", "up").agg(*(F.sum(c).alias(c) for c in ("bad", "seen", "n"))))


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    children: int = 12,
    spread: float = 0.2,
    strength: float = 5.0,
    reject: float = 0.6,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, branch, purity) of every row; see the module's text."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    ruled = rule_of(F.col("host"), F.col("path"), rules)
    known = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")).withColumn("label", ruled["verdict"])
    shapes = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), _shape)
    known = _templates(settle(known.withColumn("shapes", shapes)), children, spread)
    tally = settle(known.groupBy("host", "template").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("label") == "block", F.col("n")).otherwise(0)).alias("bad"),
        F.sum(F.when(F.col("label").isNotNull(), F.col("n")).otherwise(0)).alias("seen"),
    ))
    place, units = _branches(tally)
    over = units.groupBy("node").agg(F.sum("bad").alias("t_bad"), F.sum("seen").alias("t_seen"), F.sum("n").alias("t_n"))
    every = tally.agg(((F.coalesce(F.sum("bad"), F.lit(0))) / F.greatest(F.coalesce(F.sum("seen"), F.lit(0)), F.lit(1))).alias("share"))
    judged = lookup(units, settle(over), ["node"], "t_n").crossJoin(F.broadcast(every))  # one row
    # what other hosts tell about the branch, itself smoothed
    prior = (F.col("t_bad") - F.col("bad") + F.lit(strength) * F.col("share")) / (F.col("t_seen") - F.col("seen") + F.lit(strength))
    purity = (F.col("g_bad") + F.lit(strength) * prior) / (F.col("g_seen") + F.lit(strength))
    verdicts = settle(judged.select("host", "node", purity.alias("purity"), "n"))
    weighed = settle(lookup(place, verdicts, ["host", "node"], "n").select("host", "template", F.col("node").alias("branch"), "purity", F.col("hits").alias("n")))
    by_path = settle(lookup(known.select("host", "path", "template", F.col("n").alias("hits")), weighed, ["host", "template"], "n").drop("n"))
    answer = lookup(rows, by_path, ["host", "path"], "hits").withColumn("ruled", ruled)
    return answer.select(
        "page_id", "host", "path", F.col("ruled.rule").alias("rule"),
        F.coalesce(F.col("ruled.verdict"), F.when(F.col("purity") >= reject, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "template", "branch", "purity",
    )


def op1_url_filters(spark, sf_dir: str) -> DataFrame:
    """Judge every page's URL."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)
