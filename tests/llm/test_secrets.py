"""The secret scan against plain Python, in full: every span, and the masked texts."""

import math
import random
import re
import time

from pyspark.sql import functions as F

from vexil.llm.secrets import ACCESS, ALLOWED, ALPHABET, ASSIGN, CANDIDATE, CLASSES, HEX, KINDS, WINDOW, mask_secrets, scan_secrets


def entropy(token):
    windows = (token[i : i + WINDOW] for i in range(len(token) - WINDOW + 1))
    return max(math.log2(WINDOW) - sum(w.count(c) * math.log2(w.count(c)) for c in set(w)) / WINDOW for w in windows)


def by_hand(text):
    text = text or ""
    base = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text) if len(m[2]) >= 12]
    base += [(m.start(), k, m.end()) for k, p in ((1, ACCESS), (2, HEX)) for m in re.finditer(p, text)]
    found = []
    for m in re.finditer(CANDIDATE, text):
        if any(s < m.end() and m.start() < e for s, _, e in base) or any(re.search(p, m[0]) for p in ALLOWED):
            continue
        if entropy(m[0]) >= next(bits for p, bits in CLASSES if re.search(p, m[0])) - 1e-9:
            found.append((m.start(), 3, m.end()))
    out, at = [], 0
    for s, _, e in sorted(base + found):
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return sorted(base), found, "".join(out) + text[at:]


def some_text(rng, n):
    out = []
    for _ in range(n):
        kind = rng.randrange(7)
        token = "".join(rng.choices(ALPHABET[: rng.choice((16, 36, 62, 66))], k=rng.randrange(1, 60)))
        out.append(
            [token, f"token={token}", f'"api_key" : "{token}"', f"{rng.getrandbits(90):x}", "AKIA" + token.upper(), rng.choice(("é", "Übergrößenträger", "😀", "word")), "aB1" * 9][kind]
        )
    return rng.choice((" ", "\n", ", ")).join(out)


def test_spans_and_masks_in_full(spark):
    rng = random.Random(7)
    texts = [None, "", *(some_text(rng, n) for n in (1, 2, 3, 5, 8, 40, 63, 64, 65, 129, 300) for _ in range(4))]
    rows = [(i, t, "base") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + [(3, texts[9], "x"), (None, texts[12], "y")], "doc_id long, text string, found string")
    texts = dict(enumerate(texts))
    total = [0] * len(KINDS)
    for r in scan_secrets(df).collect():
        if r.doc_id is None or r.text == texts[9] and r.doc_id == 3:
            continue
        base, found, _ = by_hand(texts[r.doc_id])
        assert ([tuple(s) for s in r.base], [tuple(s) for s in r.found]) == (base, found)
        for s in base + found:
            total[s[1]] += 1
    assert min(total) > 5
    masked = mask_secrets(df)
    assert masked.columns == df.columns
    for r in masked.collect():
        text = texts[12] if r.doc_id is None else texts[9] if r.found == "x" else texts[r.doc_id]
        assert r.text == (None if text is None else by_hand(text)[2])


def test_time_is_in_proportion(spark):
    rng = random.Random(1)
    took = []
    for n in (4000, 4000, 16000):
        text = " ".join(f"token={rng.getrandbits(60):x} " + "".join(rng.choices(ALPHABET, k=24)) for _ in range(n // 2))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        assert mask_secrets(df).select(F.length("text")).first()[0] < len(text)
        took.append(time.time() - began)
    assert took[2] < 8 * took[1]
