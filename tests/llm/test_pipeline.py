"""The pipeline's stages, each against what the rows should be, on the smallest tables."""

import re
import zlib

import numpy as np


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages(spark, sf):
    import public_tokenizers
    import xxhash
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    import corpus_pipeline as cp
    from vexil.llm.langid import fit_languages, identify_language
    from vexil.llm.quality import fit_quality, score_quality
    from vexil.llm.secrets import scan_secrets

    stage = dict(cp.STAGES)
    source = spark.read.parquet(f"{sf}/documents.parquet").cache()
    # language and quality: what the operators' own scores say
    named = {r["doc_id"] for r in identify_language(source, fit_languages(source, F.lit(True))).where("lang_pred <> 'und'").collect()}
    known = stage["language"](spark, source, sf).cache()
    kept = {r["doc_id"] for r in known.collect()}
    assert kept <= named and len(kept) >= 0.95 * len(named)
    model = fit_quality(known, spark.read.parquet(f"{sf}/labels.parquet"), F.lit(True))
    fine = {r["doc_id"] for r in score_quality(known, model).where("score >= 0.5").collect()}
    good = stage["quality"](spark, known, sf).cache()
    assert rows(good) == rows(known.where(F.col("doc_id").isin(sorted(fine))))

    # near_dedup: all pairs of fingerprints, in plain Python; over all documents, so that there are copies
    def fingerprint(t):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        h = [xxhash.xxh64(" ".join(w[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 3))] if w else []
        return int(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)))

    prints = {r["doc_id"]: fingerprint(r["text"]) for r in source.collect()}
    root = {i: i for i in prints}
    for a in sorted(prints):
        for b in sorted(prints):
            if a < b and root[a] != root[b] and (prints[a] ^ prints[b]).bit_count() <= 4:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    single = sorted(set(root.values()))
    assert len(single) < len(prints)
    assert rows(stage["near_dedup"](spark, source, sf)) == rows(source.where(F.col("doc_id").isin(single)))

    # secrets: the scan's spans, put in place in plain Python
    want = []
    for r in scan_secrets(source).join(source.drop("text"), "doc_id").collect():
        t, out, at = r["text"], "", 0
        for a, b in sorted((s["start"], s["end"]) for s in [*r["base"], *r["found"]]):
            if a >= at:
                out += t[at:a] + "[SECRET]"
            at = max(at, b)
        want.append((r["doc_id"], None if t is None else out + t[at:], r["lang"], r["source"], len(out + t[at:])))
    masked = stage["secrets"](spark, source, sf).cache()
    got = rows(masked.select("doc_id", "text", "lang", "source", "n_chars"))
    assert got == sorted(want, key=repr) and any("[SECRET]" in (t or "") for _, t, *_ in got)

    # packing: every token of every text, once, in sequences without gaps
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, at = [], {}
    for r in masked.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        want += [(r["doc_id"], i, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for i, k in enumerate(range(0, len(ids), 2048))]
    packed = stage["packing"](spark, masked, sf).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == sorted(want)
    for r in packed:
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in at.values():
        ends = np.cumsum([0, *(n for _, n in sorted(places))]).tolist()
        assert [o for o, _ in sorted(places)] == ends[:-1] and ends[-1] <= 2048
