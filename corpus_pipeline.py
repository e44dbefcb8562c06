"""A corpus pipeline of five stages, each by one operator of ``vexil.llm``.

1. Language identification: documents in no known language go.
2. Quality classifier: documents scored below 0.5 go.
3. SimHash near-dedup: of each group of near copies the smallest id stays.
4. Secret scan: secrets are masked in the texts.
5. Best-fit packing: the documents become token sequences.

Every stage takes (spark, docs, sf_dir) and works on all that the one before
kept; all but the last return the columns of ``documents``.  An empty table gives
an empty table.  Null and repeated ids keep their rows, but where a stage's text
says otherwise; columns beyond those of ``documents`` pass through all but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexil.llm._store import stored
from vexil.llm.langid import fit_languages, keep_identified
from vexil.llm.packing import pack_documents
from vexil.llm.quality import fit_quality, keep_good
from vexil.llm.secrets import mask_secrets
from vexil.llm.simhash import keep_representatives


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what is in one of the languages that the documents' own ``lang`` names.

    Meant to go: null texts, texts without a letter, and texts of no learned language; the given tables hold next to none.
    """
    return keep_identified(docs, fit_languages(docs, F.lit(True)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what a rule ensemble, learned from ``labels``, finds good: rows scored 0.5 or more, null and empty texts like any other."""
    return keep_good(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of fingerprints within four bits: the smallest id's, rows without an id last.

    Rows with one id and different texts are different documents; null and empty texts are one group.
    """
    return keep_representatives(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask every span that the scan finds; ``n_chars`` follows the text, a null text stays null and counts 0."""
    masked = mask_secrets(docs)
    kind = docs.schema["n_chars"].dataType
    return masked.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(kind))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2,048 tokens of the public word BPE; a null text is packed as an empty one."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("packing", packing)]

#: SQL can't express learned stages; tests hold near_dedup, secrets (given the scan's spans) and packing against plain Python,
#: language and quality against what their operators say of each row.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
