"""From raw documents to packed sequences: five stages over the whole corpus.

Each stage takes all rows that the stage before kept and, but for the last, returns the columns
of ``documents``: documents that the quality rules reject go; one document of each group of near
duplicates stays; live-looking secrets are redacted in the texts; the mix repeats or leaves out
documents so that sources come near their target weights; the last stage packs.

Defined cases, of every stage: texts are taken whole. Null and empty texts have no words, so the
quality rules reject them; the near-duplicate stage keeps one of each doc_id and all without one,
and the others keep them all. Rows without doc_id are rows like others. Repeated rows are measured
and redacted each, are one of one group of duplicates (equal rows stay once), are mixed and
packed each. Of a group of duplicates that with the least doc_id stays, one without doc_id last, ties
by the hash of the text. A null source is a source, and an owner, of its own. Columns may have
any other names and pass through. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import jaccard, mixing, packing, quality, secrets
from skein.llm.registry import tokenizer_file
from skein.session import materialize, ship
from skein.sources.tables import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.keep_clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return jaccard.representatives(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.expand(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs, tokenizer_file())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", source_mix),
    ("packing", pack),
]

#: Shingle components, hashing and the tokenizer are beyond SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
