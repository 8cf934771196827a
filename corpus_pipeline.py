"""A corpus in five stages: toxic documents out, near copies out, leaked benchmark items out,
secrets out of the texts, then ids for a model.

Each stage is a function of (spark, docs, sf_dir) that works on all rows of its input. Its
result is written as Parquet to the folder that all executors share and read again as the
next one's input. All stages but the last return the columns of ``documents``.

A null text counts as an empty one and stays null until the last stage; a null id is an id
of its own row; repeated rows are judged alike, and the near-duplicate stage keeps one of
them; an empty table passes as an empty table. Columns beside those of ``documents`` are
carried along; names that begin with an underscore are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vesselflow.llm import benchmark_leaks, secret_formats, sentence_pieces, simhash, toxicity
from vesselflow.llm.common import stored_at, table
from vesselflow.session import fresh_dir
from vesselflow.sources.storage import remove_tree

REPLACEMENT = "[secret]"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learned from the labelled ones among them, does not reject."""
    model = toxicity.learn_toxicity(docs, table(spark, sf_dir, "labels"))
    return model.score(docs).where(F.col("_score") < toxicity.CUT).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash links."""
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an item of the benchmark."""
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    leaks = benchmark_leaks.find_leaks(keyed, table(spark, sf_dir, "benchmark"), key="_key")
    return keyed.join(leaks.select("_key").distinct(), "_key", "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced; ``n_chars`` is the length of the text returned."""
    model = secret_formats.learn_secrets(docs)
    masked = secret_formats.scan_secrets(docs, model, replacement=REPLACEMENT)
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as ids, and whether they decode to its text."""
    return sentence_pieces.encoded_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("secret_scans", mask_secrets),
    ("sentencepiece", encode),
]
#: The stages learn models, so SQL cannot express them; tests hold them against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage has read is removed from the shared folder when its result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_dir(spark, f"pipeline-{name}")
        docs = stored_at(stage(spark, docs, sf_dir), path)
        if before:
            remove_tree(spark, before)
        before = path
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
