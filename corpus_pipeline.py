"""Training-corpus pipeline: documents in, packed training sequences out.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which ``run`` writes as Parquet in the shared folder and rereads as the next docs.
All stages but the last return the columns of documents. Each works on all rows its
predecessor kept; empty tables pass through, extra columns are kept until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentally.llm import langid, packing, quality, secret_scan, simhash
from tokentally.llm.common import read_table, shared_table

SECRET_MARK = "[SECRET]"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that it rejects go (no text, no letters, or two languages as likely)."""
    model = langid.fit_languages(docs)
    named = langid.predict_languages(docs.withColumnsRenamed(_aside(docs, langid.COLUMNS)), model)
    return named.where(~F.col("lang_rejected")).drop(*langid.COLUMNS).withColumnsRenamed(_back(docs, langid.COLUMNS)).select(*docs.columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that it rejects (predicted 0) go."""
    model = quality.fit_quality(docs, read_table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs.withColumnsRenamed(_aside(docs, quality.COLUMNS)), model)
    return scored.where("quality_predicted = 1").drop(*quality.COLUMNS).withColumnsRenamed(_back(docs, quality.COLUMNS)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: one document of each SimHash group stays."""
    return simhash.keep_one_per_group(docs, shingle=simhash.SHINGLE, radius=simhash.RADIUS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: every span found is replaced by ``SECRET_MARK``; n_chars follows a changed text."""
    model = secret_scan.fit_secrets(docs)
    scanned = secret_scan.scan_secrets(docs.withColumnsRenamed(_aside(docs, ("secret_spans",))), model, redact=SECRET_MARK)
    if "n_chars" in docs.columns:
        changed = F.size("secret_spans") > 0
        scanned = scanned.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return scanned.drop("secret_spans").withColumnsRenamed(_back(docs, ("secret_spans",))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: token pieces (with their ids) placed in training sequences."""
    return packing.pack(docs)


def _aside(docs: DataFrame, names) -> dict[str, str]:
    """Columns of documents that an operator would replace, under names that no column has."""
    free = "_" * max([1, *map(len, docs.columns)])
    return {n: free + n for n in names if n in docs.columns}


def _back(docs: DataFrame, names) -> dict[str, str]:
    return {aside: n for n, aside in _aside(docs, names).items()}


STAGES = [("language_id", language_id), ("quality_classifier", quality_filter), ("simhash_near_dedup", near_dedup),
          ("secret_scan", secrets), ("best_fit_packing", pack)]

ORACLE_SQL = None  # the models are not SQL; tests/llm checks the pipeline stage by stage


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
