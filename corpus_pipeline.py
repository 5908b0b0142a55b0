"""A corpus pipeline of five stages over ``documents``: each is written as Parquet and read again.

quality (rejected documents go), near duplicates (one document of each group stays),
benchmark decontamination (contaminated documents go), secrets (redacted), SentencePiece ids and their round trip.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohabit.llm import decontaminate, jaccard, quality, secrets, sentencepiece
from cohabit.llm.common import free_name, scope, table, written

#: Documents of a lower score are rejected.
LEAST_QUALITY = 0.3
#: Units whose ids are broadcast in the last stage: fewer than the operator's own number, since five stages share the driver.
COMMON_UNITS = 300_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the factorisation machine scores below LEAST_QUALITY; a fifth of the labels is held out, so its rejections can be measured."""
    known = docs.select("doc_id", "text", "n_chars")
    model = quality.fit(known, table(spark, sf_dir, "labels").where(~quality.held_out()), metadata=("n_chars",))
    score = free_name(docs, "_score")
    return quality.score(docs, model, metadata=("n_chars",), to=score).where(F.col(score) >= LEAST_QUALITY).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component (shingles of five words, Jaccard 0.8)."""
    return jaccard.keep_one(docs, n=5, num=80, den=100).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth of the words lies in benchmark windows."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), action="document").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces credentials; n_chars follows where the text changed."""
    before = free_name(docs, "_before")
    clean = secrets.redact(docs.withColumn(before, F.col("text")), secrets.fit(docs))
    same = F.col("text").eqNullSafe(F.col(before))
    return clean.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds piece_ids, n_pieces and round_trip: whether the ids decode to the text."""
    back = free_name(docs, "_decoded")
    coded = sentencepiece.encode(docs, sentencepiece.load(), decoded=back, common=COMMON_UNITS)
    return coded.withColumns({"n_pieces": F.size("piece_ids").cast("long"), "round_trip": F.col(back).eqNullSafe(F.col("text"))}).drop(back)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("sentencepiece", encode_pieces),
]

#: The classifier, the inferred automata and BPE merges are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scope() as keep:  # what the stage itself wrote goes once its rows lie apart, and so do the rows before it
            docs = keep(written(stage(spark, docs, sf_dir), name, docs))
    return docs
