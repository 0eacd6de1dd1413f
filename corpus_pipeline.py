"""A corpus pipeline: language identification, near-duplicate removal, mixing and encoding, each stage over all that was kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatik.llm import bpe, dedup, language, mixing
from verbatik.llm.common import discard, give_back, materialize, outlasting, scratch_of


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is determined; those without a letter, or without text, go."""
    give_back(spark)
    model = language.train(docs, "text", "lang")
    return language.predict(docs, model).where(F.col("lang_pred") != language.UNDETERMINED).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates: of its least doc_id (null last), then of its least text hash.

    Rows without an id are documents like others. Repeated rows are copies of each other.
    """
    give_back(spark)
    found = dedup.classes(docs, detail=True)
    kept = found.where(F.col("leads")).groupBy("id", "text_hash").agg(F.count("*").alias("times"))
    kept = materialize(kept, "pipeline-kept")
    give_back(spark)
    rows = docs.withColumn("__hash", F.xxhash64("text"))
    once, more = kept.where("times = 1"), kept.where("times > 1")
    same = lambda own: F.col("doc_id").eqNullSafe(own["id"]) & (F.col("__hash") == own["text_hash"])
    out = rows.join(once, same(once), "left_semi").select(docs.columns)
    repeated = rows.join(more, same(more), "left_semi").dropDuplicates(["doc_id", "__hash"]).select(docs.columns)
    return out.unionByName(repeated)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it; rows are told apart by two hashes of all their columns.

    Rows that are equal in every column are taken as often as the mix takes them together.
    """
    give_back(spark)
    names = docs.columns
    nulls = F.array(*(F.col(c).isNull() for c in names))  # a hash passes nulls over
    keyed = docs.withColumns({"__k1": F.xxhash64(nulls, *names), "__k2": F.xxhash64(F.lit(1), nulls, *reversed(names))})
    mixed = mixing.mix(keyed, carry=("doc_id", "__k1", "__k2"))
    taken = mixed.groupBy("__k1", "__k2").agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows")).where("__copies > 0")
    taken = materialize(taken, "pipeline-taken")
    once = keyed.join(taken.where("__rows = 1"), ["__k1", "__k2"])
    equal = keyed.join(taken.where("__rows > 1"), ["__k1", "__k2"]).dropDuplicates(["__k1", "__k2"])
    rows = once.unionByName(equal)
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(names)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the text that they decode to."""
    give_back(spark)
    return bpe.encode(docs).select("doc_id", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("language", identify_language), ("near_duplicates", drop_near_duplicates), ("mixing", mix_sources), ("encoding", encode)]

#: The stages hash, learn and search; no SQL states their rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote for itself is deleted when the next one's docs are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch_of():
            found = stage(spark, docs, sf_dir)
            with outlasting():
                after = materialize(found, f"pipeline-{name}")
        discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
