"""Small dimensions: models with their back ends, and voices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Models of this engine's own, as examples: id, repository, back end, default voice.
MODELS = [("small", "models/small", "local", "af_heart"), ("large", "models/large", "remote", None), ("mini", "models/mini", "local", None)]


def models(spark: SparkSession, rows=MODELS) -> DataFrame:
    return spark.createDataFrame(list(rows), "id string, repository string, backend string, default_voice string")


def find(known: DataFrame, model: str) -> DataFrame:
    """The first row of that id, or none."""
    return known.where(F.col("id") == model).limit(1)


def dispatched(known: DataFrame, runners: dict[str, str], voice: str) -> DataFrame:
    """known with `runner`, by back end, and `voice`, the model's default or the one given; an unknown back end is an error."""
    runner = F.try_element_at(F.create_map(*(F.lit(x) for kv in runners.items() for x in kv)), F.col("backend"))
    unknown = F.raise_error(F.concat(F.lit("no runner for "), "backend")).cast("string")
    return known.withColumns({"runner": F.coalesce(runner, unknown), "voice": F.coalesce("default_voice", F.lit(voice))})


def voices(spark: SparkSession, names: list[str], default: str) -> DataFrame:
    """(voice, label): names in order, the default marked."""
    rows = spark.createDataFrame([(n,) for n in names], "voice string")
    return rows.withColumn("label", voice_label(F.col("voice"), default))


def voice_label(voice: Column, default: str) -> Column:
    return F.when(voice == default, F.concat(voice, F.lit(" (default)"))).otherwise(voice)
