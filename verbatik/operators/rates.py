"""Rates of runs: characters, words and seconds of sound a second."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_rates(rows: DataFrame, text: str, wall: Column) -> DataFrame:
    """rows without text and with chars, words (runs of other than white space), chars_per_second and words_per_second.

    A null wall, or one of 0, gives null rates; a null text has null counts.
    """
    chars, words = F.length(text).cast("long"), F.regexp_count(text, F.lit(r"(?U)\S+")).cast("long")
    seconds = F.when(wall != 0, wall)
    kept = [c for c in rows.columns if c != text]
    return rows.select(*kept, chars.alias("chars"), words.alias("words"), (chars / seconds).alias("chars_per_second"), (words / seconds).alias("words_per_second"))


def sound_rates(rows: DataFrame, samples: str, rate: int, wall: Column) -> DataFrame:
    """rows without the samples and with seconds of sound and their ratio to the wall time; null samples have none."""
    seconds = F.coalesce(F.array_size(samples), F.lit(0)) / F.lit(rate)
    kept = [c for c in rows.columns if c != samples]
    return rows.select(*kept, seconds.alias("seconds"), (seconds / F.when(wall != 0, wall)).alias("real_time_factor"))
