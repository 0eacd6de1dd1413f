"""Sinks: where output goes, table rows in Markdown, and samples as WAV files' bytes."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def output_plan(form: Column, requested: Column, encoder: Column) -> Column:
    """struct(path, m4a) from the format (auto, wav or m4a), the requested path or null, and whether there is an encoder.

    A path's ending .wav or .m4a decides; one that contradicts the format is an error.
    """
    ending = F.regexp_extract(F.lower(requested), r"\.(wav|m4a)\z", 1)
    named = F.when(ending != "", ending)
    clash = named.isNotNull() & (form != "auto") & (form != named)
    m4a = F.when(clash, F.raise_error(F.concat(F.lit("format "), form, F.lit(" contradicts ."), named)).cast("boolean")).when(named.isNotNull(), named == "m4a").when(form == "auto", encoder).otherwise(form == "m4a")
    return F.struct(F.coalesce(requested, F.when(m4a, F.lit("out.m4a")).otherwise(F.lit("out.wav"))).alias("path"), m4a.alias("m4a"))


def markdown_row(numbers: list[tuple[Column, int]], before: list[Column], note: Column) -> Column:
    """A table row: the cells before, numbers with so many digits (null: a dash), and a note with bars and line ends escaped."""
    own = [F.coalesce(F.format_string(f"%.{digits}f", c.cast("double")), F.lit("—")) if digits >= 0 else c for c, digits in numbers]
    shown = [F.when(c.isNull(), F.lit("—")).otherwise(cell) for (c, _), cell in zip(numbers, own, strict=True)]
    text = F.replace(F.translate(F.coalesce(note, F.lit("")), "\n\r", "  "), F.lit("|"), F.lit("\\|"))
    return F.concat(F.lit("| "), F.concat_ws(" | ", *before, *shown, text), F.lit(" |"))


def wav_bytes(samples: Column, rate: int) -> Column:
    """A mono WAV file of 16-bit samples; values beyond -1 and 1 are clipped, null and NaN samples are silence."""

    @F.pandas_udf("binary")
    def run(rows: pd.Series) -> pd.Series:
        def one(values) -> bytes | None:
            if values is None:
                return None
            x = np.nan_to_num(np.asarray(values, np.float32), nan=0.0, posinf=1.0, neginf=-1.0)
            body = (np.clip(x, -1, 1) * 32767).astype("<i2").tobytes()
            head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", len(body))
            return head + body

        return rows.map(one)

    return run(samples)


def write_wavs(rows, name: str, samples: str, rate: int, path: str) -> None:
    """One WAV file a row, (name, bytes), in one Parquet table; the commit protocol makes it whole or absent."""
    rows.select(name, wav_bytes(F.col(samples), rate).alias("wav")).write.mode("overwrite").parquet(path)


def write_whole(rows, path: str) -> None:
    """Replace the table at path: readers see the old one or the new one, for files are committed when all are written."""
    rows.write.mode("overwrite").parquet(path)


def markdown_table(header: list[str], cells: Column, rows, order: list[str]):
    """(line) of a Markdown table with a header, in order; rows are few, as a summary's are."""
    spark = rows.sparkSession
    top = spark.createDataFrame([(0, "| " + " | ".join(header) + " |"), (1, "|" + "---|" * len(header))], "at long, line string")
    ranked = rows.select(cells.alias("line"), *order).orderBy(*order).select((F.monotonically_increasing_id() + 2).alias("at"), "line")
    return top.unionByName(ranked).orderBy("at").select("line")


def trace_lines(reasons, n_words: Column):
    """(reason, line): a line for each reason and label of resolve.reasons(), by reason, then by label."""
    shown = F.format_string("%s %s: %d of %d", "reason", F.coalesce("label", F.lit("—")), "n", n_words)
    return reasons.select("reason", F.coalesce("label", F.lit("—")).alias("label"), shown.alias("line")).orderBy("reason", "label")
