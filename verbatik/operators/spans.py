"""Spans (doc_id, start, stop): where patterns match, joins by overlap, and rewriting by spans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Code points of a text that spans are put together by before they are compared.
BUCKET = 1024


def matches(docs: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """(the other columns, start, stop, source) of every match of the pattern in the text; offsets in code points, no shuffle."""
    return matches_of(docs, [pattern], text).drop("rule")


def matches_of(docs: DataFrame, patterns: list[str], text: str = "text") -> DataFrame:
    """(the other columns, rule, start, stop, source) of every match of each pattern; rule is the pattern's place. One scan."""
    keep = [c for c in docs.columns if c != text]

    def found(i: int, pattern: str) -> Column:
        taken = F.struct(F.lit(i).alias("rule"), F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
        return F.when(F.col(text).rlike(pattern), taken)

    each = F.explode(F.array_compact(F.array(*(found(i, p) for i, p in enumerate(patterns)))))
    rows = docs.select(*keep, each.alias("__m")).select(*keep, "__m.rule", F.col("__m.pieces").alias("__pieces"), F.col("__m.found").alias("__found"))
    schema = StructType([*rows.drop("__pieces", "__found").schema.fields, *StructType.fromDDL("start long, stop long, source string").fields])

    def run(batches):
        for batch in batches:
            pieces, found = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            row = pc.list_parent_indices(found).to_numpy(zero_copy_only=False)
            source = found.flatten()
            # there is one piece more than there are matches
            gaps = pc.utf8_length(pieces.flatten()).to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.zeros(len(gaps), np.int64)
            held = np.arange(len(source)) + row
            sizes[held] = pc.utf8_length(source).to_numpy(zero_copy_only=False)
            ends = np.cumsum(gaps + sizes)
            counts = pc.list_value_length(pieces).to_numpy(zero_copy_only=False)
            firsts = np.cumsum(counts) - counts
            base = np.where(firsts > 0, ends[np.maximum(firsts - 1, 0)], 0) if len(ends) else firsts
            stop = ends[held] - base[row]
            kept = [batch.column(i).take(pa.array(row)) for i in range(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(stop - sizes[held]), pa.array(stop), source], names=schema.names)

    return rows.mapInArrow(run, schema)


def _buckets(rows: DataFrame) -> DataFrame:
    """rows once for every BUCKET code points that they reach into; a span of no width has none."""
    last = F.greatest(F.col("stop") - 1, F.col("start"))
    return rows.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.floor(last / BUCKET))))


def _overlap() -> Column:
    near = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.__bucket") == F.col("b.__bucket"))
    return near & (F.col("a.start") < F.col("b.stop")) & (F.col("b.start") < F.col("a.stop"))


def covered(candidates: DataFrame, claimed: DataFrame) -> DataFrame:
    """Candidates that overlap a claimed span of their document. Only spans of one part of a text are compared."""
    names = candidates.columns
    hit = _buckets(candidates).alias("a").join(_buckets(claimed.select("doc_id", "start", "stop")).alias("b"), _overlap(), "left_semi")
    return candidates.join(hit.select("doc_id", "start", "stop").distinct(), ["doc_id", "start", "stop"], "left_semi").select(names)


def unclaimed(candidates: DataFrame, claimed: DataFrame) -> DataFrame:
    """Candidates that overlap no claimed span of their document."""
    hit = covered(candidates, claimed).select("doc_id", "start", "stop").distinct()
    return candidates.join(hit, ["doc_id", "start", "stop"], "left_anti").select(candidates.columns)


def spliced(text: Column, edits: Column) -> Column:
    """text with every edit (struct start, stop, replacement; they do not overlap) written over its span, last ones first."""
    ordered = F.array_sort(edits)
    stop = lambda i: F.coalesce(F.get(ordered["stop"], i - 1), F.lit(0))
    piece = F.transform(ordered, lambda e, i: F.concat(F.substr(text, (stop(i) + 1).cast("int"), (e["start"] - stop(i)).cast("int")), e["replacement"]))
    tail = F.substr(text, (F.coalesce(F.element_at(ordered["stop"], -1), F.lit(0)) + 1).cast("int"))
    return F.when(F.coalesce(F.size(ordered), F.lit(0)) <= 0, text).otherwise(F.concat(F.array_join(piece, ""), tail))
