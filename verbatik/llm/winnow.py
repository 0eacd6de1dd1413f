"""Document fingerprints by winnowing.

Every k code points are hashed; of each window of w such hashes the least is selected, and of equal ones the rightmost.
Any match of w + k - 1 code points between two texts is sure to share a selected hash, and none shorter than k does.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatik.llm.common import fields, shuffle_partitions, table

#: k: code points in a gram; w: grams in a window. Matches of 15 code points are always found, so short texts have several hashes.
GRAM, WINDOW = 8, 8
#: Windows that are looked at together; bounds the memory that a very long text takes.
BLOCK = 1 << 18

_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_PLACE = np.uint64(20)
_BITS = np.uint64((1 << 20) - 1)


def _hashes(points: np.ndarray, k: int) -> np.ndarray:
    """A 44-bit hash of each k-gram, the polynomial in _BASE built by doubling."""
    out, width, power = points.astype(np.uint64) + np.uint64(1), 1, int(_BASE)
    while width < k:
        out = out[:-width] * np.uint64(power) + out[width:]
        power, width = power * power % (1 << 64), width * 2
    out = (out ^ (out >> np.uint64(32))) * _MIX
    return (out ^ (out >> np.uint64(29))) * _MIX >> _PLACE


def winnow(text: str, k: int = GRAM, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes uint64, positions int64) selected from the text, by position; k a power of two.

    A text shorter than k has one hash, of the whole of it, at 0; the empty text has none. With fewer than w grams all of
    them make one window.
    """
    if k & (k - 1):
        raise ValueError("k must be a power of two")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(points):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(points) < k:
        digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()
        return np.frombuffer(digest[:8], "<u8") >> _PLACE, np.zeros(1, np.int64)
    grams = len(points) - k + 1
    w = min(w, grams)
    found_hash, found_at = [], []
    for start in range(0, grams - w + 1, BLOCK):
        windows = min(BLOCK, grams - w + 1 - start)
        hashes = _hashes(points[start : start + windows + w + k - 2], k)
        keys = (hashes << _PLACE) | (_BITS - np.arange(len(hashes), dtype=np.uint64))
        width = 1
        while width * 2 <= w:
            keys = np.minimum(keys[:-width], keys[width:])
            width *= 2
        if width < w:
            keys = np.minimum(keys[: windows], keys[w - width : w - width + windows])
        keys = keys[:windows]
        keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
        found_hash.append(keys >> _PLACE)
        found_at.append((_BITS - (keys & _BITS)).astype(np.int64) + start)
    hashes, at = np.concatenate(found_hash), np.concatenate(found_at)
    new = np.concatenate(([True], at[1:] != at[:-1]))
    return hashes[new], at[new]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sorted sets of hashes; 1 for two empty ones."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def pack(distinct: np.ndarray) -> str:
    """A set of 44-bit hashes as text: base64 of six little-endian bytes for each, ascending."""
    return base64.b64encode(np.ascontiguousarray(distinct.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()).decode()


def fingerprints(docs: DataFrame, text: str = "text", k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """docs with `hashes` array<long> and `positions` array<long>, columns so named replaced; a null text is empty."""
    docs = docs.drop(*(c for c in docs.columns if c in ("hashes", "positions") and c != text))
    names, schema = docs.columns, fields(docs, "hashes array<bigint>, positions array<bigint>")

    def run(batches):
        for batch in batches:
            found = [winnow(t or "", k, w) for t in batch.column(text).to_pylist()]
            hashes = pa.array([h.astype(np.int64) for h, _ in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, hashes, pa.array([p for _, p in found], pa.list_(pa.int64()))], names=[*names, "hashes", "positions"])

    return docs.mapInArrow(run, schema)


def in_order(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """docs dealt into ranges of the key, each range sorted and followed by the row that comes after it.

    Adds __range and __after (true for that extra row; after the last range it is the first row of all). Ranges hold like
    numbers of rows and there are as many as shuffle partitions. A null key comes last; equal keys go by the other columns.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    cuts = docs.where(F.col(key).isNotNull()).agg(F.percentile_approx(key, [i / n for i in range(1, n)], 100 * n).alias("c"), F.min(key).alias("first")).first() if n > 1 else docs.agg(F.lit(None).alias("c"), F.min(key).alias("first")).first()
    edges = sorted({*(cuts["c"] or []), cuts["first"]} - {None})
    width = max(1, int(len(edges) ** 0.5))
    groups = [edges[i : i + width] for i in range(0, len(edges), width)]
    if not edges:
        at = F.lit(0)
        last = 0
        starts = F.lit(False)
        first = F.col(key).isNull()
    else:
        last = len(edges) - 1
        heads = F.array(*(F.lit(g[0]) for g in groups))
        coarse = F.greatest(F.lit(1), F.size(F.filter(heads, lambda c: c <= F.col(key))))
        fine = F.element_at(F.array(*(F.array(*(F.lit(x) for x in g)) for g in groups)), coarse)
        at = F.when(F.col(key).isNull(), F.lit(last)).otherwise((coarse - 1) * width + F.size(F.filter(fine, lambda c: c <= F.col(key))) - 1)
        starts = F.coalesce(F.element_at(fine, F.greatest(F.lit(1), F.size(F.filter(fine, lambda c: c <= F.col(key))))) == F.col(key), F.lit(False))
        first = F.coalesce(F.col(key) == F.lit(edges[0]), F.lit(False))
    rows = docs.select(*columns).withColumn("__range", at.cast("int"))
    after = F.when(first, F.lit(last)).when(starts, F.col("__range") - 1)
    marked = rows.withColumn("__to", F.explode(F.array_compact(F.array(F.struct(F.col("__range").alias("r"), F.lit(False).alias("after")), F.when(after.isNotNull(), F.struct(after.cast("int").alias("r"), F.lit(True).alias("after")))))))
    # ranges are dealt by a key whose hash is the range's own partition, so that no two of them share a task
    hashed = spark.range(64 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).collect()
    own = {r["p"]: r["id"] for r in hashed}
    deal = F.element_at(F.array(*(F.lit(own.get(i, i)).cast("long") for i in range(n))), F.col("__range") % n + 1)
    dealt = marked.select(*columns, F.col("__to.r").alias("__range"), F.col("__to.after").alias("__after")).repartition(n, deal)
    others = [c for c in columns if c != key]
    return dealt.sortWithinPartitions("__range", "__after", F.col(key).asc_nulls_last(), *others)


def edited_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness to it and to the next document's.

    The edited text has its last floor(n/4) code points replaced by as many first ones of the next document's in ascending key
    (null keys last; equal keys by text). A single document is its own next. A null text is empty.
    """
    rows = in_order(docs, key, [key, text])
    key_type = docs.schema[key].dataType.simpleString()
    schema = f"{key} {key_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    key_arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[key_type]

    def run(batches):
        waiting = None  # (range, key, text, distinct hashes) of the row whose next one is to come
        out: list[tuple] = []

        def close(row, text_next, next_set):
            own, text_own, own_set = row
            n = len(text_own)
            cut = n - n // 4
            edited = text_own[:cut] + text_next[: n // 4]
            edited_set = np.unique(winnow(edited, k, w)[0])
            digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((own, n, digest, pack(own_set), pack(edited_set), likeness(own_set, edited_set), likeness(own_set, next_set)))

        def flush():
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            types = [key_arrow, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in (key, text, "__range", "__after"))
            for own, body, at, after in zip(*columns, strict=True):
                body = body or ""
                own_set = np.unique(winnow(body, k, w)[0])
                if waiting and waiting[0] == at:
                    close(waiting[1], body, own_set)
                waiting = None if after else (at, (own, body, own_set))
                if len(out) >= 512:
                    yield flush()
        yield flush()

    return rows.mapInArrow(run, schema)


def op6_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and likenesses of every row of documents, as edited_likeness() has them.

    Null texts are empty, and two empty texts are alike; null ids come last; rows that repeat an id follow each other by text;
    further columns are not read; an empty table gives no rows.
    """
    return edited_likeness(table(spark, sf_dir, "documents").select("doc_id", "text"))
