"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Vectors are dealt into cells around centres. A vector less its cell's centre is normed and rotated into `BITS` times as many
dimensions; its code is the signs there, one bit each, packed. With the code go the norm and the correction <code, o>. A
query's inner product is estimated from the bits and these scalars, and the error of the estimate is bounded: only vectors
whose upper bound reaches the k-th best of a query so far are scored exactly, in double precision. A cell whose radius rules
out that any of its vectors reaches it is not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatik.llm.common import discard, materialize, shuffle_partitions, table

#: Standard deviations in the error bound; bits of a code for each component; rows that the centres are fitted on at most,
#: how many of them each centre stands for at least, and centres at most.
EPSILON, BITS, SAMPLE, SAMPLE_ROWS, CELLS = 1.9, 4, 4096, 64, 64
#: Queries that are broadcast at a time, and codes that are estimated together.
QUERY_BLOCK, CODE_BLOCK = 8192, 1024
#: Rows of a cell that go to one task, and rows of a task at least.
PART_ROWS, TASK_ROWS = 1 << 17, 1 << 13


@dataclass
class Rotation:
    """Orthonormal rows (components, bits), the cells' centres (cells, components) and each cell's share of the sample."""

    matrix: np.ndarray
    centres: np.ndarray
    share: np.ndarray

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The nearest centre of every row; ties to the first."""
        return ((self.centres**2).sum(axis=1)[None, :] - 2 * x @ self.centres.T).argmin(axis=1)


def _centres(x: np.ndarray, rng, rounds: int = 8) -> np.ndarray:
    """Centres by Lloyd's rounds from rows drawn at random; a centre that loses its rows stays where it was."""
    x = np.unique(x, axis=0)
    centres = x[rng.choice(len(x), max(1, min(CELLS, len(x) // SAMPLE_ROWS)), replace=False)]
    for _ in range(rounds):
        own = ((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)
        held = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centres)
    return centres


def fit(vectors: DataFrame, seed: int = 7, sample: int = SAMPLE) -> dict[int, Rotation]:
    """A rotation and centres for each length of vectors, the centres from `sample` rows at most, spread by hash of the id.

    Lengths are those that occur; the bound on the sample does not decide which rows are indexed. Without rows: empty.
    """
    got = vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).select("vector").toPandas()["vector"]
    lengths = [r["n"] for r in vectors.select(F.size("vector").alias("n")).distinct().collect()]
    out = {}
    for n in sorted(lengths):
        own = [np.asarray(v, np.float64) for v in got if len(v) == n]
        rng = np.random.default_rng(seed + n)
        matrix = np.linalg.qr(rng.standard_normal((BITS * n, n)))[0].T
        centres = _centres(np.stack(own), rng) if own else np.zeros((1, n))
        out[n] = Rotation(np.ascontiguousarray(matrix), centres, np.zeros(len(centres)))
        if own:
            out[n].share = np.bincount(out[n].cells(np.stack(own)), minlength=len(centres)) / len(got)
    return out


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vector array<float>) of the vectors that take part: not null, not zero, all components present and finite."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.select(F.col(key).alias("id"), v.cast("array<float>").alias("vector")).where(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def build_index(vectors: DataFrame, rotations: dict[int, Rotation]) -> DataFrame:
    """(id, vector, cell, code binary, norm, correction double) of every row; norm is that of the vector less its centre."""
    shared = vectors.sparkSession.sparkContext.broadcast(rotations)

    def run(batches):
        for batch in batches:
            ids, own = batch.column("id"), batch.column("vector")
            sizes = own.value_lengths().to_numpy(zero_copy_only=False)
            codes, scalars, cells = [b""] * len(sizes), np.zeros((2, len(sizes))), np.zeros(len(sizes), np.int32)
            values = own.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                x = values[starts[at][:, None] + np.arange(n)]
                r = shared.value[int(n)]
                cells[at] = r.cells(x)
                rest = x - r.centres[cells[at]]
                norm = np.sqrt((rest * rest).sum(axis=1))
                turned = (rest / np.where(norm > 0, norm, 1)[:, None]) @ r.matrix
                packed = np.packbits(turned > 0, axis=1)
                for i, row in zip(at.tolist(), packed, strict=True):
                    codes[i] = row.tobytes()
                scalars[0, at], scalars[1, at] = norm, np.abs(turned).sum(axis=1) / np.sqrt(BITS * n)
            yield pa.RecordBatch.from_arrays([ids, own, pa.array(cells), pa.array(codes, pa.binary()), *(pa.array(s) for s in scalars)], names=["id", "vector", "cell", "code", "norm", "correction"])

    return vectors.mapInArrow(run, "id long, vector array<float>, cell int, code binary, norm double, correction double")


def dealt(index: DataFrame, rotations: dict[int, Rotation], rows: int) -> DataFrame:
    """index with the rows of a cell together, cut into parts of about PART_ROWS where the sample says that a cell is large."""
    n = max(1, min(shuffle_partitions(index.sparkSession), rows // TASK_ROWS + 1))
    parts = np.ones(max([len(r.share) for r in rotations.values()], default=1), np.int64)
    for r in rotations.values():
        parts[: len(r.share)] = np.maximum(parts[: len(r.share)], np.ceil(r.share * rows / PART_ROWS).astype(np.int64))
    salt = F.pmod(F.xxhash64("id"), F.element_at(F.array(*(F.lit(int(p)) for p in parts)), F.col("cell") + 1))
    return index.repartition(n, F.size("vector"), "cell", salt).sortWithinPartitions(F.size("vector"), "cell", "id")


def exact(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision; the same two vectors give the same bits wherever they stand."""
    return (queries * vectors).sum(axis=1)


class Best:
    """The k best (score, id) of each query so far; ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def floor(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(query):
            return
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep = rank < self.k
        query, ids, scores, rank = query[keep], ids[keep], scores[keep], rank[keep]
        touched, row = np.unique(query, return_inverse=True)
        score = np.full((len(touched), 2 * self.k), -np.inf)
        own = np.full((len(touched), 2 * self.k), np.iinfo(np.int64).max)
        score[:, : self.k], own[:, : self.k] = self.score[touched], self.id[touched]
        score[row, self.k + rank], own[row, self.k + rank] = scores, ids
        order = np.lexsort((own, -score), axis=1)[:, : self.k]
        self.score[touched], self.id[touched] = np.take_along_axis(score, order, 1), np.take_along_axis(own, order, 1)


def _scan(batches, block: dict, rotations: dict[int, Rotation], k: int, epsilon: float):
    """The k best of every query of the block among the vectors of one task, of copies of one vector k at most."""
    found = {n: Best(len(ids), k) for n, (ids, _) in block.items()}
    sides = {}
    for n, (_, queries) in block.items():
        length = np.sqrt((queries * queries).sum(axis=1))
        # the bound of a pair in one product: unit query by scaled signs, and 1 by the error of the code
        unit = np.concatenate((queries @ rotations[n].matrix / length[:, None], np.ones((len(queries), 1))), axis=1).astype(np.float32)
        sides[n] = length, unit
    filled: set[int] = set()
    for batch in batches:
        sizes = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
        all_values = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
        starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        all_ids = batch.column("id").to_numpy(zero_copy_only=False)
        all_cells = batch.column("cell").to_numpy(zero_copy_only=False)
        codes = batch.column("code").to_pylist()
        scalars = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("norm", "correction")]
        for n, (_, queries) in block.items():
            rotation, best, (length, unit) = rotations[n], found[n], sides[n]
            whole = np.flatnonzero(sizes == n)
            cuts = np.flatnonzero(np.diff(all_cells[whole], prepend=-1)).tolist() + [len(whole)]
            spans = [whole[i : min(i + CODE_BLOCK, hi)] for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) for i in range(lo, hi, CODE_BLOCK)]
            for at in spans:
                at = at[np.argsort(all_ids[at], kind="stable")]
                vectors = all_values[starts[at][:, None] + np.arange(n)]
                # of copies of one vector no more than k can be among a query's k nearest
                _, same = np.unique(vectors.view(f"V{4 * n}").ravel(), return_inverse=True)
                by = np.argsort(same, kind="stable")
                rank = np.empty(len(at), np.int64)
                rank[by] = np.arange(len(at)) - np.searchsorted(same[by], same[by])
                kept = np.flatnonzero(rank < k)
                at, vectors = at[kept], vectors[kept].astype(np.float64)
                ids, norm, correction = all_ids[at], *(s[at] for s in scalars)
                centre, floor = rotation.centres[all_cells[at[0]]], best.floor()
                shift, slack = queries @ centre, 1e-5 * (norm.max() + np.abs(centre).sum() + 1e-9)
                live = np.flatnonzero(shift + length * (norm.max() + slack) >= floor)
                if not len(live):
                    continue
                signs = np.unpackbits(np.frombuffer(b"".join(codes[i] for i in at), np.uint8).reshape(len(at), -1), axis=1, count=BITS * n).astype(np.float32) * 2 - 1
                signs *= (norm / np.maximum(correction, 1e-12) / np.sqrt(BITS * n)).astype(np.float32)[:, None]
                spread = norm * np.sqrt(np.maximum(0, 1 - correction**2)) / np.maximum(correction, 1e-12) / np.sqrt(max(1, BITS * n - 1))
                error = (epsilon * spread + slack).astype(np.float32)
                own = unit if len(live) == len(unit) else unit[live]
                bound = own @ np.concatenate((signs, error[:, None]), axis=1).T
                if n not in filled and len(at) > k:
                    # the first codes' best are scored at once, so that the k-th best is known from the start
                    top = np.argpartition(bound, len(at) - k, axis=1)[:, -k:]
                    query, column = np.repeat(live, k), top.ravel()
                    sure = Best(len(queries), k)
                    sure.add(query, ids[column], exact(queries[query], vectors[column]))
                    floor = np.maximum(floor, sure.floor())
                    filled.add(n)
                limit = ((floor - shift) / length).astype(np.float32)[live]
                limit -= 1e-5 * np.abs(limit, where=np.isfinite(limit), out=np.zeros_like(limit))
                query, column = np.nonzero(bound >= limit[:, None])
                for i in range(0, len(query), 1 << 18):
                    q, c = live[query[i : i + (1 << 18)]], column[i : i + (1 << 18)]
                    best.add(q, ids[c], exact(queries[q], vectors[c]))
    for n, (query_rows, _) in block.items():
        own = found[n]
        for lo in range(0, len(query_rows), 1024):
            rows = range(lo, min(lo + 1024, len(query_rows)))
            near = [[{"id": i, "score": s} for s, i in zip(own.score[r].tolist(), own.id[r].tolist(), strict=True) if s > -np.inf] for r in rows]
            live = [j for j, x in enumerate(near) if x]
            yield pa.RecordBatch.from_arrays([pa.array([query_rows[lo + j] for j in live], pa.int64()), pa.array([near[j] for j in live], pa.list_(pa.struct([("id", pa.int64()), ("score", pa.float64())])))], names=["query", "near"])


def _merge(k: int):
    return lambda: F.slice(F.sort_array(F.flatten(F.collect_list(F.transform("near", lambda x: F.struct(x["score"].alias("score"), (-x["id"]).alias("minus"))))), asc=False), 1, k)


def search(index: DataFrame, queries: DataFrame, rotations: dict[int, Rotation], k: int = 20, epsilon: float = EPSILON) -> DataFrame:
    """(query_id, rank, id, score) of the k nearest of each row of queries among all rows of the index but its own.

    queries: (id, vector), rows of the index. They are taken in blocks of QUERY_BLOCK, each broadcast and scanned against
    every code; a block's result is written before the next begins. Vectors are compared with those of their own length. Ties
    go to the smaller id. Rows that repeat an id are rows of their own, as queries and as candidates: of the entries with the
    query's id and its score with itself one is left out, its own row. Empty tables give no rows.
    """
    spark = index.sparkSession
    count = queries.count()
    blocks = max(1, -(-count // QUERY_BLOCK))
    parts = []
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id", "vector").toPandas()
        block, own = {}, []
        for n, same in rows.groupby(rows["vector"].map(len)):
            x = np.stack([np.asarray(v, np.float64) for v in same["vector"]])
            block[int(n)] = (same.index.to_numpy(np.int64), x)
            own += zip(same.index.tolist(), same["id"].tolist(), exact(x, x).tolist(), strict=True)
        shared = spark.sparkContext.broadcast((block, rotations))
        partial = index.mapInArrow(lambda batches, s=shared: _scan(batches, *s.value, k + 1, epsilon), "query long, near array<struct<id:long,score:double>>")
        merge = _merge(k + 1)
        half = partial.groupBy("query", F.pmod(F.spark_partition_id(), F.lit(32)).alias("part")).agg(merge().alias("m"))
        half = half.select("query", F.transform("m", lambda x: F.struct((-x["minus"]).alias("id"), x["score"].alias("score"))).alias("near"))
        near = half.groupBy("query").agg(merge().alias("m"))
        known = spark.createDataFrame(own, "query long, query_id long, self double")
        near = near.join(F.broadcast(known), "query")
        mine = F.array_position("m", F.struct(F.col("self").alias("score"), (-F.col("query_id")).alias("minus")))
        others = F.slice(F.filter("m", lambda x, i: i + 1 != mine), 1, k)
        out = near.select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), (-F.col("x.minus")).alias("id"), F.col("x.score").alias("score"))
        parts.append(materialize(out, f"ann-{b}") if blocks > 1 else out)
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, rank, vec_id, score): the 20 nearest by inner product of every embedding whose vec_id is divisible by 20.

    Null ids, and vectors that are null, empty, zero or hold a null or non-finite component, take no part; further columns
    are not read; an empty table gives no rows. Ties go to the smaller vec_id; repeated ids are rows of their own.
    """
    vectors = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    rotations = fit(vectors)
    coded = materialize(build_index(vectors, rotations), "ann-codes")
    index = materialize(dealt(coded, rotations, coded.count()), "ann-index")
    discard(coded)
    queries = index.where(F.col("id") % 20 == 0).select("id", "vector")
    return search(index, queries, rotations).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
