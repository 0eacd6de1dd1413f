"""Mixing sources to target weights by subset-sum budget fitting.

Every source has a target number of words. Whole passes over a source are taken while they fit; for what remains, the
source's documents are counted by exact length, most of the budget goes to every length in proportion, and a bounded
knapsack over the length counts that are left fits the rest to the word where it can. Which documents of a length are taken
is decided by a seeded hash of the id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verbatik.llm.common import materialize, table

#: Weights of the sources in code-point order, repeating; words of the mix for each word of the sources; most copies of one.
WEIGHTS, SHARE, COPIES = (3.0, 1.0, 2.0), 1.5, 2
SEED = 20240101
#: Words that are left to the knapsack; its table has up to twice as many cells, and what is beyond is fitted before and after.
CAPACITY = 1 << 15
#: Parts that the documents of one source and length are ranked in.
PARTS = 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, copies: int = COPIES) -> DataFrame:
    """sizes (source, source_size) with target double: share of all words by weight, none above copies times its size.

    Where a target stops at its limit the excess goes to the others by weight, again and again; that ends at
    min(limit, weight x level), and the level is found from the limits in ascending order of limit / weight.
    """
    ranked = sizes.withColumn("__at", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
    own = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("__at") - 1) % len(weights) + 1)
    rows = ranked.withColumn("__w", own).withColumn("__limit", F.col("source_size") * F.lit(float(copies)))
    ascending = Window.orderBy(F.col("__limit") / F.col("__w"), "__at")
    before = ascending.rowsBetween(Window.unboundedPreceding, -1)
    after = ascending.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rows = rows.withColumn("__level", (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("__limit").over(before), F.lit(0.0))) / F.sum("__w").over(after))
    level = F.max(F.when(F.col("__level") <= F.col("__limit") / F.col("__w"), F.col("__level"))).over(everything)
    return rows.withColumn("target", F.coalesce(F.least(F.col("__limit"), F.col("__w") * level), F.col("__limit"))).select(*sizes.columns, "target")


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, capacity: int = CAPACITY) -> np.ndarray:
    """How many documents of each length to take so that their words come as near to budget as they can.

    lengths: distinct and positive. floor(count x fraction) of each length are taken, then more from the longest down while
    one fits. The shortest are given back until the bounded knapsack has words to fit; it fits them exactly. What is still
    open after that (long documents leave more than the knapsack's width) is closed by single documents and by swaps of one
    for another as long as that comes nearer. The sum may end on either side of budget; any lengths are dealt with.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    taken = np.floor(counts * (max(0, budget) / max(1, total))).astype(np.int64)
    taken = _descend(lengths, counts, taken, budget)
    rest = budget - int((lengths * taken).sum())
    for i in np.argsort(lengths, kind="stable"):
        if rest >= capacity // 2 or lengths[i] > capacity // 2:
            break
        back = min(int(taken[i]), -(-(capacity // 2 - rest) // int(lengths[i])))
        taken[i] -= back
        rest += back * int(lengths[i])
    if rest > 0:
        room = min(rest, 2 * capacity)
        taken = taken + bounded_knapsack(lengths, counts - taken, room, min(room, 256))
    return _swap(lengths, counts, _descend(lengths, counts, taken, budget), budget)


def _descend(lengths: np.ndarray, counts: np.ndarray, taken: np.ndarray, budget: int) -> np.ndarray:
    """taken and as many more documents, the longest first, as fit below budget."""
    taken, rest = taken.copy(), budget - int((lengths * taken).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if 0 < lengths[i] <= rest:
            more = min(int(counts[i] - taken[i]), rest // int(lengths[i]))
            taken[i] += more
            rest -= more * int(lengths[i])
    return taken


def _swap(lengths: np.ndarray, counts: np.ndarray, taken: np.ndarray, budget: int, rounds: int = 64) -> np.ndarray:
    """taken with one document more, one less, or one for another, the best such change at a time, while the sum comes nearer."""
    taken = taken.copy()
    zero = np.zeros(1, np.int64)
    for _ in range(rounds):
        rest = budget - int((lengths * taken).sum())
        if rest == 0:
            break
        free, held = np.flatnonzero(counts > taken), np.flatnonzero(taken > 0)
        add, drop = np.concatenate((zero, lengths[free])), np.concatenate((zero, lengths[held]))
        order = np.argsort(add, kind="stable")
        want = drop + rest
        at = np.searchsorted(add[order], want)
        sides = np.stack([np.clip(at - 1, 0, len(add) - 1), np.clip(at, 0, len(add) - 1)])
        error = np.abs(want[None, :] - add[order][sides])
        side, i = np.unravel_index(int(error.argmin()), error.shape)
        if error[side, i] >= abs(rest):
            break
        j = int(order[sides[side, i]])
        if j:
            taken[free[j - 1]] += 1
        if i:
            taken[held[i - 1]] -= 1
    return taken


def bounded_knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int, above: int = 0) -> np.ndarray:
    """Counts (at most `counts`) whose lengths sum to the reachable sum nearest to budget, and not over it by more than above.
    Of two as near the smaller sum is taken.

    reach[s] is the number of items of the current length that the first way to s needed; each length is one pass over the
    sums, and what first made s reachable is kept, so that the way back needs one row of integers.
    """
    goal, budget = budget, budget + above
    first = np.full(budget + 1, -1, np.int64)
    first[0] = len(lengths)
    reachable = np.zeros(budget + 1, bool)
    reachable[0] = True
    for i in np.argsort(lengths, kind="stable"):
        size, left = int(lengths[i]), int(counts[i])
        if size > budget or left <= 0 or reachable[goal]:
            continue
        width = -(-(budget + 1) // size) * size
        # used[s]: items of this length spent to reach s, counted along each residue class
        grid = np.zeros(width, bool)
        grid[: budget + 1] = reachable
        grid = grid.reshape(-1, size)
        steps = np.arange(grid.shape[0])[:, None]
        since = np.maximum.accumulate(np.where(grid, steps, -1 << 40), axis=0)
        new = (~grid & (steps - since <= left)).ravel()[: budget + 1]
        first[new] = i
        reachable |= new
    chosen = np.zeros(len(lengths), np.int64)
    sums = np.flatnonzero(reachable)
    at = int(sums[np.abs(sums - goal).argmin()])
    while at > 0:
        i = first[at]
        chosen[i] += 1
        at -= int(lengths[i])
    return chosen


def plan(histogram: DataFrame) -> DataFrame:
    """histogram (source_key, size, n, target, source_size) with passes and extra: copies of all, and how many get one more."""
    schema = "source_key string, size long, passes long, extra long"

    def fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ignore_index=True)
        lengths, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        whole, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        passes = int(target // whole) if whole else 0
        live = lengths > 0
        extra = np.zeros(len(pdf), np.int64)
        extra[live] = fit_counts(lengths[live], counts[live], round(target - passes * whole))
        return pd.DataFrame({"source_key": pdf["source_key"], "size": lengths, "passes": passes, "extra": extra})

    return histogram.groupBy("source_key").applyInPandas(fit_source, schema)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, copies: int = COPIES, seed: int = SEED, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*carry, size, source_size, target, copies) for each row of docs (doc_id, text, source).

    carry names columns that tell rows apart; the seeded hash that chooses among rows of one length is of them. A null text
    has size 0 and is taken as often as its source's passes say. A null source is a source of its own, last. Repeated rows
    count each, and null ids are values like others. Further columns are not looked at; an empty table gives no rows.
    """
    carry = [*carry]
    key = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source")))
    rows = docs.select(*carry, F.col("source").alias("__source"), key.alias("__key"), word_count(F.col("text")).alias("size"))
    sized = materialize(rows.withColumn("__h", F.xxhash64(F.lit(seed), *carry)), "mix-sizes")
    sized = sized.withColumn("__part", F.pmod(F.shiftrightunsigned("__h", 40), F.lit(PARTS)).cast("int"))
    by_part = materialize(sized.groupBy(F.col("__key").alias("source_key"), F.col("__source").alias("source"), "size", "__part").agg(F.count("*").alias("n")), "mix-counts")
    by_size = by_part.groupBy("source_key", "source", "size").agg(F.sum("n").alias("n"))
    by_source = by_size.groupBy("source_key", "source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    goals = targets(by_source, weights, share, copies).drop("source")
    planned = plan(by_size.drop("source").join(goals, "source_key"))
    before = Window.partitionBy("source_key", "size").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = by_part.select("source_key", "size", "__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    known = parts.join(planned, ["source_key", "size"]).join(goals, "source_key")
    rank = F.row_number().over(Window.partitionBy("__key", "size", "__part").orderBy("__h", *carry))
    ranked = sized.select(*carry, F.col("__key").alias("source_key"), "size", "__part", rank.alias("__rank"))
    out = ranked.join(known, ["source_key", "size", "__part"])
    taken = F.col("passes") + F.when(F.col("__rank") + F.col("__before") <= F.col("extra"), 1).otherwise(0)
    return out.select(*carry, "size", "source_size", "target", F.least(taken, F.lit(copies)).cast("long").alias("copies"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of documents; taken is size times the copies that the mix takes.

    Null texts have size 0, a null source is the last source, null and repeated ids are rows of their own, and further columns
    are not read. An empty table gives no rows.
    """
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
