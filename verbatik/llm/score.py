"""Language-model scores by deleted interpolation.

A word's probability after its predecessor is a mixture of three estimates: the maximum-likelihood ones of the word pair and
of the word, and the uniform one over the vocabulary and one unknown. The mixture weights depend on how often the
predecessor was seen (one bucket for each power of two) and are learned by expectation-maximisation on one fold of the
training documents, with counts from which that fold is deleted; the final counts are of all training documents.

Counts of word pairs and rare words are neither broadcast nor limited. Documents are packed into chunks of word ids; every
chunk sends its distinct keys with its own counts to the owners of the keys, each owner adds up what the corpus has of a
key, and the totals go back to the chunks. Both ways keys and counts are packed, so a shuffle row is a block of keys.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatik.llm.common import as_bytes, discard, expand, fold, materialize, shuffle_partitions, squeeze, table, word_counts

#: Frequent words that are broadcast with their counts, and the longest of them in bytes.
HEAD_WORDS, HEAD_BYTES = 200_000, 64
#: Tokens in a chunk, and tokens whose keys one owner holds.
CHUNK, OWNER = 1_000_000, 2_000_000
#: Context-frequency buckets; steps of the logarithmic grid that held-out events are counted on; rounds of EM.
BUCKETS, GRID, STEPS, ROUNDS = 20, 512, 8, 60
#: Smoothing of the base score.
ADD = 0.1

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_KEY = np.uint64((1 << 56) - 1)
HELD_OUT, DEV, TRAIN = 0, 1, 2


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def chunks(docs: DataFrame, index) -> DataFrame:
    """(chunk, doc_ids, folds, lengths, words, rare) of docs (doc_id, body, part): texts as ids of frequent words, or of the
    chunk's own rare words (negative), whose 64-bit hashes are in rare. Lengths are in words."""

    def run(batches):
        import xxhash

        look, h = index.value.get, xxhash.xxh3_64_intdigest
        base, made = TaskContext.get().partitionId() << 32, 0
        ids, parts, lengths, words, rare = [], [], [], [], {}
        held = 0

        def emit():
            nonlocal made, held
            hashes = np.fromiter((h(w) for w in rare), np.uint64, len(rare))
            row = [pa.array([base + made]), pa.array([ids], pa.list_(pa.int64())), pa.array([np.asarray(parts, np.int8).tobytes()]), pa.array([squeeze(np.asarray(lengths, np.int32))]), pa.array([squeeze(np.concatenate(words) if words else np.zeros(0, np.int32))]), pa.array([squeeze(hashes)])]
            made, held = made + 1, 0
            for x in (ids, parts, lengths, words, rare):
                x.clear()
            return pa.RecordBatch.from_arrays(row, names=["chunk", "doc_ids", "folds", "lengths", "words", "rare"])

        for batch in batches:
            for doc, body, part in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("body")), batch.column("part").to_pylist(), strict=True):
                own = (body or b"").lower().split()
                at = np.fromiter(map(look, own, repeat(-1)), np.int32, len(own))
                for i in np.flatnonzero(at < 0).tolist():
                    at[i] = -1 - rare.setdefault(own[i], len(rare))
                ids.append(doc)
                parts.append(part)
                lengths.append(len(own))
                words.append(at)
                held += len(own) + 1
                if held >= CHUNK:
                    yield emit()
        if ids:
            yield emit()

    return docs.mapInArrow(run, "chunk long, doc_ids array<long>, folds binary, lengths binary, words binary, rare binary")


def unpack(row) -> dict:
    """Token arrays of a chunk: the document of each token, its word (the end of a text is token -2**31), the keys of word and pair."""
    lengths, words, rare = expand(row["lengths"], np.int32), expand(row["words"], np.int32), expand(row["rare"], np.uint64)
    folds = np.frombuffer(row["folds"], np.int8)
    ends = np.cumsum(lengths + 1)
    tokens = np.full(int(ends[-1]), -(1 << 31), np.int64)
    inner = np.ones(len(tokens), bool)
    inner[ends - 1] = False
    tokens[inner] = words
    owner = np.repeat(np.arange(len(lengths)), lengths + 1)
    code = np.empty(len(tokens), np.uint64)
    frequent, tail = tokens >= 0, inner & (tokens < 0)
    code[frequent] = mix(tokens[frequent].astype(np.uint64) + _A)
    code[tail] = rare[-1 - tokens[tail]]
    code[~inner] = _C
    before = np.empty_like(code)
    before[1:] = code[:-1]
    before[ends - lengths - 1] = _B
    pair = mix(before * _A + mix(code + _B)) & _KEY
    return {"lengths": lengths, "folds": folds, "ends": ends, "tokens": tokens, "owner": owner, "tail": tail, "word": mix(code ^ _A) & _KEY, "pair": pair}


def keys_of(x: dict) -> tuple[np.ndarray, np.ndarray]:
    """The chunk's distinct keys, ascending, and for every pair and then every rare word its place among them."""
    return np.unique(np.concatenate((x["pair"], x["word"][x["tail"]])), return_inverse=True)


def requests(packed: DataFrame, owners: int) -> DataFrame:
    """(owner, chunk, keys, train, dev): each chunk's distinct keys by owner, with its own counts."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x = unpack(row)
                keys, place = keys_of(x)
                folds = np.concatenate((x["folds"][x["owner"]], x["folds"][x["owner"][x["tail"]]]))
                train = np.bincount(place[folds != HELD_OUT], minlength=len(keys)).astype(np.uint32)
                dev = np.bincount(place[folds == DEV], minlength=len(keys)).astype(np.uint32)
                edges = np.searchsorted(keys, [(o << 56) // owners for o in range(owners)] + [1 << 56])
                out = [(o, row["chunk"], squeeze(np.diff(keys[a:b], prepend=np.uint64(0))), squeeze(train[a:b]), squeeze(dev[a:b])) for o, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if b > a]
                columns = list(zip(*out, strict=True))
                types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["owner", "chunk", "keys", "train", "dev"])

    return packed.mapInArrow(run, "owner int, chunk long, keys binary, train binary, dev binary")


def totals(asked: DataFrame) -> DataFrame:
    """(chunk, owner, train, dev): for each block of keys what all chunks together have of them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks = [np.cumsum(expand(k, np.uint64), dtype=np.uint64) for k in pdf["keys"]]
        _, place = np.unique(np.concatenate(blocks), return_inverse=True)
        size = int(place.max()) + 1
        sums = [np.bincount(place, weights=np.concatenate([expand(v, np.uint32) for v in pdf[c]]), minlength=size).astype(np.uint32) for c in ("train", "dev")]
        edges = np.cumsum([0, *map(len, blocks)])
        out = [[squeeze(s[place[a:b]]) for a, b in zip(edges[:-1], edges[1:], strict=True)] for s in sums]
        return pd.DataFrame({"chunk": pdf["chunk"], "owner": pdf["owner"], "train": out[0], "dev": out[1]})

    return asked.groupBy("owner").applyInPandas(run, "chunk long, owner int, train binary, dev binary")


def grid_place(p: np.ndarray, uniform: float) -> np.ndarray:
    """A probability's step on the grid, by its ratio to the uniform one; 0 for none."""
    with np.errstate(divide="ignore"):
        step = np.rint(np.log2(p / uniform) * STEPS) + GRID // 2
    return np.where(p > 0, np.clip(step, 1, GRID - 1), 0).astype(np.int64)


def context_bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(BUCKETS - 1, np.ceil(np.log2(np.maximum(count, 0) + 1.0))).astype(np.int64)


def counted(packed: DataFrame, answers: DataFrame, head, size: dict) -> DataFrame:
    """(doc_ids, folds, lengths, base, known, word, pair, cells, n): every token's counts in all training documents, each
    document's base score, and the fold's events on the grid of (context bucket, pair ratio, word ratio)."""
    schema = "doc_ids array<long>, folds binary, lengths binary, base array<double>, known array<long>, word binary, pair binary, cells binary, n binary"

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0]
        x = unpack(row)
        _, place = keys_of(x)
        right = right.sort_values("owner")
        train, dev = (np.concatenate([expand(v, np.uint32) for v in right[c]]).astype(np.int64)[place] for c in ("train", "dev"))
        n = len(x["tokens"])
        head_train, head_dev = head.value
        word, word_dev = np.full(n, size["docs"]), np.full(n, size["dev_docs"])
        frequent = x["tokens"] >= 0
        word[frequent], word_dev[frequent] = head_train[x["tokens"][frequent]], head_dev[x["tokens"][frequent]]
        word[x["tail"]], word_dev[x["tail"]] = train[n:], dev[n:]
        pair, pair_dev = train[:n], dev[:n]
        starts = x["ends"] - x["lengths"] - 1
        base = np.add.reduceat(np.log10((word + ADD) / (size["n"] + ADD * (size["v"] + 1))), starts)
        known = np.add.reduceat((word > 0).astype(np.int64), starts)
        context = np.concatenate(([0], (word - word_dev)[:-1]))
        context[starts] = size["docs"] - size["dev_docs"]
        on = x["folds"][x["owner"]] == DEV
        c, uniform = context[on], 1 / (size["v"] + 1)
        cell = (context_bucket(c) * GRID + grid_place((pair - pair_dev)[on] / np.maximum(c, 1), uniform)) * GRID + grid_place((word - word_dev)[on] / max(1, size["n"] - size["dev_n"]), uniform)
        cells, times = np.unique(cell, return_counts=True)
        return pd.DataFrame({"doc_ids": [row["doc_ids"]], "folds": [row["folds"]], "lengths": [row["lengths"]], "base": [base], "known": [known], "word": [squeeze(word.astype(np.uint32))], "pair": [squeeze(pair.astype(np.uint32))], "cells": [squeeze(cells)], "n": [squeeze(times)]})

    return packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(run, schema)


def learn(events: pd.DataFrame, uniform: float) -> np.ndarray:
    """(BUCKETS, 3) weights of pair, word and uniform estimates by EM; a bucket without events has those of all events."""
    cell, n = events["cell"].to_numpy(np.int64), events["n"].to_numpy(np.float64)
    bucket, pair, word = cell // (GRID * GRID), cell // GRID % GRID, cell % GRID
    ratio = lambda q: np.where(q > 0, 2.0 ** ((q - GRID // 2) / STEPS), 0.0)
    p = np.stack([ratio(pair), ratio(word), np.ones(len(cell))], axis=1) * uniform

    def em(rows: np.ndarray) -> np.ndarray:
        weights = np.full(3, 1 / 3)
        for _ in range(ROUNDS):
            share = p[rows] * weights
            weights = (share / share.sum(axis=1, keepdims=True) * n[rows, None]).sum(axis=0) / n[rows].sum()
        return weights

    overall = em(np.ones(len(cell), bool)) if len(cell) else np.asarray([0.4, 0.4, 0.2])
    out = np.stack([em(bucket == b) if (bucket == b).any() else overall for b in range(BUCKETS)])
    out[0] = [0, out[0][1], 1 - out[0][0] - out[0][1]] if out[0][0] < 1 else [0, 0, 1]
    out[0] /= out[0].sum()
    out = np.maximum(out, 1e-9)
    out[0, 0] = 0
    return out / out.sum(axis=1, keepdims=True)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", head_words: int = HEAD_WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs.

    Rows of fold 0 of 10 are held out, fold 1 teaches the mixture weights. A null text is empty and has one token, its end. A
    null key is in no fold and is learned from. Repeated rows count each. Without training documents the base is uniform.
    """
    spark = docs.sparkSession
    part = F.when(fold(F.col(key), 10) == 0, HELD_OUT).when(fold(F.col(key), 10) == 1, DEV).otherwise(TRAIN)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("body"), part.alias("part"))
    flags = rows.withColumn("train", F.col("part") != HELD_OUT).withColumn("dev", F.col("part") == DEV)
    words = materialize(word_counts(flags, "body", ["train", "dev"], lower=True), "lm-words")
    n = words.agg(F.sum("n_train").alias("n"), F.sum("n_dev").alias("dev_n"), F.count(F.when(F.col("n_train") > 0, 1)).alias("v")).first()
    ends = flags.agg(F.count(F.when(F.col("train"), 1)).alias("docs"), F.count(F.when(F.col("dev"), 1)).alias("dev_docs"), F.count("*").alias("all")).first()
    size = {"docs": ends["docs"], "dev_docs": ends["dev_docs"], "n": (n["n"] or 0) + ends["docs"], "dev_n": (n["dev_n"] or 0) + ends["dev_docs"], "v": n["v"] + (ends["docs"] > 0)}
    top = words.where((F.length("word") <= HEAD_BYTES) & (F.col("n_train") > 0)).orderBy(F.desc("n_train"), "word").limit(head_words).toArrow()
    index = spark.sparkContext.broadcast({w: i for i, w in enumerate(top.column("word").to_pylist())})
    head = spark.sparkContext.broadcast((top.column("n_train").to_numpy(), top.column("n_dev").to_numpy()))
    discard(words)
    owners = max(shuffle_partitions(spark), -(-int(size["n"]) // OWNER))
    packed = materialize(chunks(rows, index), "lm-chunks")
    asked = requests(packed, owners)
    found = materialize(counted(packed, totals(asked), head, size), "lm-counts")
    discard(packed)

    def spread(batches):
        for batch in batches:
            for cells, times in zip(batch.column("cells").to_pylist(), batch.column("n").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(expand(cells, np.int64)), pa.array(expand(times, np.int64))], names=["cell", "n"])

    events = found.select("cells", "n").mapInArrow(spread, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    weights = learn(events.sort_values("cell"), 1 / (size["v"] + 1))

    def finish(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lengths, word, pair = expand(row["lengths"], np.int32), expand(row["word"], np.uint32).astype(np.int64), expand(row["pair"], np.uint32)
                starts = np.cumsum(lengths + 1) - lengths - 1
                context = np.concatenate(([0], word[:-1]))
                context[starts] = size["docs"]
                w = weights[context_bucket(context)]
                p = w[:, 0] * (pair / np.maximum(context, 1)) + w[:, 1] * (word / max(1, size["n"])) + w[:, 2] / (size["v"] + 1)
                total = np.add.reduceat(np.log10(p), starts)
                held = np.frombuffer(row["folds"], np.int8) == HELD_OUT
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(held), pa.array(lengths.astype(np.int64) + 1), pa.array(row["known"], pa.int64()), pa.array(np.full(len(lengths), size["n"], np.int64)), pa.array(row["base"], pa.float64()), pa.array(total)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return found.drop("cells", "n").mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op9_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base score and score of every row of documents, as score() has them: null texts are empty, null ids are learned from,
    repeated rows count each, further columns are not read, and an empty table gives no rows."""
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
