"""Language identification: multinomial naive Bayes over hashed character n-grams (n = 1, 2, 3)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatik.llm.common import fields, fold, table, trimmed

#: Hash buckets of the n-grams; one more holds what spans two texts and weighs nothing.
BUCKETS = 1 << 17
#: Additive smoothing of bucket counts.
ALPHA = 0.1
#: The evidence of so many n-grams at most enters the score; overlapping n-grams are not independent.
EVIDENCE = 64
#: Characters that are hashed at once, and rows of a batch whose texts are held at once.
BLOCK, ROWS = 1 << 18, 1024
UNDETERMINED = "und"

_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    """Labels in ascending order, log probabilities (buckets + 1, labels) and log priors."""

    labels: list[str]
    log_p: np.ndarray
    prior: np.ndarray


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in lower case as one array, each followed by a zero, and each text's length with that zero."""
    own = [t.lower() for t in texts]
    points = np.frombuffer("".join(t.replace("\0", " ") + "\0" for t in own).encode("utf-32-le", "surrogatepass"), "<u4")
    return points, np.asarray([len(t) + 1 for t in own])


def _blocks(points: np.ndarray):
    """(start, buckets (3, n)) for blocks of positions; an n-gram counts where it begins."""
    for start in range(0, len(points), BLOCK):
        n = min(BLOCK, len(points) - start)
        window = np.zeros(n + 2, np.uint64)
        part = points[start : start + n + 2]
        window[: len(part)] = part
        out = np.empty((3, n), np.int64)
        gram, live = np.zeros(n, np.uint64), np.ones(n, bool)
        for order in range(3):
            at = window[order : order + n]
            live &= at != 0
            gram = (gram + at + np.uint64(order + 1)) * _MIX
            mixed = (gram ^ (gram >> np.uint64(29))) * _MIX
            out[order] = np.where(live, (mixed >> np.uint64(40)) & np.uint64(BUCKETS - 1), BUCKETS)
        yield start, out


def bucket_counts(rows: DataFrame, text: str, label: str) -> DataFrame:
    """(label, bucket int, n long) over all rows with a label; tasks count before the shuffle."""

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in (big.slice(i, ROWS) for big in batches for i in range(0, big.num_rows, ROWS)):
            by: dict[str, list[str]] = {}
            for t, lang in zip(batch.column("body").to_pylist(), batch.column("label").to_pylist(), strict=True):
                if t and lang is not None:
                    by.setdefault(lang, []).append(t)
            for lang, texts in by.items():
                own = totals.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                for i in range(0, len(texts), 256):
                    for _, grams in _blocks(_code_points(texts[i : i + 256])[0]):
                        own += np.bincount(grams.ravel(), minlength=BUCKETS + 1)
        for lang, own in totals.items():
            at = np.flatnonzero(own[:BUCKETS])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], names=["label", "bucket", "n"])

    rows = rows.select(F.col(text).alias("body"), F.col(label).alias("label")).where(F.col("label").isNotNull())
    return rows.mapInArrow(trimmed(count), "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))


def train(rows: DataFrame, text: str = "text", label: str = "lang") -> Model:
    """Fit on every row of rows. What reaches the driver is labels x buckets counts, whatever the number of rows."""
    got = bucket_counts(rows, text, label).toPandas()
    docs = {r["label"]: r["n"] for r in rows.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")).collect()}
    labels = sorted(docs)
    counts = np.zeros((BUCKETS + 1, max(1, len(labels))))
    place = {lang: i for i, lang in enumerate(labels)}
    if len(got):
        counts[got["bucket"].to_numpy(), got["label"].map(place).to_numpy()] = got["n"].to_numpy()
    live = counts[:BUCKETS] + ALPHA
    log_p = np.zeros_like(counts)
    log_p[:BUCKETS] = np.log(live) - np.log(live.sum(axis=0))
    prior = np.log(np.asarray([docs[x] for x in labels], float) / max(1, sum(docs.values()))) if labels else np.zeros(1)
    return Model(labels, log_p.astype(np.float32), prior)


def _scores(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Summed log probabilities (texts, labels) and numbers of n-grams."""
    points, lengths = _code_points(texts)
    owner = np.repeat(np.arange(len(texts)), lengths)
    total, grams = np.zeros((len(texts), model.log_p.shape[1])), np.zeros(len(texts))
    for start, buckets in _blocks(points):
        who = owner[start : start + buckets.shape[1]]
        first = who[0]
        summed = model.log_p[buckets[0]] + model.log_p[buckets[1]] + model.log_p[buckets[2]]
        edges = np.flatnonzero(np.diff(who, prepend=first - 1))
        total[who[edges]] += np.add.reduceat(summed.astype(np.float64), edges, axis=0)
        grams[who[edges]] += np.add.reduceat((buckets != BUCKETS).sum(axis=0), edges)
    return total, grams


def predict(rows: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """rows with lang_pred and score in place of columns so named; only the text is looked at.

    lang_pred is `und` with score 0 where the text is null or has no letter, or nothing was learned. Otherwise it is the
    label of the largest posterior over all n-grams (ties: first in code-point order), and score is the posterior that this
    label has with the evidence of EVIDENCE n-grams at most.
    """
    rows = rows.drop(*(c for c in rows.columns if c in ("lang_pred", "score") and c != text))
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = rows.columns
    schema = fields(rows, "lang_pred string, score double")

    def score(batches):
        import regex

        letter, own = regex.compile(r"\p{L}"), shared.value
        for batch in (big.slice(i, ROWS) for big in batches for i in range(0, big.num_rows, ROWS)):
            texts = batch.column(text).to_pylist()
            lang, sure = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            live = [i for i, t in enumerate(texts) if own.labels and t and letter.search(t)]
            for j in range(0, len(live), 256):
                some = live[j : j + 256]
                total, grams = _scores(own, [texts[i] for i in some])
                best = (total + own.prior).argmax(axis=1)
                total = total * np.minimum(1.0, EVIDENCE / np.maximum(grams, 1))[:, None] + own.prior
                likely = np.exp(total - total.max(axis=1, keepdims=True))
                posterior = likely[np.arange(len(best)), best] / likely.sum(axis=1)
                for i, b, p in zip(some, best.tolist(), posterior.tolist(), strict=True):
                    lang[i], sure[i] = own.labels[b], min(1.0, p)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(sure, pa.float64())], names=[*names, "lang_pred", "score"])

    return rows.mapInArrow(trimmed(score), schema)


def identify(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, ...) with held_out, lang_pred and score. Learns from rows of folds 0 and 2; a null doc_id is in fold 0."""
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    model = train(docs.where(~held), "text", "lang")
    return predict(docs.withColumn("held_out", held), model, "text")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of documents.

    Null texts and texts without a letter are `und`; a null lang is not learned from; null ids are not held out; repeated rows
    stay; further columns are not read; an empty table gives no rows.
    """
    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")
