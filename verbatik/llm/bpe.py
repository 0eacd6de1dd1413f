"""Byte-pair encoding through a table of distinct words, and decoding through an id-to-piece join.

White space never enters a piece of these vocabularies, so a text's ids are its words' ids in order. Words are split and
counted in Spark; every distinct word is encoded once; the ids return to each text by word position. A word that the
corpus holds once is encoded where it stands, which is that once. The most frequent words, as many as HEAD_WORDS and
HEAD_MEMORY allow, are broadcast with their ids in order of their hashes, and joined within the tasks: found by hash, then
compared as words. All rarer words that occur twice or more come back through a shuffled join, so the vocabulary may grow
without bound; a bitmap of them spares that join the words that occur once. This is one way at every size: it is taken also
where every repeated word fits the head. Ids become text by a join with the table of pieces, which lies in order of its ids and whose size is the
tokenizer's: a batch's ids take their pieces from it by place.
"""

from __future__ import annotations

import os
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatik.llm.common import as_bytes, expand, fields, materialize, squeeze, trimmed, word_counts

#: Words that are broadcast at most, the longest of them in bytes, and how many of them a worker finds by the word itself.
HEAD_WORDS, HEAD_BYTES, HOT_WORDS = 2_000_000, 256, 60_000
#: Bytes that are broadcast at most: words, ids, and ENTRY bytes of hash, offsets and rank for each.
HEAD_MEMORY, ENTRY = 80 << 20, 24
#: Bits of the broadcast bitmap of words outside the head (8 MB): with more such words it lets more others pass to the exact join.
TAIL_BITS = 1 << 26
#: Texts are looked at in groups of GROUP rows or GROUP_BYTES bytes, whichever is reached first.
GROUP, GROUP_BYTES = 512, 4 << 20
#: Distinct words that a counting task holds at a time.
DISTINCT_WORDS = 150_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_loaded: dict[str, object] = {}


def load_tokenizer(path: str):
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        _loaded[path] = tokenizer
    return _loaded[path]


def pieces(path: str) -> pa.Array:
    """The table of pieces: the piece of every id of the vocabulary, at the id's place."""
    known = load_tokenizer(path).get_vocab(with_added_tokens=True)
    out = [""] * (max(known.values()) + 1)
    for piece, i in known.items():
        out[i] = piece
    return pa.array(out, pa.large_string())


def joined(ids: list[np.ndarray], table: pa.Array) -> pa.Array:
    """The text of each array of ids: every id's piece, by position, with a space between. An id without a piece is an error."""
    ends = np.cumsum([0, *map(len, ids)])
    flat = np.concatenate(ids) if len(ids) else np.zeros(0, np.uint32)
    own = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), table.take(pa.array(flat.astype(np.int64))))
    return pc.binary_join(own, pa.scalar(" ", pa.large_string())).cast(pa.string())


def word_table(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Every word that occurs twice or more: (word binary, n_all long, h long, ids binary), each encoded once and written."""
    counted = word_counts(docs.select(text).withColumn("all", F.lit(True)), text, ["all"], limit=DISTINCT_WORDS).where("n_all > 1")

    def run(batches):
        tokenizer = load_tokenizer(path)
        for batch in batches:
            ids = [np.asarray(tokenizer.encode(w.decode("utf-8"), add_special_tokens=False).ids, "<u4").tobytes() for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], names=["word", "n_all", "ids"])

    made = materialize(counted.select("word", "n_all").mapInArrow(trimmed(run), "word binary, n_all long, ids binary"), "bpe-words")
    return made.select("word", "n_all", F.xxhash64("word").alias("h"), "ids")


def _cut(words: DataFrame, most: int, memory: int) -> int:
    """The least count such that the words that have it or more are no more than `most` and take no more than `memory` bytes."""
    size = F.length("word") + F.length("ids") + ENTRY
    counts = words.where(F.length("word") <= HEAD_BYTES).groupBy("n_all").agg(F.count("*").alias("n"), F.sum(size).alias("size"))
    cut = 1 << 62
    for r in counts.orderBy(F.desc("n_all")).toLocalIterator():
        most, memory = most - r["n"], memory - r["size"]
        if most < 0 or memory < 0:
            break
        cut = r["n_all"]
    return cut


def tail_marks(tail: DataFrame) -> np.ndarray:
    """A bitmap of TAIL_BITS bits, set where the hash of a word of tail points."""
    place = F.pmod("h", F.lit(TAIL_BITS))
    spots = tail.select(F.shiftright(place, 15).alias("bucket"), place.bitwiseAND(32767).alias("spot")).repartition("bucket")
    out = np.zeros((TAIL_BITS >> 15, 4096), np.uint8)
    for r in spots.groupBy("bucket").agg(F.bitmap_construct_agg("spot").alias("bits")).toArrow().to_pylist():
        out[r["bucket"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def words_to_bytes(words: list[bytes]) -> bytes:
    """Words, which hold no white space, as compressed bytes."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(b" ".join(words)) if words else b""


def bytes_to_words(data: bytes) -> list[bytes]:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data).split() if data else []


def marked(marks: np.ndarray, words: list[bytes]) -> np.ndarray:
    """For each word whether its bit is set: true of every word of the tail and of few others."""
    import xxhash

    at = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(42)), np.uint64, len(words)) % np.uint64(TAIL_BITS)
    return (marks[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


class Head:
    """The frequent words in order of their hashes, hot ones by themselves too; ids of the word of rank i are
    ids[edge[i]:edge[i + 1]]. Ranks go by count, so that a text's frequent words have small numbers, which pack well."""

    def __init__(self, words: DataFrame):
        got = words.select("h", "word", "ids", "n_all").toArrow()
        h = got.column("h").to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(h)
        self.hash = h[order]
        self.words = got.column("word").combine_chunks().cast(pa.large_binary()).take(pa.array(order))
        ranked = np.argsort(-got.column("n_all").to_numpy(), kind="stable")
        self.rank = np.empty(len(order), np.int32)
        self.rank[ranked] = np.arange(len(order), dtype=np.int32)
        self.rank = self.rank[order]
        column = got.column("ids").combine_chunks().cast(pa.large_binary()).take(pa.array(ranked))
        if len(column):
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            self.edge = ((offsets - offsets[0]) // 4).astype(np.uint32)
            self.ids = np.frombuffer(column.buffers()[2], "<u4")[offsets[0] // 4 : offsets[-1] // 4].astype(np.uint32)
        else:
            self.edge, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)
        own = got.column("word").take(pa.array(ranked[:HOT_WORDS])).to_pylist()
        at = self.find(own, h[ranked[:HOT_WORDS]]).tolist()
        self.hot = {w: i for w, i in zip(own, at, strict=True) if i >= 0}

    def find(self, own: list[bytes], h: np.ndarray) -> np.ndarray:
        """The rank of each word, by its hash and then by comparison; -1 for a word that is not there.

        Of different words with one hash only the first is found here; the others are encoded as words outside the head are.
        """
        if not len(self.hash) or not own:
            return np.full(len(own), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        same = pc.equal(self.words.take(pa.array(at)), pa.array(own, pa.large_binary())).to_numpy(zero_copy_only=False)
        return np.where(same, self.rank[at], -1)


class Finder:
    """Places texts' words in the head; what is not there is numbered by text."""

    def __init__(self, head: Head):
        import xxhash

        self.head, self.digest = head, xxhash.xxh64_intdigest

    def place(self, bodies: list[bytes | None]) -> list[tuple[np.ndarray, list[bytes]]]:
        """For each text the rank in the head of every word, or -1-j for the text's j-th distinct missing word, and the missing words."""
        split = [(b or b"").split() for b in bodies]
        words = [w for own in split for w in own]
        ends = np.cumsum([len(own) for own in split])
        out = np.fromiter(map(self.head.hot.get, words, repeat(-1)), np.int32, len(words))
        open_ = np.flatnonzero(out < 0)
        own = [words[i] for i in open_.tolist()]
        h = np.fromiter((self.digest(w, 42) for w in own), np.uint64, len(own))
        found = self.head.find(own, h)
        out[open_] = found
        missing: list[dict[bytes, int]] = [{} for _ in bodies]
        gone = np.flatnonzero(found < 0)
        for j, i, text in zip(gone.tolist(), open_[gone].tolist(), np.searchsorted(ends, open_[gone], side="right").tolist(), strict=True):
            out[i] = -1 - missing[text].setdefault(own[j], len(missing[text]))
        return list(zip(np.split(out, ends[:-1]), map(list, missing), strict=True)) if bodies else []

    def ids(self, at: np.ndarray, missing: list[np.ndarray]) -> np.ndarray:
        """The ids of a text from its words' places and the missing words' ids."""
        edge, n = self.head.edge, len(self.head.edge) - 1
        own_edge = np.concatenate(([0], np.cumsum([len(x) for x in missing]))) if missing else np.zeros(1, np.int64)
        rare = at < 0
        safe = np.where(rare, 0, at)
        start = np.where(rare, own_edge[np.where(rare, -1 - at, 0)], edge[safe] if n else 0)
        size = np.where(rare, np.diff(own_edge)[np.where(rare, -1 - at, 0)] if missing else 0, (edge[safe + 1] - edge[safe]) if n else 0).astype(np.int64)
        ends = np.cumsum(size)
        inner = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - ends + size, size)
        if not rare.any():
            return self.head.ids[inner]
        local, from_rare = np.concatenate(missing).astype(np.uint32), np.repeat(rare, size)
        out = np.empty(len(inner), np.uint32)
        out[from_rare], out[~from_rare] = local[inner[from_rare]], self.head.ids[inner[~from_rare]]
        return out


def groups(batches, text: str):
    """Rows of each batch with the bytes of their texts, a bounded group at a time."""
    for big in batches:
        for batch in (big.slice(i, GROUP) for i in range(0, big.num_rows, GROUP)):
            bodies = as_bytes(batch.column(text))
            block = np.cumsum([len(b or b"") for b in bodies]) // GROUP_BYTES
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                yield batch.slice(a, b - a), bodies[a:b]


def encode(docs: DataFrame, text: str = "text", path: str | None = None, head_words: int = HEAD_WORDS) -> DataFrame:
    """docs without the text and with `ids` (binary: little-endian unsigned 32-bit) and `decoded` (string), of whole texts.

    Columns of docs named ids or decoded are replaced. A null or empty text has no ids and decodes to the empty string.
    Repeated rows stay repeated. No column but the text is looked at.
    """
    path = path or default_tokenizer()
    spark = docs.sparkSession
    docs = docs.drop(*(c for c in docs.columns if c in ("ids", "decoded") and c != text))
    words = word_table(docs, path, text)
    in_head = (F.col("n_all") >= _cut(words, head_words, HEAD_MEMORY)) & (F.length("word") <= HEAD_BYTES)
    head = spark.sparkContext.broadcast(Head(words.where(in_head)))
    tail = words.where(~in_head)
    marks = spark.sparkContext.broadcast(tail_marks(tail))
    kept = [c for c in docs.columns if c != text]
    schema = fields(docs.select(*kept), "ids binary, decoded string")

    def once(word: bytes) -> np.ndarray:
        return np.asarray(load_tokenizer(path).encode(word.decode("utf-8"), add_special_tokens=False).ids, np.uint32)

    def finished(batch, ids: list[np.ndarray], table: pa.Array):
        arrays = [batch.column(c) for c in kept] + [pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), joined(ids, table)]
        return pa.RecordBatch.from_arrays(arrays, names=[*kept, "ids", "decoded"])

    def pack(batches):
        import xxhash
        from pyspark import TaskContext

        finder, salt = Finder(head.value), TaskContext.get().partitionId()
        for batch, bodies in groups(batches, text):
            placed = finder.place(bodies)
            keys = [xxhash.xxh3_64_intdigest(b or b"", salt) - (1 << 63) for b in bodies]
            arrays = [batch.column(c) for c in kept]
            arrays += [pa.array(keys, pa.int64()), pa.array([squeeze(at) for at, _ in placed], pa.binary()), pa.array([words_to_bytes(m) for _, m in placed], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "__key", "__at", "__rare"])

    def ask(batches):
        for batch in batches:
            rare = [bytes_to_words(x) for x in batch.column("__rare").to_pylist()]
            words = [w for own in rare for w in own]
            keys = np.repeat(batch.column("__key").to_numpy(zero_copy_only=False), [len(own) for own in rare])
            own = np.flatnonzero(marked(marks.value, words))
            yield pa.RecordBatch.from_arrays([pa.array(keys[own], pa.int64()), pa.array([words[i] for i in own.tolist()], pa.binary())], names=["__key", "word"])

    def unpack(batches):
        finder, table = Finder(head.value), pieces(path)
        for batch in batches:
            ids = []
            for at, rare, found in zip(*(batch.column(c).to_pylist() for c in ("__at", "__rare", "__found")), strict=True):
                own = {f["word"]: np.frombuffer(f["ids"], "<u4") for f in found or ()}
                ids.append(finder.ids(expand(at, np.int32), [own[w] if w in own else once(w) for w in bytes_to_words(rare)]))
            yield finished(batch, ids, table)

    # dealt by key once: ask() takes every column, so that both of its readers share the exchange
    packed = docs.select(*kept, text).mapInArrow(trimmed(pack), fields(docs.select(*kept), "__key long, __at binary, __rare binary")).repartition("__key")
    asked = packed.mapInArrow(trimmed(ask), "__key long, word binary")
    found = asked.join(tail.select("word", "ids"), "word").groupBy("__key").agg(F.collect_set(F.struct("word", "ids")).alias("__found"))
    return packed.join(found, "__key", "left").mapInArrow(trimmed(unpack), schema)


def decode(rows: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """rows with `decoded`: every id of the array or little-endian binary `ids` joined to its piece, by position, with a
    space between. A null `ids` decodes to null; an id that is no piece's is an error."""
    path = path or default_tokenizer()
    rows = rows.drop(*(c for c in rows.columns if c == "decoded" and c != ids))
    names, packed = rows.columns, rows.schema[ids].dataType.simpleString() == "binary"

    def run(batches):
        table = pieces(path)
        for batch in batches:
            own = batch.column(ids)
            lists = [np.frombuffer(x or b"", "<u4") if packed else np.asarray(x or [], np.int64) for x in own.to_pylist()]
            out = pc.if_else(own.is_valid(), joined(lists, table), pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*names, "decoded"])

    return rows.mapInArrow(trimmed(run), fields(rows, "decoded string"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of ids and digests of ids and decoded text of every row of documents: null and empty texts have no ids, repeated
    rows and ids stay, further columns are not read, and an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode(docs)
    return out.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
