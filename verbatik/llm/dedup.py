"""Near-duplicate documents by DartMinHash signatures, joined in bands and checked exactly.

A weighted set throws darts: for every element the plane of (weight, rank) holds a hashed Poisson process of darts, the same
for every set. The darts below the element's weight count for a set; each has a hashed coordinate, and the one of the least
rank in each of k coordinates makes the signature. Two signatures agree in a coordinate with the probability of the sets'
weighted Jaccard similarity. Ranks are enumerated only as far as a set of its total weight needs, so a signature takes time
in the order of k log k + elements.

Documents with equal shingle sets form one class. Classes that share a band are compared with that class of the band which
meets most others in all its bands, the middle of a group of edited copies, and what is linked is merged. Every class that a
band still holds apart from the band's main component is then compared with all that the band holds of other components,
unless the shingles that only it has, what both have in common with the band's middle, or the sizes, rule a link out. So no
link between two classes that share a band is lost. Every link is a Jaccard similarity of `threshold` or more, counted on the whole shingle sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatik.llm.common import as_bytes, discard, give_back, materialize, table, trimmed

#: Words in a shingle; least similarity; bands and rows of a band. At 0.8 a pair shares no band with probability 0.00007.
WORDS, THRESHOLD, BANDS, ROWS = 5, 0.8, 24, 5
#: What stands for a null id where ids are compared.
NO_ID = -(1 << 63)
#: Word hashes that a task keeps.
CACHE = 400_000
#: Bits of the bitmap of ids that is broadcast (4 MB at most): with more ids it lets more rows pass to the exact join.
ID_BITS = 1 << 25

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Rank strips: [0, 1/32), then doubling to 1, then of one unit each.
_DOUBLING = 5


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def strip(i: int) -> tuple[float, float]:
    """Lower end and width of rank strip i."""
    if i > _DOUBLING:
        return float(i - _DOUBLING), 1.0
    return (0.0, 2.0**-_DOUBLING) if i == 0 else (2.0 ** (i - 1 - _DOUBLING), 2.0 ** (i - 1 - _DOUBLING))


def _poisson_cdf(mean: float) -> np.ndarray:
    p, total, out = math.exp(-mean), 0.0, []
    for n in range(40):
        total += p
        out.append(total)
        p *= mean / (n + 1)
    return np.asarray(out)


_CDF = {w: _poisson_cdf(w) for w in {strip(i)[1] for i in range(_DOUBLING + 2)}}


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, k: int) -> np.ndarray:
    """(n, k) uint64 signatures of n weighted sets; set i has the elements (uint64) whose owner is i. Sets must not be empty."""
    total = np.bincount(owner, weights=weights, minlength=n)
    theta = (k * math.log(k) + 2 * k) / total
    out = np.zeros((n, k), np.uint64)
    todo = np.arange(n)
    copies = np.ceil(weights).astype(np.int64)
    at = np.repeat(np.arange(len(elements)), copies)
    part = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
    cell = mix(elements[at] + part.astype(np.uint64) * _M3)
    cell_owner, room = owner[at], weights[at] - part
    while len(todo):
        place = np.full(n, -1)
        place[todo] = np.arange(len(todo))
        own = place[cell_owner]
        live = own >= 0
        cells, owners, rooms = cell[live], own[live], room[live]
        limit = theta[todo][owners]
        found_key, found_rank, found_value = [], [], []
        i, top = 0, float(limit.max())
        while (low := strip(i)[0]) < top:
            width = strip(i)[1]
            if i and not (limit > low).all():
                keep = limit > low
                cells, owners, rooms, limit = cells[keep], owners[keep], rooms[keep], limit[keep]
            h = mix(cells + np.uint64((i + 1) * 0xD1342543DE82EF95 % (1 << 64)))
            darts = np.searchsorted(_CDF[width], _unit(h), side="right")
            hit = np.flatnonzero(darts)
            times = darts[hit]
            which = np.repeat(hit, times)
            turn = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
            dart = mix(h[which] + (turn + 1).astype(np.uint64) * _M3)
            rank = low + width * _unit(mix(dart + _M1))
            good = (_unit(mix(dart + _M2)) < rooms[which]) & (rank < limit[which])
            dart = dart[good]
            found_key.append(owners[which][good] * k + (dart % np.uint64(k)).astype(np.int64))
            found_rank.append(rank[good])
            found_value.append(dart)
            i += 1
        key, rank, value = (np.concatenate(x) for x in (found_key, found_rank, found_value))
        order = np.argsort(rank, kind="stable")[::-1]
        filled = np.zeros(len(todo) * k, bool)
        least = np.zeros(len(todo) * k, np.uint64)
        filled[key] = True
        least[key[order]] = value[order]
        done = filled.reshape(-1, k).all(axis=1)
        out[todo[done]] = least.reshape(-1, k)[done]
        todo = todo[~done]
        theta[todo] *= 2
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) int64 keys of the bands of (n, bands * rows) signatures."""
    parts = signature.reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _M3, parts.shape[:2]).copy()
    for i in range(rows):
        key = mix(key * _M1 + parts[:, :, i])
    return key.view(np.int64)


class Shingler:
    """Hashes of the shingles of a text: runs of `size` lower-case words, or all words of a shorter text as one."""

    def __init__(self, size: int = WORDS):
        import xxhash

        self.size, self.hash, self.known = size, xxhash.xxh3_64_intdigest, {}

    def all(self, body: bytes | None) -> np.ndarray:
        words = (body or b"").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > CACHE:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.hash(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.size, len(words))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out = mix(out * _M3 + h[i : len(h) - n + 1 + i])
        return out

    def distinct(self, body: bytes | None, counted: bool = False) -> np.ndarray:
        """Ascending elements of the text's set. counted: the i-th occurrence of a shingle is an element of its own, so that
        plain Jaccard of such sets is the Jaccard similarity weighted by occurrences."""
        if not counted:
            return np.unique(self.all(body))
        shingles, times = np.unique(self.all(body), return_counts=True)
        turn = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        return np.unique(mix(np.repeat(shingles, times) + turn.astype(np.uint64) * _M2))


def sketch(docs: DataFrame, key: str, text: str, weighting: str = "set", words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, text_hash, d1, d2, n, bands array<long>) of every row: digest and size of its set of shingles, keys of the bands.

    weighting `set` gives every shingle the weight 1, so that similarity is Jaccard's; `count` weighs it by its occurrences,
    and n is the number of shingles with repeats. A text without words has n 0 and no bands; the digest is then of the text.
    """
    counted = weighting == "count"

    def run(batches):
        import xxhash

        shingler = Shingler(words)
        for batch in batches:
            bodies = as_bytes(batch.column("body"))
            for lo in range(0, len(bodies), 256):
                some = bodies[lo : lo + 256]
                sets = [np.unique(shingler.all(b), return_counts=True) for b in some]
                digests = [xxhash.xxh3_128_digest(s.tobytes() + (t.tobytes() if counted else b"") if len(s) else b"\0" + (b or b"")) for b, (s, t) in zip(some, sets, strict=True)]
                pairs = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                sizes = np.asarray([len(s) for s, _ in sets])
                live = np.flatnonzero(sizes)
                keys: list = [[] for _ in some]
                if len(live):
                    elements = np.concatenate([sets[i][0] for i in live])
                    weights = np.concatenate([sets[i][1] for i in live]).astype(np.float64) if counted else np.ones(len(elements))
                    signed = signatures(elements, weights, np.repeat(np.arange(len(live)), sizes[live]), len(live), bands * rows)
                    for i, row in zip(live.tolist(), band_keys(signed, bands, rows).tolist(), strict=True):
                        keys[i] = row
                whole = np.asarray([t.sum() for _, t in sets]) if counted else sizes
                own = [batch.column(c)[lo : lo + 256] for c in ("id", "text_hash")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(whole), pa.array(keys, pa.list_(pa.int64()))], names=["id", "text_hash", "d1", "d2", "n", "bands"])

    body = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("body"))
    return body.mapInArrow(trimmed(run), "id long, text_hash long, d1 long, d2 long, n long, bands array<long>")


def of_nodes(rows: DataFrame, nodes: DataFrame, on: tuple[str, ...] = ("node",)) -> DataFrame:
    """The rows whose columns `on` are those of one of nodes, with the other columns of nodes. A bitmap of hashes, of bounded
    size, spares most other rows the shuffle. `on` must hold no null."""
    place = F.pmod(F.xxhash64(*on), F.lit(ID_BITS))
    spots = nodes.select(F.shiftright(place, 15).alias("bucket"), place.bitwiseAND(32767).alias("spot")).repartition("bucket")
    bitmap = spots.groupBy("bucket").agg(F.bitmap_construct_agg("spot").alias("bits"))
    is_set = F.expr("cast(conv(hex(substring(bits, cast(spot div 8 as int) + 1, 1)), 16, 10) as int) & shiftleft(1, cast(spot % 8 as int)) <> 0")
    near = rows.withColumns({"bucket": F.shiftright(place, 15), "spot": place.bitwiseAND(32767)}).join(F.broadcast(bitmap), "bucket").where(is_set)
    # an inner join with distinct ids: a semi join would be moved below the bitmap
    return near.select(rows.columns).join(nodes.distinct(), [*on])


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, a_n, b_n, both) of pairs (a, b): sizes of their shingle sets (node, shingles binary) and of the intersection."""

    def run(batches):
        for batch in batches:
            found = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                found.append((len(p), len(q), len(np.intersect1d(p, q, assume_unique=True))))
            counts = np.asarray(found, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *(pa.array(c) for c in counts.T)], names=["a", "b", "a_n", "b_n", "both"])

    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(trimmed(run), "a long, b long, a_n long, b_n long, both long")


def linked(counted: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of overlaps() that have a Jaccard similarity of threshold or more."""
    return counted.where(F.col("both") >= threshold * (F.col("a_n") + F.col("b_n") - F.col("both")) - 1e-9).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b): the least node that it is connected to.

    Each round takes the least label of a node's neighbours and then the label of that label, until none changes; nothing of
    it is collected.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("component")), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        stepped = labels.join(near, "node").select("node", F.least("component", "m").alias("c"), F.col("component").alias("old"))
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("cc"))
        new = materialize(stepped.join(jump, "c", "left").select("node", F.least("c", F.coalesce("cc", "c")).alias("component"), "old"), "cc-labels")
        moved = new.where("component <> old").limit(1).count()
        discard(labels)
        labels = new.drop("old")
        labels._scratch_path = new._scratch_path
        if not moved:
            discard(both)
            return labels


def shingle_sets(docs: DataFrame, key: str, text: str, nodes: DataFrame, words: int, counted: bool = False) -> DataFrame:
    """(node, shingles binary): the sorted elements of the set of each of nodes (node, id, text_hash), from one of its rows."""

    def run(batches):
        shingler = Shingler(words)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sets = [shingler.distinct(b, counted).tobytes() for b in as_bytes(part.column("body"))]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"])

    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("body"))
    found = of_nodes(rows, nodes, ("id", "text_hash")).select("node", "body")
    return found.mapInArrow(trimmed(run), "node long, shingles binary").dropDuplicates(["node"])


def own_shingles(sets: DataFrame) -> DataFrame:
    """(node, own): how many of its shingles no other row of sets (node, shingles) has; nodes without any have no row."""

    def run(batches):
        for batch in batches:
            for node, data in zip(batch.column("node").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
                h = np.frombuffer(data, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), node)), pa.array(h)], names=["node", "shingle"])

    held = sets.select("node", "shingles").mapInArrow(trimmed(run), "node long, shingle long").groupBy("shingle").agg(F.count("*").alias("m"), F.min("node").alias("node"))
    return held.where("m = 1").groupBy("node").agg(F.count("*").alias("own"))


def compared(able: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the pairs of classes of one band and two components that the bounds of able (band, node, n, component, main,
    within, beyond, most) don't rule out, each once, however many bands hold both."""
    share = threshold / (1 + threshold)
    # the same bound against the least of sizes and the most of shingles in the band leaves out what can meet no other
    bounds = able.groupBy("band").agg(F.min("n").alias("n_min"), F.max("within").alias("within_max"), F.max("beyond").alias("beyond_max"))
    reach = F.least(F.col("most"), F.least("within", "within_max") + F.least("beyond", "beyond_max"))
    least_n = F.greatest(F.col("n_min").cast("double"), F.col("n") * threshold)
    strays = able.where("component <> main").join(bounds, "band").where(reach >= (F.col("n") + least_n) * share - 1e-6)
    # two classes are compared in the first band that holds both, once: what a band's bounds rule out is no link in any other
    held = able.groupBy("node").agg(F.collect_set("band").alias("bands"))
    strays = strays.join(held, "node").select("band", *(F.col(c).alias(f"a_{c}") for c in ("node", "n", "component", "within", "beyond", "most", "bands")))
    others = able.join(strays.select("band").distinct(), "band").withColumn("in_main", F.col("component") == F.col("main")).join(held, "node")
    others = others.select("band", *(F.col(c).alias(f"b_{c}") for c in ("node", "n", "component", "within", "beyond", "most", "bands", "in_main")))
    reach = F.least("a_most", "b_most", F.least("a_within", "b_within") + F.least("a_beyond", "b_beyond"))
    once = (F.col("b_in_main") | (F.col("a_node") < F.col("b_node"))) & (F.array_min(F.array_intersect("a_bands", "b_bands")) == strays["band"])
    second = strays.join(others, (strays["band"] == others["band"]) & (F.col("a_component") != F.col("b_component")) & (reach >= (F.col("a_n") + F.col("b_n")) * share - 1e-6) & once)
    return second.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, weighting: str = "set", words: int = WORDS, bands: int = BANDS, rows: int = ROWS, detail: bool = False) -> DataFrame:
    """(id, class_id) of every row of docs: the least id that it is linked to, over any number of links.

    Null and empty texts are copies of each other; other texts without words are alike only if equal. Texts of fewer than
    `words` words are one shingle. Rows that repeat an id with other texts are documents of their own. A row without an id is
    linked like others; a class of such rows alone has a null class_id. Further columns are not looked at; an empty table
    gives no rows. detail adds text_hash (xxhash64 of the text) and leads: whether the row is its class's first by id (null
    last) and then by text_hash.
    """
    counted_sets = weighting == "count"
    drawn = materialize(sketch(docs, key, text, weighting, words, bands, rows), "dedup-sketch")
    own_first = F.min(F.struct(F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(NO_ID)).alias("id"), "text_hash")).alias("lead")
    # a node's number only has to tell groups apart; it is written before it is used
    groups = drawn.groupBy("d1", "d2").agg(own_first, F.first("n").alias("n"), F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id())
    groups = materialize(groups, "dedup-groups")
    members = groups.select("node", "n", F.explode("bands").alias("band"))
    together = members.groupBy("band").agg(F.count("*").alias("m")).where("m > 1")
    met = materialize(members.join(together, "band").select("band", "node", "n", "m"), "dedup-met")
    degree = met.groupBy("node").agg(F.sum(F.col("m") - 1).alias("degree"))
    top = met.join(degree, "node").groupBy("band").agg(F.max(F.struct("degree", (-F.col("node")).alias("minus"), "n")).alias("top"))
    shared = materialize(met.join(top, "band").select("band", "node", "n", (-F.col("top.minus")).alias("rep"), F.col("top.n").alias("rep_n")), "dedup-shared")
    discard(met)
    close = (F.col("n") >= F.col("rep_n") * (threshold - 1e-9)) & (F.col("rep_n") >= F.col("n") * (threshold - 1e-9))
    first = shared.where((F.col("node") != F.col("rep")) & close).select(F.least("node", "rep").alias("a"), F.greatest("node", "rep").alias("b")).distinct()
    pairs = materialize(first, "dedup-pairs")
    involved = groups.join(shared.select("node").distinct(), "node").select("node", "lead.id", "lead.text_hash")
    sets = materialize(shingle_sets(docs, key, text, involved, words, counted_sets), "dedup-sets")
    counted = materialize(overlaps(pairs, sets), "dedup-counted")
    edges = materialize(linked(counted, threshold), "dedup-edges")
    labels = components(edges)
    give_back(docs.sparkSession)
    # what a band holds besides its main component is compared with all of other components in it
    placed = shared.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = placed.groupBy("band", "component").agg(F.count("*").alias("m"))
    main = sizes.groupBy("band").agg(F.max_by("component", "m").alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    apart = materialize(placed.join(main, "band"), "dedup-apart")
    # a shingle that one class alone has is shared with none: overlap <= n - own. Of the middle's shingles two classes share
    # at most what either has of them, of others at most what either has besides its own. A similarity of t needs an overlap
    # of t / (1 + t) of both sizes
    looked_at = apart.select("node").unionByName(apart.select(F.col("rep").alias("node"))).distinct()
    own = own_shingles(of_nodes(sets, looked_at))
    common = counted.select(F.col("a").alias("least"), F.col("b").alias("most"), "both")
    able = apart.join(own, "node", "left").withColumns({"own": F.coalesce("own", F.lit(0)), "least": F.least("node", "rep"), "most": F.greatest("node", "rep")}).join(common, ["least", "most"], "left").drop("least", "most")
    able = able.withColumn("within", F.when(F.col("node") == F.col("rep"), F.col("n") - F.col("own")).otherwise(F.coalesce("both", F.least("n", "rep_n"))))
    able = able.withColumn("beyond", F.when(F.col("node") == F.col("rep"), F.lit(0)).when(F.col("both").isNull(), F.col("n") - F.col("own")).otherwise(F.col("n") - F.col("both") - F.col("own")))
    able = able.withColumn("most", F.least(F.col("n") - F.col("own"), F.col("within") + F.col("beyond"))).where(F.col("most") >= F.col("n") * threshold - 1e-9)
    able = materialize(able.select("band", "node", "n", "component", "main", "within", "beyond", "most"), "dedup-able")
    second = compared(able, threshold).join(pairs, ["a", "b"], "left_anti")
    second = materialize(second, "dedup-pairs")
    ends = second.select(F.col("a").alias("node")).unionByName(second.select(F.col("b").alias("node"))).distinct()
    more = materialize(linked(overlaps(second, of_nodes(sets, ends)), threshold), "dedup-edges")
    if more.limit(1).count():
        labels = components(edges.unionByName(more))
    for done in (sets, apart, able, shared, pairs, second, counted):
        discard(done)
    known = groups.join(labels, "node", "left").select("d1", "d2", "lead", F.coalesce("component", "node").alias("component"))
    first = known.groupBy("component").agg(F.min("lead").alias("first"))
    known = known.join(first, "component").select("d1", "d2", F.when(~F.col("first.none"), F.col("first.id")).alias("class_id"), "first")
    out = drawn.join(known, ["d1", "d2"], "left")
    if not detail:
        return out.select("id", "class_id")
    leads = (F.coalesce("id", F.lit(NO_ID)) == F.col("first.id")) & (F.col("text_hash") == F.col("first.text_hash"))
    return out.select("id", "class_id", "text_hash", leads.alias("leads"))


def op2_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, class_id, kept) of every row of documents; kept marks the rows of a class's least doc_id.

    Null and empty texts are one class; null ids are linked but have no class of their own; repeated ids are documents of
    their own; further columns are not read; an empty table gives no rows.
    """
    found = classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "class_id", (F.col("id") == F.col("class_id")).alias("kept"))
