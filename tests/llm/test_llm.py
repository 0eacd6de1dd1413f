"""The operators of verbatik.llm against brute force, round trips or held-out accuracy, on small and on odd tables."""

import collections
import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest

from verbatik.llm import ann, bpe, chat, dedup, extract, language, licence, mixing, score, winnow
from verbatik.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, size long, score string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and extra columns with names of results."""
    long_text = " ".join(f"wort{i % 977}" for i in range(30_000))
    rows = [(1, "Hello wide world <|endoftext|> naïve ½", "en", "a"), (2, None, None, None), (3, "", "en", "b"), (4, "123 456 !!", "fr", "a"), (4, "123 456 !!", "fr", "a"), (None, "no id here at all", "en", "a"), (7, long_text, "de", None), (8, "   x\x1cy Å Å", "en", "é"), (9, "the same five words here now", "en", "b"), (10, "the same five words here now", "en", "b")]
    return spark.createDataFrame([(*r, None, "ids", 5, "s") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe(spark, odd, empty):
    tokenizer = bpe.load_tokenizer(bpe.default_tokenizer())
    for head in (bpe.HEAD_WORDS, 3):
        got = bpe.encode(odd, head_words=head).collect()
        assert len(got) == odd.count()
        want = collections.Counter()
        for r in odd.collect():
            ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
            want[(r["doc_id"], tuple(ids), tokenizer.decode(ids, skip_special_tokens=False))] += 1
        assert collections.Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist()), r["decoded"]) for r in got) == want
    assert bpe.encode(empty).count() == 0
    once = bpe.encode(odd).drop("decoded")
    assert {(r["doc_id"], r["decoded"]) for r in bpe.decode(once).collect()} == {(r["doc_id"], r["decoded"]) for r in bpe.encode(odd).collect()}


def test_bpe_words_that_share_a_hash_are_told_apart(spark):
    rows = [(w.encode(), 2, h, np.asarray(ids, "<u4").tobytes()) for w, h, ids in [("alpha", 7, [1, 2]), ("beta", 7, [3]), ("gamma", -5, [4])]]
    head = bpe.Head(spark.createDataFrame(rows, "word binary, n_all long, h long, ids binary"))
    own = [b"alpha", b"beta", b"gamma", b"delta"]
    at = head.find(own, np.asarray([7, 7, -5, 7]).view(np.uint64)).tolist()
    found = {w: head.ids[head.edge[i] : head.edge[i + 1]].tolist() for w, i in zip(own, at) if i >= 0}
    ids = {b"alpha": [1, 2], b"beta": [3], b"gamma": [4]}
    assert len(found) == 2 and b"gamma" in found and all(ids[w] == x for w, x in found.items())
    assert set(head.hot) == set(found)


def test_bpe_head_is_bounded_in_bytes(spark):
    words = spark.createDataFrame([(b"a" * 10, 9, b"1234"), (b"b" * 10, 5, b"1234"), (b"c" * 10, 5, b"1234"), (b"d" * 300, 99, b"1234")], "word binary, n_all long, ids binary")
    one = 10 + 4 + bpe.ENTRY
    assert [bpe._cut(words, 10, n * one) for n in (3, 2, 1)] == [5, 9, 9]
    assert bpe._cut(words, 0, 3 * one) > 99


def test_bpe_decode_of_unknown_ids_fails(spark):
    rows = spark.createDataFrame([(1, [3, 4]), (2, None), (3, [])], "doc_id long, ids array<long>")
    tokenizer = bpe.load_tokenizer(bpe.default_tokenizer())
    assert {r["doc_id"]: r["decoded"] for r in bpe.decode(rows).collect()} == {1: tokenizer.decode([3, 4], skip_special_tokens=False), 2: None, 3: ""}
    with pytest.raises(Exception, match="out of bounds"):
        bpe.decode(spark.createDataFrame([(1, [1 << 40])], "doc_id long, ids array<long>")).collect()


def test_language(spark, odd, empty):
    got = {(r["doc_id"], r["text"]): r for r in language.identify(odd).collect()}
    assert got[(2, None)]["lang_pred"] == got[(3, "")]["lang_pred"] == got[(4, "123 456 !!")]["lang_pred"] == "und"
    assert language.identify(empty).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = language.identify(docs).where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in held)


def test_language_prior_does_not_outweigh_long_texts(spark):
    log_p = np.zeros((language.BUCKETS + 1, 2), np.float32)
    log_p[:-1] = -10, -9.9
    model = language.Model(["hot", "rare"], log_p, np.log([0.9999, 0.0001]))
    rows = spark.createDataFrame([("abc ",), ("abc " * 50,)], "text string")
    got = {len(r["text"]): r for r in language.predict(rows, model).collect()}
    assert (got[4]["lang_pred"], got[200]["lang_pred"]) == ("hot", "rare")
    odds = np.exp(0.1 * language.EVIDENCE) * 0.0001 / 0.9999
    assert got[200]["score"] == pytest.approx(odds / (1 + odds), rel=1e-3)


def test_winnow():
    rng = random.Random(1)
    for _ in range(30):
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 900)))
        got = list(zip(*map(list, winnow.winnow(text, 16, 20)), strict=True))
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        if len(text) < 16:
            assert len(got) == bool(text)
            continue
        hashes, w, want = winnow._hashes(points, 16).tolist(), min(20, len(text) - 15), []
        for i in range(len(hashes) - w + 1):
            window = hashes[i : i + w]
            at = i + max(j for j in range(w) if window[j] == min(window))
            if not want or want[-1][1] != at:
                want.append((hashes[at], at))
        assert got == want


def test_winnow_matches_are_found():
    rng = random.Random(2)
    part = "".join(rng.choice("abcdefgh ") for _ in range(winnow.GRAM + winnow.WINDOW - 1))
    a, b = ("".join(rng.choice("xyz") for _ in range(300)) + part + "q" * k for k in (5, 77))
    assert set(winnow.winnow(a)[0].tolist()) & set(winnow.winnow(b)[0].tolist())


def test_winnow_short_texts_keep_their_likeness():
    rng = random.Random(4)
    near = []
    for n in [*range(24, 79)] * 4:
        own, after = ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)) for _ in range(2))
        sets = [np.unique(winnow.winnow(t)[0]) for t in (own, own[: n - n // 4] + after[: n // 4], after)]
        near.append(winnow.likeness(sets[0], sets[1]))
        assert winnow.likeness(sets[0], sets[2]) == 0
    assert np.mean(np.asarray(near) == 0) < 0.05 and np.median(near) > 0.4


def test_winnow_order(spark, odd, empty):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = dict(sorted((r["doc_id"], r["text"]) for r in rows.collect()))
    ids = list(texts)
    for r in winnow.edited_likeness(rows).collect():
        own, after = texts[r["doc_id"]], texts[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]]
        cut = len(own) - len(own) // 4
        edited = own[:cut] + after[: len(own) // 4]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (np.unique(winnow.winnow(t)[0]) for t in (own, edited, after))
        assert (r["near_edited"], r["near_next"]) == (winnow.likeness(a, b), winnow.likeness(a, c))
    assert winnow.edited_likeness(odd).count() == odd.count()
    assert winnow.edited_likeness(empty).count() == 0


def test_chat_round_trip(spark):
    odd_text = "a\\<|im_end|><|image|>\\n<"
    messages = [("us\ner", [{"type": "text", "text": odd_text}, {"type": "image", "ref": "i", "width": 29, "height": 28}]), ("assistant", [{"type": "audio", "ref": "s", "seconds": 1.5}, {"type": "text", "text": odd_text}, {"type": "document", "ref": "d", "pages": 2}])]
    formatted, attachments, spans = chat.render(messages)
    assert [(r, [p.get("text") or p["type"] for p in ps]) for r, ps in chat.parse(formatted)] == [(r, [p.get("text") or p["type"] for p in ps]) for r, ps in messages]
    assert [(a["type"], a["tokens"], a["turn"]) for a in attachments] == [("image", 2, 0), ("audio", 38, 1), ("document", 2048, 1)]
    assert len(spans) == 1
    rows = spark.createDataFrame([(1, 1, "assistant", None), (1, 0, "user", "x"), (None, None, None, "y"), (1, 1, "assistant", "<|im_end|>")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(chat.text_messages(rows))).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 10
    assert got[1]["loss_sha256"] == hashlib.sha256(b"<|im_end|>").hexdigest()
    assert chat.read_back(chat.format_conversations(chat.text_messages(rows.limit(0)))).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want, got = con.sql(ORACLE_SQL[name]).df(), QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns) and len(want)
    rows = lambda d: sorted(map(repr, d[columns].astype(object).where(d[columns].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)
    assert name != "op8_chat" or -1 in set(got["conv_id"])


@pytest.mark.parametrize("name", ["op2_dart_minhash", "op6_winnow"])
def test_query_of_odd_texts_against_sql(spark, tmp_path, name):
    base = " ".join(f"w{i}" for i in range(100))
    texts = [None, "", "abc", "ABC", "  ", "seven77", "eight888", "é" * 15, "é" * 16, "a\nb" * 9, base, edited(base, 3), edited(edited(base, 3), 90), base.upper(), "one two\x0bthree", "one two three", "𝄞" * 20, "abc"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want, got = con.sql(ORACLE_SQL[name]).df(), QUERIES[name](spark, str(tmp_path)).toPandas()
    key = lambda d: d.sort_values("doc_id", ignore_index=True)[sorted(want.columns)].to_dict("list")
    assert key(got) == key(want)


def test_ann_query_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x, ids = np.stack(rows["embedding"]).astype(float), rows["vec_id"].to_numpy()
    got = ann.op1_ann(spark, sf).toPandas().groupby("query_id")["vec_id"].apply(set)
    hits = 0
    for q in np.flatnonzero(ids % 50 == 0)[:200]:
        if ids[q] % 20:
            continue
        order = np.lexsort((ids, -(x @ x[q])))
        hits += len(got[ids[q]] & set(ids[order[order != q][:20]].tolist())) / 20
    assert hits >= 0.95 * sum(ids[q] % 20 == 0 for q in np.flatnonzero(ids % 50 == 0)[:200])


def test_ann(spark):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((400, 24)).astype(np.float32)
    vectors[100:160] = vectors[7]
    data = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] * 24), (None, [1.0] * 24), (1003, [1.0, 2.0])]
    rows = ann.usable(spark.createDataFrame(data, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    rotations = ann.fit(rows)
    index = ann.build_index(rows, rotations)
    got = collections.defaultdict(list)
    for r in ann.search(index, index.where("id % 20 = 0").select("id", "vector"), rotations, 20).collect():
        got[r["query_id"]].append((r["rank"], r["id"], r["score"]))
    x, hits = vectors.astype(np.float64), 0
    for q in range(0, 400, 20):
        s = (x * x[q]).sum(axis=1)
        want = [i for i in np.lexsort((np.arange(400), -s)) if i != q][:20]
        own = [i for _, i, _ in sorted(got[q])]
        hits += len(set(own) & set(want))
        assert [p for p, _, _ in sorted(got[q])] == list(range(1, 21))
    assert hits >= 0.98 * 400
    assert 1003 not in {i for rs in got.values() for _, i, _ in rs}
    twice = ann.usable(spark.createDataFrame([(20, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [0.5, 0.5]), (40, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>"), "vec_id", "embedding")
    own = ann.fit(twice)
    table = ann.dealt(ann.build_index(twice, own), own, 5)
    found = ann.search(table, table.where("id % 20 = 0").select("id", "vector"), own, 3).collect()
    assert collections.Counter(r["query_id"] for r in found) == {20: 9, 40: 3}
    assert sorted((r["rank"], r["id"], r["score"]) for r in found if r["query_id"] == 40) == [(1, 3, 1.0), (2, 20, 0.5), (3, 20, 0.0)]
    assert sorted((r["id"], r["score"]) for r in found if r["query_id"] == 20 and r["rank"] == 1) == [(3, 1.0)] * 3
    none = rows.limit(0)
    assert ann.search(ann.build_index(none, {}), none, {}, 20).count() == 0


def test_knapsack():
    rng = np.random.default_rng(4)
    for _ in range(50):
        lengths = np.unique(rng.integers(1, 30, 6))
        counts, budget = rng.integers(0, 4, len(lengths)), int(rng.integers(1, 120))
        chosen = mixing.bounded_knapsack(lengths, counts, budget)
        reachable = {0}
        for size, n in zip(lengths.tolist(), counts.tolist(), strict=True):
            reachable = {s + size * k for s in reachable for k in range(n + 1)}
        assert (chosen <= counts).all() and (chosen >= 0).all()
        assert int((chosen * lengths).sum()) == max(s for s in reachable if s <= budget)
        near = int((mixing.bounded_knapsack(lengths, counts, budget, 9) * lengths).sum())
        assert abs(near - budget) == min(abs(s - budget) for s in reachable if s <= budget + 9)


def test_mixing(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.mix(docs).toPandas().merge(docs.select("doc_id", "source").toPandas(), on="doc_id")
    for _, g in got.groupby("source"):
        assert abs((g["size"] * g["copies"]).sum() - g["target"].iloc[0]) <= max(12, g["size"].min())
    assert got["copies"].between(0, 2).all()
    assert sorted(map(tuple, mixing.mix(docs).collect())) == sorted(map(tuple, mixing.mix(docs).collect()))
    assert mixing.mix(odd).count() == odd.count()
    assert mixing.mix(empty).count() == 0


def resharing():
    """Sources' sizes and the targets that resharing the excess again and again gives them."""
    rng = np.random.default_rng(9)
    for _ in range(6):
        sizes = rng.integers(0, 1000, rng.integers(1, 9)).astype(float)
        weights = [(3.0, 1.0, 2.0)[i % 3] for i in range(len(sizes))]
        left, open_, want = 1.5 * sizes.sum(), set(range(len(sizes))), np.zeros(len(sizes))
        while open_:
            own = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
            over = [i for i in open_ if own[i] > 2 * sizes[i]]
            for i in over or list(open_):
                want[i] = min(own[i], 2 * sizes[i])
                open_.discard(i)
            left -= sum(want[i] for i in over)
        yield [(chr(97 + i), int(n)) for i, n in enumerate(sizes)], want


def test_targets(spark):
    for rows, want in resharing():
        got = mixing.targets(spark.createDataFrame(rows, "source string, source_size long")).orderBy("source").toPandas()["target"]
        assert got.tolist() == pytest.approx(want.tolist(), abs=1e-6)


def test_fit_counts_is_nearest():
    rng = np.random.default_rng(11)
    for _ in range(60):
        lengths = np.unique(rng.integers(1, 40, 5))
        counts = rng.integers(1, 4, len(lengths))
        budget = int(rng.integers(1, int((lengths * counts).sum()) + 1))
        reachable = {0}
        for size, n in zip(lengths.tolist(), counts.tolist(), strict=True):
            reachable = {s + size * k for s in reachable for k in range(n + 1)}
        taken = mixing.fit_counts(lengths, counts, budget)
        assert (taken >= 0).all() and (taken <= counts).all()
        assert abs(int((taken * lengths).sum()) - budget) == min(abs(s - budget) for s in reachable)


def test_fit_counts_with_very_long_documents():
    rng = np.random.default_rng(12)
    for _ in range(100):
        lengths = np.unique(np.concatenate((rng.integers(1, 2000, 300), rng.integers(60_000, 400_000, 8))))
        counts = np.where(lengths < 2001, rng.integers(1, 30, len(lengths)), 1)
        budget = int(rng.integers(1, int((lengths * counts).sum())))
        taken = mixing.fit_counts(lengths, counts, budget)
        assert (taken >= 0).all() and (taken <= counts).all()
        assert abs(int((taken * lengths).sum()) - budget) <= lengths[0]
    lengths, counts = np.asarray([100, 200, 300, 500, 1000, 70_000, 90_000, 150_000]), np.asarray([3000] * 5 + [1] * 3)
    assert int((mixing.fit_counts(lengths, counts, 500_000) * lengths).sum()) == 500_000


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var x = "<p>no</p>";</script></head><body>
<header class="site"><h2>Site</h2></header><nav><a href="/">Menu</a></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head &amp; line %d</h1><p>First <b>bold<br>text %d<p>Second &lt;p&gt;</p><form><input>Ask</form><div class="ad">Buy</div><p>Shared by all</p></article>
<section id="comments"><p>A reader says</p></section><aside>Side</aside><footer>&copy; foot</footer></body></html>"""


def test_extract(spark):
    rows = spark.createDataFrame([(i, "http://h.org/x", PAGE % (i, i)) for i in range(6)] + [(7, None, None), (8, "http://one.org/", "<p>alone &amp; free</p>"), (9, "x", "")], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in extract.extract(rows).collect()}
    assert got[2] == "Head & line 2\n\nFirst bold text 2\n\nSecond <p>\n\nShared by all"
    assert (got[7], got[8], got[9]) == ("", "alone & free", "")
    assert extract.main_text(PAGE % (3, 3)) == "Head & line 3\n\nFirst bold text 3\n\nSecond <p>\n\nShared by all"
    assert extract.extract(rows.limit(0)).count() == 0


def plain_page(i: int, layout: int = 0) -> str:
    """A page that marks nothing: what all pages of its layout share is boilerplate."""
    words = " ".join(f"w{i}x{j}" for j in range(30))
    top = ["<div>Welcome to the site</div>", "<table><tr><td>Our other layout</td></tr></table>"][layout]
    return f"<body>{top}<div><p>Start of {i}</p><p>{words}</p><p>Follow us every day</p></div><div>Made by hand</div></body>"


def plain_text(i: int) -> str:
    return f"Start of {i}\n\n" + " ".join(f"w{i}x{j}" for j in range(30))


def test_templates_decide_on_pages_without_marks(spark, monkeypatch):
    rows = [(i, f"http://plain.org/{i}", plain_page(i, i % 2)) for i in range(40)] + [(i, f"http://two.org/{i}", plain_page(i)) for i in (100, 101)]
    pages = spark.createDataFrame(rows + rows[:20], "page_id long, url string, html string")
    for most in (extract.GROUP_PAGES, 7):
        monkeypatch.setattr(extract, "GROUP_PAGES", most)
        got = {r["page_id"]: r["text"] for r in extract.extract(pages).collect()}
        assert all(got[i] == plain_text(i) for i in range(40))
        assert got[100].startswith("Welcome to the site") and got[100].endswith("Made by hand")


def test_near_copies_of_a_page_make_no_template():
    story = " ".join(f"word{j}" for j in range(60))
    pages = [f"<body><p>Visit {i}</p><p>{story}</p></body>" for i in range(6)]
    assert extract.induce([extract.parse(x) for x in pages]) is None
    copies = [f"<article><p>visit {i}</p><p>{story}</p></article>" for i in range(6)]
    assert extract.main_text(copies[0], extract.induce([extract.parse(x) for x in copies])) == f"visit 0\n\n{story}"


def slow_match(a, b):
    """Weight of the best order-preserving match by trying everything."""
    if not a or not b:
        return 0
    x, y = a[0], b[0]
    best = max(slow_match(a[1:], b), slow_match(a, b[1:]))
    if x.tag == y.tag:
        best = max(best, 1 + (x.text == y.text if x.tag == "#" else slow_match(x.children, y.children)) + slow_match(a[1:], b[1:]))
    return best


def test_match_against_trying_everything():
    rng = random.Random(14)

    def tree(depth):
        out = []
        for _ in range(rng.randint(0, 4)):
            node = extract.Node(rng.choice(["#", "p", "div"]), rng.choice("ab"))
            if node.tag != "#" and depth:
                node.children = tree(depth - 1)
            out.append(node)
        return out

    for _ in range(150):
        a, b = tree(2), tree(2)
        pairs = extract.match(a, b)
        assert extract.size_of_match(a, b) == slow_match(a, b)
        assert all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:], strict=False))
        weight = sum(1 + (a[i].text == b[j].text if a[i].tag == "#" else slow_match(a[i].children, b[j].children)) for i, j in pairs)
        assert weight == slow_match(a, b)


def test_dedup_compares_two_classes_once(spark):
    # in each of bands 0 to 9 classes 1 and 2 are of its main component, 3 and 4 are not; 5 is in band 0 only and too small for all
    rows = [(band, node, 100, main, 1, 95, 0, 95) for band in range(10) for node, main in ((1, 1), (2, 1), (3, 3), (4, 4))] + [(0, 5, 30, 5, 1, 30, 0, 30)]
    able = spark.createDataFrame(rows, "band long, node long, n long, component long, main long, within long, beyond long, most long")
    assert sorted(tuple(r) for r in dedup.compared(able, 0.8).collect()) == [(1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]
    # main components differ from band to band: 1 is apart in band 7, 2 in band 8
    rows = [(7, 1, 100, 1, 2, 95, 0, 95), (7, 2, 100, 2, 2, 95, 0, 95), (8, 1, 100, 1, 1, 95, 0, 95), (8, 2, 100, 2, 1, 95, 0, 95)]
    assert [tuple(r) for r in dedup.compared(spark.createDataFrame(rows, able.schema), 0.8).collect()] == [(1, 2)]


def test_long_lists_are_matched_whole(monkeypatch):
    def page(i: int, before: int) -> str:
        return "".join(f"<p>{i} first {j}</p>" for j in range(before)) + "<ul><li>Follow us</li></ul>" + "".join(f"<div>{i} then {j}</div>" for j in range(200))

    pages = [page(0, 200), page(1, 200), page(2, 5), page(3, 5)]
    template = extract.induce([extract.parse(x) for x in pages])
    for x in pages:  # what is constant lies 97 places from its like place
        text = extract.main_text(x, template)
        assert "Follow us" not in text and text.count("\n\n") == x.count("<p>") + 199

    rng = random.Random(5)

    def node(depth: int):
        x = extract.Node(rng.choice(["#", "p", "div"]), rng.choice("abcdef"))
        if x.tag != "#" and depth < 3:
            x.children = [node(depth + 1) for _ in range(rng.randrange(4))]
        return x

    for _ in range(100):
        a, b = ([node(0) for _ in range(rng.randrange(1, 12))] for _ in range(2))
        monkeypatch.setattr(extract, "LONG", 1 << 30)
        best = extract.size_of_match(a, b)
        for long, cells in ((0, 1 << 20), (20, 1 << 20), (0, 5)):
            monkeypatch.setattr(extract, "LONG", long)
            monkeypatch.setattr(extract, "CELLS", cells)
            pairs = extract.match(a, b)
            assert extract.size_of_match(a, b) == best == sum(extract._weight(a[i], b[j], {}) for i, j in pairs)
            assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:], strict=False))


def test_extract_deep_and_long_pages():
    import time

    assert extract.main_text("<div>" * 3000 + "x<p>y" + "<nav>n</nav>" + "</div>" * 2000 + "z") == "x\n\ny\n\nz"
    assert extract.main_text("<nav>" * 1500 + "x") == ""
    pages = [extract.parse("".join(f"<p>{i} {j}</p>" for j in range(3000))) for i in range(3)]
    began = time.time()
    extract.induce(pages)
    assert time.time() - began < 30


def test_extract_names():
    for kept in ('<article class="post no-comments">x</article>', '<main class="has-sidebar">x</main>', '<article class="comments">x</article>', '<div class="sidebar"><article>x</article></div>', '<div class="top search"><h1>x</h1></div>', '<article><section id="related-work">x</section></article>', '<article><h2 id="share">x</h2></article>', '<h2 id="share-prices">x</h2>', *(f"<p><a {a}>x</a></p>" for a in ('href="/hidden-gems"', 'title="a hidden valley"', 'data-hidden="false"', 'href="/p?id=comments"', "href=/p?id=comments", 'data-class="ad"'))):
        assert extract.main_text(kept) == "x", kept
    for gone in ('<div class="box Sidebar">x</div>', "<p id=comments>x</p>", "<p hidden>x</p>", '<p aria-hidden="true">x</p>', '<p style="color:red; display: none">x</p>', '<div role="navigation">x</div>', '<article><div class="comments"><article>x</article></div></article>', '<div class="hero">x</div>', '<span class="ad">x</span>'):
        assert extract.main_text(gone) == "", gone


def test_extract_head_left_open():
    for page in ("<html><head><title>t</title><body><p>x</p></body></html>", "<head><title>t</title><meta charset=utf-8><p>x</p>", "<head><script>s</script>x", "<head><noscript><link></noscript><div>x</div>", "<head><noscript><p>n</p><body>x", "<head><title>t</title></head><body>x"):
        assert extract.main_text(page) == "x", page


def test_licence(spark, odd, empty):
    model = licence.train(["The cat sat on the mat in the house.", "He got a new license to fish, version 3."])
    lines = [("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"), ("Released under the MIT License.", "mit"), ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"), ("Licensed under the Apache License, Version 2.0.", "apache-2.0"), ("He has a driving license.", None), (None, None), ("", None)]
    rows = spark.createDataFrame([(i, t if t is None else f"Some words.\n{t}\nOthers.") for i, (t, _) in enumerate(lines)], "doc_id long, text string")
    got = {r["doc_id"]: r["licences"] for r in licence.scan(rows, model).collect()}
    assert [got[i] for i in range(len(lines))] == [[f] if f else [] for _, f in lines]
    assert licence.scan(odd, model).count() == odd.count() and licence.scan(empty, model).count() == 0


def test_licence_wrapped(spark):
    model = licence.train(["The cat sat on the mat in the house.", "He got a new license to fish, version 3."])
    texts = {
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files, to deal\nin the Software without restriction",
        "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that",
        "bsd-3-clause": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted\n\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products",
        "gpl-3.0": "# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n#\n# This program is distributed",
        "apache-2.0": " * You may obtain a copy of the License at\n *\n *     http://www.apache.org/licenses/LICENSE-2.0",
        "unlicense": "This is free and unencumbered software\nreleased into the public domain.",
    }
    prose = "\n".join(f"prose of a run-on text, line {i}" for i in range(40))
    rows = [(f, t) for f, t in texts.items()] + [(f, f"{prose}\n{t}\n{prose}") for f, t in texts.items()] + [("", f"{prose}\nHe has a driving\nlicense.")]
    for r in licence.scan(spark.createDataFrame(rows, "family string, text string"), model).collect():
        assert r["licences"] == [f for f in [r["family"]] if f], r["text"]


def test_licence_anchors_lose_nothing():
    model = licence.train(["The cat sat on the mat."], rounds=5)
    for _, own in model.templates:
        free = [p for p in own if not set(p.split()) & set(model.anchors)]
        assert len(free) / len(own) < licence.CONFIRM


def test_licence_held_out(spark):
    """Notices in words that training did not see, wrapped at random, and prose with words of licences."""
    rng = random.Random(21)
    model = licence.train([r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect()])
    ways = ["Use of this file is governed by the {}.", "It comes to you under {}, see below.", "All of it is offered on the terms of the {} and no other.", "Terms: {}"]
    rows = [(f, w.format(n)) for f, own in licence.NAMES.items() for n in own for w in ways]
    prose = ["He renewed the license of his car in version 2 of the form.", "The commons voted on the public act, section 3.", "Apache tribes lived there; a new library opened.", "Creative people share their work under pressure.", "The general terms of the lease are on page 2.0.", "She is licensed to fly and to teach at the MIT campus.", "The clause was new and simplified, in two parts."]
    rows += [("", p) for p in prose * 12]

    def wrapped(text):
        words, lines = text.split(), [[]]
        for w in words:
            if len(lines[-1]) >= rng.randint(3, 9):
                lines.append([])
            lines[-1].append(w)
        return "Opening words of it.\n\n" + "\n".join(map(" ".join, lines)) + "\n\nClosing words of it."

    data = spark.createDataFrame([(i, f, wrapped(t)) for i, (f, t) in enumerate(rows)], "i long, want string, text string")
    got = [(r["want"], set(r["licences"])) for r in licence.scan(data, model).select("want", "licences").collect()]
    hits = sum(w in found for w, found in got if w)
    reported = sum(len(found) for _, found in got)
    right = sum(w in found for w, found in got if w)
    print("licence recall", hits / sum(bool(w) for w, _ in got), "precision", right / reported)
    assert hits >= 0.9 * sum(bool(w) for w, _ in got)
    assert right >= 0.95 * reported


def test_score(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    tokens = {r["doc_id"]: [*r["text"].encode().lower().split(), b""] for r in docs.collect()}
    count = collections.Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(count.values()), len(count)
    got = score.score(docs, head_words=50).collect()
    for r in got:
        own = tokens[r["doc_id"]]
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), abs=1e-6)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(count[w] > 0 for w in own), n)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert score.score(odd).count() == odd.count() and score.score(empty).count() == 0


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    elements = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    a, b = rng.integers(0, 5, 60).astype(float), rng.integers(0, 5, 60).astype(float)
    both = [x > 0 for x in (a, b)]
    signed = dedup.signatures(np.concatenate([elements[m] for m in both]), np.concatenate([a[both[0]], b[both[1]]]), np.repeat([0, 1], [both[0].sum(), both[1].sum()]), 2, 2000)
    assert (signed[0] == signed[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.04)


def test_dedup(spark, odd, empty):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choices(vocabulary, k=120) for _ in range(25)]
    texts = [" ".join(x) for x in base]
    for x in base[:12]:
        for _ in range(4):
            y = list(x)
            for _ in range(rng.randint(1, 3)):
                y[rng.randrange(len(y))] = rng.choice(vocabulary)
            texts.append(" ".join(y))
    texts += texts[:5]
    got = {r["id"]: r["class_id"] for r in dedup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    assert got == dict(enumerate(label))
    own = dedup.classes(odd).collect()
    assert len(own) == odd.count() and {(r["id"], r["class_id"]) for r in own} >= {(10, 9), (3, 2), (4, 4), (None, None)}
    assert dedup.classes(empty).count() == 0
    assert {r["class_id"] for r in own if r["id"] is None} == {None}


def edited(text: str, at: int) -> str:
    words = text.split()
    words[at] = "edited"
    return " ".join(words)


def test_dedup_rows_that_repeat_an_id_keep_their_links(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(150)) for x in "abc")
    rows = [(1, a), (1, b), (2, edited(a, 3)), (3, edited(b, 70)), (None, edited(a, 100)), (None, c), (None, edited(c, 4)), (9, "other text of its own here")]
    for _ in range(2):
        got = dedup.classes(spark.createDataFrame(rows, "doc_id long, text string"), detail=True).collect()
        # a and b are in one class each; both hold rows of id 1
        assert sorted((r["id"] or 0, r["class_id"] or 0) for r in got) == [(0, 0), (0, 0), (0, 1), (1, 1), (1, 1), (2, 1), (3, 1), (9, 9)]
        assert sum(r["leads"] for r in got) == 4


def test_dedup_counts_weigh_links(spark):
    rng = random.Random(8)
    phrase, rest = " ".join(rng.choices("abcdefgh", k=5)), " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"{rest} {phrase}"), (2, f"{rest} " + f"{phrase} " * 30), (3, f"{rest} " + f"{phrase} " * 29)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["id"]: r["class_id"] for r in dedup.classes(docs, weighting="count").collect()} == {1: 1, 2: 2, 3: 2}
    assert {r["id"]: r["class_id"] for r in dedup.classes(docs).collect()}[3] == 1 or len(dedup.Shingler().distinct(rows[2][1].encode())) > 70


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "mixing", "encoding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.identify_language(spark, docs, SF)
    one = corpus_pipeline.drop_near_duplicates(spark, kept, SF)
    mixed = corpus_pipeline.mix_sources(spark, one, SF)
    assert kept.columns == one.columns == mixed.columns == docs.columns
    assert mixed.count() == corpus_pipeline.run(spark, SF).count()


def test_pipeline_stages_on_odd_tables(spark, odd, empty):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
        assert stage(spark, odd, SF).count() >= 1
    kept = corpus_pipeline.drop_near_duplicates(spark, odd, SF).collect()
    assert collections.Counter(r["doc_id"] for r in kept) == collections.Counter([1, 2, 4, None, 7, 8, 9])


def test_pipeline_mixes_rows_without_an_id_one_by_one(spark):
    import corpus_pipeline

    rows = [(None, " ".join(["x"] * n), "en", "a", n) for n in (4, 4, 5, 6)] + [(1, "y y", "en", "b", 3), (1, "y z", "en", "b", 3), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = collections.Counter()
    for r in mixing.mix(docs, carry=("doc_id", "text")).collect():
        want[(r["doc_id"], r["text"])] += r["copies"]
    got = collections.Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.mix_sources(spark, docs, SF).collect())
    times = collections.Counter((r[0], r[1]) for r in rows)
    assert sum(got.values()) == sum(want.values()) and all(n <= 2 * times[k] for k, n in got.items())


def test_the_driver_gives_memory_back(spark):
    import gc
    import weakref

    from verbatik.llm import common

    class Held:
        pass

    gc.disable()
    try:
        held = Held()
        held.own = held  # only the collector frees it
        seen = weakref.ref(held)
        del held
        common.give_back(spark)
        assert seen() is None
    finally:
        gc.enable()
