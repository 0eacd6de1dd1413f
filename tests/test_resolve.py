"""Abbreviations, names, spans and the resolution of words, on texts of our own."""

import pytest
from pyspark.sql import functions as F

from verbatik.functions import abbreviations, rewrite, tokens
from verbatik.operators import context, lexicon, names, rates, resolve, spans
from verbatik.sources import registry, sinks, text


@pytest.fixture(scope="module")
def said(spark):
    rows = [(1, "O'Riley's wind had read it, hmm."), (2, None), (3, ""), (4, "Children contract it. The Children's contract is lead."), (5, "She read it while he walked.")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_abbreviations(spark):
    cases = {
        "Mrs. Ada came.": '<sub alias="Missus">Mrs.</sub> Ada came.',
        "at 9 P.M. Then": 'at 9 <sub alias="P M. …">P.M.</sub> Then',
        "Ind. and ind.": '<sub alias="Indiana">Ind.</sub> and ind.',
        "the U.S.A. won": 'the <sub alias="U S A">U.S.A.</sub> won',
        "12 lb. of it, a lb.": '12 <sub alias="pound">lb.</sub> of it, a lb.',
        "fig. 2 and fig. x": '<sub alias="figure">fig.</sub> 2 and fig. x',
        'a <sub alias="b">etc.</sub> etc.': 'a <sub alias="b">etc.</sub> <sub alias="et cetera">etc.</sub>',
        "xDr. a": "xDr. a",
        "at 7 Hill Rd. now": 'at 7 Hill <sub alias="Road">Rd.</sub> now',
        "near St. Helena's": 'near <sub alias="Saint">St.</sub> Helena\'s',
        "on Ash St. now": 'on Ash <sub alias="Street">St.</sub> now',
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: r["a"] for r in rows.select("t", rewrite.abbreviations(F.col("t")).alias("a")).collect()}
    assert got == cases
    assert rows.where("false").select(rewrite.abbreviations(F.col("t"))).count() == 0


def test_contexts(spark):
    rows = [("dr.", "it is 3:30", "Ash", "time"), ("dr.", "see", "Ash", "title"), ("dr.", "see", "ash", "default"), ("ave.", "9 Elm", "", "place"), ("st.", "on 2nd", "x", "place"), ("st.", "see", "Paul", "religious")]
    got = spark.createDataFrame(rows, "own string, l string, r string, want string").select("want", abbreviations.context(F.col("own"), F.col("l"), F.col("r")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_escapes(spark):
    row = spark.createDataFrame([('a&b"<c>', "x\\$1")], "a string, t string").select(rewrite.attribute(F.col("a")), rewrite.template(F.col("t")), rewrite.ipa_override(F.lit("w"), F.lit("ab"))).first()
    assert list(row) == ["a&amp;b&quot;&lt;c&gt;", "x\\\\\\$1", "[w](/a b/)"]


def test_tokens_are_laid_out_by_row(spark):
    rows = spark.createDataFrame([(1, "Mt. Ada is  big, so"), (1, "a b"), (2, None), (3, ""), (4, "  x")], "doc_id long, text string")
    got = tokens.lay_out(rows, merged=True).collect()
    assert [(r["pos"], r["token"], r["start"], r["ws"], r["before"], r["next_word"]) for r in got if r["pos"] < 9 and r["doc_id"] == 1][:10] == [
        (0, "Mt.", 0, " ", None, "Ada"), (1, " ", 3, "", "Mt.", None), (2, "Ada", 4, " ", "Mt.", "is"), (3, " ", 7, "", "Ada", None), (4, "is", 8, "  ", "Ada", "big"),
        (5, "  ", 10, "", "is", None), (6, "big", 12, "", "is", None), (7, ",", 15, " ", "big", None), (8, " ", 16, "", ",", None), (0, "a", 0, " ", None, "b"),
    ]
    assert [(r["token"], r["start"], r["kind"]) for r in got if r["doc_id"] == 4] == [("  ", 0, "space"), ("x", 2, "word")]
    assert tokens.lay_out(rows.limit(0)).count() == 0


def test_spans(spark):
    docs = spark.createDataFrame([(1, "ab xab 😀ab"), (2, "none"), (1, "ab"), (3, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in spans.matches(docs, "ab").collect()) == [(1, 0, 2, "ab"), (1, 0, 2, "ab"), (1, 4, 6, "ab"), (1, 8, 10, "ab")]
    a = spark.createDataFrame([(1, 0, 10), (1, 5000, 5001), (1, 10, 20), (2, 0, 3)], "doc_id long, start long, stop long")
    b = spark.createDataFrame([(1, 9, 4000), (2, 3, 9)], "doc_id long, start long, stop long")
    assert sorted(r["start"] for r in spans.covered(a, b).collect()) == [0, 10]
    assert sorted((r["doc_id"], r["start"]) for r in spans.unclaimed(a, b).collect()) == [(1, 5000), (2, 0)]


def test_lexicon_forms_and_tiers(spark):
    rows = [(0, "a", "Word", "-", "1"), (1, "b", "word", "VERB", "2"), (1, "b", "word", "DEFAULT", None), (2, "c", "word", "-", "3"), (2, "c", "uber", "-", "4")]
    entries = spark.createDataFrame(rows, "tier_rank int, tier string, word string, variant string, ipa string")
    asked = [("Word", "NOUN", "1"), ("word", "VBD", "2"), ("word", None, "3"), ("WORD", "NOUN", "3"), ("Über", None, "4"), ("no", None, None), (None, None, None)]
    words = spark.createDataFrame([(i, w, p) for i, (w, p, _) in enumerate(asked)], "i int, word string, pos string")
    assert [r["ipa"] for r in lexicon.resolve(words, entries).orderBy("i").collect()] == [x for _, _, x in asked]
    assert {r["word"]: r["ipa"] for r in lexicon.plain(words.select("word").distinct(), entries).collect()} == {"Word": "1", "word": None, "WORD": None, "Über": "4", "no": None, None: None}
    assert [r["homograph"] for r in lexicon.known_homographs(spark.createDataFrame([("word",), ("uber",)], "word string"), entries).orderBy("word").collect()] == [False, True]


def test_resolution(spark, said):
    entries = lexicon.lexicon(spark)
    plan = resolve.resolve(said, entries)
    assert {r["doc_id"]: (r["plain"], r["hom"], r["name"], r["span"], r["oov"]) for r in resolve.counts(plan).collect()} == {1: (1, 1, 1, 0, 2), 2: (0, 0, 0, 0, 0), 3: (0, 0, 0, 0, 0), 4: (1, 3, 0, 0, 4), 5: (0, 0, 0, 0, 5)}
    got = {r["doc_id"]: r for r in resolve.emit(plan).collect()}
    assert got[1]["annotated"] == "[O'Riley's](/O ɹ ˈ I l i z/) [wind](/w ˈ ɪ n d/) had [read](/ɹ ˈ i d/) it, hmm." and got[1]["lexicon"] == {"hmm": list("hˈmː")}
    assert (got[2]["annotated"], got[3]["annotated"]) == (None, "")
    assert "[read](/ɹ ˈ ɛ d/)" in got[5]["annotated"]
    assert resolve.resolve(said.limit(0), entries).claims.count() == 0


def test_tags_promote_verbs(spark, said):
    tag = F.when(F.col("token") == "Children", "Noun").when(F.col("token") == "contract", "Noun").when(F.col("token").isin("is"), "Verb").when(F.col("token") == "The", "Determiner")
    plan = resolve.resolve(said.where("doc_id = 4"), lexicon.lexicon(spark), tagger=lambda t: t.withColumn("tag", tag))
    assert [(r["word"], r["ipa"]) for r in plan.claims.orderBy("start").collect()] == [("contract", "kəntɹˈækt"), ("contract", "kˈɑntɹˌækt"), ("lead", "lˈɛd")]


def test_orders_of_rules(spark):
    entries = lexicon.lexicon(spark).unionByName(spark.createDataFrame([(1, "gold", "Maya", "-", "mˈIə"), (1, "gold", "iron", "-", "ˈIəɹn")], "tier_rank int, tier string, word string, variant string, ipa string"))
    docs = spark.createDataFrame([(1, "McKay met Maya; O'Neil's iron. They used to permit it.")], "doc_id long, text string")
    assert resolve.normalize(docs, "text", "n", "raw").first()["n"] == docs.first()["text"]
    classic = resolve.normalize(docs, "text", "n", "classic", entries).first()["n"]
    assert classic == "<sub alias=\"Mackkay\">McKay</sub> met [Maya](/m ˈ I ə/); [O'Neil's](/O n ˈ i l z/) [iron](/ˈ I ə ɹ n/). They [used](/j ˈ u s t/) to [permit](/p ˈ ɜ ɹ m ɪ t/) it."
    with pytest.raises(ValueError):
        resolve.normalize(docs, "text", "n", "other", entries)


def test_small_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": "1", "y": {"VERB": "2", "NOUN": null}, "z": null}')
    got = text.lexicon_tiers(spark, {"gold": f"file://{tmp_path}/a.json", "gone": f"file://{tmp_path}/b.json"}).collect()
    assert sorted((r["word"], r["variant"], r["ipa"] or "") for r in got) == [("x", "-", "1"), ("y", "NOUN", ""), ("y", "VERB", "2"), ("z", "-", "")]
    (tmp_path / "l.txt").write_text(" one two\r\n---\n\nthree\n", newline="")
    assert [(r["number"], r["line"], r["echoed"]) for r in text.lines(spark, f"file://{tmp_path}/l.txt").collect()] == [(1, " one", False), (2, "two", False), (3, "---", True), (4, "", True), (5, "three", False)]
    assert [r["line"] for r in text.given_lines(spark, "a b\n\nc\n").collect()] == ["a b", "", "c"]
    assert text.fixtures(spark, f"file://{tmp_path}/l.txt").first()["text"].endswith("three\n")
    assert [text.input_source(x) for x in (None, "-", "", "a")] == [("stdin", None), ("stdin", None), ("literal", ""), ("literal", "a")]
    known = registry.models(spark)
    assert registry.find(known, "large").first()["backend"] == "remote" and registry.find(known, "x").count() == 0
    with pytest.raises(Exception, match="no runner"):
        registry.dispatched(known, {"local": "here"}, "v").collect()


def test_sinks_and_rates(spark, tmp_path):
    rows = spark.createDataFrame([(1, [0.0, 1.0]), (2, None)], "i long, s array<float>")
    sinks.write_wavs(rows, "i", "s", 24000, f"file://{tmp_path}/w")
    assert {r["i"]: r["wav"] and len(r["wav"]) for r in spark.read.parquet(f"file://{tmp_path}/w").collect()} == {1: 48, 2: None}
    own = rates.text_rates(spark.createDataFrame([("a  b", 2.0), (None, 1.0), ("x", 0.0)], "t string, w double"), "t", F.col("w")).collect()
    assert [tuple(r)[1:] for r in own] == [(4, 2, 2.0, 1.0), (None, None, None, None), (1, 1, None, None)]
    table = sinks.markdown_table(["n"], F.concat(F.lit("| "), "i", F.lit(" |")), rows, ["i"])
    assert [r["line"] for r in table.collect()] == ["| n |", "|---|", "| 1 |", "| 2 |"]
    reasons = spark.createDataFrame([("b", None, 1), ("a", "x", 2)], "reason string, label string, n long")
    assert [r["line"] for r in sinks.trace_lines(reasons, F.lit(9)).collect()] == ["a x: 2 of 9", "b —: 1 of 9"]


def test_names(spark):
    docs = spark.createDataFrame([(1, "xMcKay O'Bryan’s, MacRead")], "doc_id long, text string")
    assert [(r["start"], r["source"], r["bare"], r["possessive"]) for r in names.find(docs).collect()] == [(7, "O'Bryan’s", "O'Bryan", "’s"), (18, "MacRead", "MacRead", None)]


def test_context_operators(spark):
    docs = spark.createDataFrame([(1, "it is, so we go")], "doc_id long, text string")
    assert [(r["token"], r["next_word"]) for r in context.next_words(docs).collect()] == [("it", "is"), ("is", None), ("so", "we"), ("we", "go"), ("go", None)]
    assert [r["vetoed"] for r in context.copula_vetoes(docs).collect()] == [False, True, False, True, False]


def test_words_are_read_in_their_rows(spark):
    entries = lexicon.lexicon(spark)
    texts = ["The wind, IN the Thé Dr. Permit’s", "hmm HMM hm. lead-in bass", "", None, "ÎN in-the U.S.A.x R.S.V.P. 12 _a", "nulled read's don't 😀 présent", "O'Riley's wind", "She read it while he walked in.", "MacX in Oslo"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plan = resolve.resolve(docs, entries)
    whole = resolve.Plan(plan.docs, plan.words, plan.claims)  # by rows of words and joins
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(resolve.counts(plan)) == rows(resolve.counts(whole))
    assert rows(resolve.lexicon_map(plan)) == rows(resolve.lexicon_map(whole))
    easy = resolve.resolve(docs.where("doc_id < 5"), entries)
    joins = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("Join")
    assert (joins(resolve.counts(easy)), joins(resolve.lexicon_map(easy))) == (1, 0)
    got = docs.select(tokens.token_array(F.col("text"), merged=True).alias("t"), F.regexp_extract_all("text", F.lit(tokens.MERGED), F.lit(0)).alias("m")).collect()
    assert [r["t"] for r in got] == [r["m"] for r in got]
    assert all(spark.range(1).select(F.lit(f"a {x} b").rlike(f"^a {tokens.SOON} b$").alias("x")).first()["x"] for x in abbreviations.SURFACES[::20])


def test_lookups_in_python_are_those_of_the_join(spark):
    rows = [(0, "a", "Word", "-", "1"), (1, "b", "word", "VERB", "2"), (1, "b", "word", "DEFAULT", None), (2, "c", "word", "-", "3"), (2, "c", "uber", "-", "4"), (0, "a", "two", "DEFAULT", "5"), (0, "a", "two", "-", "6")]
    entries = spark.createDataFrame(rows, "tier_rank int, tier string, word string, variant string, ipa string")
    asked = ["Word", "word", "WORD", "Über", "über", "ÜBER", "no", "two", "Two"]
    want = lexicon.resolve(spark.createDataFrame([(w, None) for w in asked], "word string, pos string"), entries).collect()
    readings = lexicon.Readings(rows)
    assert {r["word"]: r["ipa"] for r in want} == {w: readings.ipa(w) for w in asked}
