import json

import pytest
from pyspark.sql import functions as F

from verbatik.functions import arrays, chunks
from verbatik.operators import context, lexicon
from verbatik.sources import text as sources
from verbatik.streaming.rewriting import normalize_stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def tagged(spark, *words):
    return spark.createDataFrame([(1, i, *w.split("/")) for i, w in enumerate(words)], "doc_id long, pos int, token string, tag string")


def packed(text, most):
    """The rule in plain Python."""
    sentences, now = [], ""
    for ch in text:
        now += ch
        if ch in ".;:!?":
            sentences.append(now.strip(" \t"))
            now = ""
    sentences.append(now.strip(" \t"))
    out, open_ = [], ""
    for s in filter(None, sentences):
        parts, long = (s.split(), True) if len(s) >= most else ([s], False)
        if long and open_:
            out, open_ = [*out, open_], ""
        for p in parts:
            if open_ and len(open_) + 1 + len(p) > most:
                out, open_ = [*out, open_], p
            else:
                open_ = f"{open_} {p}" if open_ else p
        if long and open_:
            out, open_ = [*out, open_], ""
    return [*out, open_] if open_ else out


@pytest.mark.parametrize("text", ["", "one.", "a b. c d! e f; g", "word " * 30, "short. " + "word " * 12 + ". end", "x" * 40 + " y. z"])
def test_chunks(spark, text):
    assert one(spark, chunks.chunks(F.lit(text), 20)) == packed(text, 20)
    assert one(spark, chunks.chunks(F.lit(None).cast("string"), 20)) is None


def test_crossfade(spark):
    x = F.array(*(F.lit(1.0) for _ in range(6)))
    got = one(spark, arrays.crossfade(F.array(x, x), 1000, 3))
    assert got == pytest.approx([1, 1, 1, 1, 2**0.5, 1, 1, 1, 1], abs=1e-6)
    both = one(spark, arrays.combined(F.array(x, x, x), F.array(F.lit(2), F.lit(0)), 1000, 1, 3))
    assert len(both) == 6 + 2 + 6 + 6 - 3


def test_promotion(spark):
    flagged = lambda *w: [r["promoted"] for r in context.promote_verbs(tagged(spark, *w)).orderBy("pos").collect()]
    assert flagged("Children/Noun", "present/Adjective", "awards/Noun")[1] is True
    assert flagged("The/Determiner", "analysts/Noun", "project/Noun", "manager/Noun")[2] is False
    assert flagged("Models/Noun", ",/", "project/Noun")[2] is False
    assert flagged("They/Pronoun", "permit/Noun", "is/Verb")[1] is False


def test_homographs(spark):
    found = lexicon.homographs(lexicon.lexicon(spark))
    read = lambda *w: [(r["token"], r["variant"], r["ipa"]) for r in context.read_homographs(tagged(spark, *w), found).orderBy("pos").collect()]
    assert read("Models/Noun", "project/Noun", "sales/Noun") == [("project", "VERB", "pɹəʤˈɛkt")]
    assert read("the/Determiner", "project/Noun") == [("project", "DEFAULT", "pɹˈɑʤˌɛkt")]
    assert read("is/Verb", "present/Verb") == [("present", "DEFAULT", "pɹˈɛzᵊnt")]
    assert one(spark, context.hum(F.lit("Hmm"))) == "hˈmː"


def test_sources(spark, tmp_path):
    (tmp_path / "lex.json").write_text(json.dumps({"a": "ə", "read": {"DEFAULT": "ɹˈid", "VBD": None}}))
    rows = {(r["word"], r["variant"], r["ipa"]) for r in sources.lexicon(spark, str(tmp_path / "lex.json"), "gold", 1).collect()}
    assert rows == {("a", "-", "ə"), ("read", "DEFAULT", "ɹˈid"), ("read", "VBD", None)}
    (tmp_path / "vocab.json").write_text(json.dumps({"vocab": {"a": 1, "b": 2}}))
    assert {r["symbol"] for r in sources.vocabulary(spark, str(tmp_path / "vocab.json")).collect()} == {"a", "b"}
    bad = lexicon.invalid_scalars(sources.lexicon(spark, str(tmp_path / "lex.json"), "gold", 1), ["ə"]).collect()
    assert [(r["word"], r["bad"]) for r in bad] == [("read", "ɹ")]
    (tmp_path / "lines.txt").write_text("one\n\n=== two\n")
    assert [r["echoed"] for r in sources.lines(spark, str(tmp_path / "lines.txt")).collect()] == [False, True, True]


def test_stream(spark, tmp_path):
    spark.createDataFrame([("the 21st",)], "text string").write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("text string").parquet(str(tmp_path / "in"))
    normalize_stream(rows, "text", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first()["normalized"] == 'the <sub alias="twenty first">21st</sub>'
