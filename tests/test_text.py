import duckdb
import pytest
from pyspark.sql import functions as F

from verbatik.functions import arrays, numbers, rewrite
from verbatik.functions.tokens import token_array

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("n", "words"),
    [(0, "zero"), (13, "thirteen"), (21, "twenty one"), (100, "one hundred"), (342, "three hundred forty two"), (-17, "minus seventeen"), (1_000_001, "one million one"), (10**15, ""), (2_000_000_000_000, "two trillion")],
)
def test_cardinal(spark, n, words):
    assert one(spark, numbers.cardinal(F.lit(n))) == words


@pytest.mark.parametrize(("n", "words"), [(1, "first"), (12, "twelfth"), (20, "twentieth"), (42, "forty second"), (100, "one hundredth"), (1003, "one thousand third")])
def test_ordinal(spark, n, words):
    assert one(spark, numbers.ordinal(F.lit(n))) == words


# 2000 is pinned: it is read as a round century
@pytest.mark.parametrize(("n", "words"), [(1984, "nineteen eighty four"), (1900, "nineteen hundred"), (1905, "nineteen oh five"), (2003, "two thousand three"), (2000, "twenty hundred"), (1066, "one thousand sixty six")])
def test_year(spark, n, words):
    assert one(spark, numbers.year(F.lit(n))) == words


def test_other_numbers(spark):
    assert one(spark, numbers.decimal(F.lit("7.26"))) == "seven point two six"
    assert one(spark, numbers.decimal(F.lit(".8"))) == "point eight"
    assert one(spark, numbers.decimal(F.lit("6"))) == "6"
    assert one(spark, numbers.grouped_cardinal(F.lit("1,234"))) == "one thousand two hundred thirty four"
    assert one(spark, numbers.grouped_cardinal(F.lit("x"))) is None
    assert one(spark, numbers.decade(F.lit("nineteen eighty"))) == "nineteen eighties"
    assert one(spark, numbers.roman(F.lit("MCMXCIV"))) == 1994
    assert one(spark, numbers.roman(F.lit("IIII"))) == 4
    assert one(spark, numbers.roman(F.lit("ABC"))) is None
    assert one(spark, numbers.range_end(F.lit("1999"))) == "nineteen ninety nine"


@pytest.mark.parametrize(
    ("stage", "text", "out"),
    [
        (rewrite.emails, "Mail a.b@x-y.org now", 'Mail <sub alias="a dot b at x dash y dot org">a.b@x-y.org</sub> now'),
        (rewrite.phones, "call 555-123-4567", 'call<sub alias="5 5 5, 1 2 3, 4 5 6 7"> 555-123-4567</sub>'),
        (rewrite.ipv4, "at 10.0.0.1!", 'at <sub alias="1 0 dot 0 dot 0 dot 1">10.0.0.1</sub>!'),
        (rewrite.money, "$1,234.01 or £1", '<sub alias="one thousand two hundred thirty four dollars and one cent">$1,234.01</sub> or <sub alias="one pound">£1</sub>'),
        (rewrite.percents, "12.5%", '<sub alias="twelve point five percent">12.5%</sub>'),
        (rewrite.temperatures, "3°C", '<sub alias="three degrees Celsius">3°C</sub>'),
        (rewrite.ordinals, "the 21st", 'the <sub alias="twenty first">21st</sub>'),
        (rewrite.codes, "QF12 flies", '<sub alias="Q F 1 2">QF12</sub> flies'),
        (rewrite.initialisms, "NASA AI", "NASA [A](/ˈeɪ/) [I](/ˈaɪ/)"),
        (rewrite.slashes, "A/B", '<sub alias="A slash B">A/B</sub>'),
        (rewrite.compounds, "up-to-date x", '<sub alias="up to date">up-to-date</sub> x'),
        (rewrite.iso_dates, "2024-01-02", '<say-as interpret-as="date" format="ymd">2024-01-02</say-as>'),
        (rewrite.times, "at 9:30", 'at <say-as interpret-as="time">9:30</say-as>'),
        (rewrite.fold_punctuation, "a -- b... ‘c’ [d]", "a — b… 'c' (d)"),
        (rewrite.closed, "done", "done."),
        (rewrite.ordinals, '<sub alias="x">1st</sub> 1st', '<sub alias="x">1st</sub> <sub alias="first">1st</sub>'),
        (rewrite.romans, "Volume IX, Part MMMMM", 'Volume <sub alias="nine">IX</sub>, Part MMMMM'),
        (rewrite.dimensions, "2.5 x 7", '<sub alias="two point five by seven">2.5 x 7</sub>'),
        (rewrite.years, "the 1990s, In 1984 and May 2005", 'the <sub alias="nineteen nineties">1990s</sub>, In <sub alias="nineteen eighty four">1984</sub> and May <sub alias="two thousand five">2005</sub>'),
        (rewrite.course_codes, "Physics 204", 'Physics <sub alias="two oh four">204</sub>'),
        (rewrite.ranges, "250–500 ms, 1990—1999", '<sub alias="two hundred fifty to five hundred milliseconds">250–500 ms</sub>, <sub alias="nineteen ninety to nineteen ninety nine">1990—1999</sub>'),
        (rewrite.units, "a 200 mg tube, 200 mg of it, 1 kg", 'a <sub alias="two hundred milligram">200 mg</sub> tube, <sub alias="two hundred milligrams">200 mg</sub> of it, <sub alias="one kilogram">1 kg</sub>'),
        (rewrite.fractions, "5/9 on 3/14/2021", '<sub alias="five out of nine">5/9</sub> on 3/14/2021'),
        (rewrite.ratios, "2:1", '<sub alias="two to one">2:1</sub>'),
        (rewrite.parentheses, "a (b) c (d). [e](/f/)", "a — b — c — d. [e](/f/)"),
        (rewrite.clauses, "He came, and left; I stayed", "He came — and left — I stayed"),
        (rewrite.clauses, "a" * 190 + " — b — and more words.", "a" * 190 + " — b; and more words."),
        (rewrite.urls, "see www.x-1.io/a_b.", 'see <sub alias="www x dash one dot io slash a underscore b">www.x-1.io/a_b</sub>.'),
        (rewrite.meridiem_times, "at 5:30 a.m. My 6:47 p.m. then", 'at <sub alias="5 30 A M. …">5:30 a.m.</sub> My <sub alias="6 47 P M">6:47 p.m.</sub> then'),
        (rewrite.room_codes, "Apt. 4B, not 98F", 'Apt. <sub alias="4 bee">4B</sub>, not 98F'),
    ],
)
def test_stage(spark, stage, text, out):
    assert one(spark, stage(F.lit(text))) == out
    assert one(spark, stage(F.lit(None).cast("string"))) is None
    assert one(spark, stage(F.lit("plain words"))) in ("plain words", "plain words.")


def test_tokens(spark):
    assert one(spark, token_array(F.lit("Don't re-do Châteauneuf  it."))) == ["Don't", " ", "re-do", " ", "Châteauneuf", "  ", "it", "."]


def test_fades(spark):
    x = F.array(*(F.lit(1.0) for _ in range(6)))
    assert one(spark, arrays.microfade(x, 1000, 2)) == pytest.approx([0, 0.5, 1, 1, 0.5, 0])
    assert len(one(spark, arrays.join_with_pauses([x, x], 1000, [3], 1))) == 15


def _names():
    from verbatik.plans.catalog import ORACLE_SQL

    return sorted(ORACLE_SQL)


@pytest.mark.parametrize("name", _names())
def test_oracle(spark, name):
    from verbatik.plans.catalog import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    ours, theirs = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE_SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    rows = lambda d: sorted(map(repr, d[columns].astype(object).where(d[columns].notna(), None).itertuples(index=False, name=None)))
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_normalize_documents_has_every_row(spark, tmp_path, monkeypatch):
    from verbatik.plans.catalog import QUERIES

    monkeypatch.setattr(rewrite, "STAGES", (rewrite.ordinals,))  # the rows are looked at here
    rows = [(1, "the 21st", "en"), (2, "the 21st", "de"), (3, "the 21st", None), (4, None, "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["normalized"] for r in QUERIES["normalize_documents"](spark, str(tmp_path)).collect()}
    assert got == dict.fromkeys((1, 2, 3), 'the <sub alias="twenty first">21st</sub>') | {4: None}


def test_ipv4_alias_is_its_sql_where_addresses_adjoin(spark, tmp_path):
    from verbatik.plans.catalog import ORACLE_SQL, QUERIES

    texts = ["1.2.3.4 5.6.7.8", "1.2.3.4,5.6.7.8,9.9.9.9", "1.2.3.4  5.6.7.8\n", "1.2.3.4\n5.6.7.8", "1.2.3.4.5 1.2.3.4567", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    ours = sorted(tuple(r) for r in QUERIES["ipv4_alias"](spark, str(tmp_path)).collect())
    assert ours == sorted(con.sql(ORACLE_SQL["ipv4_alias"]).fetchall()) and len(ours) == 6
    assert one(spark, rewrite.ipv4(F.lit("1.2.3.4 5.6.7.8"))).count("<sub") == 2  # the rule of the rewriting takes both
