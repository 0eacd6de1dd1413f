"""Text sources: passages, lines, lexicon and vocabulary files in JSON, and process listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def passages(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files, trimmed at both ends."""
    return fixtures(spark, path).withColumn("text", F.regexp_replace("text", r"^\s+|\s+\z", ""))


def fixtures(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files as they are."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, number, line, echoed) of files, split at every Unicode line end; blank, `===` and `---` lines are only to be echoed.

    A file is one row until it is split, for numbers need the lines before; a line end at a file's end begins no line.
    """
    whole = fixtures(spark, path)
    own = F.split(F.regexp_replace("text", r"(?:\r\n|[\n\x0b\f\r\x{85}\x{2028}\x{2029}])\z", ""), r"\r\n|[\n\x0b\f\r\x{85}\x{2028}\x{2029}]", -1)
    rows = whole.select("path", F.posexplode(own).alias("at", "line"))
    return rows.select("path", (F.col("at") + 1).alias("number"), "line", is_divider(F.col("line")).alias("echoed"))


def given_lines(spark: SparkSession, text: str) -> DataFrame:
    """(number, line, echoed) of a text at hand, such as standard input, split at line feeds."""
    own = text.removesuffix("\n").split("\n")
    rows = spark.createDataFrame([(i + 1, line) for i, line in enumerate(own)], "number int, line string")
    return rows.withColumn("echoed", is_divider(F.col("line")))


def input_source(argument: str | None) -> tuple[str, str | None]:
    """("stdin", None) for no argument or a dash, else ("literal", argument), the empty string too."""
    return ("stdin", None) if argument is None or argument == "-" else ("literal", argument)


def is_divider(line: Column) -> Column:
    return line.rlike(r"^\s*\z|^\s*(?:===|---)")


def lexicon(spark: SparkSession, path: str, tier: str, tier_rank: int) -> DataFrame:
    """(tier_rank, tier, word, variant, ipa) of a JSON object whose values are strings or objects of strings by variant.

    A null value is an entry with a null reading, plain or of its variant; a word that the object lacks has no row.
    """
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("word", "entry"))
    by_tag = F.from_json("entry", "map<string,string>")
    nested = raw.where(F.col("entry").startswith("{")).select("word", F.explode(by_tag).alias("variant", "ipa"))
    plain = raw.where(F.col("entry").isNull() | ~F.col("entry").startswith("{")).select("word", F.lit("-").alias("variant"), F.col("entry").alias("ipa"))
    return plain.unionByName(nested).select(F.lit(tier_rank).alias("tier_rank"), F.lit(tier).alias("tier"), "word", "variant", "ipa")


def lexicon_tiers(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """The entries of all tiers (name to path, in order); a tier whose file is missing is left out."""
    out = spark.createDataFrame([], "tier_rank int, tier string, word string, variant string, ipa string")
    for rank, (tier, path) in enumerate(paths.items()):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            out = out.unionByName(lexicon(spark, path, tier, rank))
    return out


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(symbol) of a JSON object, or of its `vocab`."""
    raw = spark.read.text(path, wholetext=True)
    inner = F.from_json(F.get_json_object("value", "$.vocab"), "map<string,string>")
    return raw.select(F.explode(F.map_keys(F.coalesce(inner, F.from_json("value", "map<string,string>")))).alias("symbol"))


def processes(listing: DataFrame, line: str = "line") -> DataFrame:
    """(pid, ppid, rss in bytes) of lines of a process listing with pid, parent and kilobytes; other lines have no row."""
    part = F.split(F.trim(F.translate(F.col(line), "\t", " ")), " +")
    rows = listing.select(*(F.get(part, F.lit(i)).try_cast(t).alias(c) for i, (c, t) in enumerate((("pid", "int"), ("ppid", "int"), ("rss", "long")))))
    return rows.where("pid is not null and ppid is not null and rss is not null").withColumn("rss", F.col("rss") * 1024)
