"""Surnames with the prefixes O', Mc and Mac: found by pattern, read through the lexicon or respelled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatik.operators import lexicon, spans

# The pattern of such names, readings of the prefixes, and stems that are read as another word.
NAME = r"(?<![A-Za-z])(O'|Mc|Mac)([A-Z][a-z]+)(['’]s)?(?![A-Za-z])"
PREFIXES = {"O'": "O", "Mc": "mˈɪk", "Mac": "mˈæk"}
RESPELLED = {"Brien": "Bryan", "Reilly": "Riley", "Neil": "Kneel"}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """(the other columns, start, stop, source, prefix, stem, bare, possessive) of every name in the text."""
    part = lambda i: F.regexp_extract("source", r"^(O'|Mc|Mac)([A-Z][a-z]+)(['’]s)?$", i)
    found = spans.matches(docs, NAME, text)
    found = found.withColumns({"prefix": part(1), "stem": part(2), "possessive": F.when(part(3) != "", part(3))})
    return found.withColumn("bare", F.concat("prefix", "stem"))


def read(names: DataFrame, entries: DataFrame) -> DataFrame:
    """names with ipa, provenance, tier and alias: the whole name's plain reading, else the prefix and the stem's reading, else
    the prefix and the reading of what the stem is respelled as; a name without a reading has an alias.

    Distinct names are looked up, each once. A possessive adds a z to the reading and stays in the alias.
    """
    asked = names.select("prefix", "stem", "bare").distinct()
    respelled = F.try_element_at(_map(RESPELLED), F.col("stem"))
    rows = asked.withColumn("respelled", respelled)
    none = F.lit(None).cast("string")
    for word, column in (("bare", "__whole"), ("stem", "__stem"), ("respelled", "__other")):
        hits = lexicon.with_hits(rows, entries, word)
        got = lexicon.plain_hit(F.col("hits")) if word == "bare" else lexicon.best_hit(F.col("hits"), none)
        rows = hits.withColumn(column, F.struct(got["tier"].alias("tier"), got["ipa"].alias("ipa"))).drop("hits")
    way = F.when(F.col("__whole.ipa").isNotNull(), "lexicon").when(F.col("__stem.ipa").isNotNull(), "compose").when(F.col("__other.ipa").isNotNull(), "respelling")
    prefix = _map(PREFIXES)[F.col("prefix")]
    ipa = F.coalesce("__whole.ipa", F.concat(prefix, F.coalesce("__stem.ipa", "__other.ipa")))
    known = rows.select("bare", way.alias("provenance"), F.coalesce("__whole.tier", "__stem.tier", "__other.tier").alias("tier"), ipa.alias("ipa"))
    found = names.join(known, "bare")
    alias = F.when(F.col("prefix") == "O'", F.concat(F.lit("Oh "), "stem")).otherwise(F.concat(F.lit("Mack"), F.lower("stem")))
    own = F.concat("ipa", F.when(F.col("possessive").isNotNull(), F.lit("z")).otherwise(F.lit("")))
    return found.withColumns({"ipa": own, "alias": F.when(F.col("ipa").isNull(), F.concat(alias, F.coalesce("possessive", F.lit(""))))})
