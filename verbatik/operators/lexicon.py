"""Tiered lexicon resolution: four key forms of a word against ordered tiers, then a chain of variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Tiers in order, parents of tags, and letters that fold to plain ones.
TIERS = ["overlay", "gold", "celtic", "silver"]
PARENT = {"VBD": "VERB", "VBP": "VERB", "VBN": "VERB"}
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyAAAAAACEEEEIIIINOOOOOUUUUY"
#: Entries of a lexicon that are broadcast at most, and the type of what is found in it.
BROADCAST_ROWS = 500_000
HITS = "array<struct<tier_rank:int,form:int,tier:string,variant:string,ipa:string>>"
# A small lexicon (tier, word, variant, ipa); variant '-' is a plain entry. The last four rows are synthetic.
ENTRIES = [
    ("gold", "read", "DEFAULT", "ɹˈid"), ("gold", "read", "VBD", "ɹˈɛd"), ("gold", "Bryan", "-", "bɹˈIən"), ("gold", "Riley", "-", "ɹˈIli"), ("gold", "Kneel", "-", "nˈil"),
    ("gold", "contract", "DEFAULT", "kˈɑntɹˌækt"), ("gold", "contract", "VERB", "kəntɹˈækt"), ("gold", "project", "DEFAULT", "pɹˈɑʤˌɛkt"), ("gold", "project", "VERB", "pɹəʤˈɛkt"),
    ("gold", "permit", "DEFAULT", "pˈɜɹmɪt"), ("gold", "permit", "VERB", "pəɹmˈɪt"), ("gold", "present", "DEFAULT", "pɹˈɛzᵊnt"), ("gold", "present", "VERB", "pɹizˈɛnt"), ("gold", "used", "VBD", "jˈust"),
    ("gold", "nulled", "VBD", None), ("silver", "nulled", "DEFAULT", "nˈʌld"), ("silver", "the", "-", "ðə"), ("silver", "in", "-", "ˈɪn"),
]


def lexicon(spark: SparkSession) -> DataFrame:
    """(tier_rank, tier, word, variant, ipa) of the built-in entries."""
    return spark.createDataFrame([(TIERS.index(t), t, w, v, i) for t, w, v, i in ENTRIES], "tier_rank int, tier string, word string, variant string, ipa string")


def is_small(entries: DataFrame) -> bool:
    """Whether there are no more than BROADCAST_ROWS entries, counted once."""
    known = getattr(entries, "_is_small", None)
    if known is None:
        known = entries._is_small = entries.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return known


def _table(entries: DataFrame) -> DataFrame:
    """(key, found): each word's rows in all tiers; broadcast if no more than BROADCAST_ROWS entries are counted, once."""
    known = getattr(entries, "_by_word", None)
    if known is None:
        row = F.struct("tier_rank", "tier", "variant", "ipa")
        known = entries.groupBy(F.col("word").alias("__key")).agg(F.collect_list(row).alias("__found"))
        if is_small(entries):
            known = F.broadcast(known)
        entries._by_word = known
    return known


def with_hits(words: DataFrame, entries: DataFrame, word: str = "word") -> DataFrame:
    """words with `hits`, array<struct<tier_rank, form, tier, variant, ipa>>: of each tier the rows of its first form.

    The forms are the word, its lower case, and both without accents. One join for each form, with no shuffle of words
    unless the lexicon is too large to broadcast.
    """
    table = _table(entries)
    folded = F.translate(word, ACCENTED, PLAIN)
    out = words
    for i, form in enumerate((F.col(word), F.lower(word), folded, F.lower(folded))):
        own = table.select(F.col("__key").alias(f"__k{i}"), F.transform("__found", _hit(i)).alias(f"__h{i}"))
        out = out.withColumn(f"__f{i}", form).join(own, F.col(f"__f{i}") == F.col(f"__k{i}"), "left")
    every = F.concat(*(F.coalesce(f"__h{i}", F.array().cast(HITS)) for i in range(4)))
    first = F.filter(every, lambda x: ~F.exists(every, lambda y: (y["tier_rank"] == x["tier_rank"]) & (y["form"] < x["form"])))
    return out.select(*words.columns, F.array_distinct(first).alias("hits"))


def _hit(form: int):
    own = lambda r, names: (r[n].alias(n) for n in names)
    return lambda r: F.struct(*own(r, ["tier_rank"]), F.lit(form).alias("form"), *own(r, ["tier", "variant", "ipa"]))


def best_hit(hits: Column, pos: Column) -> Column:
    """struct(tier_rank, step, tier, variant, ipa) of the first tier that has a value for pos, null if none has.

    In a tier pos, its parent and DEFAULT are tried, null values falling through; a plain entry fits any pos.
    """
    parent = F.try_element_at(F.create_map(*(F.lit(x) for kv in PARENT.items() for x in kv)), pos)

    def step(v: Column) -> Column:
        return F.when(v == "-", 0).when(v.eqNullSafe(pos), 1).when(v.eqNullSafe(parent), 2).when(v == "DEFAULT", 3)

    row = lambda x: F.struct(x["tier_rank"].alias("tier_rank"), step(x["variant"]).alias("step"), x["tier"].alias("tier"), x["variant"].alias("variant"), x["ipa"].alias("ipa"))
    return F.array_min(F.filter(F.transform(hits, row), lambda x: x["step"].isNotNull() & x["ipa"].isNotNull()))


def plain_hit(hits: Column) -> Column:
    """struct(tier, ipa) of the first tier that has the word at all, if it has it as a plain entry; null for homographs."""
    first = F.array_min(F.transform(hits, lambda x: x["tier_rank"]))
    own = F.filter(hits, lambda x: (x["tier_rank"] == first) & (x["variant"] == "-") & x["ipa"].isNotNull())
    return F.when(F.size(own) > 0, F.struct(F.get(own, F.lit(0))["tier"].alias("tier"), F.get(own, F.lit(0))["ipa"].alias("ipa")))


def resolve(words: DataFrame, entries: DataFrame) -> DataFrame:
    """words (word, pos) with tier, variant and ipa, null where no tier has the word."""
    best = with_hits(words, entries).withColumn("__best", best_hit(F.col("hits"), F.col("pos")))
    return best.select(*words.columns, *(F.col(f"__best.{c}").alias(c) for c in ("tier", "variant", "ipa")))


class Readings:
    """best_hit() without a tag for one word after the other, from the rows (tier_rank, tier, word, variant, ipa) of a lexicon."""

    folds = str.maketrans(ACCENTED, PLAIN)

    def __init__(self, rows):
        self.rows: dict[str, list[tuple]] = {}
        for rank, tier, word, variant, ipa in rows:
            self.rows.setdefault(word, []).append((rank, tier, variant, ipa))

    def ipa(self, word: str) -> str | None:
        folded = word.translate(self.folds)
        first: dict[int, list[tuple]] = {}
        for form in (word, word.lower(), folded, folded.lower()):
            new: dict[int, list[tuple]] = {}
            for hit in self.rows.get(form, ()):
                if hit[0] not in first:
                    new.setdefault(hit[0], []).append(hit)
            first |= new
        steps = {"-": 0, None: 1, "DEFAULT": 3}
        found = [(rank, steps[variant], ipa) for hits in first.values() for rank, _, variant, ipa in hits if variant in steps and ipa is not None]
        return min(found)[2] if found else None


def plain(words: DataFrame, entries: DataFrame) -> DataFrame:
    """words (word) with tier and ipa of plain entries; null for homographs and unknown words."""
    found = with_hits(words, entries).withColumn("__plain", plain_hit(F.col("hits")))
    return found.select(*words.columns, F.col("__plain.tier").alias("tier"), F.col("__plain.ipa").alias("ipa"))


def known_homographs(words: DataFrame, entries: DataFrame) -> DataFrame:
    """words (word) with `homograph`: whether any tier has readings of it by tag."""
    found = with_hits(words, entries)
    return found.select(*words.columns, F.exists("hits", lambda x: x["variant"] != "-").alias("homograph"))


def grow(entries: DataFrame) -> DataFrame:
    """entries and, for each lower-case or capitalised word of two letters or more, the other form; a tier's own words win."""
    low = F.lower("word")
    capital = F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, 2, 1 << 20))
    other = F.when(F.length("word") < 2, None).when(F.col("word") == low, capital).when(F.col("word") == capital, low)
    extra = entries.withColumn("other", other).where(F.col("other").isNotNull() & (F.col("other") != F.col("word")))
    extra = extra.withColumn("word", F.col("other")).select(entries.columns)
    return entries.unionByName(extra.join(entries.select("tier_rank", "word").distinct(), ["tier_rank", "word"], "left_anti").select(entries.columns))


def invalid_scalars(entries: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Entries with `bad`, the first scalar of ipa that is not in the vocabulary; an empty vocabulary accepts all."""
    known = F.array(*(F.lit(v) for v in vocabulary)).cast("array<string>")
    bad = F.get(F.filter(F.split("ipa", ""), lambda c: ~F.array_contains(known, c)), F.lit(0))
    return entries.withColumn("bad", bad).where(F.col("bad").isNotNull() & F.lit(bool(vocabulary)))


def homographs(entries: DataFrame) -> DataFrame:
    """(word, variants map): words with readings by tag, from the first tier that has them so, null readings left out."""
    own = entries.where(F.col("variant") != "-")
    first = own.groupBy("word").agg(F.min("tier_rank").alias("tier_rank"))
    read = own.join(first, ["word", "tier_rank"]).where(F.col("ipa").isNotNull())
    return read.groupBy("word").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("variant", "ipa")))).alias("variants"))
