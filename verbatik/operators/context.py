"""Choice of a homograph's reading from tags and clause context, by windows over a document's tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatik.functions.tokens import MARKS, kind, lay_out

# Clause openers, plurals without s, words before which a verb reading does not hold.
OPENERS = "and or but nor yet so because since although though while when where if unless until after before whenever wherever whereas that which who whom whose".split()
PLURALS = "men women children people feet teeth mice geese oxen lice analyses crises theses phenomena criteria strata bacteria data media alumni".split()
COPULAS = "is are was were be been being am 's 're still very quite so really truly".split()
# Tags and the lexicon's names for them.
TAG_VARIANT = {"Verb": "VERB", "Noun": "NOUN", "Adjective": "ADJ", "Adverb": "ADV"}


def plural_noun(word: Column) -> Column:
    """Whether a word looks like a plural noun."""
    low = F.lower(word)
    return low.isin(PLURALS) | ((F.length(word) >= 3) & low.rlike("s$") & ~low.rlike("(?:ss|us|is)$"))


def hum(word: Column) -> Column:
    """`hˈmː` for an h with one m or more, null for other words."""
    return F.when(word.rlike(r"(?i)^hm+\z"), F.lit("hˈmː"))


def copula_vetoes(docs: DataFrame, copulas=tuple(COPULAS)) -> DataFrame:
    """(doc_id, pos, token, vetoed) of every token after another, white space aside: whether that other is a copula."""
    rows = lay_out(docs.select("doc_id", "text")).where((F.col("kind") != "space") & F.col("before").isNotNull())
    return rows.select("doc_id", "pos", "token", F.lower("before").isin(*copulas).alias("vetoed"))


def next_words(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, token, next_word) of every word: the next word of its clause, null at its end."""
    return lay_out(docs.select("doc_id", "text")).where(F.col("kind") == "word").select("doc_id", "pos", "token", "next_word")


def promote_verbs(tokens: DataFrame) -> DataFrame:
    """tokens (doc_id, pos, token, tag; no white space) with `promoted`: a noun or adjective that its clause shows to be a verb.

    Between the last clause mark, conjunction or opener and the token there is a pronoun or plural noun, and no determiner,
    verb or copula; the clause's next word is no verb. A null tag counts as none. One shuffle, by document.
    """
    low, tag = F.lower("token"), F.coalesce("tag", F.lit(""))
    word, mark = kind(F.col("token")) == "word", F.col("token").isin(MARKS)
    word = word | F.col("token").isin("'s", "'re")
    veto = word & (tag.isin("Determiner", "Verb") | low.isin(COPULAS))
    opens = mark | (word & ~veto & ((tag == "Conjunction") | low.isin(OPENERS)))
    subject = word & ~veto & ~opens & ((tag == "Pronoun") | ((tag == "Noun") & plural_noun(F.col("token"))))
    doc = Window.partitionBy("doc_id").orderBy("pos")
    rows = tokens.withColumns({"__word": word, "__veto": veto, "__subject": subject, "__clause": F.sum(opens.cast("int")).over(doc), "__marks": F.sum(mark.cast("int")).over(doc)})
    before = Window.partitionBy("doc_id", "__clause").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("doc_id", "__marks").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    following = F.first(F.when(F.col("__word"), tag), ignorenulls=True).over(after)
    seen, barred = F.max("__subject").over(before), F.max("__veto").over(before)
    promoted = tag.isin("Noun", "Adjective") & F.coalesce(seen, F.lit(False)) & ~F.coalesce(barred, F.lit(False)) & (F.coalesce(following, F.lit("")) != "Verb")
    return rows.withColumn("promoted", promoted).select(*tokens.columns, "promoted")


def read_homographs(tokens: DataFrame, homographs: DataFrame) -> DataFrame:
    """Tokens that the homographs (word, variants) know, with `variant` and `ipa`: the reading of the tag, else DEFAULT.

    A verb right after a copula loses its tag, a promoted token that has a verb reading is a verb. Tokens without a fitting
    reading are left out.
    """
    lag = F.lag(F.lower("token")).over(Window.partitionBy("doc_id").orderBy("pos"))
    rows = promote_verbs(tokens).withColumn("__before", lag).withColumn("__key", F.lower("token"))
    names = F.create_map(*(F.lit(x) for kv in TAG_VARIANT.items() for x in kv))
    known = homographs.select(F.lower("word").alias("__key"), "variants").dropDuplicates(["__key"])
    rows = rows.join(known, "__key")
    own = F.when((F.col("tag") == "Verb") & F.col("__before").isin(COPULAS), None).when(F.col("promoted") & F.map_contains_key("variants", F.lit("VERB")), "VERB").otherwise(F.try_element_at(names, F.col("tag")))
    variant = F.when(own.isNotNull() & F.coalesce(F.map_contains_key("variants", own), F.lit(False)), own).otherwise("DEFAULT")
    rows = rows.withColumn("variant", variant).withColumn("ipa", F.try_element_at("variants", F.col("variant")))
    return rows.where(F.col("ipa").isNotNull()).select(*tokens.columns, "variant", "ipa")
