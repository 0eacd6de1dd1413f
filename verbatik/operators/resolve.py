"""Resolution of a text's words: names, past tenses, homographs, hums and plain lookups, and what is emitted of them.

Every rule gives claims (doc_id, start, stop, word, reason, ipa or alias, and where the reading comes from). Names claim first,
then past tenses, then homographs; a later claim that overlaps an earlier one is dropped by an anti join of spans. Words that
nothing claims and no homograph rule knows are looked up. Offsets are code points of the text with folded punctuation.
"""

from __future__ import annotations

from dataclasses import dataclass

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verbatik.functions import rewrite, tokens
from verbatik.operators import context, lexicon, names, spans

# Homographs with readings tuned by hand, as reading of a verb and reading otherwise.
TUNED = {"live": ("lˈɪv", "lˈIv"), "lead": ("lˈid", "lˈɛd"), "wind": ("wˈInd", "wˈɪnd"), "tear": ("tˈɛɹ", "tˈɪɹ"), "bass": (None, "bˈAs")}
# The context of past tenses and participles.
PERFECT = r"(?:had|have|has|having|been|was|were|be|being|is|are|never|ever|already|just)\s+(?:\w+\s+){0,2}"
PAST_TIME = r"(?=[^.!?;\n]{0,80}?\b(?:yesterday|last\s+(?:night|week|month|year|summer|time)|\w+\s+ago|earlier|this\s+morning)\b)"
PAST_VERBS = r"was|were|had|did|said|went|came|took|gave|told|paid|saw|made|found|kept|left|felt|thought|knew|held|brought|taught|caught|bought|heard|ran|sat|stood|understood|became|began|spoke|wrote|sent|lost|got|put|set|cut|hit|\w{3,}ed"
TOLD_BEFORE = rf"(?:[^!?;\n]{{0,300}}?\b(?:{PAST_VERBS})\b[^!?;\n]*?)"
TOLD_AFTER = rf"(?=[^!?;\n]{{0,300}}?\b(?:{PAST_VERBS})\b)"
SUBJECT = r"(?:she|he|they|we|I|you|it|who|which|that)\s+"
SUBJECT_OR_NAME = r"(?:she|he|they|we|I|you|it|who|which|that|[A-Z][a-z]+)\s+"
PASSIVE = r"(?:was|were|been|being|is|are|be|had|have|has|having)\s+"
#: Word, tag, what stands before and after it; the first rule that fits a place holds.
PAST_RULES = [
    *((w, tag, before, after) for w in ("read", "reread") for tag, before, after in (("VBN", PERFECT, ""), ("VBD", "", PAST_TIME), ("VBD", TOLD_BEFORE, ""), ("VBD", SUBJECT_OR_NAME, TOLD_AFTER))),
    ("used", "VBD", "", r"(?=\s+to\b)"),
    ("wound", "VBD", SUBJECT, ""),
    ("wound", "VBN", PASSIVE, ""),
]
#: The rules of the classic order, which has none of the ones by verbs told before or after.
CLASSIC_RULES = [r for r in PAST_RULES if r[2] not in (TOLD_BEFORE, SUBJECT_OR_NAME)]
CLAIM = ["doc_id", "start", "stop", "word", "reason", "ipa", "alias", "provenance", "tier", "variant"]


@dataclass
class Plan:
    """docs (doc_id, text folded), words (tokens that are words, with ipa where a lookup gives one) and claims; entries of the
    lexicon where no tagger has a say."""

    docs: DataFrame
    words: DataFrame
    claims: DataFrame
    entries: DataFrame | None = None


def name_claims(docs: DataFrame, entries: DataFrame) -> DataFrame:
    found = names.read(names.find(docs), entries)
    reason = F.when(F.col("ipa").isNotNull(), "properName").otherwise("properNameFallback")
    variant = F.when(F.col("provenance") == "lexicon", "-")
    return found.withColumns({"word": F.col("source"), "reason": reason, "variant": variant}).select(CLAIM)


def past_claims(docs: DataFrame, entries: DataFrame, rules=PAST_RULES) -> DataFrame:
    """Claims of words whose context shows a past tense or participle; words without such a reading claim nothing."""
    spark = docs.sparkSession
    asked = spark.createDataFrame(sorted({(w, tag) for w, tag, _, _ in rules}), "word string, pos string")
    readings = F.broadcast(lexicon.resolve(asked, entries).where(F.col("ipa").isNotNull()).select(F.col("word").alias("key"), F.col("pos").alias("variant"), "tier", "ipa"))
    some = docs.select("doc_id", "text").where(F.col("text").rlike(rf"(?i)\b(?:{'|'.join(sorted({r[0] for r in rules}))})\b"))
    found = spans.matches_of(some, [rf"(?i)\b{before}\b{word}\b{after}" for word, _, before, after in rules])
    rule = F.col("rule") + 1
    key = F.element_at(F.array(*(F.lit(r[0]) for r in rules)), rule)
    every = found.withColumns({"key": key, "variant": F.element_at(F.array(*(F.lit(r[1]) for r in rules)), rule)})
    every = every.withColumns({"start": F.col("stop") - F.length("key"), "word": F.right("source", F.length("key"))})
    known = every.join(readings, ["key", "variant"])
    best = known.groupBy("doc_id", "start", "stop", "word").agg(F.min(F.struct("rule", "variant", "tier", "ipa")).alias("b"))
    return best.select("doc_id", "start", "stop", "word", F.lit("pennContext").alias("reason"), "b.ipa", F.lit(None).cast("string").alias("alias"), F.lit("lexicon").alias("provenance"), "b.tier", "b.variant")


def homograph_rules(spark: SparkSession, entries: DataFrame) -> DataFrame:
    """(key, readings map by variant, tiers map, tuned): words with a reading by a tag of the tagger, and those tuned by hand."""
    own = lexicon.homographs(entries).select(F.lower("word").alias("key"), "word", "variants")
    first = own.groupBy("key").agg(F.min_by("variants", "word").alias("variants"))
    by_tag = F.exists(F.map_keys("variants"), lambda k: k.isin(*context.TAG_VARIANT.values()))
    rank = entries.where("variant <> '-'").groupBy(F.lower("word").alias("key")).agg(F.min_by("tier", "tier_rank").alias("tier"))
    tuned = spark.createDataFrame([(w, {k: v for k, v in (("VERB", verb), ("DEFAULT", other)) if v}) for w, (verb, other) in TUNED.items()], "key string, variants map<string,string>")
    learned = first.where(by_tag).join(rank, "key").join(F.broadcast(tuned.select("key")), "key", "left_anti")
    none = F.lit(None).cast("string")
    return learned.select("key", "variants", "tier", F.lit(False).alias("tuned")).unionByName(tuned.select("key", "variants", none.alias("tier"), F.lit(True).alias("tuned")))


def homograph_claims(words: DataFrame, rules: DataFrame) -> DataFrame:
    """Claims of the words (lay_out's columns and tag, with promoted) that rules know, by tag; null readings claim nothing."""
    tags = F.create_map(*(F.lit(x) for kv in context.TAG_VARIANT.items() for x in kv))
    rows = words.withColumn("key", F.lower("token")).join(F.broadcast(rules.withColumnRenamed("tier", "own_tier")), "key")
    verb = (F.col("tag") == "Verb") & F.coalesce(F.lower("before").isin(context.COPULAS), F.lit(False))
    own = F.when(verb, None).when(F.col("promoted") & F.map_contains_key("variants", F.lit("VERB")), "VERB").otherwise(F.try_element_at(tags, F.col("tag")))
    variant = F.when(own.isNotNull() & F.coalesce(F.map_contains_key("variants", own), F.lit(False)), own).otherwise("DEFAULT")
    rows = rows.withColumn("variant", variant).withColumn("ipa", F.try_element_at("variants", F.col("variant"))).where(F.col("ipa").isNotNull())
    tuned = F.col("tuned")
    return rows.select("doc_id", "start", (F.col("start") + F.col("len")).alias("stop"), F.col("token").alias("word"), F.lit("homograph").alias("reason"), "ipa", F.lit(None).cast("string").alias("alias"), F.when(tuned, "handTuned").otherwise("lexicon").alias("provenance"), F.col("own_tier").alias("tier"), F.when(~tuned, F.col("variant")).alias("variant"))


def resolve(docs: DataFrame, entries: DataFrame, text: str = "text", tagger=None) -> Plan:
    """The plan of docs (doc_id, text): each is resolved apart, so doc_id must tell rows apart.

    tagger maps a token table to one with a column tag (Noun, Verb, Adjective, Adverb, Determiner, Pronoun, Conjunction or
    another value); without one all tags are null and homographs have their DEFAULT reading. A null text has no tokens.
    """
    return _resolved(docs.select("doc_id", rewrite.fold_punctuation(F.col(text)).alias("text")), entries, tagger)


def _resolved(folded: DataFrame, entries: DataFrame, tagger=None) -> Plan:
    spark = folded.sparkSession
    table = tokens.tagged(tokens.lay_out(folded, merged=True), tagger)
    solid = table.where(F.col("kind") != "space")
    solid = context.promote_verbs(solid) if tagger else solid.withColumn("promoted", F.lit(False))
    named = name_claims(folded, entries)
    past = spans.unclaimed(past_claims(folded, entries), named)
    taken = named.unionByName(past)
    rules = homograph_rules(spark, entries)
    words = solid.where(F.col("kind") == "word").withColumn("stop", F.col("start") + F.col("len"))
    chosen = spans.unclaimed(homograph_claims(words, rules), taken)
    claims = taken.unionByName(chosen)
    free = spans.unclaimed(words, taken)
    keyed = free.withColumn("key", F.lower("token")).join(F.broadcast(rules.select("key")), "key", "left_anti")
    hum = context.hum(F.col("token"))
    # every distinct word is looked up once
    asked = keyed.select(F.col("token").alias("word")).distinct().withColumn("pos", F.lit(None).cast("string"))
    found = lexicon.resolve(asked, entries).select(F.col("word").alias("token"), F.col("ipa").alias("__ipa"), "tier")
    read = keyed.join(found, "token", "left").withColumn("ipa", F.coalesce(hum, "__ipa"))
    held = read.where(F.col("ipa").isNotNull()).select("doc_id", "pos", "ipa", F.when(hum.isNull(), F.col("tier")).alias("tier"))
    return Plan(folded, words.select("doc_id", "pos", "token", "tag", "start", "stop").join(held, ["doc_id", "pos"], "left"), claims, None if tagger else entries)


#: Words that a task keeps the readings of.
CACHE = 400_000


def may_claim(text: Column) -> Column:
    """Whether a name or a past tense can be in text, so that its words need offsets."""
    some = text.rlike(rf"(?i)\b(?:{'|'.join(sorted({r[0] for r in PAST_RULES}))})\b")
    past = F.lit(False)
    for word, _, before, after in PAST_RULES:
        past = past | text.rlike(rf"(?i)\b{before}\b{word}\b{after}")
    name = (text.contains("O'") | text.contains("Mc") | text.contains("Mac")) & text.rlike(names.NAME)
    return F.coalesce(name | (some & past), F.lit(False))


def read_in_rows(folded: DataFrame, entries: DataFrame, listed: bool) -> DataFrame:
    """Of texts (doc_id, text) that no name or past tense is in, without tags and with a lexicon that is broadcast: (doc_id,
    plain, hom, oov) of every row or, listed, (doc_id, token, ipa) of its different words looked up. Within the row, no shuffle."""
    spark = folded.sparkSession
    # both are bounded by BROADCAST_ROWS
    rules = {r["key"]: "DEFAULT" in r["variants"] for r in homograph_rules(spark, entries).select("key", "variants").collect()}
    readings = lexicon.Readings(tuple(r) for r in entries.select("tier_rank", "tier", "word", "variant", "ipa").collect())
    shared = spark.sparkContext.broadcast((rules, readings))
    key = folded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        rules, readings = shared.value
        hums, known = re.compile("[hH][mM]+"), {}

        def read(word: str) -> tuple[int, str | None]:
            """0 for a word with nothing, 1 and its reading for one looked up, 2 for a homograph."""
            low = word.lower()
            if low in rules:
                return (2 if rules[low] else 0), None
            ipa = "hˈmː" if hums.fullmatch(word) else readings.ipa(word)
            return int(ipa is not None), ipa

        for batch in batches:
            lists, ids = batch.column(1), batch.column(0)
            row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            coded = lists.flatten().dictionary_encode()
            at, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
            if len(known) > CACHE:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = read(w)
            ways = np.fromiter((known[w][0] for w in words), np.int8, len(words))[at] if len(words) else np.zeros(0, np.int8)
            if listed:
                own = np.unique(row[ways == 1].astype(np.int64) * max(1, len(words)) + at[ways == 1])
                place, word = own // max(1, len(words)), own % max(1, len(words))
                held = [words[i] for i in word]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(place)), pa.array(held, pa.string()), pa.array([known[w][1] for w in held], pa.string())], names=["doc_id", "token", "ipa"])
            else:
                sums = [pa.array(np.bincount(row[ways == k], minlength=batch.num_rows).astype(np.int64)) for k in (1, 2, 0)]
                yield pa.RecordBatch.from_arrays([ids, *sums], names=["doc_id", "plain", "hom", "oov"])

    out = f"doc_id {key}, " + ("token string, ipa string" if listed else "plain long, hom long, oov long")
    return folded.select("doc_id", tokens.word_array(F.col("text")).alias("words")).mapInArrow(run, out)


def _parts(plan: Plan, listed: bool) -> tuple[DataFrame, Plan | None]:
    """The rows that need no offsets, read in place, and a plan of the others; None if there are none, which a pass finds out.
    The others stay in Spark's cache, as the plan reads them often."""
    claims = may_claim(F.col("text"))
    others = plan.docs.where(claims).persist()
    if others.isEmpty():
        others.unpersist()
        return read_in_rows(plan.docs, plan.entries, listed), None
    return read_in_rows(plan.docs.where(~claims), plan.entries, listed), _resolved(others, plan.entries)


def provenance_label(provenance: Column, tier: Column, variant: Column) -> Column:
    """tier, or tier:variant, or the way a name was put together with its tier, or hand-tuned."""
    entry = F.when(F.coalesce(variant, F.lit("-")) == "-", tier).otherwise(F.concat(tier, F.lit(":"), variant))
    built = F.when(provenance == "compose", F.concat(F.lit("celtic-compose:"), tier)).when(provenance == "respelling", F.concat(F.lit("celtic-respell:"), tier))
    return F.when(provenance == "handTuned", F.lit("hand-tuned")).when(provenance == "lexicon", entry).otherwise(built)


def counts(plan: Plan) -> DataFrame:
    """(doc_id, plain, hom, name, span, oov) of every document: words looked up, claims by reason, and words with nothing.

    Without a tagger and with a lexicon that is broadcast only texts that may hold a name or a past tense are taken apart into
    rows of words.
    """
    columns = ("plain", "hom", "name", "span", "oov")
    if plan.entries is not None and lexicon.is_small(plan.entries):
        own, rest = _parts(plan, listed=False)
        own = own.select("doc_id", "plain", "hom", F.lit(0).cast("long").alias("name"), F.lit(0).cast("long").alias("span"), "oov")
        if rest:
            own = own.unionByName(counts(Plan(rest.docs, rest.words, rest.claims)).dropDuplicates(["doc_id"]))
        found = own.groupBy("doc_id").agg(*(F.sum(c).alias(c) for c in columns))
        return plan.docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in columns))
    own = plan.claims.groupBy("doc_id").agg(*(F.count_if(F.col("reason") == r).alias(n) for r, n in (("homograph", "hom"), ("properName", "name"), ("properNameFallback", "span"))))
    plain = plan.words.groupBy("doc_id").agg(F.count("ipa").alias("plain"))
    missed = spans.unclaimed(plan.words.where(F.col("ipa").isNull()), plan.claims).groupBy("doc_id").agg(F.count("*").alias("oov"))
    out = plan.docs.select("doc_id").join(plain, "doc_id", "left").join(own, "doc_id", "left").join(missed, "doc_id", "left")
    return out.select("doc_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("plain", "hom", "name", "span", "oov")))


def reasons(plan: Plan) -> DataFrame:
    """(reason, label, n): the claims by reason and provenance."""
    return plan.claims.groupBy("reason", provenance_label(F.col("provenance"), F.col("tier"), F.col("variant")).alias("label")).agg(F.count("*").alias("n"))


def lexicon_map(plan: Plan) -> DataFrame:
    """(doc_id, lexicon map<string, array<string>>) of words looked up, one entry a word, its reading as single scalars."""
    if plan.entries is not None and lexicon.is_small(plan.entries):
        own, rest = _parts(plan, listed=True)
        words = own.unionByName(rest.words.select("doc_id", "token", "ipa")) if rest else own
    else:
        words = plan.words
    pairs = words.where(F.col("ipa").isNotNull()).select("doc_id", "token", F.split("ipa", "").alias("scalars"))
    return pairs.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("token", "scalars")))).alias("lexicon"))


def annotated(plan: Plan) -> DataFrame:
    """(doc_id, annotated): the text with readings and aliases written over their spans."""
    new = F.when(F.col("ipa").isNotNull(), rewrite.ipa_override(F.col("word"), F.col("ipa"))).otherwise(rewrite.sub(F.col("alias"), F.col("word")))
    edits = plan.claims.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop", new.alias("replacement"))).alias("edits"))
    return plan.docs.join(edits, "doc_id", "left").select("doc_id", spans.spliced(F.col("text"), F.col("edits")).alias("annotated"))


def emit(plan: Plan) -> DataFrame:
    """(doc_id, annotated, lexicon) of every document."""
    return annotated(plan).join(lexicon_map(plan), "doc_id", "left")


# Words that the curated lexicon has, and those of the classic order whose readings are written over them.
CURATED = "Maya Worcestershire colonel Colonel kettle choir iron rural squirrel February boil midnight moonlight spotlight sunrise sideline online offline outside website deadline portrait email rolling review research approved defense began".split()
OVERRIDDEN = "Maya Worcestershire colonel Colonel kettle choir iron rural squirrel February boil Angeles Louisville Worcester Moines Márquez Marquez García Garcia Hernández Hernandez Rodríguez Rodriguez González Gonzalez Pérez Perez Ramírez Ramirez Núñez Nunez López Lopez".split()
AGGRESSIVE = "midnight moonlight spotlight sunrise sideline online offline outside website deadline portrait email rolling review research approved defense began".split()


def scanned_lexicon(docs: DataFrame, entries: DataFrame, text: str = "text") -> DataFrame:
    """(word, ipa, tier, way) of the distinct words of all texts: plain entries, names put together, and homographs without ipa.

    Words are runs of letters and apostrophes. way is plain, homograph or name; other words have no row.
    """
    words = docs.select(F.explode(F.regexp_extract_all(text, F.lit(r"[\p{L}']+"), F.lit(0))).alias("word")).distinct()
    hits = lexicon.with_hits(words, entries).withColumn("p", lexicon.plain_hit(F.col("hits")))
    way = F.when(F.col("p").isNotNull(), "plain").when(F.exists("hits", lambda x: x["variant"] != "-"), "homograph")
    own = hits.select("word", F.col("p.ipa").alias("ipa"), F.col("p.tier").alias("tier"), way.alias("way")).where(F.col("way").isNotNull())
    found = names.read(names.find(docs.select(text), text).withColumn("possessive", F.lit(None).cast("string")), entries)
    named = found.where(F.col("ipa").isNotNull()).select(F.col("bare").alias("word"), "ipa", "tier", F.lit("name").alias("way")).distinct()
    return own.unionByName(named.join(own.where("way = 'plain'").select("word"), "word", "left_anti"))


def curated_lexicon(docs: DataFrame, entries: DataFrame, text: str = "text", words=tuple(CURATED)) -> DataFrame:
    """(word, ipa) of the listed words, plain or by DEFAULT, and of the names in the texts."""
    asked = docs.sparkSession.createDataFrame([(w,) for w in words], "word string")
    hits = lexicon.with_hits(asked, entries)
    ipa = F.coalesce(lexicon.plain_hit(F.col("hits"))["ipa"], lexicon.best_hit(F.col("hits"), F.lit(None).cast("string"))["ipa"])
    listed = hits.select("word", ipa.alias("ipa")).where(F.col("ipa").isNotNull())
    found = names.read(names.find(docs.select(text), text).withColumn("possessive", F.lit(None).cast("string")), entries)
    named = found.where(F.col("ipa").isNotNull()).select(F.col("bare").alias("word"), "ipa").distinct()
    return listed.join(named.select("word"), "word", "left_anti").unionByName(named)


def _readings(spark: SparkSession, entries: DataFrame, asked: list[tuple[str, str | None]]) -> dict[tuple[str, str | None], str]:
    """Readings of a fixed list of words, which bounds what comes to the driver."""
    rows = lexicon.resolve(spark.createDataFrame(asked, "word string, pos string"), entries).where(F.col("ipa").isNotNull()).collect()
    return {(r["word"], r["pos"]): r["ipa"] for r in rows}


#: What later rules leave as it is: markup and readings of earlier ones.
PROTECTED = r"<[^>]*>|\[[^\]]*\]\(/[^)]*/\)"


def classic_names(docs: DataFrame, entries: DataFrame, text: str = "text", lexicon_active: bool = False) -> DataFrame:
    """docs with names in text read or, without a reading, aliased; with lexicon_active names with a reading stay.

    docs must have doc_id, which tells rows apart. Only documents with names are joined.
    """
    found = names.read(names.find(docs.select("doc_id", text), text), entries)
    tail = F.coalesce("possessive", F.lit(""))
    bare = F.regexp_replace("alias", r"['’]s$", "")
    aliased = F.concat(rewrite.sub(bare, F.col("bare")), tail)
    spoken = F.when(F.col("ipa").isNotNull(), F.col("source") if lexicon_active else rewrite.ipa_override(F.col("source"), F.col("ipa"))).otherwise(aliased)
    edits = found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop", spoken.alias("replacement"))).alias("__edits"))
    return docs.join(edits, "doc_id", "left").withColumn(text, spans.spliced(F.col(text), F.col("__edits"))).drop("__edits")


def classic_overrides(docs: DataFrame, entries: DataFrame, text: str = "text", aggressive: bool = False, tags: str | None = None) -> DataFrame:
    """docs with readings written over words by the classic order's last three rules: past tenses, listed words, homographs.

    tags names a column, map of a word in lower case to its tag, for homographs; without one they have their DEFAULT reading.
    """
    spark = docs.sparkSession
    column = F.col(text)
    known = _readings(spark, entries, [(w, tag) for w, tag, _, _ in CLASSIC_RULES])
    for word, tag, before, after in CLASSIC_RULES:
        if (word, tag) in known:
            reading = F.lit(" ".join(known[word, tag]))
            own = lambda m, n=len(word), r=reading: F.concat(F.left(m, F.length(m) - n), F.lit("["), F.right(m, F.lit(n)), F.lit("](/"), r, F.lit("/)"))
            column = _beside(column, rf"(?i:\b{before}{word}\b{after})", own)
    listed = [*OVERRIDDEN, *(AGGRESSIVE if aggressive else [])]
    plain = _readings(spark, entries, [(w, None) for w in listed])
    if plain:
        ipa = F.create_map(*(F.lit(x) for (w, _), v in plain.items() for x in (w, v)))
        pattern = rf"(?<![A-Za-z\[<>/])(?:{'|'.join(sorted((w for w, _ in plain), key=len, reverse=True))})(?![A-Za-z\]<>/])"
        column = _beside(column, pattern, lambda m: rewrite.ipa_override(m, ipa[m]))
    rules = {r["key"]: r["variants"] for r in homograph_rules(spark, entries).limit(HOMOGRAPHS + 1).collect()}
    if len(rules) > HOMOGRAPHS:
        raise ValueError(f"more than {HOMOGRAPHS} homographs; resolve() joins them instead")
    readings = F.create_map(*(x for k, v in rules.items() for x in (F.lit(k), F.create_map(*(F.lit(y) for kv in v.items() for y in kv)))))
    variants = F.create_map(*(F.lit(x) for kv in context.TAG_VARIANT.items() for x in kv))

    def read(m: Column) -> Column:
        own = readings[F.lower(m)]
        tag = F.try_element_at(variants, F.try_element_at(F.col(tags), F.lower(m))) if tags else F.lit(None).cast("string")
        ipa = F.coalesce(F.try_element_at(own, tag), F.try_element_at(own, F.lit("DEFAULT")))
        return F.when(ipa.isNotNull(), rewrite.ipa_override(m, ipa)).otherwise(m)

    column = _beside(column, rf"(?i)(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(sorted(rules, key=len, reverse=True))})(?![\p{{L}}\p{{N}}_])", read)
    return docs.withColumn(text, column)


#: Homographs that the classic order writes into its plan at most; the lexicon of the tests has nine, a full one some 700.
HOMOGRAPHS = 2000


def _beside(text: Column, pattern: str, mapped) -> Column:
    """splice, but what PROTECTED matches stays."""
    own = lambda m: F.when(m.rlike(rf"^(?:{PROTECTED})$"), m).otherwise(mapped(m))
    return F.when(text.rlike(pattern), rewrite.splice(text, f"{PROTECTED}|{pattern}", own)).otherwise(text)


#: The classic order: no folding of punctuation, names after compounds, readings at the end.
CLASSIC_STAGES = tuple(s for s in rewrite.STAGES if s is not rewrite.fold_punctuation)


def normalize(docs: DataFrame, text: str, out: str, mode: str = "ported", entries: DataFrame | None = None, tagger=None) -> DataFrame:
    """docs with `out`: the text as it is (raw), after resolution, emission and all rules but folding (ported), or after the
    rules in the classic order (classic). Without entries ported is the rules alone. docs must have doc_id."""
    if mode == "raw":
        return docs.withColumn(out, F.col(text))
    if mode == "ported":
        if entries is None:
            return rewrite.normalize(docs, text, out)
        resolved = annotated(resolve(docs, entries, text, tagger)).withColumnRenamed("annotated", out)
        return rewrite.normalize(docs.join(resolved, "doc_id"), out, out, CLASSIC_STAGES)
    if mode != "classic" or entries is None:
        raise ValueError("mode is raw, ported or classic, and classic needs a lexicon")
    at = CLASSIC_STAGES.index(rewrite.compounds) + 1
    head = rewrite.normalize(docs, text, out, CLASSIC_STAGES[:at])
    named = classic_names(head, entries, out)
    return classic_overrides(rewrite.normalize(named, out, out, CLASSIC_STAGES[at:]), entries, out)
