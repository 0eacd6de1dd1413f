"""Numbers as English words, as Column expressions without Python on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of small numbers, tens, scales and irregular ordinals.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = ["", "", *"twenty thirty forty fifty sixty seventy eighty ninety".split()]
SCALES = ["", "thousand", "million", "billion", "trillion"]
IRREGULAR = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def bound(x: Column, read: Callable[[Column], Column]) -> Column:
    """read(x) with x computed once, however often read refers to it."""
    return F.transform(F.array(x), read)[0]


def strings(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _pick(values: list[str], i: Column) -> Column:
    return F.element_at(strings(values), (i + 1).cast("int"))


def _whole(x: Column, by: int) -> Column:
    return F.floor(x / by) if by < 1_000_000 else ((x - x % by) / by).cast("long")


def _group(x: Column) -> Column:
    """Words of 1 to 999; the empty string for 0."""
    h, r = F.floor(x / 100), x % 100
    return F.concat_ws(" ", F.when(h > 0, F.concat(_pick(ONES, h), F.lit(" hundred"))), F.when((r > 0) & (r < 20), _pick(ONES, r)), F.when(r >= 20, _pick(TENS, F.floor(r / 10))), F.when((r >= 20) & (r % 10 > 0), _pick(ONES, r % 10)))


def cardinal(n: Column) -> Column:
    """Cardinal words of a whole number; null for null. Groups from 10^15 on are left out."""

    def group_of(a: Column, i: int) -> Column:
        return F.struct(((_whole(a, 1000**i) if i else a) % 1000).alias("g"), F.lit(SCALES[i]).alias("scale"))

    def read(n: Column) -> Column:
        groups = F.array(*(group_of(F.abs(n), i) for i in range(len(SCALES) - 1, -1, -1)))
        live = F.filter(groups, lambda x: x["g"] > 0)
        words = F.transform(live, lambda x: F.concat_ws(" ", _group(x["g"]), F.when(x["scale"] != "", x["scale"])))
        return F.when(n.isNull(), None).when(n == 0, F.lit("zero")).otherwise(F.concat_ws(" ", F.when(n < 0, F.lit("minus")), words))

    return bound(n.cast("long"), read)


def ordinal_word(word: Column) -> Column:
    """The ordinal of a number's last word."""
    known = F.element_at(F.create_map(*(F.lit(x) for kv in IRREGULAR.items() for x in kv)), word)
    return F.coalesce(known, F.when(word.endswith("y"), F.regexp_replace(word, "y$", "ieth")).otherwise(F.concat(word, F.lit("th"))))


def ordinal(n: Column) -> Column:
    return bound(F.split(cardinal(n), " "), lambda words: F.concat_ws(" ", F.slice(words, 1, F.size(words) - 1), ordinal_word(F.element_at(words, -1))))


def year(n: Column) -> Column:
    """A year's reading: pairs of digits, "hundred" for round ones, the plain number at the start of some centuries."""

    def read(n: Column) -> Column:
        high, low = F.floor(n / 100), n % 100
        plain = (n < 1100) | (n > 9999) | ((high % 10 == 0) & (low < 10) & (low > 0))
        between = F.when(low == 0, F.lit(" hundred")).when(low < 10, F.lit(" oh ")).otherwise(F.lit(" "))
        first = cardinal(F.when(plain, n).otherwise(high))
        return F.when(plain, first).otherwise(F.concat(first, between, F.when(low == 0, F.lit("")).otherwise(cardinal(low))))

    return bound(n.cast("long"), read)


def digit_words(s: Column) -> Column:
    """Each digit of a string as a word; other characters are left out."""
    return F.array_join(F.transform(F.regexp_extract_all(s, F.lit("[0-9]"), F.lit(0)), lambda d: _pick(ONES, d.cast("int"))), " ")


def decimal(s: Column) -> Column:
    """`3.14` as "three point one four"; a string without exactly one point stays as it is."""
    parts = F.split(s, r"\.")
    whole = F.coalesce(cardinal(parts[0].try_cast("long")), parts[0])
    read = F.when(parts[0] == "", F.concat(F.lit("point "), digit_words(parts[1]))).otherwise(F.concat(whole, F.lit(" point "), digit_words(parts[1])))
    return F.when(F.size(parts) != 2, s).otherwise(read)


def grouped_cardinal(s: Column) -> Column:
    """Cardinal of digits with commas between; null if that is no number."""
    plain = F.replace(s, F.lit(","), F.lit(""))
    return F.when(plain.rlike(r"^[+-]?[0-9]{1,18}$"), cardinal(plain.try_cast("long")))


def decade(words: Column) -> Column:
    """Plural of a decade's words."""
    return F.when(words.endswith("y"), F.regexp_replace(words, "y$", "ies")).otherwise(F.concat(words, F.lit("s")))


def roman(s: Column) -> Column:
    """Value of Roman digits, canonical or not; null for other characters or nothing."""
    values = F.create_map(*(F.lit(x) for kv in ROMAN.items() for x in kv))
    step = lambda acc, c: F.struct((acc["total"] + F.when(values[c] < acc["last"], -values[c]).otherwise(values[c])).alias("total"), values[c].alias("last"))
    folded = F.aggregate(F.reverse(F.split(s, "")), F.struct(F.lit(0).alias("total"), F.lit(0).alias("last")), step)
    return F.when(s.rlike("^[IVXLCDM]+$"), folded["total"])


def range_end(s: Column) -> Column:
    """How the end of a range is read: a decimal, a year from 1100 to 2099, or a cardinal."""
    n = s.try_cast("long")
    return F.when(s.contains("."), decimal(s)).when(n.isNull(), s).when(n.between(1100, 2099), year(n)).otherwise(cardinal(n))
