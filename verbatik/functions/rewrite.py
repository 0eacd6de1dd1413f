"""Ordered span rewriting of prose: every rule finds its matches left to right and writes a replacement for each.

`splice` is the kernel: the text between matches and the mapped matches are zipped and joined, so offsets never shift. All
rules are row-local Column expressions and run on streaming DataFrames as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from verbatik.functions import abbreviations as short
from verbatik.functions.numbers import bound, cardinal, decade, decimal, digit_words, grouped_cardinal, ordinal, range_end, roman, year

# Capital runs that are read as words, and letter names.
WORD_ACRONYMS = "NASA NATO UNICEF UNESCO OPEC DARPA FEMA FIFA IKEA INTERPOL SCUBA LASER RADAR SONAR MODEM TASER GIF JPEG MPEG JSON SWAT SEAL AIDS SARS COVID EBOLA ASAP AWOL SNAFU FUBAR NIMBY WASP YOLO YAML".split()
LETTER_NAMES = dict(zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ˈeɪ bˈiː sˈiː dˈiː ˈiː ˈɛf dʒˈiː ˈeɪtʃ ˈaɪ dʒˈeɪ kˈeɪ ˈɛl ˈɛm ˈɛn ˈoʊ pˈiː kjˈuː ˈɑːɹ ˈɛs tˈiː jˈuː vˈiː dˈʌbəljˌuː ˈɛks wˈaɪ zˈiː".split(), strict=True))
# Characters folded to one other, and those that become a space.
FOLDED = {
    "'": "’‘`´ʹ′＇",
    "—": "–−―‒⸺⸻",
    '"': "‚‛„‟«»‹›「」『』《》",
    ";": "；",
    ":": "：︰",
    ",": "，、",
    ".": "．。｡",
    "!": "！¡⁈‼",
    "?": "？¿⁉⸮",
    "(": "［【〔〈｛（[{",
    ")": "］】〕〉｝）]}",
    "#": "＃",
    "$": "＄",
    "%": "％",
    "&": "＆",
    "*": "＊",
    "+": "＋",
    "=": "＝",
    "@": "＠",
    "_": "＿",
    "x": "×",
    " ": "~^\\|<>～＾｜＜＞†‡§¶•·±÷©®™→←↑↓↔↕",
}

# Units with their singular and plural, words before a year, month names, nouns before a Roman numeral.
UNITS = {"GHz": ("gigahertz", "gigahertz"), "MHz": ("megahertz", "megahertz"), "kHz": ("kilohertz", "kilohertz"), "Hz": ("hertz", "hertz"), "ms": ("millisecond", "milliseconds"), "mg": ("milligram", "milligrams"), "kg": ("kilogram", "kilograms"), "lbs": ("pounds", "pounds"), "lb": ("pound", "pounds"), "oz": ("ounce", "ounces"), "ml": ("milliliter", "milliliters"), "cm": ("centimeter", "centimeters"), "mm": ("millimeter", "millimeters"), "km": ("kilometer", "kilometers"), "mph": ("miles per hour", "miles per hour")}
YEAR_CUES = "in since by before after around circa during through until till year of from between".split()
MONTHS = "January February March April May June July August September October November December".split()
ROMAN_CUES = "Chapter Chapters Volume Volumes Vol Part Parts Act Acts Book Books Scene Scenes Article Articles Appendix Section Sections Figure Figures Table Tables Episode Episodes Stage Stages".split()
# Nouns before a room code, letters as read there, top-level domains.
ROOM_CUES = "apartment apt room rm gate exit building bldg suite ste flat unit floor fl lab block bay office studio box door zone".split()
ROOM_LETTERS = dict(zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ay,bee,see,dee,ee,eff,gee,aitch,eye,jay,kay,ell,em,en,oh,pee,cue,are,ess,tee,you,vee,double you,ex,why,zee".split(","), strict=True))
DOMAINS = "com org net edu gov mil int biz info io co us uk eu de fr jp cn ca au nz ru br mx es it nl ai dev app xyz".split()

# Patterns of addresses and numbers, which decide what a match is.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"(\+?\d{1,2})?[ .-]?\(?(\d{3})\)?[ .-](\d{3})[ .-](\d{4})\b"
IPV4 = r"(?<![0-9.])(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})(?![0-9.])"


def splice(text: Column, pattern: str, mapped: Callable[[Column], Column]) -> Column:
    """text with every match of pattern replaced by mapped(match); text without a match is not taken apart."""

    def read(t: Column) -> Column:
        pieces, found = F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        joined = F.array_join(F.zip_with(pieces, F.transform(found, mapped), lambda s, r: F.concat(s, F.coalesce(r, F.lit("")))), "")
        return F.when(t.rlike(pattern), joined).otherwise(t)

    return bound(text, read)


def guarded(text: Column, pattern: str, mapped: Callable[[Column], Column]) -> Column:
    """As splice, but what an earlier rule has put into a span stays; a match mapped to null stays too."""
    both = rf'<sub\b[^>]*>[^<]*</sub>|{pattern}'
    own = lambda m: F.when(m.startswith("<sub"), m).otherwise(F.coalesce(mapped(m), m))
    return bound(text, lambda t: F.when(t.rlike(pattern), splice(t, both, own)).otherwise(t))


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def sub(alias: Column, source: Column) -> Column:
    return F.concat(F.lit('<sub alias="'), alias, F.lit('">'), source, F.lit("</sub>"))


def attribute(value: Column) -> Column:
    """value as it stands in an attribute: &, quotes and angle brackets as references."""
    for own, reference in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        value = F.replace(value, F.lit(own), F.lit(reference))
    return value


def template(value: Column) -> Column:
    """value as it stands in the replacement of a pattern: backslashes and dollar signs are escaped."""
    return F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def ipa_override(word: Column, ipa: Column) -> Column:
    """word with its phonetic reading, one scalar a token."""
    return F.concat(F.lit("["), word, F.lit("](/"), F.array_join(F.split(ipa, ""), " "), F.lit("/)"))


def spelled(s: Column) -> Column:
    return F.array_join(F.split(s, ""), " ")


def fold_punctuation(text: Column) -> Column:
    """Dot runs to an ellipsis, hyphen pairs and spaced hyphens to dashes, then every folded character to its one."""
    run = r"\s*\.\s+\.\s+\.\s*|\.{2,}|\x{FF0E}{2,}|\x{30FB}{3,}|\s+--\s+|--|\s+-\s+"
    one = splice(text, run, lambda m: F.when(m == "--", F.lit("—")).when(m.contains("-"), F.lit(" — ")).otherwise(F.lit("…")))
    return F.translate(one, "".join(FOLDED.values()), "".join(to * len(own) for to, own in FOLDED.items()))


def email_alias(m: Column) -> Column:
    user, at = F.split_part(m, F.lit("@"), F.lit(1)), F.split_part(m, F.lit("@"), F.lit(2))
    dots = lambda c: F.replace(F.replace(c, F.lit("."), F.lit(" dot ")), F.lit("-"), F.lit(" dash "))
    return F.concat(F.replace(dots(user), F.lit("_"), F.lit(" underscore ")), F.lit(" at "), dots(at))


def phone_alias(m: Column) -> Column:
    group = lambda i: F.regexp_extract(m, PHONE, i)
    country = F.replace(group(1), F.lit("+"), F.lit(""))
    return F.concat_ws(", ", F.when(country != "", spelled(country)), spelled(group(2)), spelled(group(3)), spelled(group(4)))


def ipv4_alias(m: Column) -> Column:
    return F.array_join(F.transform(F.split(m, r"\."), spelled), " dot ")


def money_alias(m: Column, one: str, many: str, cent: str, cents: str) -> Column:
    major = F.regexp_extract(m, r"^.([0-9,]+)", 1)
    minor = F.regexp_extract(m, r"\.([0-9]{1,2})$", 1).try_cast("long")
    unit = F.when(F.replace(major, F.lit(","), F.lit("")).try_cast("long") == 1, F.lit(one)).otherwise(F.lit(many))
    rest = F.when(minor > 0, F.concat(F.lit(" and "), cardinal(minor), F.lit(" "), F.when(minor == 1, F.lit(cent)).otherwise(F.lit(cents))))
    return F.concat(grouped_cardinal(major), F.lit(" "), unit, F.coalesce(rest, F.lit("")))


def point_words(m: Column) -> Column:
    whole, part = F.regexp_extract(m, r"^([0-9]+)", 1), F.regexp_extract(m, r"^[0-9]+\.([0-9]+)", 1)
    return F.concat(cardinal(whole.try_cast("long")), F.when(part != "", F.concat(F.lit(" point "), digit_words(part))).otherwise(F.lit("")))


def emails(text: Column) -> Column:
    return splice(text, EMAIL, lambda m: sub(attribute(email_alias(m)), m))


def phones(text: Column) -> Column:
    return splice(text, PHONE, lambda m: sub(phone_alias(m), m))


def compounds(text: Column) -> Column:
    return splice(text, r"(?<![A-Za-z0-9>])[A-Za-z]+(?:-[A-Za-z]+){2,}(?![A-Za-z0-9<])", lambda m: sub(F.replace(m, F.lit("-"), F.lit(" ")), m))


def technical(text: Column) -> Column:
    for own, alias in (("IPv4", "I P version four"), ("IPv6", "I P version six")):
        text = F.regexp_replace(text, rf"(?<![A-Za-z0-9]){own}(?![A-Za-z0-9])", f'<sub alias="{alias}">{own}</sub>')
    return text


def iso_dates(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<![0-9])(\d{4}-\d{2}-\d{2})(?![0-9])", '<say-as interpret-as="date" format="ymd">$1</say-as>')


def times(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<![0-9<>])(\d{1,2}:\d{2}(?::\d{2})?)(?![0-9<>])", '<say-as interpret-as="time">$1</say-as>')


def ipv4(text: Column) -> Column:
    return splice(text, IPV4, lambda m: sub(ipv4_alias(m), m))


def money(text: Column) -> Column:
    text = splice(text, r"\$(?:\d{1,3}(?:,\d{3})*|\d+)(?:\.\d{1,2})?", lambda m: sub(money_alias(m, "dollar", "dollars", "cent", "cents"), m))
    text = splice(text, r"£(?:\d{1,3}(?:,\d{3})*|\d+)(?:\.\d{1,2})?", lambda m: sub(money_alias(m, "pound", "pounds", "penny", "pence"), m))
    return splice(text, r"€(?:\d{1,3}(?:,\d{3})*|\d+)(?:\.\d{1,2})?", lambda m: sub(money_alias(m, "euro", "euros", "cent", "cents"), m))


def percents(text: Column) -> Column:
    return splice(text, r"\d+(?:\.\d+)?%", lambda m: sub(F.concat(point_words(m), F.lit(" percent")), m))


def temperatures(text: Column) -> Column:
    unit = lambda m: F.when(m.endswith("F"), F.lit("Fahrenheit")).when(m.endswith("C"), F.lit("Celsius")).otherwise(F.lit("Kelvin"))
    return splice(text, r"\d+(?:\.\d+)?[°º][FCK]", lambda m: sub(F.concat(point_words(m), F.lit(" degrees "), unit(m)), m))


def ordinals(text: Column) -> Column:
    return guarded(text, r"(?<![A-Za-z0-9<>])\d+(?:st|nd|rd|th)(?![A-Za-z0-9])", lambda m: sub(ordinal(F.regexp_extract(m, r"(\d+)", 1).try_cast("long")), m))


def number_words(s: Column) -> Column:
    return F.when(s.contains("."), decimal(s)).otherwise(F.coalesce(cardinal(s.try_cast("long")), s))


def after_cue(m: Column, alias: Callable[[Column], Column]) -> Column:
    """A match of a cue, white space and a last word: the cue stays, the last word becomes a span."""
    last = F.regexp_extract(m, r"(\w+)$", 1)
    return F.concat(F.regexp_extract(m, r"(?s)^(.*?)\w+$", 1), sub(alias(last), last))


def romans(text: Column) -> Column:
    value = lambda s: F.when(roman(s) <= 3999, cardinal(roman(s)))
    return guarded(text, rf"\b(?:{'|'.join(ROMAN_CUES)})\s+[IVXLCDM]{{1,6}}\b", lambda m: after_cue(m, value))


def dimensions(text: Column) -> Column:
    side = lambda m, i: number_words(F.regexp_extract(m, r"^([0-9.]+)\s*[x×]\s*([0-9.]+)$", i))
    return splice(text, r"(?<![0-9A-Za-z<>])\d+(?:\.\d+)?\s*[x×]\s*\d+(?:\.\d+)?(?![0-9A-Za-z])", lambda m: sub(F.concat(side(m, 1), F.lit(" by "), side(m, 2)), m))


YEAR = r"(?:1[0-9]|20)\d{2}"


def decades(text: Column) -> Column:
    return splice(text, rf"(?i)\b{YEAR}s\b", lambda m: sub(decade(year(F.left(m, F.lit(4)).try_cast("long"))), m))


def _years_after(text: Column, cues: list[str]) -> Column:
    return splice(text, rf"(?i)\b(?:{'|'.join(cues)})\s+{YEAR}\b", lambda m: after_cue(m, lambda s: year(s.try_cast("long"))))


def cued_years(text: Column) -> Column:
    return _years_after(text, YEAR_CUES)


def month_years(text: Column) -> Column:
    return _years_after(text, MONTHS)


def years(text: Column) -> Column:
    """The three rules of years in one expression; STAGES has them apart, which keeps the plan small."""
    return month_years(cued_years(decades(text)))


def course_codes(text: Column) -> Column:
    def read(s: Column) -> Column:
        digit = lambda i: cardinal(F.substring(s, i, 1).try_cast("long"))
        oh = lambda i: F.when(F.substring(s, i, 1) == "0", F.lit("oh")).otherwise(digit(i))
        return F.concat_ws(" ", digit(1), oh(2), oh(3))

    return guarded(text, r"(?<![A-Za-z])[A-Z][A-Za-z]{2,}\s+\d{3}(?![0-9A-Za-z–—])", lambda m: after_cue(m, read))


def ranges(text: Column) -> Column:
    own = rf"(\d+(?:\.\d+)?)\s*[–—]\s*(\d+(?:\.\d+)?)(?:\s?({'|'.join(UNITS)}))?"
    plural = literal_map({k: many for k, (_, many) in UNITS.items()})
    part = lambda m, i: F.regexp_extract(m, f"^{own}$", i)
    return splice(text, rf"(?<![0-9A-Za-z<>]){own}(?![0-9A-Za-z])", lambda m: sub(F.concat_ws(" ", range_end(part(m, 1)), F.lit("to"), range_end(part(m, 2)), F.element_at(plural, part(m, 3))), m))


def units(text: Column) -> Column:
    """A number and a unit: in the singular before a noun (any word but "of" and "per") and after a one."""
    one, many = (literal_map({k: v[i] for k, v in UNITS.items()}) for i in (0, 1))
    own = rf"(\d+(?:,\d{{3}})*)(?:\.(\d+))?\s?({'|'.join(UNITS)})"
    part = lambda m, i: F.regexp_extract(m, f"^{own}$", i)
    words = lambda m: F.concat_ws(" ", F.coalesce(grouped_cardinal(part(m, 1)), part(m, 1)), F.when(part(m, 2) != "", F.concat(F.lit("point "), digit_words(part(m, 2)))))
    single = lambda m: (part(m, 2) == "") & F.replace(part(m, 1), F.lit(","), F.lit("")).rlike("^0*1$")
    start, noun = r"(?<![0-9A-Za-z<>])", r"(?=\s+(?!(?i:of|per)(?![A-Za-z]))[A-Za-z])"
    text = guarded(text, f"{start}{own}(?![A-Za-z0-9]){noun}", lambda m: sub(F.concat_ws(" ", words(m), F.element_at(one, part(m, 3))), m))
    return guarded(text, f"{start}{own}(?![A-Za-z0-9])", lambda m: sub(F.concat_ws(" ", words(m), F.when(single(m), F.element_at(one, part(m, 3))).otherwise(F.element_at(many, part(m, 3)))), m))


def _two_numbers(m: Column, mark: str, between: str) -> Column:
    sides = F.split(m, mark)
    return F.concat(cardinal(sides[0].try_cast("long")), F.lit(between), cardinal(sides[1].try_cast("long")))


def fractions(text: Column) -> Column:
    return guarded(text, r"(?<![0-9A-Za-z<>/])\d{1,3}/\d{1,3}(?![0-9/])", lambda m: sub(_two_numbers(m, "/", " out of "), m))


def ratios(text: Column) -> Column:
    return guarded(text, r"(?<![0-9A-Za-z:<>])\d+:\d+(?![0-9:])", lambda m: sub(_two_numbers(m, ":", " to "), m))


def parentheses(text: Column) -> Column:
    """Asides between dashes; the second dash goes before the end of a sentence."""
    aside = r"(?<!\])\((?!/)([^()]+)\)"
    return F.regexp_replace(F.regexp_replace(text, aside + "(?=[.!?])", "— $1"), aside, "— $1 —")


def clauses(text: Column) -> Column:
    """Dashes for commas before connectives and participles; a semicolon for the last dash of a long sentence without one."""
    text = F.regexp_replace(text, r"(?i),\s+(and|but|or|so|yet|nor|then|however|therefore|meanwhile|still)\s+", " — $1 ")
    text = F.regexp_replace(text, r",\s+([a-z]+(?:ed|ing))\s+", " — $1 ")
    sentences = F.split(text, r"""(?<=[.!?])(?=[ \t\n]+(?:[A-Z"']|\z))""")
    marked = lambda s: F.regexp_replace(s, r"\d+:\d+|https?://", "").rlike("[;:]")
    text = F.array_join(F.transform(sentences, lambda s: F.when((F.length(s) > 200) & ~marked(s), F.regexp_replace(s, r"(?s) ?—(?!.*—)", ";")).otherwise(s)), "")
    return F.regexp_replace(text, r";\s+([aAI])(?=\s|[.,!?])", " — $1")


def url_alias(s: Column) -> Column:
    for pattern, by in ((r"(?i)https://", "https "), (r"(?i)http://", "http "), (r"(?i)www\.", "www "), (r":(\d+)", " colon $1")):
        s = F.regexp_replace(s, pattern, by)
    domain, rest = F.regexp_extract(s, r"(?s)^([^/]*)", 1), F.regexp_extract(s, r"(?s)^[^/]*(/.*)$", 1)
    s = F.concat(F.replace(domain, F.lit("."), F.lit(" dot ")), rest)
    for mark, name in (("/", "slash"), ("-", "dash"), ("_", "underscore"), ("?", "question mark"), ("=", "equals"), ("&", "and"), ("%", "percent")):
        s = F.replace(s, F.lit(mark), F.lit(f" {name} "))
    for digit, name in enumerate("oh one two three four five six seven eight nine".split()):
        s = F.replace(s, F.lit(str(digit)), F.lit(f" {name} "))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def urls(text: Column) -> Column:
    # fixed value: the pattern of an address
    ends = "|".join(sorted(DOMAINS, key=lambda d: (-len(d), d)))
    found = rf"""(?i)(?<![@A-Za-z0-9])(?:https?://|www\.)?[A-Za-z0-9][A-Za-z0-9.-]*\.(?:{ends})\b(?::\d+)?(?:/[^\s"'<>]*)?"""
    closing = r"[.,;:!?)\]}]*$"
    core = lambda m: F.regexp_replace(m, closing, "")
    return splice(text, found, lambda m: F.concat(sub(attribute(url_alias(core(m))), core(m)), F.regexp_extract(m, f"({closing})", 1)))


def meridiem_times(text: Column) -> Column:
    """A time with a.m. or p.m. as one span; a pause follows it where a sentence begins."""
    # fixed value: the pattern of such a time
    own = r"(?<![A-Za-z0-9])\d{1,2}:\d{2}\s+[aApP]\.[mM]\.(?![A-Za-z0-9])"
    part = lambda m, i: F.regexp_extract(m, r"^(\d+):(\d+)\s+(.)", i)
    alias = lambda m: F.concat_ws(" ", part(m, 1), part(m, 2), F.upper(part(m, 3)), F.lit("M"))
    text = splice(text, own + r"(?=\s{1,2}[A-Z])", lambda m: sub(F.concat(alias(m), F.lit(". …")), m))
    return guarded(text, own, lambda m: sub(alias(m), m))


def abbreviations(text: Column) -> Column:
    """Abbreviations as spans of what they stand for, by their context; spans and tags of earlier rules stay."""
    protect = r"<(?:sub|say-as)\b[^>]*>[\s\S]*?</(?:sub|say-as)>|<[^>]*(?:>|\z)"
    pattern = f"{protect}|{short.PATTERN}"

    def read(t: Column) -> Column:
        pieces, found = F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))

        def one(m: Column, i: Column) -> Column:
            near = F.concat(F.get(found, i - 1), F.get(pieces, i))
            left = F.right(F.coalesce(F.concat(F.get(pieces, i - 1), near), near, F.get(pieces, i)), F.lit(short.NEAR))
            rest = F.concat(F.get(pieces, i + 1), F.coalesce(F.get(found, i + 1), F.lit("")), F.coalesce(F.get(pieces, i + 2), F.lit("")))
            alias = F.when(~m.startswith("<"), short.expansion(m, left, rest))
            return bound(alias, lambda own: F.when(own.isNull(), m).otherwise(sub(own, m)))

        spans = F.transform(found, one)
        return F.when(t.rlike(short.PATTERN), F.array_join(F.zip_with(pieces, spans, lambda s, r: F.concat(s, F.coalesce(r, F.lit("")))), "")).otherwise(t)

    return bound(text, read)


def room_codes(text: Column) -> Column:
    letters = literal_map(ROOM_LETTERS)
    own = rf"(?<![A-Za-z.])\.*(?i:{'|'.join(ROOM_CUES)})(?:\.+[ \t]*|[ \t]+)\d+[A-Z](?![A-Za-z0-9])"
    return splice(text, own, lambda m: after_cue(m, lambda s: F.concat(F.regexp_extract(s, r"^(\d+)", 1), F.lit(" "), F.element_at(letters, F.right(s, F.lit(1))))))


def codes(text: Column) -> Column:
    return splice(text, r"(?<![A-Za-z0-9<])[A-Z]{2,}\d+(?![A-Za-z0-9>])", lambda m: sub(spelled(m), m))


def initialisms(text: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in LETTER_NAMES.items() for x in kv))
    letters = lambda m: F.array_join(F.transform(F.split(m, ""), lambda c: F.concat(F.lit("["), c, F.lit("](/"), names[c], F.lit("/)"))), " ")
    return splice(text, r"(?<![A-Za-z0-9<>\[\]/])[A-Z]{2,}(?![A-Za-z0-9<>\[\]/])", lambda m: F.when(m.isin(WORD_ACRONYMS), m).otherwise(letters(m)))


def slashes(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<![A-Za-z0-9/])([A-Z])/([A-Z])(?![A-Za-z0-9/])", '<sub alias="$1 slash $2">$1/$2</sub>')


def closed(text: Column) -> Column:
    """A period at the end unless a sentence or clause mark is there."""
    return F.when(text.rlike(r"[.!?…:;]\z"), text).otherwise(F.concat(text, F.lit(".")))


#: The stages that are built, in their order.
STAGES = (fold_punctuation, parentheses, clauses, emails, urls, phones, compounds, technical, meridiem_times, abbreviations, iso_dates, times, ipv4, money, percents, temperatures, romans, dimensions, decades, cued_years, month_years, course_codes, ranges, units, fractions, ratios, ordinals, room_codes, codes, initialisms, slashes)


def normalize(df, text: str, out: str, stages=STAGES):
    """df with `out`: the text after all stages; each is bound to a column so that no stage is computed twice."""
    df = df.withColumn(out, F.col(text))
    for stage in stages:
        df = df.withColumn(out, stage(F.col(out)))
    return df
