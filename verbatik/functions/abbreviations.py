"""Abbreviations: what they stand for, and the context that decides where they stand for more than one thing."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from verbatik.functions.numbers import bound

# Abbreviations of any case and what they stand for, in the order of the rules.
EXPANSIONS = {
    "Mr.": "Mister", "Mrs.": "Missus", "Ms.": "Miss", "Dr.": "Doctor", "Prof.": "Professor", "Rev.": "Reverend", "Hon.": "Honorable", "Mx.": "Mix", "Esq.": "Esquire",
    "Lt.": "Lieutenant", "Gen.": "General", "Col.": "Colonel", "Maj.": "Major", "Capt.": "Captain", "Sgt.": "Sergeant", "Cpl.": "Corporal",
    "Mon.": "Monday", "Tue.": "Tuesday", "Tues.": "Tuesday", "Wed.": "Wednesday", "Thu.": "Thursday", "Thur.": "Thursday", "Thurs.": "Thursday", "Fri.": "Friday", "Sat.": "Saturday", "Sun.": "Sunday",
    "Jan.": "January", "Feb.": "February", "Mar.": "March", "Apr.": "April", "Jun.": "June", "Jul.": "July", "Aug.": "August", "Sep.": "September", "Sept.": "September", "Oct.": "October", "Nov.": "November", "Dec.": "December",
    "St.": "Saint", "Ave.": "Avenue", "Rd.": "Road", "Blvd.": "Boulevard", "Ln.": "Lane", "Ct.": "Court", "Pl.": "Place", "Pkwy.": "Parkway", "Apt.": "Apartment", "Ste.": "Suite", "Fl.": "Floor",
    "N.Y.": "New York", "L.A.": "Los Angeles", "D.C.": "District of Columbia",
    "A.M.": "A M", "P.M.": "P M", "A.D.": "A D", "B.C.": "B C",
    "Ph.D.": "P H D", "M.D.": "M D", "B.A.": "B A", "M.A.": "M A", "B.S.": "B S", "M.S.": "M S", "Jr.": "Junior", "Sr.": "Senior", "M.B.A.": "M B A", "D.D.S.": "D D S", "D.V.M.": "D V M", "R.N.": "R N", "L.P.N.": "L P N",
    "etc.": "et cetera", "vs.": "versus", "v.": "versus", "e.g.": "for example", "i.e.": "that is", "dept.": "department", "govt.": "government", "approx.": "approximately", "est.": "estimated",
    "inc.": "incorporated", "corp.": "corporation", "ltd.": "limited", "co.": "company", "No.": "number", "vol.": "volume", "pg.": "page", "pp.": "pages", "ch.": "chapter", "fig.": "figure",
    "max.": "maximum", "min.": "minimum", "misc.": "miscellaneous", "assn.": "association", "assoc.": "association",
    "U.S.A.": "U S A", "U.S.": "U S", "U.K.": "U K", "U.N.": "U N", "E.U.": "E U",
    "Mt.": "Mount", "Mtn.": "Mountain", "Pk.": "Park", "Cir.": "Circle", "Sq.": "Square", "Bldg.": "Building", "Cyn.": "Canyon",
    "viz.": "namely", "cf.": "compare", "ibid.": "ibidem", "ca.": "circa",
    "F.Y.I.": "F Y I", "R.S.V.P.": "R S V P", "E.T.A.": "E T A", "A.I.": "A I",
    "in.": "inch", "ft.": "foot", "yd.": "yard", "mi.": "mile", "oz.": "ounce", "lb.": "pound", "lbs.": "pounds", "gal.": "gallon", "qt.": "quart", "pt.": "pint", "tsp.": "teaspoon", "tbsp.": "tablespoon", "hr.": "hour", "hrs.": "hours", "sec.": "second",
    "attn.": "attention", "ref.": "reference",
}
# Abbreviations that must be written just so.
CASED = {
    "Ala.": "Alabama", "Ariz.": "Arizona", "Ark.": "Arkansas", "Calif.": "California", "Colo.": "Colorado", "Conn.": "Connecticut", "Del.": "Delaware", "Fla.": "Florida", "Ga.": "Georgia", "Ill.": "Illinois", "Ind.": "Indiana",
    "Kan.": "Kansas", "Ky.": "Kentucky", "La.": "Louisiana", "Md.": "Maryland", "Mass.": "Massachusetts", "Mich.": "Michigan", "Minn.": "Minnesota", "Miss.": "Mississippi", "Mo.": "Missouri", "Mont.": "Montana", "Neb.": "Nebraska",
    "Nev.": "Nevada", "Okla.": "Oklahoma", "Ore.": "Oregon", "Pa.": "Pennsylvania", "Tenn.": "Tennessee", "Tex.": "Texas", "Va.": "Virginia", "Vt.": "Vermont", "Wash.": "Washington", "Wis.": "Wisconsin", "Wyo.": "Wyoming",
    "N.H.": "New Hampshire", "N.J.": "New Jersey", "N.M.": "New Mexico", "N.C.": "North Carolina", "N.D.": "North Dakota", "R.I.": "Rhode Island", "S.C.": "South Carolina", "S.D.": "South Dakota", "W.Va.": "West Virginia",
}
# What is one only before a number, what is one only after a number.
BEFORE_NUMBER = "no. vol. pg. pp. ch. fig.".split()
AFTER_NUMBER = "in. ft. yd. mi. oz. lb. lbs. gal. qt. pt. tsp. tbsp. hr. hrs. sec.".split()
# Names that make St. a saint, names of towns, and endings of street names.
SAINTS = "peter paul john mary patrick francis joseph michael george luke mark matthew thomas james anthony andrew".split()
TOWNS = "louis paul petersburg augustine helena cloud albans andrews".split()
STREETS = "st. rd. ave. blvd. ln. ct. pl. pkwy. cir. sq. dr.".split()
#: Code points before an abbreviation that its context is looked for in.
NEAR = 80

#: Every abbreviation, the longest first.
SURFACES = sorted([*EXPANSIONS, *CASED], key=lambda a: -len(a))
ANY = "|".join(re.escape(a) if a in CASED else f"(?i:{re.escape(a)})" for a in SURFACES)
PATTERN = rf"(?<![A-Za-z0-9<>])(?=[A-Za-z][A-Za-z.]{{0,7}}\.)(?:{ANY})(?=[\s,;:!?<]|\z)"


def context(own: Column, left: Column, right: Column) -> Column:
    """time, religious, place, title or default: what the text on both sides says of the abbreviation `own` (lower case).

    A number before it makes a time. St. is a saint before a saint's or a town's name and a street after an ordinal, a house
    number or a capitalised word. A house number, or a capitalised word before the ending of a street name, makes a place, a
    capitalised word after it a title.
    """
    sides = F.struct(F.regexp_replace(left, r"[ \t]+\z", "").alias("left"), F.regexp_replace(right, r"^[ \t]+", "").alias("right"))
    return bound(sides, lambda s: _context(own, s["left"], s["right"]))


def _context(own: Column, left: Column, right: Column) -> Column:
    named = F.lower(F.regexp_extract(right, r"^[\s's.,;:!?]*([^\s]*?)[\s's.,;:!?]*(?:\s|\z)", 1)).isin([*SAINTS, *TOWNS])
    recent = F.right(left, F.lit(30))
    street = left.rlike(r"[A-Z][a-z]+\s*\z")
    numbered = recent.rlike(r"(?i)\d+(?:st|nd|rd|th)\s*\z") | recent.rlike(r"(?i)\d+\s+(?:[NSEW]\.?\s+)?[A-Z]\w*\s*\z")
    saint = F.when(named, "religious").when(numbered | street, "place").otherwise("religious")
    house = left.rlike(r"(?i)\b\d+\s+(?:[A-Z]\.\s+)?\w+(?:\s+\w+)*\z")
    return (
        F.when(left.rlike(r"\b\d{1,2}(?::\d{2})?\s*\z"), "time")
        .when(own == "st.", saint)
        .when(house | (own.isin(STREETS) & street), "place")
        .when(right.rlike(r"^(?:\w+\s+)*[A-Z][a-z]+"), "title")
        .otherwise("default")
    )


def expansion(surface: Column, left: Column, right: Column) -> Column:
    """What the abbreviation stands for between left and right; null where it needs a number that is not there.

    One with two periods or more before a capital begins a new sentence after it and has a pause.
    """
    sides = F.struct(F.lower(surface).alias("own"), left.alias("left"), right.alias("right"))
    return bound(sides, lambda s: _expansion(surface, s["own"], s["left"], s["right"]))


def _expansion(surface: Column, own: Column, left: Column, right: Column) -> Column:
    known = lambda values: F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    plain = F.coalesce(F.try_element_at(known(CASED), surface), F.try_element_at(known({k.lower(): v for k, v in EXPANSIONS.items()}), own))
    # only two abbreviations depend on their context
    place = F.when(own.isin("dr.", "st."), context(own, left, right) == "place").otherwise(F.lit(False))
    words = F.when(place, F.when(own == "dr.", F.lit("Drive")).otherwise(F.lit("Street"))).otherwise(plain)
    after = F.when(own == "in.", left.rlike(r"(?:^|[^\w.])\d[\d,]*(?:\.\d+)?\s*\z")).otherwise(left.rlike(r"\d[\d,]*(?:\.\d+)?\s*\z"))
    barred = (own.isin(BEFORE_NUMBER) & ~right.rlike(r"^\s*\d")) | (own.isin(AFTER_NUMBER) & ~after)
    pause = (F.length(F.regexp_replace(surface, r"[^.]", "")) > 1) & F.left(right, F.lit(3)).rlike(r"^\s+[A-Z]")
    return F.when(~barred, F.concat(words, F.when(pause, F.lit(". …")).otherwise(F.lit(""))))


def surfaces(text: Column) -> Column:
    """The abbreviations that stand in text, in order, whatever their context."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
