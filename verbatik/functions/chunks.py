"""Packing of text into chunks of bounded length: whole sentences where they fit, words otherwise."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SENTENCE = re.compile(r"[^.;:!?]*(?:[.;:!?]|\Z)")
#: The tab and all space separators.
BLANKS = "\t \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def pack(parts, most: int) -> list[str]:
    """Parts joined by spaces, in order, into as few runs of at most `most` characters; a longer part stays whole."""
    runs, held, size = [], [], 0
    for part in parts:
        if held and size + 1 + len(part) > most:
            runs.append(" ".join(held))
            held, size = [], 0
        size += len(part) + (1 if held else 0)
        held.append(part)
    return [*runs, " ".join(held)] if held else runs


def chunk_text(text: str, most: int) -> list[str]:
    """A sentence of `most` characters or more is packed by words, apart from its neighbours."""
    runs, short = [], []
    for sentence in filter(None, (m.group().strip(BLANKS) for m in SENTENCE.finditer(text))):
        if len(sentence) < most:
            short.append(sentence)
        else:
            runs += [*pack(short, most), *pack(filter(None, sentence.split(" ")), most)]
            short = []
    return runs + pack(short, most)


def chunks(text: Column, most: int = 140) -> Column:
    """Chunks of at most `most` characters in order; a word that is longer stays whole. Null stays null, the empty text has none.

    In Arrow batches: a fold by higher-order functions copies the chunks so far at every step, and long texts take its square.
    """

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else chunk_text(t, most))

    return run(text)
