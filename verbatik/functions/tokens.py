"""Tokens with code-point offsets; their concatenation is the text.

Tokens are found by one regular expression in the JVM. What needs a token's neighbours (offsets, the space after it, the word
before or after it) is worked out within the row, in Arrow batches and without a shuffle, so rows that repeat a key stay apart
and a very long text is no hot key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from verbatik.functions import abbreviations

SPACE = r"\t\n\x0b\f\r\x{85}\p{Z}"
WORD = r"[\p{L}\p{M}\p{N}_]+"
#: Hyphenated words, contractions, words, single other characters, runs of white space.
TOKEN = rf"{WORD}(?:-{WORD})+|{WORD}(?:'{WORD})+|{WORD}|[^\p{{L}}\p{{M}}\p{{N}}_{SPACE}]|[{SPACE}]+"
#: The same with adjacent tokens that make an abbreviation as one; the longest abbreviation wins. An abbreviation ends with a
#: period and begins where a token does, so that it always covers whole tokens.
MERGED = rf"(?:{abbreviations.ANY})|{TOKEN}"
#: An abbreviation, looked for only where a period follows soon enough; and the words alone of the merged tokens, each run of
#: letters read once. Both are for the JVM: RE2 has no lookahead.
SOON = rf"(?=[A-Za-z][A-Za-z.]{{0,7}}\.)(?:{abbreviations.ANY})"
WORDS = rf"{SOON}|{WORD}+(?:(?:-{WORD}+)++|(?:'{WORD}+)++)?"
#: Marks that end a clause.
MARKS = [".", "!", "?", ";", ":", ","]
#: Rows whose tokens are laid out at once.
ROWS = 256


def token_array(text: Column, merged: bool = False) -> Column:
    return F.regexp_extract_all(text, F.lit(f"{SOON}|{TOKEN}" if merged else TOKEN), F.lit(0))


def word_array(text: Column) -> Column:
    """The merged tokens that are words."""
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def is_space(token: Column) -> Column:
    return token.rlike(rf"^[{SPACE}]+$")


def kind(token: Column) -> Column:
    return F.when(token.rlike(r"^[\p{L}\p{M}\p{N}_]"), "word").when(is_space(token), "space").otherwise("other")


def _last_where(mask: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For every place the last place before it, in its row, where mask holds; -1 if there is none."""
    at = np.maximum.accumulate(np.where(mask, np.arange(len(mask)), -1)) if len(mask) else np.zeros(0, np.int64)
    before = np.concatenate(([-1], at[:-1])) if len(at) else at
    return np.where((before >= 0) & (row[before] == row), before, -1)


def _taken(values: pa.Array, at: np.ndarray) -> pa.Array:
    return values.take(pa.array(at, mask=at < 0))


def lay_out(docs: DataFrame, text: str = "text", merged: bool = False, keep: list[str] | None = None) -> DataFrame:
    """(*keep, pos, token, len, start, kind, ws, before, next_word) of every token of every row; keep is all columns but text.

    start is the token's offset in code points and ws the white space right after it, empty if there is none. before is the
    last token before it that is no white space, next_word the next word of its clause. A null text has no tokens.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    rows = docs.select(*keep, token_array(F.col(text), merged).alias("__tokens"))
    more = "pos int, token string, len int, start long, kind string, ws string, before string, next_word string"
    schema = StructType([*rows.drop("__tokens").schema.fields, *StructType.fromDDL(more).fields])
    spaces, words = rf"^[{SPACE}]+$".replace(r"\x0b", "\x0b"), r"^[\p{L}\p{M}\p{N}_]"

    def run(batches):
        for big in batches:
            for lo in range(0, big.num_rows, ROWS):
                batch = big.slice(lo, ROWS)
                lists = batch.column(batch.num_columns - 1)
                token, row = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
                n = len(token)
                index = np.arange(n)
                first = np.searchsorted(row, row)
                size = pc.utf8_length(token).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.cumsum(size)
                start = ends - size - (ends - size)[first] if n else size
                space, word = (pc.match_substring_regex(token, p).to_numpy(zero_copy_only=False) for p in (spaces, words))
                mark = pc.is_in(token, pa.array(MARKS)).to_numpy(zero_copy_only=False)
                after = np.where((index + 1 < n) & np.append(row[1:] == row[:-1], False) & np.append(space[1:], False), index + 1, -1) if n else index
                clause = np.cumsum(mark)
                at = np.flatnonzero(word)
                following = np.full(n, -1)
                if len(at) > 1:
                    same = (row[at[1:]] == row[at[:-1]]) & (clause[at[1:]] == clause[at[:-1]])
                    following[at[:-1]] = np.where(same, at[1:], -1)
                names = pa.array(np.where(word, "word", np.where(space, "space", "other")), pa.string())
                own = [
                    pa.array((index - first).astype(np.int32)),
                    token,
                    pa.array(size.astype(np.int32)),
                    pa.array(start),
                    names,
                    pc.fill_null(_taken(token, after), ""),
                    _taken(token, _last_where(~space, row)),
                    _taken(token, following),
                ]
                kept = [batch.column(i).take(pa.array(row)) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, *own], names=schema.names)

    return rows.mapInArrow(run, schema)


def tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, token, start, len) of every token."""
    return lay_out(docs.select(key, text), text).select(key, "pos", "token", "start", "len")


def tagged(tokens: DataFrame, tagger=None) -> DataFrame:
    """tokens with `tag`, by tagger, a function from tokens to tokens with a tag; null tags without one or where it has none."""
    if tagger:
        return tagger(tokens)
    return tokens if "tag" in tokens.columns else tokens.withColumn("tag", F.lit(None).cast("string"))
