"""Text scalars: tokenising, trimming, stop words, date text.

Every function has a Column form for the index side; those the query side needs
have a plain Python form that gives the same.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of Unicode and the hyphen. Java's \s is ASCII only, so the class is spelt out.
SEPARATOR = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000-]"

EDGE = r"^[^\p{L}\p{Nd}_]+|[^\p{L}\p{Nd}_]+$"

#: The English stop words.
STOP_WORDS = (
    "a able about across after all almost also am among an and any are as at be because been but by can cannot could dear did do does either else "
    "ever every for from get got had has have he her hers him his how however i if in into is it its just least let like likely may me might most "
    "must my neither no nor not of off often on only or other our own rather said say says she should since so some than that the their them then "
    "there these they this tis to too twas us wants was we were what when where which while who whom why will with would yet you your"
).split()

TOKENS = T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())]))


def as_text(value: Column, kind: T.DataType) -> Column:
    """A field value as text: dates as 'Tue Jan 01 2013 12:00:00 GMT+0000', all else as Spark casts it. Arrays aren't text: see ``array_tokens``."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        ts = value.cast("timestamp")
        return F.concat(F.date_format(ts, "EEE MMM dd yyyy HH:mm:ss"), F.lit(" GMT"), F.replace(F.date_format(ts, "xxx"), F.lit(":"), F.lit("")))
    return value.cast("string")


def tokens(text: Column, separator: str = SEPARATOR) -> Column:
    """Lower-cased non-empty pieces of a text, in order."""
    return F.filter(F.split(F.lower(text), separator), lambda t: t != "")


def array_tokens(values: Column) -> Column:
    """Array elements as they are, one token each, null as the empty string."""
    return F.transform(values, lambda v: F.coalesce(v.cast("string"), F.lit("")))


def tokenize(text: str, separator: str = SEPARATOR) -> list[tuple[str, int, int]]:
    """(token, start, length) of each token; offsets count code points of the text."""
    out, start = [], 0
    for m in [*re.finditer(separator, text), None]:
        end = m.start() if m else len(text)
        if end > start:
            out.append((text[start:end].lower(), start, end - start))
        start = m.end() if m else end
    return out


#: Bytes of texts that are split at once.
AT_ONCE = 1 << 20

#: The separator as Arrow's regular expressions write it.
_RE2 = re.sub(r"\\u([0-9a-f]{4})", lambda m: chr(int(m[1], 16)), SEPARATOR).replace("\\x85\\xa0", "\x85\xa0")
PLACES = pa.list_(pa.struct([("token", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))


def _places(texts: pa.Array, separator: str) -> pa.Array:
    """Lists of (token, start, length). With the usual separator, of one character, by columns, so a token costs its own bytes and two integers."""
    if separator != SEPARATOR:
        named = [t and [{"token": w, "start": s, "length": n} for w, s, n in tokenize(t, separator)] for t in texts.to_pylist()]
        return pa.array([[] if t == "" else t for t in named], PLACES)
    pieces = pc.split_pattern_regex(texts, _RE2)
    words, ends = pieces.flatten(), pieces.offsets
    length = pc.utf8_length(words)
    total = np.concatenate([[0], np.cumsum(np.asarray(length, dtype=np.int64) + 1)])
    of = np.repeat(np.arange(len(texts)), np.diff(ends))
    start = total[:-1] - total[np.asarray(ends)[of]]
    full = np.asarray(length) > 0
    kept = np.concatenate([[0], np.cumsum(full)])[np.asarray(ends)]
    columns = [words.filter(pa.array(full)), pa.array(start[full], pa.int32()), length.cast(pa.int32()).filter(pa.array(full))]
    return pa.ListArray.from_arrays(pa.array(kept, pa.int32()), pa.StructArray.from_arrays(columns, ["token", "start", "length"]), mask=texts.is_null() if texts.null_count else None)


def places(texts: pa.Array, separator: str = SEPARATOR) -> pa.Array:
    """Tokens, not yet lower-cased, with their places; some texts are split at a time."""
    size = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))])
    out, i = [], 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(size, size[i] + AT_ONCE, "right")) - 1)
        out.append(_places(texts.slice(i, j - i), separator))
        i = j
    return pa.concat_arrays(out) if out else _places(texts, separator)


def placed_tokens(separator: str = SEPARATOR):
    """A vectorised function from text to tokens with their places."""

    @F.arrow_udf(TOKENS)
    def place(texts: pa.Array) -> pa.Array:
        return places(texts, separator)

    def lower(t: Column) -> Column:
        return F.struct(F.lower(t["token"]).alias("token"), t["start"].alias("start"), t["length"].alias("length"))

    return lambda text: F.transform(place(text), lower)


def trim(token: Column) -> Column:
    """Without leading and trailing characters other than letters, digits and underscores."""
    return F.regexp_replace(token, EDGE, "")


def trim_text(token: str) -> str:
    return regex.sub(EDGE, "", token)


def is_stop_word(token: Column) -> Column:
    return F.lower(token).isin(STOP_WORDS)
