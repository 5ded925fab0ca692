"""Text normalisation and tokenisation as Spark column expressions.

Everything here stays JVM-side (regex, higher-order functions) except the
Porter stemmer, which runs as an Arrow-batched pandas UDF with a per-worker
word cache.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fuzzyspark.functions.porter import stem_text

# The whitespace set of Python's str.split() / str.isspace()
# (ASCII tab..CR, file/group/record/unit separators, space, NEL, NBSP and the
# Unicode space separators), written as a regex character-class body that
# both Java regex and RE2 accept.
WS = (r"\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
# Word characters as in Python's Unicode \w: letters, numbers, underscore.
PUNCT = r"[^\p{L}\p{N}_" + WS + r"]"

NULL_TOKEN = "nan"

PREPROCESS_METHODS = ("lower", "lowerStem", "lowerRemovePunctuation",
                      "lowerRemovePunctuationStem")
TOKENIZE_METHODS = ("threeGram", "splitBySpace")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(T.StringType())
def stem_words(s: pd.Series) -> pd.Series:
    """Porter-stem every whitespace-separated word (Arrow batch UDF)."""
    return s.map(stem_text, na_action="ignore")


def as_text(c, null_token: str | None = NULL_TOKEN) -> Column:
    """Value as string; nulls become ``null_token`` (``None`` keeps null)."""
    s = _col(c).cast("string")
    return s if null_token is None else F.coalesce(s, F.lit(null_token))


def lower(c) -> Column:
    return F.lower(_col(c))


def remove_punctuation(c) -> Column:
    return F.regexp_replace(_col(c), PUNCT, "")


def preprocess(c, method: str, stem: bool = True) -> Column:
    """One of the four preprocessing methods on an already-string column.

    ``stem=False`` turns the stemming methods into their unstemmed twins
    (used where a SQL oracle has to reproduce the result).
    """
    if method not in PREPROCESS_METHODS:
        raise ValueError(f"{method} is an invalid preprocessing method")
    x = lower(c)
    if "RemovePunctuation" in method:
        x = remove_punctuation(x)
    if method.endswith("Stem") and stem:
        x = stem_words(x)
    return x


def split_by_space(c) -> Column:
    """``str.split()``: whitespace runs separate tokens, no empty tokens."""
    return F.filter(F.split(_col(c), "[" + WS + "]+"), lambda t: t != "")


def collapse_space(c) -> Column:
    return F.array_join(split_by_space(c), " ")


def _windows(s: Column) -> Column:
    """All three-character windows of a string padded with ``$$``.

    The padded string is an element of an array, so it is built once and not
    again for every window."""
    padded = F.concat(F.lit("$$"), s, F.lit("$$"))
    return F.element_at(F.transform(F.array(padded), lambda p: F.transform(
        F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, 3))), 1)


def three_gram(c) -> Column:
    """3-grams of the whitespace-collapsed string padded with ``$$``.

    Duplicates are kept; the empty string gives ``['$$$', '$$$']``.
    """
    return _windows(collapse_space(c))


def tokenize(c, method: str | None) -> Column:
    if method is None:
        return _col(c)
    if method == "threeGram":
        return three_gram(c)
    if method == "splitBySpace":
        return split_by_space(c)
    raise ValueError(f"{method} is an invalid tokenization method")


def record_text(cols, null_token: str | None = NULL_TOKEN) -> Column:
    """Concatenate the join columns of a record with one space."""
    return F.concat_ws(" ", *[as_text(c, null_token if null_token is not None else "") for c in cols])


def block_normalize(cols, stem: bool = True,
                    null_token: str | None = NULL_TOKEN) -> Column:
    """Record normaliser of blocking and negative rules.

    Concatenate columns, lower-case, punctuation to a space, split on
    whitespace, stem each word and re-join with one space.
    """
    x = F.regexp_replace(F.lower(record_text(cols, null_token)), PUNCT, " ")
    x = collapse_space(x)
    return stem_words(x) if stem else x


def block_tokens(value) -> Column:
    """Blocking tokens: 3-grams of the value followed by its words."""
    v = _col(value)
    return F.concat(_windows(v), split_by_space(v))
