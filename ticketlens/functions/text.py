"""Text normalisation, tokens and n-grams as Spark column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as white space, and the token classes.
_SPACES = r"\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
WHITESPACE = f"[{_SPACES}]+"
EDGE_WHITESPACE = f"^[{_SPACES}]+|[{_SPACES}]+$"
WORD = r"[\p{L}\p{N}_]+"
WORD_2 = r"[\p{L}\p{N}_]{2,}"
LETTERS_2 = r"^[\p{L}\p{Nl}\p{No}]{2,}$"

# Mail-template phrases dropped from classifier text.
TEMPLATE_PHRASES = (
    r"тема письма[:\s]*",
    r"текст письма[:\s]*",
    r"индекс опс[:\s]*",
    r"добрый день[,!\s]*",
    r"здравствуйте[,!\s]*",
)

# Stop words of the classifier vocabulary.
STOP_WORDS = (
    "и в во на с со по за из для от до к ко у о об а но или не нет это как что при все "
    "вы мы я он она они num url неуказано"
).split()

# Characters that NFKC leaves alone and whose case folding is lower() plus the
# sharp s. Text made only of them never has to leave the JVM.
STABLE_TEXT = (
    r"^[\x00-\x7FÀ-ıĴ-ľŁ-ňŊ-ž"
    r"Ѐ-џ‐‒-―‘-‟]*$"
)


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfkc_casefold(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v).casefold(), na_action="ignore")


@F.pandas_udf(T.StringType())
def _casefold(values: pd.Series) -> pd.Series:
    return values.map(str.casefold, na_action="ignore")


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """Apply ``use`` to ``value`` evaluated once, however often ``use`` mentions it."""
    return F.transform(F.array(value), lambda x: use(x))[0]


def collapse(value: Column | str) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(as_column(value), WHITESPACE, " "))


def strip(value: Column | str) -> Column:
    return F.regexp_replace(as_column(value), EDGE_WHITESPACE, "")


def blank_to_null(value: Column | str) -> Column:
    return F.nullif(strip(as_column(value).cast("string")), F.lit(""))


def is_blank(value: Column | str) -> Column:
    """Whether :func:`blank_to_null` is null; the search ends at the first character that is no white space."""
    return F.coalesce(~as_column(value).cast("string").rlike(f"[^{_SPACES}]"), F.lit(True))


def clean_text(value: Column | str, fill: str | None = None) -> Column:
    cleaned = F.nullif(collapse(as_column(value).cast("string")), F.lit(""))
    return F.coalesce(cleaned, F.lit(fill)) if fill is not None else cleaned


def clean_text_batch(value: Column | str, fill: str | None = None) -> Column:
    """Batch dialect: an empty string stays empty and only null takes ``fill``."""
    cleaned = collapse(as_column(value).cast("string"))
    return F.coalesce(cleaned, F.lit(fill)) if fill is not None else cleaned


def simple_casefold(value: Column | str) -> Column:
    return F.replace(F.lower(as_column(value)), F.lit("ß"), F.lit("ss"))


def _outside_stable(value: Column) -> Column:
    return F.when(~value.rlike(STABLE_TEXT), value)


def normalize_text(value: Column | str) -> Column:
    """NFKC and collapsed white space; only text that NFKC may change goes to Arrow."""
    source = as_column(value)
    return collapse(F.coalesce(_nfkc(_outside_stable(source)), source))


def normalize_casefold(value: Column | str) -> Column:
    source = as_column(value)
    return collapse(F.coalesce(_nfkc_casefold(_outside_stable(source)), simple_casefold(source)))


def casefold(value: Column | str) -> Column:
    source = as_column(value)
    return F.coalesce(_casefold(_outside_stable(source)), simple_casefold(source))


def classifier_text(value: Column | str, phrases: Sequence[str] = TEMPLATE_PHRASES) -> Column:
    """Lower case, template phrases dropped, addresses and whole numbers masked."""
    text = F.lower(F.coalesce(as_column(value), F.lit("")))
    if phrases:
        text = F.regexp_replace(text, "(?U)" + "|".join(phrases), " ")
    text = F.regexp_replace(text, f"http[^{_SPACES}]+|www[^{_SPACES}]+", " <URL> ")
    text = F.regexp_replace(text, r"(?<![\p{L}\p{N}_])\p{Nd}+(?![\p{L}\p{N}_])", " <NUM> ")
    return collapse(text)


def feature_text(text: Column | str, service: Column | str, component: Column | str) -> Column:
    """``text | service | component``; a missing part leaves its slot empty."""
    return F.concat_ws(" | ", classifier_text(text), classifier_text(service), classifier_text(component))


def word_tokens(value: Column | str, pattern: str = WORD_2) -> Column:
    return F.regexp_extract_all(as_column(value), F.lit(pattern), F.lit(0))


def token_set(value: Column | str) -> Column:
    """Sorted distinct words of already normalised text."""
    return F.sort_array(F.array_distinct(word_tokens(value, WORD)))


def search_words(value: Column | str) -> Column:
    return word_tokens(F.lower(as_column(value)), WORD_2)


def classifier_words(value: Column | str, stop_words: Sequence[str] = tuple(STOP_WORDS)) -> Column:
    """Letters-only words of two or more characters without the stop words."""
    words = word_tokens(F.lower(as_column(value)), WORD)
    return F.filter(words, lambda w: w.rlike(LETTERS_2) & ~w.isin(*stop_words))


def padded_words(value: Column | str) -> Column:
    """White-space separated lower-case words, each padded with one blank per side."""
    words = F.split(collapse(F.lower(as_column(value))), " ")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
