"""Keys and text."""

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from payouts.schemas import DOCUMENT_WIDTH

__all__ = [
    "NUMBER_PATTERN", "blank_to_null", "fold_text", "fold_text_exact", "is_blank_key",
    "norm_document", "norm_key", "pad_document", "sanitize_label", "source_key", "strip", "zfill",
]

# Text that reads as a finite decimal number.
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# All characters Unicode counts as white space; plain trim only knows the blank.
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


@functools.cache
def _letter_map() -> tuple[str, str]:
    """Every character whose compatibility decomposition, without combining marks, is one other character (accented
    and full-width letters, styled digits, ...), then every combining mark, which translate deletes. Decompositions
    into several characters (ligatures, fractions) are left as they are."""
    source, target, marks = [], [], []
    for code in range(0xA0, 0x110000):
        if 0xD800 <= code < 0xE000:
            continue
        char = chr(code)
        if unicodedata.combining(char):
            marks.append(char)
            continue
        base = [c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)]
        if len(base) == 1 and base[0] != char:
            source.append(char)
            target.append(base[0])
    return "".join(source + marks), "".join(target)


def strip(c: Column) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.btrim(c.cast("string"), F.lit(WHITESPACE))


def norm_key(c: Column) -> Column:
    """Comparison key of an uploaded value: blank for NULL, stripped, upper case."""
    return F.upper(strip(F.coalesce(c.cast("string"), F.lit(""))))


def source_key(c: Column) -> Column:
    """Join key of a source column: case-insensitive, NULL when blank so it never joins."""
    return F.upper(blank_to_null(c))


def blank_to_null(c: Column) -> Column:
    # Not nullif: Spark makes its argument a column of its own, which moves with every row where this is a join key.
    text = F.trim(c.cast("string"))
    return F.when(text != "", text)


def fold_text(c: Column) -> Column:
    """Accent-free upper-case text, through one JVM translate built from Unicode's decompositions."""
    stripped = strip(F.coalesce(c.cast("string"), F.lit("")))
    accented, plain = _letter_map()
    return F.upper(F.translate(stripped, accented, plain))


@F.pandas_udf(T.StringType())
def _decompose(values: pd.Series) -> pd.Series:
    def bare(text: str) -> str:
        return "".join(ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch))

    return values.map(bare)


def fold_text_exact(c: Column) -> Column:
    """fold_text for any script (ligatures, full-width forms); costs an Arrow round trip."""
    return F.upper(_decompose(strip(F.coalesce(c.cast("string"), F.lit("")))))


def norm_document(c: Column) -> Column:
    """A number-like document becomes its integer text, anything else stripped text."""
    text = strip(F.coalesce(c.cast("string"), F.lit("")))
    whole = text.try_cast("double").try_cast("bigint").cast("string")
    return F.when(text.rlike(NUMBER_PATTERN), F.coalesce(whole, text)).otherwise(text)


def zfill(c: Column, width: int = DOCUMENT_WIDTH) -> Column:
    """Zero-fill on the left after an optional sign; longer text stays whole."""
    signed = c.rlike("^[+-]")
    body = F.when(signed, F.substring(c, 2, 1 << 30)).otherwise(c)
    sign = F.when(signed, F.substring(c, 1, 1)).otherwise(F.lit(""))
    filled = F.concat(sign, F.repeat(F.lit("0"), F.lit(width) - F.length(c)), body)
    return F.when(F.length(c) < width, filled).otherwise(c)


def pad_document(c: Column) -> Column:
    document = norm_document(c)
    return F.when(document == "", document).otherwise(zfill(document))


def is_blank_key(c: Column, numeric: bool = False) -> Column:
    """No usable key: NULL, blank, '-', 'nan', or zero when the column is a number."""
    blank = F.lower(strip(F.coalesce(c.cast("string"), F.lit("")))).isin("", "-", "nan")
    return blank | F.coalesce(c == 0, F.lit(False)) if numeric else blank


def sanitize_label(c: Column) -> Column:
    """File-safe label."""
    text = strip(F.coalesce(c.cast("string"), F.lit("")))
    safe = F.regexp_replace(text, r'[\\/:*?"<>|]+', "_")
    spaced = F.regexp_replace(safe, r"(?U)\s+", "_")
    return F.coalesce(F.nullif(spaced, F.lit("")), F.lit("periodo"))
