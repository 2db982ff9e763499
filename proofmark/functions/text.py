"""Text normalisation as column expressions.

Only compatibility normalisation and case folding, which Spark lacks, are a
pandas UDF; ASCII values pass through it by ``lower`` alone.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from proofmark.config import IMAGE_EXTENSIONS, SAFE_FILENAME

#: White space as in the patterns of Python, beyond what Spark's trim strips; the same signs one by one.
SPACE = r"(?U)[\s\x1c-\x1f]"
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: What stays of a text in its key for comparisons.
KEY_WORD = re.compile("[a-z0-9']+")
#: Texts of an Arrow batch that are turned into Python's at a time.
AT_ONCE = 256


@F.pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    """Compatibility-normalised and case-folded."""
    return text.map(lambda t: t if t is None else t.lower() if t.isascii() else unicodedata.normalize("NFKC", t).casefold())


@F.pandas_udf(StringType())
def folded_lower(text: pd.Series) -> pd.Series:
    """Compatibility-normalised and lower-cased."""
    return text.map(lambda t: t if t is None else t.lower() if t.isascii() else unicodedata.normalize("NFKC", t).lower())


def _key(t: str | None) -> str | None:
    if t is None:
        return None
    t = t.replace("`", "'").lower() if t.isascii() else unicodedata.normalize("NFKC", t).replace("`", "'").casefold()
    return " ".join(KEY_WORD.findall(t)) or None


@F.arrow_udf(StringType())
def comparison_normalize(text: pa.Array) -> pa.Array:
    """Key for fuzzy comparison: letters a-z, digits, apostrophes (grave accents count as such) and single spaces; null if nothing is left.

    One function gives the whole key, so Spark works it out once per row however often an expression names it.
    Few texts of a batch are Python's at a time, so whole documents don't fill its memory.
    """
    parts = (text[i : i + AT_ONCE].to_pylist() for i in range(0, len(text), AT_ONCE))
    return pa.concat_arrays([pa.array([_key(t) for t in part], pa.string()) for part in parts] or [pa.array([], pa.string())])


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it; keeps expressions small.  Not for Python functions."""
    return F.get(F.transform(F.array(c), f), 0)


def nonempty(c: Column) -> Column:
    return F.when(c != "", c)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def squash(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, rf"{SPACE}+", " "))


def warning_normalize(c: Column) -> Column:
    return nonempty(folded(squash(c)))


def comparison_key(c: Column) -> Column:
    return nonempty(squash(F.lower(c)))


def eval_normalize(c: Column) -> Column:
    """For recognition metrics: word characters, points, percent signs and slashes stay."""
    return squash(F.regexp_replace(folded_lower(c), r"(?U)[^\w\s.%/]", " "))


def lines(c: Column) -> Column:
    """Stripped lines that aren't empty."""
    return F.filter(F.transform(F.split(c, r"[\n\r\x0B\x0C\x1C\x1D\x1E\x85  ]"), strip), lambda x: x != "")


def clean_display(c: Column) -> Column:
    """A line without junk at its edges; the line itself if nothing else is left."""
    inner = F.regexp_replace(F.regexp_replace(strip(c), r"""^(?U)[^\w"']+""", ""), r"""(?U)[^\w"'.!?-]+\z""", "")
    return F.coalesce(let(strip(inner), nonempty), strip(c))


def dedupe_lines(c: Column) -> Column:
    """The first of lines that differ in case only, in order."""
    return let(c, lambda a: let(F.transform(a, F.lower), lambda keys: F.filter(a, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)))


def ordered_distinct(*c: Column) -> Column:
    return F.array_distinct(F.concat(*c))


def safe_filename(c: Column) -> Column:
    """The stripped name if it is a plain, safe base name, else null."""
    name = strip(c)
    bad = (name == "") | name.contains("/") | name.contains("\\") | name.contains("..") | (name == ".")
    return F.when(~bad & name.rlike(SAFE_FILENAME), name)


def extension(c: Column) -> Column:
    """The lower-cased suffix with its point; empty for none, and for names whose one point comes first or last."""
    return F.lower(F.regexp_extract(c, r"^.+(\.[^.]+)$", 1))


def is_image_name(c: Column) -> Column:
    return extension(c).isin(*IMAGE_EXTENSIONS)


def preview(c: Column, n: int = 500) -> Column:
    return F.substring(c, 1, n)


def truncate(c: Column, n: int) -> Column:
    """At most ``n`` characters, an ellipsis included."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n - 1), F.lit("…")))


def quality_note(warnings: Column) -> Column:
    """Warnings as one note, without the name of the blur measure."""
    cleaned = F.transform(warnings, lambda w: squash(F.regexp_replace(w, r"(?i)\blaplacian\b", "")))
    return F.array_join(F.filter(cleaned, lambda w: w != ""), " ")


def general(c: Column) -> Column:
    """A number with up to six significant digits and no trailing zeros (C's %g), for 1e-4 <= abs < 1e6 and zero; else in scientific form."""
    return let(c, _general)


def _general(c: Column) -> Column:
    size = F.abs(c)
    digits = F.round(c, 9)
    for bound, places in ((1.0, 6), (10.0, 5), (100.0, 4), (1e3, 3), (1e4, 2), (1e5, 1), (1e6, 0)):
        digits = F.when((size < bound) & (size >= (0 if bound == 1.0 else bound / 10)), F.bround(c, places)).otherwise(digits)
    plain = F.regexp_replace(F.format_string("%.9f", digits), r"\.?0+$", "")
    return F.when((size >= 1e6) | (size < 1e-4) & (size > 0), F.regexp_replace(F.format_string("%.5e", c), r"\.?0+e", "e")).otherwise(plain)


def fixed(c: Column, places: int = 1) -> Column:
    """A number with so many decimals, rounded from its exact binary value as C does; only true halves go to the even digit.  Null from 1e15 on."""
    scale, half = 10**places, float(1 << 26)

    def told(x: Column) -> Column:
        # Each part has few enough bits for every product here to be exact.
        rest = x - F.floor(x)
        high = F.floor(rest * half) / half
        digit = F.floor(high * scale)
        over, missing = high * scale - digit - 0.5, (high - rest) * scale
        return F.floor(x) * scale + digit + F.when(over > missing, 1).when(over < missing, 0).otherwise(digit % 2)

    digits = let(F.abs(c.cast("double")), told).cast("long")
    text = F.concat(F.when(c < 0, "-").otherwise(""), F.floor(digits / scale).cast("string"), F.lit("."), F.lpad((digits % scale).cast("string"), places, "0"))
    return F.when(F.abs(c) < 1e15, text)
