"""Fill-in-the-middle: texts rearranged so that a model learns to fill a gap from both sides.

The tokenizers library's ``Split`` pre-tokenizer, with its matches isolated, cuts a
text into units; nothing is trained.  It gives each unit's offsets in code points:
their number is n, and the offsets ranked at two drawn places cut the text into
prefix, middle and suffix.  Python hands back three numbers for a text; the
texts themselves stay with Spark, which puts the parts together.

The draws come from the SHA-256 of ``seed:doc_id``, so they depend on the row
alone, and a task that runs again gives the same output.

Defined results: a null text counts as empty; an empty text, and one that contains
a mark, stays plain (n is counted all the same); a null ``doc_id`` draws as an
empty one; repeated rows are each transformed, alike; columns other than
``doc_id`` and ``text`` are left out, whatever their names; no rows give no rows.
A long text is cut piece by piece, so that few units are held at a time.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import common

#: Units: runs of ASCII letters, and every other code point by itself.
UNITS = "[A-Za-z]+|[^A-Za-z]"
#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Percent of the texts that stay plain, and of the others that begin with the suffix.
PLAIN, SUFFIX_FIRST = 10, 20
#: Code points that are cut into units at a time, and those of a text whose units are all kept until its places are known.
PIECE, HELD = 512, 1 << 15
#: Where a text may be cut in two without changing its units: before anything but an ASCII letter.
EDGE = re.compile("[^A-Za-z]")


@cache
def _cutter():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(UNITS), "isolated")


def pieces(text: str) -> Iterator[tuple[int, str]]:
    """The text in pieces of about ``PIECE`` code points, each with its place; no unit crosses an edge."""
    at = 0
    while at < len(text):
        edge = EDGE.search(text, at + PIECE)
        end = edge.start() if edge else len(text)
        yield at, text[at:end]
        at = end


def places(text: str, *draws: int) -> tuple[int, list[int]]:
    """The number of units and, for each draw, the code point at which unit ``draw % (n + 1)`` begins (n: the text's end)."""
    cut = _cutter().pre_tokenize_str
    held, firsts, n = len(text) <= HELD, [], 0
    for at, piece in pieces(text):
        units = cut(piece)
        # The units of longer texts are not kept; the pieces of the two places are cut once more.
        firsts.append((n, at, units if held else piece))
        n += len(units)
    out = []
    for rank in (d % (n + 1) for d in draws):
        if rank == n:
            out.append(len(text))
        else:
            first, at, units = firsts[bisect_right(firsts, rank, key=itemgetter(0)) - 1]
            out.append(at + (units if held else cut(units))[rank - first][1][0])
    return n, out


@F.arrow_udf(StructType([StructField(c, LongType()) for c in ("n", "prefix_end", "middle_end")]))
def cuts(text: pa.Array, one: pa.Array, other: pa.Array) -> pa.Array:
    """The number of units, and the ends of prefix and middle in code points."""
    rows = []
    for t, a, b in zip(text, one.to_pylist(), other.to_pylist(), strict=True):
        n, found = places(t.as_py(), a, b)
        rows.append((n, *sorted(found)))
    columns = [list(c) for c in zip(*rows, strict=True)] or [[], [], []]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["n", "prefix_end", "middle_end"])


def transform(docs: DataFrame, seed: int = 1, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``doc_id``, ``n`` (units), ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` (code points; null if plain) and ``output`` of every row.

    psm is prefix, suffix, middle, each behind its mark; spm begins with the suffix.
    Of a hundred draws ``plain`` leave a text as it is, and of a hundred others ``suffix_first`` make it spm.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draw = lambda k: F.conv(F.substring("digest", 8 * k - 7, 8), 16, 10).cast("long")
    p, s, m = map(F.lit, MARKS)
    text, cut = F.col("text"), F.col("cut")
    marked = F.lit(False)
    for mark in MARKS:
        marked = marked | text.contains(mark)
    form = F.when((text == "") | marked | (draw(3) % 100 >= 100 - plain), "plain").when(draw(4) % 100 < suffix_first, "spm").otherwise("psm")
    # Python sees the text and two numbers, and answers three.
    made = common.texts_of(docs).withColumn("digest", digest).withColumn("cut", cuts("text", draw(1), draw(2))).withColumn("form", form)
    prefix = F.substring(text, F.lit(1), cut["prefix_end"].cast("int"))
    middle = F.substring(text, cut["prefix_end"].cast("int") + 1, (cut["middle_end"] - cut["prefix_end"]).cast("int"))
    suffix = F.substring(text, cut["middle_end"].cast("int") + 1, F.length(text))
    output = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(text)
    split = F.col("form") != "plain"
    return made.select("doc_id", cut["n"].alias("n"), "form", F.when(split, cut["prefix_end"]).alias("prefix_chars"), F.when(split, cut["middle_end"] - cut["prefix_end"]).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text as it was, from an output and its form alone; texts that hold a mark are plain, so the marks found are those put in."""
    parts = F.split(output, "|".join(map(re.escape, MARKS)))
    return F.when(form == "psm", F.concat(F.get(parts, 1), F.get(parts, 3), F.get(parts, 2))).when(form == "spm", F.concat(F.get(parts, 2), F.get(parts, 3), F.get(parts, 1))).otherwise(output)
