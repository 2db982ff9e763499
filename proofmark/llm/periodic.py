"""Runs of repeated word sequences: every maximal stretch of a text that has a small period.

A run is a stretch of consecutive words of at least ``least`` words and ``min_exp``
periods in which words one period apart are equal, with no smaller period, and
which no neighbouring word extends.

Words become integers, and the array is compared with itself shifted by every lag
up to n / min_exp; stretches of equal places are measured.  A stretch that is long
enough at a lag holds one place of every grid as wide as the length asked for,
so the comparison begins on that grid (n / lag places rather than n) and goes on,
both ways, where it found equality: the scan is exact and takes n log n comparisons.
Many texts stand in one array, longest first, parted by numbers that occur once;
each lag looks at those that are long enough for it.

Spark deals texts to tasks.  A text over ``LONG`` bytes is dealt as (text, range of
lags) to several tasks, equal texts once; a task finds a stretch's smallest period
by itself, so each run comes from one range, and the ranges' runs are put together
by text.

Defined results: a null text counts as empty and has no words; a text of fewer than
``least`` words has no runs; null and repeated ids change nothing, each row has its
result; columns other than ``doc_id`` and ``text`` are left out; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from . import common

#: Words and periods that a run has at least.
LEAST, MIN_EXP = 12, 2
#: Texts of more bytes are dealt by ranges of lags.
LONG = 1 << 16
#: Lags in a range; a longer text has longer ranges instead of more than ``SHARES``, so that it is sent at most so many times.
LAGS, SHARES = 1 << 13, 8
#: Words of texts put in one array.
WORDS = 1 << 18
#: Runs of so many periods are remembered, and the multiples of their periods passed over.
MANY = 64

RUN = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])
FOUND = StructType([StructField("n_words", LongType()), StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())])


class _Numbers(dict):
    """Word to a number of its own."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _end(a: np.ndarray, b: np.ndarray, i: int) -> int:
    """The first place from ``i`` on at which the arrays differ."""
    step = 64
    while i < len(a):
        apart = a[i : i + step] != b[i : i + step]
        k = int(apart.argmax())
        if apart[k]:
            return i + k
        i, step = i + len(apart), min(4 * step, 1 << 20)
    return len(a)


def _begin(a: np.ndarray, b: np.ndarray, i: int) -> int:
    """The least place from which the arrays are equal up to ``i``."""
    step = 64
    while i > 0:
        apart = (a[max(0, i - step) : i] != b[max(0, i - step) : i])[::-1]
        k = int(apart.argmax())
        if apart[k]:
            return i - k
        i, step = i - len(apart), min(4 * step, 1 << 20)
    return 0


def _period(words: np.ndarray, q: int) -> int:
    """The smallest period of an array that has period ``q`` and at least two of them: it divides ``q``."""
    for d in (d for d in range(1, q // 2 + 1) if q % d == 0):
        if _end(words[:-d], words[d:], 0) == len(words) - d:
            return d
    return q


def scan(words: np.ndarray, reach: Callable[[int], int], lags: range, least: int = LEAST, min_exp: int = MIN_EXP) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs whose period is among the lags, in an array of numbers; ``reach(q)`` places of it matter for lag q."""
    runs, seen = [], {}
    many: list[tuple[int, int]] = []  # ends and periods of runs of many periods
    cover = None  # which of them holds a place, -1 for none
    for q in lags:
        size = reach(q)
        if size <= q:
            continue
        a, b = words[: size - q], words[q:size]
        need = max(least, min_exp * q) - q
        hits = np.flatnonzero(a[need - 1 :: need] == b[need - 1 :: need]) * need + (need - 1)
        half = (need - 1) // 2
        if half and len(hits):
            # A stretch as long as needed also holds the place half its length before or behind.
            ahead, behind = np.minimum(hits + half, len(a) - 1), hits - half
            hits = hits[((hits + half < len(a)) & (a[ahead] == b[ahead])) | (a[behind] == b[behind])]
        done = 0
        for i in hits.tolist():
            if i < done:
                continue
            if cover is not None and cover[i] >= 0:
                end, p = many[cover[i]]
                if q % p == 0 and i + q < end:  # the same run at a multiple of its period
                    done = end - q
                    continue
            end = _end(a, b, i)
            start = _begin(a, b, i)
            done = end
            if end - start < need or (start, end + q) in seen:
                continue
            end += q
            # From lag 1 on, a smaller period would have been seen before.
            p = q if lags.start == 1 else _period(words[start:end], q)
            seen[start, end] = p
            if p == q:
                runs.append((start, end - start, q))
            if end - start >= MANY * p:
                if cover is None:
                    cover = np.full(len(words), -1, np.int32)
                cover[start:end] = len(many)
                many.append((end, p))
    return runs


def runs_of(texts: list[list[bytes]], least: int = LEAST, min_exp: int = MIN_EXP) -> list[list[tuple[int, int, int]]]:
    """The runs of each of several texts (lists of words), by start and period; the texts share one array."""
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    order = [k for k in order if len(texts[k]) >= least]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not order:
        return out
    numbers = _Numbers()
    sizes = np.array([len(texts[k]) for k in order])
    ends = np.cumsum(sizes + 1)  # behind the number that parts a text from the next
    words = np.empty(ends[-1], np.int32)
    for k, end, size in zip(order, ends.tolist(), sizes.tolist(), strict=True):
        words[end - 1 - size : end - 1] = [numbers[w] for w in texts[k]]
    words[ends - 1] = -1 - np.arange(len(ends), dtype=np.int32)
    falling = -sizes

    def reach(q: int) -> int:
        n = int(np.searchsorted(falling, -max(least, min_exp * q), "right"))
        return int(ends[n - 1]) - 1 if n else 0

    found = scan(words, reach, range(1, int(sizes[0]) // min_exp + 1), least, min_exp)
    for start, length, period in found:
        at = int(np.searchsorted(ends, start, "right"))
        out[order[at]].append((start - (int(ends[at - 1]) if at else 0), length, period))
    for k in order:
        out[k].sort(key=lambda r: (r[0], r[2]))
    return out


def share_of(text: bytes, share: int, shares: int, least: int = LEAST, min_exp: int = MIN_EXP) -> tuple[int, list[tuple[int, int, int]]]:
    """The number of words of a text, and the runs whose period lies in one of ``shares`` equal ranges of its lags."""
    words = text.split()
    n, numbers = len(words), _Numbers()
    array = np.array([numbers[w] for w in words], np.int32)
    lags = n // min_exp
    return n, scan(array, lambda q: n if n >= least else 0, range(1 + share * lags // shares, 1 + (share + 1) * lags // shares), least, min_exp)


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run holds behind its first period."""
    if runs:
        starts, lengths, periods = np.array(runs, np.int64).T
        step = np.zeros(len(words) + 1, np.int64)
        np.add.at(step, starts + periods, 1)
        np.add.at(step, starts + lengths, -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]
    return b" ".join(words)


def _column(rows: list[tuple[int, list[tuple[int, int, int]], bytes | None]]) -> pa.StructArray:
    """Words, runs and text of several rows as one Arrow column."""
    offsets = np.cumsum([0, *(len(r) for _, r, _ in rows)])
    flat = np.array([x for _, r, _ in rows for x in r], np.int64).reshape(-1, 3)
    runs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=RUN.names)
    return pa.StructArray.from_arrays([pa.array([n for n, _, _ in rows], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs), pa.array([t for _, _, t in rows], pa.binary()).cast(pa.string())], names=FOUND.names)


def _bytes(texts: pa.Array) -> list[bytes]:
    return texts.cast(pa.binary()).to_pylist()


def _whole(least: int, min_exp: int) -> Callable[[Column], Column]:
    """A function of a text column: words, runs and collapsed text."""

    @F.arrow_udf(FOUND)
    def whole(texts: pa.Array) -> pa.Array:
        rows, held, size = [], [], 0

        def flush() -> None:
            rows.extend((len(w), r, collapsed(w, r)) for w, r in zip(held, runs_of(held, least, min_exp), strict=True))
            held.clear()

        for at in range(0, len(texts), 256):
            for t in _bytes(texts.slice(at, 256)):
                held.append(t.split())
                size += len(held[-1])
                if size >= WORDS:
                    flush()
                    size = 0
        flush()
        return _column(rows)

    return whole


def _ranged(least: int, min_exp: int) -> Callable[..., Column]:
    """A function of text, share and number of shares: words and runs of that range of lags."""

    @F.arrow_udf(FOUND)
    def ranged(texts: pa.Array, share: pa.Array, shares: pa.Array) -> pa.Array:
        return _column([(*share_of(t.as_py().encode(), k, n, least, min_exp), None) for t, k, n in zip(texts, share.to_pylist(), shares.to_pylist(), strict=True)])

    return ranged


@F.arrow_udf(StringType())
def _collapse(texts: pa.Array, runs: pa.Array) -> pa.Array:
    return pa.array([collapsed(t.as_py().encode().split(), [(r["start"], r["length"], r["period"]) for r in rs.as_py()]) for t, rs in zip(texts, runs, strict=True)], pa.binary()).cast(pa.string())


def find(docs: DataFrame, least: int = LEAST, min_exp: int = MIN_EXP, long: int = LONG) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` (start, length, period, by start and period) and ``collapsed`` (the text without repeats) of every row.

    ``long`` parts texts by bytes: longer ones are dealt by ranges of lags.  Both ways give the same rows.
    """
    if min_exp < 2 or least < 2:
        raise ValueError("a run has at least two words and two periods")
    spark = docs.sparkSession
    texts = common.texts_of(docs)
    short = texts.where(F.octet_length("text") <= long).select("doc_id", _whole(least, min_exp)("text").alias("found")).select("doc_id", "found.*")
    longer = texts.where(F.octet_length("text") > long).withColumn("digest", F.sha2("text", 256))
    # Stored: read once for the scan and once more to leave out repeats.
    distinct = common.store(longer.groupBy("digest").agg(F.first("text").alias("text")), "periodic-texts")
    lags = (F.octet_length("text") + 1) / (2 * min_exp)
    shares = F.least(F.lit(SHARES), F.ceil(lags / LAGS)).cast("int")
    dealt = distinct.withColumn("shares", shares).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "digest", "share")
    ranges = dealt.select("digest", _ranged(least, min_exp)("text", "share", "shares").alias("found"))
    by_text = ranges.groupBy("digest").agg(F.max("found.n_words").alias("n_words"), F.flatten(F.collect_list("found.runs")).alias("runs"))
    ordered = F.transform(F.array_sort(F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))), lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period")))
    made = by_text.withColumn("runs", ordered).join(distinct, "digest").select("digest", "n_words", "runs", _collapse("text", "runs").alias("collapsed"))
    return short.unionByName(longer.select("doc_id", "digest").join(made, "digest").drop("digest"))


def digests(found: DataFrame) -> DataFrame:
    """Per row of ``find`` the number of its runs, the longest one, and digests of all runs and of the text without repeats."""
    # Greatest length first, then smallest start and period.
    best = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), 0)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    made = found.withColumn("best", best)
    length, period = -F.col("best.less"), F.col("best.period")
    return made.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
