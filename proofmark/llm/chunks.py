"""Repeated passages across documents by content-defined chunking with a gear rolling hash.

A text's UTF-8 bytes are cut where the gear hash of the last ``GEAR`` bytes has
its top bits zero, at least ``LEAST`` and at most ``MOST`` bytes after the last
cut; where no such place comes, at the first place of the least hash, so texts
that repeat one unit are cut in step with it.  Cuts depend on content alone, so an
insertion moves no cut beyond its surroundings.  A chunk whose 64-bit digest two or more
documents hold is repeated, and repeated chunks that
touch are a run.  Short chunks recur by chance, so a run says little by itself: it
is gone through in windows of chunks that hold at least ``RUN`` bytes or ``WORDS``
words, and only windows that another document holds whole count (by 96 bits, made of those
of their chunks; a window of one chunk alone, of 16 words or more in 64 bytes, has its 64).  Windows that one
place of another document holds in the same order are joined to a passage.  The
occurrence in the document with the least id stays; the others may be removed.

A run's outermost chunks reach at most one chunk short of the passage's true
ends, so a passage of 50 words holds a run well over ``RUN`` bytes, or, where its
words are short, over ``WORDS`` words.

Null and empty texts have no chunks.  Rows that repeat a ``doc_id`` are one
document: what only they share isn't repeated, and each of them is reported.
All rows with a null ``doc_id`` are likewise one document, which orders first.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

GEAR, LEAST, MOST, MASK_BITS = 16, 12, 64, 4
RUN, WORDS = 80, 16
#: Stands for a null id.
NO_ID = -(1 << 63)
_draw = random.Random(20240611)
TABLE = np.array([_draw.getrandbits(32) for _ in range(256)], np.uint32)


#: Bytes that part words.
BLANK = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))


def hashes(data: bytes) -> np.ndarray:
    """The gear hash after each byte; after ``GEAR`` shifts bit 15 has been reached by every byte of the window."""
    h = TABLE[np.frombuffer(data, np.uint8)]
    width = 1
    while width < GEAR:  # the hash of twice as many bytes, from two halves
        h[width:] += h[:-width].copy() << np.uint32(width)
        width *= 2
    return h & np.uint32((1 << GEAR) - 1)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks."""
    n, last, out = len(data), 0, []
    h = hashes(data)
    for c in [*(np.flatnonzero(h < np.uint32(1 << (GEAR - MASK_BITS))) + 1).tolist(), n]:
        while c - last > MOST:
            last += LEAST + int(np.argmin(h[last + LEAST - 1 : last + MOST]))
            out.append(last)
        if c - last >= LEAST or last < c == n:
            last = c
            out.append(c)
    return out


def words_of(data: bytes, ends: list[int]) -> list[int]:
    """How many words begin in each chunk."""
    word = ~BLANK[np.frombuffer(data, np.uint8)]
    word[1:] &= ~word[:-1]
    return np.add.reduceat(word, [0, *ends[:-1]], dtype=np.int32).tolist()


def told(parts: list[bytes]) -> np.ndarray:
    """128-bit digests as two columns of signed numbers."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), "<i8").reshape(-1, 2)


def digest(parts: list[bytes]) -> np.ndarray:
    """64-bit digests of chunks, as signed numbers."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts)).view(np.int64)


def placed(start: np.ndarray, end: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Start, length and words of chunks in one number each, in order of start; neither of the last two reaches 256."""
    return start.astype(np.int64) << 16 | end - start << 8 | words


def spans(docs: DataFrame) -> DataFrame:
    """``row``, ``id``, ``place`` (start, length and words in one number, see ``placed``) and ``digest`` of every chunk."""

    def pieces(batches) -> Iterator[list]:
        for b in batches:
            for row, doc_id, text in zip(b["row"].to_pylist(), b["id"].to_pylist(), b["text"].to_pylist(), strict=True):
                data = text.encode("utf-8", "replace")
                if data:
                    ends = cuts(data)
                    starts = [0, *ends[:-1]]
                    yield [np.full(len(ends), row), np.full(len(ends), doc_id), placed(np.array(starts), np.array(ends), np.array(words_of(data, ends))), digest([data[a:e] for a, e in zip(starts, ends, strict=True)])]

    numbered = common.texts_of(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text", F.monotonically_increasing_id().alias("row"))
    return common.map_pieces(numbered, pieces, "row long, id long, place long, digest long")


def digests(docs: DataFrame) -> DataFrame:
    """``digest`` and ``id``, once for each of a row's distinct chunks."""

    def pieces(batches) -> Iterator[list]:
        for b in batches:
            for doc_id, text in zip(b["id"].to_pylist(), b["text"].to_pylist(), strict=True):
                data = text.encode("utf-8", "replace")
                if data:
                    ends = cuts(data)
                    held = digest(list({data[a:e] for a, e in zip([0, *ends[:-1]], ends, strict=True)}))
                    yield [held, np.full(len(held), doc_id)]

    return common.map_pieces(common.texts_of(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text"), pieces, "digest long, id long")


def covers(start: np.ndarray, end: np.ndarray, words: np.ndarray, first: np.ndarray, least: int = RUN, most: int = WORDS) -> np.ndarray:
    """First and last place of the windows of runs of chunks, one pair a row; ``first`` has the places at which the runs begin.

    From each chunk on and up to each chunk the shortest window of ``least``
    bytes or ``most`` words: any part of a run that holds so much is covered by
    those inside it.  The whole run comes too, so a copy is one passage even if it
    repeats itself.  Runs that hold less have none.
    """
    n = len(start)
    if not n:
        return np.zeros((0, 2), np.int64)
    lengths = np.diff(np.append(first, n))
    last = np.repeat(np.append(first[1:], n) - 1, lengths)
    begin = np.repeat(first, lengths)
    # Runs lie one behind another, with room for a window between them.
    apart = np.repeat(np.arange(len(first), dtype=np.int64), lengths) * (int(end.max(initial=0)) + least + 1)
    low, high = start + apart, end + apart
    upto = np.cumsum(words)
    before = upto - words
    # The first end that is enough, by bytes or by words, and the last beginning that is.
    place = np.arange(n)
    j = np.minimum(np.searchsorted(high, low + least), np.searchsorted(upto, before + most))
    i = np.maximum(np.searchsorted(low, high - least, "right"), np.searchsorted(before, upto - most, "right")) - 1
    forth, back = j <= last, i >= begin
    enough = (end[last[first]] - start[first] >= least) | (upto[last[first]] - before[first] >= most)
    found = [place[forth] * n + j[forth], i[back] * n + place[back], first[enough] * n + last[first][enough]]
    return np.stack(np.divmod(np.unique(np.concatenate(found)), n), axis=1)


def windows(parts: DataFrame, least: int = RUN, words: int = WORDS) -> DataFrame:
    """The windows of runs of chunks (see ``covers``), of chunks in order of row and place: where they lie, their first and last chunk in the run, and a digest of their chunks' digests.

    A task holds one run at a time beside a batch of chunks.
    """

    def of(row, doc_id, start, end, count, digests) -> list | None:
        first = _breaks(row, start, end)
        pairs = covers(start, end, count, first, least, words)
        if not len(pairs):
            return None
        held, (i, j) = digests.astype("<i8").tobytes(), pairs.T
        both = told([held[8 * a : 8 * e + 8] for a, e in pairs.tolist()])
        begin = first[np.searchsorted(first, i, "right") - 1]
        return [row[i], doc_id[i], start[i], end[j], i - begin, j - begin, both[:, 0], both[:, 1].astype(np.int32)]

    def pieces(batches) -> Iterator[list]:
        held = None
        for b in batches:
            row, doc_id, place, digests = (c.to_numpy() for c in b.columns)
            start = place >> 16
            now = [row, doc_id, start, start + (place >> 8 & 255), place & 255, digests]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            # The last run may go on in the next batch.
            at = _breaks(*held[:1], *held[2:4])[-1] if len(held[0]) else 0
            if at and (found := of(*(x[:at] for x in held))):
                yield found
            held = [x[at:] for x in held]
        if held and len(held[0]) and (found := of(*held)):
            yield found

    return common.map_arrays(parts.select("row", "id", "place", "digest"), pieces, "row long, id long, start int, end int, i int, j int, high long, low int")


def _breaks(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Where runs of touching chunks begin."""
    return np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != end[:-1])])) if len(row) else np.zeros(0, np.int64)


def passages(docs: DataFrame, least: int = RUN, words: int = WORDS) -> DataFrame:
    """One row per passage of a document that a single other document holds whole.

    ``first_doc_id`` is the least id among the documents that hold one of its
    windows (this document, if it is the first), and ``kept`` says whether this
    document is the first.  Passages may overlap where several documents hold
    different parts; none lies inside another of the same ``kept``.

    The first and last id of each digest come from a partial aggregate, so a
    chunk that a third of all documents hold is one row per task in that
    shuffle.  Only digests with two ids are joined back to the chunks (cut anew:
    that is cheaper than keeping them); both sides are plain shuffles, so the
    rows of a digest that very many hold can be split.  Windows take the same
    way, with the place of their first and last holder.
    """
    held = digests(docs).groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    repeated = common.store(held.where("first <> last").select("digest"), "chunks-repeated")
    found = spans(docs).join(repeated, "digest").repartition("row").sortWithinPartitions("row", "place")
    common.release(docs.sparkSession)
    cut = common.store(windows(found, least, words), "chunks-windows")
    common.forget(repeated)
    common.release(docs.sparkSession)
    place = F.struct("id", "row", "start")
    holders = cut.groupBy("high", "low").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first.id <> last.id")
    shared = cut.join(common.store(holders, "chunks-holders"), ["high", "low"])
    common.release(docs.sparkSession)
    kept = F.col("id") == F.col("first.id")
    other = F.when(kept, F.col("last")).otherwise(F.col("first"))
    each = shared.select("row", "id", "start", "end", "i", "j", F.col("first.id").alias("first"), kept.alias("kept"), other["row"].alias("other"), (F.col("start") - other["start"]).alias("shift"))
    one = Window.partitionBy("row", "kept", "other", "shift").orderBy("start", "end")
    before = F.max("end").over(one.rowsBetween(Window.unboundedPreceding, -1))
    parts = each.withColumn("gap", (F.col("start") > F.coalesce(before, F.lit(-1))).cast("int")).withColumn("part", F.sum("gap").over(one.rowsBetween(Window.unboundedPreceding, 0)))
    joined = parts.groupBy("row", "kept", "other", "shift", "part").agg(
        F.max("id").alias("id"),
        F.min("start").cast("long").alias("start"),
        F.max("end").cast("long").alias("end"),
        (F.max("j") - F.min("i") + 1).cast("long").alias("n_chunks"),
        F.min("first").alias("first"),
    )
    outer = Window.partitionBy("row", "kept").orderBy("start", F.desc("end"), "first").rowsBetween(Window.unboundedPreceding, -1)
    most = joined.withColumn("reached", F.max("end").over(outer)).where("reached is null or end > reached")
    named = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return most.select(named("id").alias("doc_id"), "start", "end", "n_chunks", named("first").alias("first_doc_id"), "kept")


def without_repeats(docs: DataFrame, least: int = RUN, words: int = WORDS) -> DataFrame:
    """``doc_id`` and the text without the passages that a document of a lesser id holds; ids have to be distinct here."""
    drop = passages(docs, least, words).where(~F.col("kept")).groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("cut"))
    texts = common.texts_of(docs)
    joined = texts.join(drop, texts["doc_id"].eqNullSafe(drop["doc_id"]), "left").select(texts["doc_id"], "text", "cut")

    def rows(batches) -> Iterator[list[tuple]]:
        for b in batches:
            out = []
            for doc_id, text, cut in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["cut"].to_pylist(), strict=True):
                data, kept, at = text.encode("utf-8", "replace"), [], 0
                for c in cut or ():
                    kept.append(data[at : c["start"]])
                    at = max(at, c["end"])
                out.append((doc_id, b"".join([*kept, data[at:]]).decode("utf-8", "ignore")))
            yield out

    return common.map_rows(joined, rows, "doc_id long, text string")
