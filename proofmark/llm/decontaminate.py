"""Benchmark decontamination by winnowing.

Words are runs of letters, digits and non-ASCII characters.  A window is 13
consecutive words of an item; an item of fewer words, but not none, is one
window.  Of each run of 9 consecutive 5-grams the least hash is kept as a
fingerprint: 13 words hold 9 such 5-grams, so a window that a document shares
with an item has the same fingerprint in both.  Documents' fingerprints are
joined with the items', and each hit is extended to the whole windows around it
and compared word by word.  Windows of fewer than 13 words are found by the hash
of all their words.

The items' windows are sent to all tasks if they are few enough (``MOST_WINDOWS``,
``MOST_BYTES``, checked by an aggregate).  Beyond that, a filter of at
most ``MOST_SLOTS`` bits (32 MB) holds their fingerprints, and the document windows that pass it are joined with
the items' windows in Spark.

A null or empty text has no words and no hits.  Repeated documents are judged
one by one.  Items that repeat an ``item_id`` are one item.  A null ``item_id``
hits, but is not listed.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SPAN, GRAM = 13, 5
WINDOW = SPAN - GRAM + 1
#: Bounds of what is sent to every task.
MOST_WINDOWS, MOST_BYTES = 1 << 18, 1 << 25
#: Slots of the filter used beyond them: 16 for each window, within these bounds.
LEAST_SLOTS, MOST_SLOTS = 1 << 22, 1 << 28
#: Word hashes kept per worker.
KEPT = 500_000

WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
MULTIPLIER = 0x9E3779B97F4A7C15


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(WORDS).split()


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


HASHES = _Hashes()


def hashed(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, ws), np.uint64, len(ws))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words."""
    n = len(h) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out *= np.uint64(MULTIPLIER)
        out += h[i : i + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def least(g: np.ndarray) -> np.ndarray:
    """The fingerprint of each window: the least of each ``WINDOW`` hashes in a row."""
    out, width = g, 1
    while 2 * width <= WINDOW:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: len(g) - WINDOW + 1], out[len(out) - (len(g) - WINDOW + 1) :])


def fingerprints(h: np.ndarray, size: int) -> np.ndarray:
    """The fingerprint of each window of ``size`` words."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    return least(grams(h, GRAM)) if size == SPAN else grams(h, size)


def windows(bench: DataFrame) -> DataFrame:
    """Distinct (item_id, size, text, fingerprint) of the items' windows; the text is the words joined by spaces."""

    def rows(batches) -> Iterator[list[tuple]]:
        for b in batches:
            out = []
            for item, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                ws = words(text)
                if ws:
                    size = min(SPAN, len(ws))
                    fps = fingerprints(hashed(ws), size).astype(np.int64).tolist()
                    out += {(item, size, b" ".join(ws[s : s + size]).decode("utf-8", "replace"), fp) for s, fp in enumerate(fps)}
            yield out

    return common.map_rows(common.texts_of(bench.select(F.col("item_id").alias("doc_id"), "text")), rows, "item_id long, size int, text string, fingerprint long")


class Index:
    """The items' windows, if they are within the bounds."""

    def __init__(self, rows: list):
        self.items: dict[bytes, set] = defaultdict(set)
        prints: dict[int, set] = defaultdict(set)
        for item, size, text, fp in rows:
            self.items[text.encode()].add(item)
            prints[size].add(fp)
        self.prints = {size: np.sort(np.array([*fps], np.int64).astype(np.uint64)) for size, fps in prints.items()}
        self.items = dict(self.items)

    def passing(self, size: int, fps: np.ndarray) -> np.ndarray:
        known = self.prints[size]
        return np.flatnonzero(known[np.minimum(np.searchsorted(known, fps), len(known) - 1)] == fps)


class Filter:
    """The same for any number of windows: fingerprints by slot; some others pass too."""

    def __init__(self, slots: dict[int, np.ndarray]):
        self.prints = slots
        self.size = 8 * max(map(len, slots.values()), default=1)

    def passing(self, size: int, fps: np.ndarray) -> np.ndarray:
        slot = (fps % np.uint64(self.size)).astype(np.int64)
        return np.flatnonzero(self.prints[size][slot >> 3] >> (slot & 7).astype(np.uint8) & 1)


def passing(ws: list[bytes], index: Index | Filter) -> Iterator[tuple[int, int, bytes]]:
    """(start, size, text) of the document's windows whose fingerprint an item has."""
    if len(ws) >= min(index.prints, default=SPAN + 1):
        h = hashed(ws)
        for size in index.prints:
            for s in index.passing(size, fingerprints(h, size)).tolist() if len(ws) >= size else ():
                yield s, size, b" ".join(ws[s : s + size])


def covered(spans: list[tuple[int, int]]) -> int:
    """Words inside any of the spans (start, size)."""
    n = end = 0
    for s, size in sorted(spans):
        n += max(0, s + size - max(s, end))
        end = max(end, s + size)
    return n


def listed(items: set) -> tuple[int, str]:
    names = sorted(str(x) for x in items if x is not None)
    return len(names), hashlib.sha256(",".join(names).encode()).hexdigest()


def is_contaminated(n_hit: int, n_words: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def judge(ws: list[bytes], index: Index) -> tuple[int, set]:
    spans, items = [], set()
    for s, size, text in passing(ws, index):
        if text in index.items:
            spans.append((s, size))
            items |= index.items[text]
    return covered(spans), items


def indexed(found: DataFrame) -> Index | None:
    """The index to send to all tasks, or None if it would pass the bounds."""
    n, size = found.agg(F.count("*"), F.sum(F.length("text"))).first()
    return Index(found.collect()) if n <= MOST_WINDOWS and (size or 0) <= MOST_BYTES else None


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def report(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """One row per document with its hit words and items."""
    found = common.store(windows(bench), "benchmark-windows")
    index = indexed(found)
    if index is None:
        return joined(common.texts_of(docs), found)
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def rows(batches) -> Iterator[list[tuple]]:
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                ws = words(text)
                n_hit, items = judge(ws, sent.value)
                out.append((doc_id, len(ws), n_hit, *listed(items), is_contaminated(n_hit, len(ws))))
            yield out

    return common.map_rows(common.texts_of(docs), rows, SCHEMA)


def joined(texts: DataFrame, found: DataFrame) -> DataFrame:
    """``report`` for items beyond the bounds: only filter slots come to the driver, part by part, and all window sizes share one filter's size."""
    n = 16 * found.select("size", "fingerprint").distinct().count()
    size = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << n.bit_length()))
    sizes = [r[0] for r in found.select("size").distinct().collect()]
    size = max(1 << 16, size >> max(0, len(sizes) - 1).bit_length())
    slots = {k: np.zeros(size // 8, np.uint8) for k in sizes}
    for k, slot in found.select("size", F.pmod(F.col("fingerprint"), F.lit(size)).alias("slot")).distinct().toLocalIterator():
        slots[k][slot >> 3] |= 1 << (slot & 7)
    sent = texts.sparkSession.sparkContext.broadcast(Filter(slots))

    def rows(batches) -> Iterator[list[tuple]]:
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                ws = words(text)
                out.append((doc_id, len(ws), [{"start": s, "size": size, "text": t.decode("utf-8", "replace")} for s, size, t in passing(ws, sent.value)]))
            yield out

    scanned = common.store(common.map_rows(texts, rows, "doc_id long, n_words long, near array<struct<start:int,size:int,text:string>>").withColumn("row", F.monotonically_increasing_id()), "benchmark-candidates")
    known = found.select("text").distinct()
    hits = common.store(scanned.select("row", F.explode("near").alias("x")).select("row", "x.*").join(known, "text"), "benchmark-hits")
    items = hits.select("row", "text").distinct().join(found.select("text", "item_id").distinct(), "text").where("item_id is not null").groupBy("row").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    at = F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)
    spans = hits.select("row", F.explode(at).alias("at")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    out = scanned.select("row", "doc_id", "n_words").join(spans, "row", "left").join(items, "row", "left").withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), F.expr("n_hit > 0 and 20 * n_hit >= n_words").alias("contaminated"))


def clean(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    found = common.store(windows(bench), "benchmark-windows")
    index = indexed(found)
    if index is None:
        # Rows are numbered in a stored copy; columns of any name lie within ``doc``.
        whole = common.store(docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc"), F.monotonically_increasing_id().alias("doc_id")), "benchmark-documents")
        bad = joined(whole.select("doc_id", F.coalesce(F.col("doc")["text"].cast("string"), F.lit("")).alias("text")), found).where("contaminated").select("doc_id")
        return whole.join(bad, "doc_id", "left_anti").select("doc.*")
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def keeps(batches: Iterator[list[str]]) -> Iterator[list[bool]]:
        for texts in batches:
            split = map(words, texts)
            yield [not is_contaminated(judge(ws, sent.value)[0], len(ws)) for ws in split]

    return common.keep_rows(docs, "text", keeps)
