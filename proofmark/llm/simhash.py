"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has 64 bits, eight positional bytes.  Two fingerprints that differ
in at most 4 bits share at least 4 of them.  Distinct fingerprints are posted
under groups of byte positions: 20 triples, chosen so that any four positions
hold one of them whole.  Within a posting, the positional bytes that each pair
shares are tallied; pairs with 4 or more are verified bit by bit.

A posting of at most ``POSTING`` fingerprints is compared inside one task.  A longer one is taken apart exactly, at a cost in proportion to its
length: two fingerprints differ in at most 4 bits just if some value differs
from either in at most 2, so each is posted under all values within 2 bits (in
the bytes that the posting leaves open) and linked to the least one there.

Equal fingerprints are one class and are never compared.  Only enough links to
join each posting are kept.  Null texts count as empty.  Texts without words
have fingerprint 0 and are linked like any other.  A null ``doc_id`` takes part,
but is no component's id unless its whole component has none (then null).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

SHINGLE, BITS, SEED = 4, 4, 42
#: Positional bytes that a pair with at most BITS differing bits shares at least.
SHARED = 8 - BITS
POSTING = 1 << 14
#: Hashes whose bits are counted at a time.
SLICE = 1 << 15


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles, unsigned; a bit is 1 if it is set in over half the hashes."""
    ws = text.encode("utf-8", "replace").lower().split()
    if not ws:
        return 0
    line, ends, at = b" ".join(ws), [], -1
    for w in ws:
        at += len(w) + 1
        ends.append(at)
    if len(ws) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    digest = xxhash.xxh64_intdigest
    starts = [0, *(e + 1 for e in ends[:-shingle])]
    hashes = np.fromiter((digest(line[a:e], SEED) for a, e in zip(starts, ends[shingle - 1 :], strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), SLICE):
        part = hashes[i : i + SLICE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, the fingerprint as a signed long, ``print``, and further columns of strings."""

    def rows(batches) -> Iterator[list[tuple]]:
        for b in batches:
            prints = np.array([fingerprint(t) for t in b["text"].to_pylist()], np.uint64).astype(np.int64).tolist()
            yield list(zip(b["doc_id"].to_pylist(), prints, *(b[c].to_pylist() for c in more), strict=True))

    return common.map_rows(common.texts_of(docs, *more), rows, ", ".join(["doc_id long, print long", *(f"{c} string" for c in more)]))


def triples(positions: int = 8) -> list[tuple[int, ...]]:
    """Byte triples of which any four positions hold one whole: positions in three parts round a circle, triples in one part or two of one and one of the next."""
    part = [p % 3 for p in range(positions)]
    held = []
    for t in combinations(range(positions), 3):
        inside = sorted(part[p] for p in t)
        counts = [inside.count(i) for i in range(3)]
        if 3 in counts or any(counts[i] == 2 and counts[(i + 1) % 3] == 1 for i in range(3)):
            held.append(t)
    return held


def postings(prints: DataFrame) -> DataFrame:
    """``triple``, ``bytes`` and ``print``: each fingerprint under its triples of positional bytes."""
    under = []
    for i, t in enumerate(triples()):
        mask = sum(255 << 8 * p for p in t)
        under.append(F.struct(F.lit(i).alias("triple"), F.col("print").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("bytes")))
    return prints.select("print", F.explode(F.array(*under)).alias("key")).select("key.triple", "key.bytes", "print")


def links(prints: list[int]) -> list[tuple[int, int]]:
    """Links that join distinct fingerprints (unsigned) as all their links would: each new member looks for partners among those not yet reached."""
    found, left = [], np.array(prints, np.uint64)
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            differ = left ^ np.uint64(x)
            tally = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            near = tally >= SHARED
            near[near] = np.bitwise_count(differ[near]) <= BITS
            if near.any():
                reached = left[near].tolist()
                found += [(x, y) for y in reached]
                queue += reached
                left = left[~near]
    return found


def few(prints: list[int]) -> list[tuple[int, int]]:
    """The same for a few fingerprints, without arrays."""
    found, left = [], list(prints)
    while len(left) > 1:
        queue = [left.pop()]
        while queue and left:
            x = queue.pop()
            reached = [y for y in left if sum(not (x ^ y) >> 8 * i & 255 for i in range(8)) >= SHARED and (x ^ y).bit_count() <= BITS]
            if reached:
                found += [(x, y) for y in reached]
                queue += reached
                left = [y for y in left if y not in reached]
    return found


def linked(prints: DataFrame, most: int = POSTING) -> DataFrame:
    """Links (a, b) between distinct fingerprints that join them as all links of at most BITS bits would."""
    posted = common.store(postings(prints), "simhash-postings")
    counts = common.store(posted.groupBy("triple", "bytes").agg(F.count("*").alias("n")).where("n > 1"), "simhash-counts")
    shared = posted.join(counts, ["triple", "bytes"])

    def short(batches) -> Iterator[list[tuple]]:
        for b in batches:
            out = []
            for group in b["prints"].to_pylist():
                unsigned = [p % (1 << 64) for p in group]
                out += few(unsigned) if len(group) <= 16 else links(unsigned)
            yield [tuple(x - (1 << 64) if x >> 63 else x for x in pair) for pair in out]

    lists = shared.where(F.col("n") <= most).groupBy("triple", "bytes").agg(F.collect_list("print").alias("prints"))
    found = common.map_rows(lists.select("prints"), short, "a long, b long").distinct()
    if counts.where(F.col("n") > most).isEmpty():
        return found
    long = shared.where(F.col("n") > most).select("triple", "bytes", "print")
    flips = [0, *(1 << i for i in range(64)), *(1 << i | 1 << j for i, j in combinations(range(64), 2))]
    every = triples()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = np.array([sum(255 << 8 * p for p in t) for t in every], np.uint64)
        turn = np.array(flips, np.uint64)
        for b in batches:
            triple, p = b["triple"].to_numpy(), b["print"].to_numpy().astype(np.uint64)
            for i in range(len(p)):
                open_ = turn[(turn & masks[triple[i]]) == 0]
                n = len(open_)
                yield pa.RecordBatch.from_pydict({"triple": pa.array(np.full(n, triple[i]), pa.int32()), "value": (p[i] ^ open_).astype(np.int64), "print": np.full(n, p[i]).astype(np.int64)})

    spread = long.mapInArrow(near, "triple int, value long, print long")
    least = spread.groupBy("triple", "value").agg(F.min("print").alias("a"), F.count("*").alias("n")).where("n > 1").select("triple", "value", "a")
    more = spread.join(least, ["triple", "value"]).where("print <> a").select(F.col("print").alias("a"), F.col("a").alias("b")).distinct()
    return found.unionByName(more)


def classes(docs: DataFrame, most: int = POSTING, *more: str) -> DataFrame:
    """``doc_id``, ``print`` and ``component_id`` of every document; with further columns of strings also ``component``, which is never null."""
    each = common.store(fingerprints(docs, *more), "simhash-prints")
    distinct = common.store(each.groupBy("print").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    joined = components(linked(distinct.select("print"), most))
    labelled = distinct.join(joined.withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    labelled = common.store(labelled, "simhash-labelled")
    heads = common.store(labelled.groupBy("component").agg(F.min("first").alias("component_id")), "simhash-heads")
    ids = common.store(labelled.select("print", "component").join(heads, "component").select("print", *["component"] * bool(more), "component_id"), "simhash-components")
    return each.join(ids, "print")


def report(docs: DataFrame, most: int = POSTING) -> DataFrame:
    """One row per document: its fingerprint as 16 hex digits and the least ``doc_id`` of its component."""
    return classes(docs, most).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def clean(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the least ``doc_id``, with all its columns.

    Rows are told apart by ``doc_id`` and a digest of the text: different texts
    under one id, null included, stand each for itself.  Within a component, of
    rows with the least ``doc_id`` the one with the least digest stays; a null
    id comes last.  Rows that repeat both are one document.
    """
    # Columns of any name lie within ``doc``.
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    keyed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc"), docs["doc_id"].cast("long").alias("id"), F.md5(text).alias("digest"))
    each = classes(docs.select("doc_id", "text", F.md5(text).alias("digest")), POSTING, "digest").groupBy("component", "doc_id", "digest").agg(F.count("*").alias("n"))
    first = each.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest", "n")).alias("x"))
    keep = common.store(first.select(F.col("x.doc_id").alias("kept_id"), F.col("x.digest").alias("kept_digest"), "x.n"), "simhash-keep")
    held = lambda which: keyed.join(keep.where(which), keyed["id"].eqNullSafe(F.col("kept_id")) & (keyed["digest"] == F.col("kept_digest")), "left_semi")
    once = held("n = 1").select("doc.*")
    if keep.where("n > 1").isEmpty():
        return once
    return once.unionByName(held("n > 1").dropDuplicates(["id", "digest"]).select("doc.*"))
