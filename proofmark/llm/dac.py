"""Token ids as directly addressable codes: chunk levels, continuation bitmaps, rank directories.

An id is split into bytes.  Level 0 holds every id's lowest byte; its bitmap
says which ids go on, and the next level holds the next byte of those alone.
A directory counts the set bits before each 512-bit stretch, so the place of an
id in the next level, and thus any single id, is found without decoding others.

Files are Parquet tables of blocks in ascending ``doc_id`` order.  A block holds
whole documents, about ``BLOCK`` ids, with the directory of its documents.

Null texts count as empty and get the end id alone.  A null ``doc_id`` sorts
first; rows that repeat a ``doc_id`` follow one another by text.
"""

from __future__ import annotations

import functools
import operator
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

BLOCK = 1 << 17
#: Blocks that a lookup names in its filter.
LISTED = 256
#: Bytes of a bitmap between two entries of its rank directory.
STRETCH = 64
ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


def pack(ids: np.ndarray) -> bytes:
    """Layout: number of levels, then for each level its length; then each level's bytes, bitmap and directory."""
    rest, levels = ids.astype(np.uint32), []
    while True:
        more = rest >= 256
        bits = np.packbits(more, bitorder="little")
        before = np.concatenate([[0], np.cumsum(ONES[bits], dtype=np.uint32)])[:-1:STRETCH].astype("<u4") if len(bits) else np.zeros(0, "<u4")
        levels.append((len(rest), (rest & 255).astype(np.uint8).tobytes() + bits.tobytes() + before.tobytes()))
        rest = rest[more] >> 8
        if not len(rest):
            return struct.pack(f"<I{len(levels)}I", len(levels), *(n for n, _ in levels)) + b"".join(x for _, x in levels)


class Codes:
    """A packed block; nothing is decoded until it is asked for."""

    def __init__(self, packed: bytes):
        self.packed = packed
        (n,) = struct.unpack_from("<I", packed)
        self.sizes = struct.unpack_from(f"<{n}I", packed, 4)
        self.at, at = [], 4 + 4 * n
        for size in self.sizes:
            bits = -(-size // 8)
            self.at.append((at, at + size, at + size + bits))
            at += size + bits + 4 * -(-bits // STRETCH)

    def __len__(self) -> int:
        return self.sizes[0]

    def __getitem__(self, i: int) -> int:
        """One id, by a byte and a rank at each level."""
        found = 0
        for level, (data, bits, ranks) in enumerate(self.at):
            found |= self.packed[data + i] << 8 * level
            byte, bit = divmod(i, 8)
            if not self.packed[bits + byte] >> bit & 1:
                break
            stretch = byte // STRETCH
            (rank,) = struct.unpack_from("<I", self.packed, ranks + 4 * stretch)
            rank += int.from_bytes(self.packed[bits + stretch * STRETCH : bits + byte], "little").bit_count()
            i = rank + (self.packed[bits + byte] & (1 << bit) - 1).bit_count()
        return found

    def all(self) -> np.ndarray:
        """Every id."""
        found, places = np.zeros(len(self), np.uint32), slice(None)
        for level, (size, (data, bits, _)) in enumerate(zip(self.sizes, self.at, strict=True)):
            found[places] |= np.frombuffer(self.packed, np.uint8, size, data).astype(np.uint32) << np.uint32(8 * level)
            more = np.unpackbits(np.frombuffer(self.packed, np.uint8, -(-size // 8), bits), count=size, bitorder="little").view(bool)
            places = np.flatnonzero(more) if level == 0 else places[more]
        return found


SCHEMA = "shard int, block int, start long, n_ids long, doc_ids array<long>, lengths array<long>, codes binary"


def write(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """Encodes every text, appends ``end``, and writes the blocks to the shared folder; returns the written table.

    Texts are dealt into ranges of ``doc_id`` once and encoded where they land,
    so ids are never shuffled.  ``start`` counts within the shard (range).
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = common.texts_of(docs).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    last = np.array([end], "<u4").tobytes()

    def rows(batches) -> Iterator[list[tuple]]:
        encode = tokens.encoder(tokenizer).encode
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        ids, doc_ids, lengths, held = [], [], [], 0

        def full() -> tuple:
            return (shard, block, start, held, doc_ids, lengths, pack(np.frombuffer(b"".join(ids), "<u4")))

        for b in batches:
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                got = encode(text) + last
                ids.append(got)
                doc_ids.append(doc_id)
                lengths.append(len(got) // 4)
                held += len(got) // 4
                if held >= BLOCK:
                    yield [full()]
                    block, start = block + 1, start + held
                    ids, doc_ids, lengths, held = [], [], [], 0
        if doc_ids:
            yield [full()]

    return common.store(common.map_rows(ranged, rows, SCHEMA), "token-codes")


def placed(blocks: DataFrame) -> DataFrame:
    """The blocks with ``start`` counted over all shards.  Only one sum per shard comes to the driver."""
    before, sums = [], dict(blocks.groupBy("shard").agg(F.sum("n_ids")).collect())
    for shard in sorted(sums):
        before.append((shard, before[-1][1] + before[-1][2] if before else 0, sums[shard]))
    shards = blocks.sparkSession.createDataFrame(before, "shard int, before long, n long").select("shard", "before")
    return blocks.join(F.broadcast(shards), "shard").withColumn("start", F.col("start") + F.col("before")).drop("before")


def read(blocks: DataFrame) -> DataFrame:
    """One row per document from the written blocks: its place among all ids, its length, a checksum of its ids, and, by direct access, its first and last id."""

    def rows(batches) -> Iterator[list[tuple]]:
        for b in batches:
            for start, doc_ids, lengths, codes in zip(*(b[c].to_pylist() for c in ("start", "doc_ids", "lengths", "codes")), strict=True):
                coded = Codes(codes)
                ids, out, at = coded.all().astype("<u4"), [], 0
                for doc_id, n in zip(doc_ids, lengths, strict=True):
                    out.append((doc_id, start + at, n, zlib.crc32(ids[at : at + n].tobytes()), coded[at], coded[at + n - 1]))
                    at += n
                yield out

    wanted = placed(blocks).select("start", "doc_ids", "lengths", "codes")
    return common.map_rows(wanted, rows, "doc_id long, start long, n_tokens long, ids_crc32 long, first_id long, last_id long")


def lookup(blocks: DataFrame, positions: DataFrame) -> DataFrame:
    """The id at each ``position`` (long, counted over all ids), read from its block alone; positions outside get no row.

    Blocks are found by equal cells of ``BLOCK`` ids, not by comparing each
    position with each block, and from their places alone.  Codes are then read
    of these blocks: up to ``LISTED`` of them are named in the scan's filter, so
    the files of others are skipped; more are joined.
    """
    cells = placed(blocks.select("shard", "block", "start", "n_ids")).withColumn("cell", F.explode(F.sequence(F.expr(f"start div {BLOCK}"), F.expr(f"(start + n_ids - 1) div {BLOCK}"))))
    asked = positions.select(F.col("position").cast("long").alias("position")).withColumn("cell", F.expr(f"position div {BLOCK}"))
    met = asked.join(cells, "cell").where("position >= start and position < start + n_ids").select("shard", "block", "position", (F.col("position") - F.col("start")).alias("i"))
    wanted = met.select("shard", "block").distinct().limit(LISTED + 1).collect()
    codes = blocks.select("shard", "block", "codes")
    if len(wanted) <= LISTED:
        by = {s: sorted(x.block for x in wanted if x.shard == s) for s in sorted({x.shard for x in wanted})}
        codes = codes.where(functools.reduce(operator.or_, ((F.col("shard") == s) & F.col("block").isin(b) for s, b in by.items()), F.lit(False)))
    met = met.join(codes, ["shard", "block"]).select("position", "i", "codes")

    def rows(batches) -> Iterator[list[tuple]]:
        for b in batches:
            yield [(p, Codes(codes)[i]) for p, i, codes in zip(*(b[c].to_pylist() for c in ("position", "i", "codes")), strict=True)]

    return common.map_rows(met, rows, "position long, id long")
