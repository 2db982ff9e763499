"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

Every document is encoded, ended, and, only where it is longer than a sequence,
cut into pieces of which the first may be shorter.  The pieces' lengths, not
their tokens, are dealt at random into groups of about ``GROUP`` pieces; each
group is packed on its own, which costs at most about one sequence per group.

Null texts count as empty: the end id alone.  Ties are broken by the order of
``doc_id`` and piece, nulls last; repeated rows are separate documents.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

GROUP = 1 << 13


def best_two_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Sequences as lists of places in ``lengths``.

    A sequence takes the longest piece that fits, again and again.  If it isn't
    full then, its smallest piece makes room for the two unpacked pieces that
    fill the gap best, where two fill it more tightly.
    """
    held: dict[int, list[int]] = defaultdict(list)
    for place in range(len(lengths) - 1, -1, -1):
        held[lengths[place]].append(place)
    there = sum(1 << n for n in held)  # bit n: pieces of n tokens are left
    upto = [(1 << n + 1) - 1 for n in range(size + 1)]

    def take(n: int) -> int:
        nonlocal there
        place = held[n].pop()
        if not held[n]:
            there &= ~(1 << n)
        return place

    def give(place: int) -> None:
        nonlocal there
        held[lengths[place]].append(place)
        there |= 1 << lengths[place]

    packed = []
    while there:
        now, gap = [], size
        while gap and (fits := there & upto[gap]):
            n = fits.bit_length() - 1
            now.append(take(n))
            gap -= n
        if gap and there:
            least = lengths[now[-1]]
            room, best = gap + least, (least, 0, 0)
            fits = there & upto[room - 1]
            while fits and best[0] < room:
                a = fits.bit_length() - 1
                if 2 * a <= best[0]:
                    break
                fits &= ~(1 << a)
                others = there & upto[min(a, room - a)]
                if others >> a & 1 and len(held[a]) < 2:
                    others &= ~(1 << a)
                if others and a + (b := others.bit_length() - 1) > best[0]:
                    best = (a + b, a, b)
            if best[1]:
                give(now.pop())
                now += [take(best[1]), take(best[2])]
        packed.append(now)
    return packed


def pieces(docs: DataFrame, tokenizer: str, end: int, size: int) -> DataFrame:
    """One row per piece: its document, its number there, its first token's place, its length, a checksum of its ids."""
    last = np.array([end], "<u4").tobytes()

    def rows(batches) -> Iterator[list[tuple]]:
        encode = tokens.encoder(tokenizer).encode
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                ids = encode(text) + last
                n = len(ids) // 4
                cuts = [0, *range(n % size or size, n + 1, size)]
                out += [(doc_id, i, a, e - a, zlib.crc32(ids[4 * a : 4 * e])) for i, (a, e) in enumerate(zip(cuts, cuts[1:], strict=False))]
            yield out

    return common.map_rows(common.texts_of(docs), rows, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, end: int = 0, size: int = 2048) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``; a sequence's pieces lie gapless from 0."""
    found = common.store(pieces(docs, tokenizer, end, size).withColumn("row", F.monotonically_increasing_id()), "packing-pieces")
    groups = -(-found.count() // GROUP) or 1
    # By the row too, so that rows which repeat a document do not meet in one group.
    dealt = found.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "row"), F.lit(groups)))

    def place(key: tuple, group: pa.Table) -> pa.Table:
        group = group.drop_columns(["group", "row"]).sort_by([(c, "ascending") for c in ("doc_id", "piece", "start", "ids_crc32")])
        lengths = group["length"].to_pylist()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for number, places in enumerate(best_two_fit(lengths, size)):
            at = 0
            for x in places:
                sequence[x], offset[x] = key[0].as_py() << 32 | number, at
                at += lengths[x]
        return group.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return dealt.groupBy("group").applyInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
