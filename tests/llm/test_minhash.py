"""Fingerprints, neighbours and likeness worked out by hand."""

import hashlib
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from proofmark.llm import minhash

R = random.Random(55)
WORDS = [f"w{i}é" if i % 7 == 0 else f"Word{i}" for i in range(400)]


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


ROWS = [
    *((i * 3, prose(R.choice([0, 1, 3, 4, 5, 6, 9, 40, 200, 900]))) for i in range(60)),
    *((None, prose(R.randint(0, 30))) for _ in range(70)),
    *((500, prose(R.randint(0, 30))) for _ in range(60)),
    *((500, "the same text of these rows here") for _ in range(20)),
    (None, None),
    (1001, None),
    (1002, " \t\n"),
    (-5, "ends all"),
    (2**62, "far away 𝔘"),
    (2**62 + 1, "far away too"),
]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chained(*parts):
    """Spark's 64-bit hash of several values: each one's hash is the next one's seed."""
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else struct.pack("<i", p), seed & (1 << 64) - 1)
    return signed(seed)


def bins_of(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    n, size = minhash.SHINGLE, minhash.BINS
    found = [chained(*words[i : i + n]) for i in range(len(words) - n + 1)] or [chained(" ".join(words))]
    low = {}
    for h in found:
        b = (h >> 57) + size // 2
        low[b] = min(h, low.get(b, h))
    out, mask = [], (1 << minhash.BITS) - 1
    for b in range(size):
        drawn = next((d for t in range(minhash.DRAWS) if (d := chained(b, t) % size) in low), None)
        if b in low:
            value = low[b]
        elif drawn is not None:
            value = low[drawn]
        else:
            value = min(chained(b, c) & ~mask | h & mask for c, h in low.items())
        out.append(value & mask)
    return out


def hexed(bins):
    return "".join(f"{b:02x}" for b in bins)


def like(a, b):
    same, chance = sum(x == y for x, y in zip(a, b, strict=True)) / minhash.BINS, 2.0**-minhash.BITS
    return max(0.0, (same - chance) / (1 - chance))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("cell", "copy", "bins", "next_text", "to", "row")}).repartition(5)


def test_fingerprints_equal_those_worked_out_by_hand(docs):
    got = sorted((str(r.doc_id), r.fingerprint) for r in minhash.fingerprints(docs).collect())
    assert got == sorted((str(i), hexed(bins_of(t))) for i, t in ROWS)


def test_report_follows_the_order_of_documents(docs):
    """Each row's next one comes from the rows of the next id downwards, or its own, in one ring over all rows."""
    out = minhash.report(docs).collect()
    assert len(out) == len(ROWS)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    order = sorted({i for i, _ in ROWS if i is not None}, reverse=True) + [None]
    groups = {i: [t or "" for j, t in ROWS if j == i] for i in order}
    known = {}
    for r in out:
        at = order.index(r.doc_id)
        later = groups[r.doc_id] + groups[order[(at + 1) % len(order)]]
        own = [t for t in set(groups[r.doc_id]) if hexed(bins_of(t)) == r.fingerprint and len(t) == r.n_chars]
        met = False
        for t in own:
            half = len(t) // 2
            for other in later:
                edited = t[: len(t) - half] + other[:half]
                if sha(edited) == r.edited_sha256 and hexed(bins_of(edited)) == r.edited_fingerprint:
                    a, b, e = bins_of(t), bins_of(other), bins_of(edited)
                    met = met or abs(like(a, e) - r.near_edited) < 1e-12 and abs(like(a, b) - r.near_next) < 1e-12
        assert met, r
        known.setdefault(r.doc_id, []).append(r)
    assert {i: len(v) for i, v in known.items()} == {i: len(v) for i, v in groups.items()}
    single = [i for i in order if len(groups[i]) == 1]
    for a, b in zip(order, order[1:]):
        if a in single and b in single:
            t, u = groups[a][0], groups[b][0]
            assert known[a][0].edited_sha256 == sha(t[: len(t) - len(t) // 2] + u[: len(t) // 2])


def test_rows_of_one_id_are_dealt_apart(docs):
    """Null ids, and an id that many rows share, don't meet in one cell."""
    for buckets in (4, 16):
        cells = minhash.dealt(docs, buckets).groupBy("cell").agg(F.count("*").alias("n")).collect()
        assert max(r.n for r in cells) < 60 and sum(r.n for r in cells) == len(ROWS)


def test_next_rows_form_one_ring(spark):
    """With distinct texts, following the next row comes by every row once, whatever ids repeat."""
    rows = [(i // 40 if i % 3 else None, f"text number {i} of all") for i in range(400)]
    nexts = minhash.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 8).select("text", "next_text").collect()
    step, seen, at = dict(map(tuple, nexts)), set(), "text number 0 of all"
    while at not in seen:
        seen.add(at)
        at = step[at]
    assert len(nexts) == len(rows) == len(seen)
