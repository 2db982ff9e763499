"""Passages against a plain search through the same chunks, window by window."""

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from proofmark.llm import chunks, common

R = random.Random(66)
WORDS = ["to", "be", "Stone", "creek", "é", "distillery", "a", "of", "warning", "𝔘nicode", "x1", "reserve"]


def prose(n, r=R):
    return " ".join(r.choice(WORDS) + r.choice(["", "", str(r.randint(0, 99))]) for _ in range(n))


def enough(part, least, words):
    return part[-1][1] - part[0][0] >= least or sum(c[2] for c in part) >= words


def plain_windows(run, least, words):
    """Shortest windows from each chunk on and up to each chunk, and the whole run."""
    n, found = len(run), set()
    if not enough(run, least, words):
        return found
    for i in range(n):
        found |= {(i, j) for j in range(i, n) if enough(run[i : j + 1], least, words) and not (j > i and enough(run[i:j], least, words))}
        found |= {(k, i) for k in range(i + 1) if enough(run[k : i + 1], least, words) and not (k < i and enough(run[k + 1 : i + 1], least, words))}
    return found | {(0, n - 1)}


def chunked(text):
    data = (text or "").encode("utf-8", "replace")
    ends = chunks.cuts(data) if data else []
    starts = [0, *ends[:-1]][: len(ends)]
    return [(a, e, w, data[a:e]) for a, e, w in zip(starts, ends, chunks.words_of(data, ends) if ends else [], strict=True)]


def runs_of(parts, repeated):
    out = []
    for c in parts:
        if c[3] not in repeated:
            continue
        if out and out[-1][-1][1] == c[0]:
            out[-1].append(c)
        else:
            out.append([c])
    return out


def plain(rows, least=chunks.RUN, words=chunks.WORDS):
    """Rows as (row, id, text); the order of rows decides between places of one id."""
    holders = defaultdict(set)
    for _, i, t in rows:
        for c in chunked(t):
            holders[c[3]].add(i)
    repeated = {d for d, ids in holders.items() if len(ids) > 1}
    places, cut = defaultdict(list), []
    for row, i, t in rows:
        for run in runs_of(chunked(t), repeated):
            for a, b in plain_windows(run, least, words):
                held = tuple(c[3] for c in run[a : b + 1])
                cut.append((row, i, run[a][0], run[b][1], a, b, held))
                places[held].append((i, row, run[a][0]))
    groups = defaultdict(list)
    for row, i, start, end, a, b, held in cut:
        first, last = min(places[held]), max(places[held])
        if first[0] == last[0]:
            continue
        kept = i == first[0]
        other = last if kept else first
        groups[row, i, kept, other[1], start - other[2]].append((start, end, a, b, first[0]))
    joined = defaultdict(list)
    for (row, i, kept, _, _), found in groups.items():
        part = None
        for start, end, a, b, first in sorted(found, key=lambda x: x[:2]):
            if part is None or start > part[1]:
                part = [start, end, a, b, first]
                joined[row, i, kept].append(part)
            else:
                part[1], part[2], part[3], part[4] = max(part[1], end), min(part[2], a), max(part[3], b), min(part[4], first)
    out = []
    for (_, i, kept), parts in joined.items():
        reached = -1
        for start, end, a, b, first in sorted(parts, key=lambda x: (x[0], -x[1], x[4])):
            if end > reached:
                out.append((i, start, end, b - a + 1, first, kept))
                reached = end
    return sorted(out, key=str)


def made():
    shared = [prose(n) for n in (20, 30, 60, 60, 120, 200)]
    texts = [" ".join(R.choice([prose(R.randint(3, 60)), prose(R.randint(1, 9)), R.choice(shared), R.choice(shared)[R.randint(0, 40) :]]) for _ in range(R.randint(1, 6))) for _ in range(60)]
    unit = "one two three four five six seven "
    texts += [texts[0], texts[0] + " end", prose(5) + texts[1], None, "", " \n", unit * 40, "x " + unit * 30, "y" * 3_000, "z" + "y" * 2_500, prose(3_000, random.Random(1)), "+" + prose(3_000, random.Random(1))]
    return texts


@pytest.mark.parametrize("least,words", [(chunks.RUN, chunks.WORDS), (40, 1_000), (200, 8)])
def test_passages_equal_a_plain_search(spark, least, words):
    texts = made()
    rows = [(i, i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t) for _, i, t in rows], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "id", "start", "digest", "check", "high", "first")}).coalesce(1)
    out = chunks.passages(df, least, words).select("doc_id", "start", "end", "n_chunks", "first_doc_id", "kept").collect()
    expected = plain(rows, least, words)
    assert sorted(map(tuple, out), key=str) == expected and len(expected) > 50


def test_windows_equal_the_plain_ones_however_batches_fall(spark):
    runs = []
    for _ in range(300):
        at, run = R.randint(0, 50), []
        for _ in range(R.choice([1, 2, 3, 8, 30])):
            size = R.randint(12, 128)
            run.append((at, at + size, R.randint(0, 9)))
            at += size
        runs.append(run)
    flat, first = [], []
    for run in runs:
        first.append(len(flat))
        flat += run
    start, end, words = (np.array(x, np.int64) for x in zip(*flat, strict=True))
    for least, most in ((80, 16), (200, 10_000), (100_000, 5), (10**6, 10**6)):
        found = {tuple(p) for p in chunks.covers(start, end, words, np.array(first), least, most).tolist()}
        assert found == {(f + i, f + j) for f, run in zip(first, runs, strict=True) for i, j in plain_windows(run, least, most)}
    rows = [(r, 7 * r, *c, R.randint(-9, 9)) for r, run in enumerate(runs) for c in run]
    packed = [(r, i, int(chunks.placed(np.array([a]), np.array([e]), np.array([w]))[0]), d) for r, i, a, e, w, d in rows]
    df = spark.createDataFrame(packed, "row long, id long, place long, digest long").coalesce(1).sortWithinPartitions("row", "place")
    results = []
    for size in (7, 100_000):
        with common.batches_of(spark, size):
            results.append(sorted(map(tuple, chunks.windows(df).collect())))
    assert results[0] == results[1]
    by = {r: [c for c in rows if c[0] == r] for r in range(len(runs))}
    expected = []
    for r, run in enumerate(runs):
        for i, j in plain_windows(run, chunks.RUN, chunks.WORDS):
            held = b"".join(d.to_bytes(8, "little", signed=True) for *_, d in by[r][i : j + 1])
            x = xxhash.xxh3_128_digest(held)
            expected.append((r, 7 * r, run[i][0], run[j][1], i, j, int.from_bytes(x[:8], "little", signed=True), int.from_bytes(x[8:12], "little", signed=True)))
    assert results[0] == sorted(expected)


def test_no_rows(spark):
    assert chunks.passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert len(chunks.covers(*[np.zeros(0, np.int64)] * 4)) == 0


def met(r, passage):
    """Whether two texts that hold the passage between different prose have a window of it in common."""
    found = [chunked(f"{prose(r.randint(20, 60), r)} {passage} {prose(r.randint(20, 60), r)}") for _ in range(2)]
    both = {c[3] for c in found[0]} & {c[3] for c in found[1]}
    held = [{tuple(c[3] for c in run[i : j + 1]) for run in runs_of(x, both) for i, j in plain_windows(run, chunks.RUN, chunks.WORDS)} for x in found]
    return bool(held[0] & held[1])


@pytest.mark.parametrize("size,unit,least", [(2, 51, 0.9), (3, 51, 0.95), (5, 51, 0.99), (2, 1, 0.9), (2, 2, 0.9), (2, 5, 0.9), (3, 3, 0.9), (4, 3, 0.85), (5, 2, 0.85), (7, 2, 0.9)])
def test_recall_of_short_words_and_of_repeated_units(size, unit, least):
    """Passages of 51 words of so many letters, a unit of so many words repeated in them."""
    r = random.Random(100 * size + unit)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(size))
    times = 200
    assert sum(met(r, " ".join(([word() for _ in range(unit)] * 51)[:51])) for _ in range(times)) >= least * times
