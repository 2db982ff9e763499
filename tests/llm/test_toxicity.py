"""Scores worked out from plain counts, and the whole pipeline's rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofmark.llm import toxicity

R = random.Random(91)
SAFE = "morning river stone walks with women and men near the old mill blind poet young black birds".split()
VILE = "scumbag vermin idiotic worthless".split()


def text(toxic):
    words = [R.choice(SAFE) for _ in range(R.randint(0, 25))]
    if toxic:
        words.insert(R.randint(0, len(words)), R.choice(VILE))
        words += [R.choice(["women", "Muslims", "gay"])] * R.randint(0, 1)
    return R.choice([" ", ", ", "\n"]).join(words)


ROWS = [(i, text(i % 3 == 0)) for i in range(240)] + [(300, None), (301, ""), (None, "a scumbag near"), (302, "VERMIN " * 50), (5, "a second row of five"), (303, "ünïcode vermin")]
LABELS = [(i, 1, int(i % 3 == 0)) for i in range(0, 240, 1) if i % 4 < 3] + [(5, 0, 0), (300, 1, 0), (301, None, None), (None, 1, 1), (9_999, 1, 1)]


def out(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 == 0


def cut(t):
    return set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()))


def grams(ws):
    return {g for w in ws for m in [f"<{w}>"] for g in (w, *(m[i : i + n] for n in (4, 5) for i in range(len(m) - n + 1)))}


def plain(rows, labels, most):
    known = {}
    for i, _, toxic in labels:
        if i is not None and toxic is not None and not out(i):
            known[i] = max(known.get(i, 0), toxic)
    texts = {}
    for i, t in rows:
        if i in known:
            texts[i] = min(texts.get(i, t or ""), t or "")
    sample = [(texts[i], known[i]) for i in texts]
    pos, neg = Counter(), Counter()
    for t, y in sample:
        (pos if y else neg).update(grams(cut(t)))
    a, b = sum(y for _, y in sample), sum(1 - y for _, y in sample)
    ratios = {}
    for g in pos.keys() | neg.keys():
        p, n = pos[g], neg[g]
        if p + n >= toxicity.SUPPORT:
            cells = ((p, a, p + n), (n, b, p + n), (a - p, a, a + b - p - n), (b - n, b, a + b - p - n))
            ratios[g] = 2 * sum(x * math.log(x * (a + b) / (whole * side)) for x, whole, side in cells if x)
    chosen = sorted((g for g, r in ratios.items() if r >= toxicity.RATIO), key=lambda g: (-round(ratios[g], 9), g))[:most]
    place = {g: k for k, g in enumerate(chosen)}
    ids = lambda ws: {place[g] for g in grams(ws) if g in place}
    pairs = Counter()
    for t, _ in sample:
        ws = cut(t)
        for term in sorted(ws & toxicity.KIND.keys()):
            others = [x for x in toxicity.KIND[term] if x != term]
            for k in (len(term), 2 * len(term) + 1):
                was, now, rest = ids({term}), ids({others[k % len(others)]} - ws), ids(ws - {term})
                lost, gained = was - now, now - was
                pairs[tuple(sorted(lost - rest)), tuple(sorted(gained - rest))] += 1
    order = sorted(pairs)
    weights, bias = toxicity.descend(np.array([float(y) for _, y in sample]), [sorted(ids(cut(t))) for t, _ in sample], [list(p[0]) for p in order], [list(p[1]) for p in order], np.array([float(pairs[p]) for p in order]), len(chosen))
    return [1 / (1 + math.exp(-(bias + sum(weights[k] for k in ids(cut(t)))))) for _, t in rows]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("score", "toxic", "row", "feature")}).repartition(4)
    return docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").repartition(2)


@pytest.mark.parametrize("most", [toxicity.FEATURES, 12, None])
def test_scores_equal_those_of_a_plain_fit(tables, most):
    got = sorted((str(r.doc_id), r.held_out, r.predicted, r.score) for r in toxicity.report(*tables, most=most).collect())
    expected = sorted((str(i), out(i), int(s >= 0.5), s) for (i, _), s in zip(ROWS, plain(ROWS, LABELS, most), strict=True))
    assert [g[:3] for g in got] == [e[:3] for e in expected]
    assert all(abs(g[3] - e[3]) < 1e-6 for g, e in zip(got, expected, strict=True))
    assert len({g[2] for g in got}) == 2


def test_cleaned_rows_keep_all_columns(tables):
    docs, labels = tables
    bad = Counter(str(r.doc_id) for r in toxicity.report(docs, labels).where("predicted = 1").collect())
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns
    assert Counter(str(r.doc_id) for r in kept.collect()) == Counter(str(i) for i, _ in ROWS) - bad
