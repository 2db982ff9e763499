"""Periodic runs against a plain search through all lags and places."""

import hashlib
import random
import time
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from proofmark.llm import periodic, queries

R = random.Random(12)


def plain(words, least=12, min_exp=2):
    best = {}
    for q in range(1, len(words) // min_exp + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, min_exp * q):
                best.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def kept(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


TEXTS = [
    *(" ".join(R.choice("ab"[: R.randint(1, 2)]) for _ in range(R.randint(0, 60))) for _ in range(60)),
    *(" ".join(R.choice("abc") for _ in range(R.randint(20, 200))) for _ in range(40)),
    *(" ".join((u := [R.choice("abcdefgh") for _ in range(R.randint(1, 9))]) * R.randint(2, 9) + u[: R.randint(0, 3)] + ["x"] + u * R.randint(1, 8)) for _ in range(60)),
    " ".join(fibonacci(400)),
    "spam " * 300,
    "é é\n" * 7 + "  é \x1c \x85 " * 13,
    "one two three",
    "",
    " \t\n ",
]


def test_runs_equal_a_plain_search():
    texts = [t.encode().split() for t in TEXTS]
    for least, min_exp in ((12, 2), (6, 3), (2, 2)):
        expected = [plain(t, least, min_exp) for t in texts]
        assert periodic.runs_of(texts, least, min_exp) == expected
        for t, e in list(zip(TEXTS, expected))[::5]:
            for shares in (1, 3, 7):
                found = [periodic.share_of(t.encode(), k, shares, least, min_exp) for k in range(shares)]
                assert sorted((r for _, rs in found for r in rs), key=lambda r: (r[0], r[2])) == e
    assert sum(map(len, expected)) > 500


@pytest.fixture(scope="module")
def docs(spark):
    rows = [*enumerate(TEXTS), (1000, None), (None, TEXTS[120]), (3, TEXTS[120]), (3, TEXTS[120]), (1001, "w " * 40_000 + "z " * 5)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("digest", "runs", "share", "shares", "found", "n_words")}).repartition(3)


def test_both_ways_give_the_rows_of_the_plain_search(docs):
    rows, df = docs
    expected = []
    for i, t in rows:
        words = [w.decode() for w in (t or "").encode().split()]
        runs = [(0, 40_000, 1)] if i == 1001 else plain(words)
        expected.append((i, len(words), runs, kept(words, runs)))
    for long in (periodic.LONG, 40):
        found = periodic.find(df, long=long)
        assert found.columns == ["doc_id", "n_words", "runs", "collapsed"]
        assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found.collect()), key=str) == sorted(expected, key=str)


def test_repeats_without_end_take_time_in_proportion():
    for unit in (1, 7, 977):
        words = [str(i % unit).encode() for i in range(120_000)]
        began = time.time()
        assert periodic.runs_of([words]) == [[(0, 120_000, unit)]]
        n, runs = periodic.share_of(b" ".join(words), 3, 4)
        assert (n, runs) == (120_000, []) and time.time() - began < 30
    spread = [w for i in range(40) for w in [b"a", b"b"] * 200 + [str(i).encode()]]
    assert len(periodic.runs_of([spread])[0]) == 40


def test_arguments_are_checked(docs):
    with pytest.raises(ValueError):
        periodic.find(docs[1], min_exp=1)


def test_query_equals_its_sql_and_the_plain_search(spark, tmp_path):
    rows = [(i, " ".join(R.choice("abcdefghijkl") for _ in range(R.randint(0, 150)))) for i in range(200)] + [(None, "a " * 20), (90, None), (5, ""), (7, "x " * 99), (7, "x " * 99)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = queries.op12_periodic_runs(spark, str(tmp_path))
    expected, planted = [], 0
    for i, t in rows:
        words = (t or "").split()
        h = None if i is None else zlib.crc32(str(i).encode())
        if h is not None and h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
            planted += 1
        runs = plain(words)
        s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        expected.append((i, len(runs), s, n, q, 1000 * n // q if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(kept(words, runs))))
    assert planted > 10
    assert sorted(map(tuple, df.collect()), key=str) == sorted(expected, key=str)
    with duckdb.connect() as c:
        c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        told = c.sql(f"select {', '.join(df.columns)} from ({queries.oracle_sql()['op12_periodic_runs']})").fetchall()
    assert sorted(told, key=str) == sorted(expected, key=str)


def test_empty_table(spark):
    assert periodic.digests(periodic.find(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
