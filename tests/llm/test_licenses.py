"""License labels against every block compared with every template, and phrases against a plain search."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from proofmark.llm import licenses, queries

R = random.Random(13)
FILLER = "the of and is in this work be all any use to a by for software license licensed copy words 2 3 Été naïve".split()


def prose(n):
    return " ".join(R.choice(FILLER) for _ in range(n))


def damaged(text, gone):
    """The template's text without some of its words, with other words strewn in."""
    words = text.split()
    for _ in range(gone):
        words.pop(R.randrange(len(words)))
    return R.choice(["\n", " ", " * "]).join(words)


TEXTS = [
    None,
    "",
    " \t\n",
    "Été!",
    *(prose(R.randint(1, 300)) for _ in range(40)),
    *(f"{prose(R.randint(0, 150))}\n{damaged(t, R.randint(0, len(t.split()) // 2))}\n{prose(R.randint(0, 150))}" for _ in range(4) for _, t in licenses.TEMPLATES),
    *(t for _, t in licenses.TEMPLATES),
    "Released UNDER the MIT\tLicense. under the mit license",
    "Apache License, Version 2.0; CC-BY-NC cc by nc cc by",
    "under the MİT license, under the KMIT license",
    "under the mit",
    f"{prose(6_000)} under the mit license {prose(6_000)} {licenses.TEMPLATES[0][1]}",
]
ROWS = [*enumerate(TEXTS), (None, TEXTS[50]), (None, TEXTS[50]), (None, None), (3, "under the mit license"), (3, "x")]


def words(t):
    low = (t or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(t, threshold=licenses.THRESHOLD):
    ws = words(t)
    found = sorted((i, label) for p, label in licenses.PHRASES for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split())
    base = {label for _, label in found}
    met = []
    for label, text in licenses.TEMPLATES:
        held, width = set(words(text)), licenses.width_of(text)
        for b in range(max(1, -(-len(ws) // width) - 1)):
            share = len(held & set(ws[b * width : (b + 2) * width])) / len(held)
            if share >= threshold - 1e-9:
                met.append((share, label))
    return len(ws), [i for i, _ in found], sorted(base), sorted(base | {label for _, label in met}), 1.0 if found else max(met, default=(0.0,))[0]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("words", "width", "held", "label", "need", "digest", "score")}).repartition(3)


@pytest.mark.parametrize("threshold", [0.8, 0.5])
def test_labels_equal_those_of_all_blocks(docs, threshold):
    found = [(r.doc_id, r.n_words, list(r.places), list(r.base_labels), list(r.labels), r.score) for r in licenses.scan(docs, threshold=threshold).collect()]
    expected = [(i, *plain(t, threshold)) for i, t in ROWS]
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert len({label for e in expected for label in e[4]}) == len({label for label, _ in licenses.TEMPLATES} | {"cc-by-nc"})


def test_every_meeting_block_is_found(docs):
    texts = docs.select("doc_id", "text").where("doc_id is not null and doc_id <> 3").withColumn("text", F.coalesce("text", F.lit("")))
    found = {(r.doc_id, r.template, r.block, r.score) for r in licenses.matches(texts).collect()}
    expected = set()
    for i, t in ROWS:
        if i is not None and i != 3:
            ws = words(t)
            for k, (_, text) in enumerate(licenses.TEMPLATES):
                held, width = set(words(text)), licenses.width_of(text)
                for b in range(max(1, -(-len(ws) // width) - 1)):
                    share = len(held & set(ws[b * width : (b + 2) * width])) / len(held)
                    if share >= 0.8:
                        expected.add((i, k, b, share))
    assert found == expected and len(expected) > 30


def test_a_stretch_as_long_as_its_template_lies_in_one_block():
    for width in (8, 16, 64):
        for n in range(1, 5 * width):
            blocks = max(1, -(-n // width) - 1)
            assert all(any(b * width <= s and s + min(width, n) <= (b + 2) * width for b in range(blocks)) for s in range(max(1, n - width + 1)))


def test_arguments_are_checked(docs):
    for templates, threshold in (((("x", "?!"),), 0.8), ((), 0.8), (licenses.TEMPLATES, 0.0), (licenses.TEMPLATES, 1.5)):
        with pytest.raises(ValueError):
            licenses.scan(docs, templates, threshold=threshold)


def test_native_plan_and_empty_table(spark, docs):
    plan = licenses.scan(docs.select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|ArrowEval", plan) and "BroadcastHashJoin" in plan
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_equals_its_sql(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = queries.op13_licenses(spark, str(tmp_path))
    with duckdb.connect() as c:
        c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        told = c.sql(f"select {', '.join(df.columns)} from ({queries.oracle_sql()['op13_licenses']})").fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(told, key=str)
