"""Fill-in-the-middle outputs against a plain version."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from proofmark.llm import fim, queries

R = random.Random(11)
ALPHABET = "abcXYZ  \n\t.,;<>PSM0129éß𝔘😀\x00"
ROWS = [
    *((i, "".join(R.choice(ALPHABET) for _ in range(R.randint(0, 60)))) for i in range(300)),
    (300, None),
    (301, ""),
    (302, "x" * 30_000 + " " + "y" * 9_000),
    (303, "Long text, 😀 of several pieces. " * 2_000),
    (304, "has <M> in it"),
    (305, "ends in <"),
    (None, "no id"),
    (7, "same"),
    (7, "same"),
    (-(2**62), "far id"),
]


def plain(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "form", "output", "digest", "cut")}).repartition(3)


def test_outputs_equal_the_plain_version(docs):
    found = fim.transform(docs)
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted((plain(*r) for r in ROWS), key=str)
    assert {r.form for r in found.select("form").distinct().collect()} == {"plain", "psm", "spm"}


def test_texts_come_back_from_output_and_form(docs):
    back = fim.transform(docs).select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("text"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(((i, t or "") for i, t in ROWS), key=str)


def test_pieces_make_up_the_text_and_keep_units_whole():
    text = ("ab" * 3_000 + " 1" * 2_000 + "é") * 3
    parts = list(fim.pieces(text))
    assert "".join(p for _, p in parts) == text and all(text[a : a + len(p)] == p for a, p in parts)
    assert len(parts) > 3 and all(not re.match("[A-Za-z]", p) for _, p in parts[1:])
    units = [m.start() for m in re.finditer(fim.UNITS, text)]
    for draw in (0, 1, 5, len(units) - 1, len(units), len(units) + 1, 999):
        rank = draw % (len(units) + 1)
        assert fim.places(text, draw) == (len(units), [units[rank] if rank < len(units) else len(text)])


def test_shares_are_arguments(docs):
    assert {r.form for r in fim.transform(docs, plain=100).select("form").distinct().collect()} == {"plain"}
    assert "psm" not in {r.form for r in fim.transform(docs, plain=0, suffix_first=100).select("form").distinct().collect()}


def test_empty_table_and_query(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fim.transform(empty).collect() == []
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expected = [(*(p := plain(*r))[:5], sha(p[5]), sha(r[1] or "")) for r in ROWS]
    assert sorted(map(tuple, queries.op11_fim(spark, str(tmp_path)).collect()), key=str) == sorted(expected, key=str)
