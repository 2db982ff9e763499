"""Manifests in number against the standard library's reader, and numbers over ranges."""

import csv
import io
import random

from pyspark.sql import functions as F

from proofmark.config import MANIFEST_COLUMNS
from proofmark.operators.ranks import numbered
from proofmark.sources import readers

R = random.Random(9)
CELLS = ["a.jpg", " Old Tom ", 'say "hi"', "1,5 L", "two\nlines", "", "Ünïcödé", "=x", "  ", "crlf\r\ninside"]


def plain(content):
    """Rows and problem, as one reads a single upload."""
    if not content.strip():
        return [], "empty_manifest"
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return [], "manifest_encoding"
    reader = csv.DictReader(io.StringIO(text, newline=""))
    headers = [h.strip().lower() for h in reader.fieldnames or []]
    if any(c not in headers for c in MANIFEST_COLUMNS):
        return [], "missing_columns"
    rows = []
    for number, row in enumerate(reader, 2):
        cells = {k.strip().lower(): (v or "").strip() for k, v in row.items() if k is not None}
        rows.append((number, *(cells[c] for c in MANIFEST_COLUMNS)))
    return rows, None if rows else "empty_manifest"


def made(i):
    if i % 97 == 0:
        return R.choice([b" \n\t\n", b"\xef\xbb\xbf", b"filename,\xff\xfe\n", b"filename,brand_name\na,b\n", ",".join(MANIFEST_COLUMNS).encode(), b"\n" + ",".join(MANIFEST_COLUMNS).encode() + b"\na,b,c,d,e\n"])
    columns = [f" {c.upper()} " if R.random() < 0.3 else c for c in MANIFEST_COLUMNS] + R.choice([[], ["notes"], [""], ["filename"]])
    if i % 3:
        R.shuffle(columns)
    out = io.StringIO(newline="")
    w = csv.writer(out, lineterminator=R.choice(["\n", "\r\n"]))
    w.writerow(columns)
    for _ in range(R.randint(0, 12)):
        w.writerow([R.choice(CELLS) for _ in range(max(0, len(columns) + R.choice([0, 0, 0, -1, -3, 2])))])
        if R.random() < 0.1:
            out.write("\n")
    return R.choice([b"", b"\xef\xbb\xbf"]) + out.getvalue().encode()


def test_a_thousand_manifests_equal_those_read_one_by_one(spark, tmp_path):
    contents = {f"m{i:04d}.csv": made(i) for i in range(1000)}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    read = readers.manifests(spark, f"file://{tmp_path}/*.csv")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan
    got = {name: ([], None) for name in contents}
    for r in read.collect():
        name = r.path.rsplit("/", 1)[1]
        if r.problem:
            got[name] = (got[name][0], r.problem)
        else:
            got[name][0].append((r.row_number, *(r[c] for c in MANIFEST_COLUMNS)))
    expected = {name: plain(content) for name, content in contents.items()}
    assert got == expected
    assert {p for _, p in expected.values()} == {None, "empty_manifest", "manifest_encoding", "missing_columns"}


def test_a_long_manifest_and_one_that_breaks_off(spark, tmp_path):
    header = ",".join(MANIFEST_COLUMNS)
    (tmp_path / "long.csv").write_text(header + "\n" + "".join(f"f{i}.jpg,b,c,d,e\n" for i in range(25_000)))
    rows, problem = readers.manifest(spark, f"file://{tmp_path}/long.csv")
    assert problem is None and rows.agg(F.count("*"), F.min("row_number"), F.max("row_number"), F.countDistinct("row_number")).first() == (25_000, 2, 25_001, 25_000)
    assert rows.where("row_number <> cast(substring_index(substring(filename, 2), '.', 1) as long) + 2").isEmpty()
    (tmp_path / "wide.csv").write_text(f"{header}\na,b,c,d,e\n{'x' * 200_000},b,c,d,e\n")
    assert readers.manifest(spark, f"file://{tmp_path}/wide.csv")[1] == "manifest_unreadable"


def test_numbers_follow_the_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v"), F.lit("x").alias("n"))
    for ranges in (1, 7):
        got = numbered(df, "place", "v", ranges=ranges).collect()
        assert sorted((r.v, r.place) for r in got) == list(zip(sorted(r.v for r in got), range(1, 5001)))
    tied = numbered(spark.range(100).select((F.col("id") % 3).alias("v")), "place", "v", ranges=5).collect()
    assert sorted(r.place for r in tied) == list(range(1, 101)) and [r.v for r in sorted(tied, key=lambda r: r.place)] == sorted(r.v for r in tied)
    assert numbered(df.limit(0), "place", "v").collect() == []


def test_uploads_are_numbered_by_path(spark, tmp_path):
    for i in R.sample(range(30), 30):
        (tmp_path / f"u{i:02d}.jpg").write_bytes(bytes([i]))
    got = readers.uploads(spark, f"file://{tmp_path}").collect()
    assert sorted((r.ordinal, r.filename, bytes(r.content), r["size"]) for r in got) == [(i + 1, f"u{i:02d}.jpg", bytes([i]), 1) for i in range(30)]
