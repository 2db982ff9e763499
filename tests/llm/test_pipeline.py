"""The pipeline's rows: what each stage keeps, masked texts, and pieces, with rows without ids or texts."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from proofmark.llm import common, tokens

R = random.Random(4)
WORDS = "river stone mill garden letter window morning harbour copper meadow quiet lantern".split()


def prose(n):
    return " ".join(R.choice(WORDS) + str(R.randint(0, 99)) for _ in range(n))


KEY = "password = hunter2secret9"
ITEM = prose(40)
BASE = [prose(80) for _ in range(60)]
ROWS = [
    *((i, t, f"s{i % 4}") for i, t in enumerate(BASE)),
    *((100 + i, " ".join([*t.split()[:40], "scumbag vermin", *t.split()[40:]]), "s1") for i, t in enumerate(prose(60) for _ in range(40))),
    (200, BASE[0], "s2"),
    (201, f"{prose(30)} {ITEM} {prose(10)}", "s2"),
    (202, f"{prose(50)} {KEY} {prose(50)}", "s3"),
    (203, None, "s0"),
    (204, "", "s0"),
    (None, prose(30), None),
    (None, BASE[1], "s1"),
    (205, prose(3000), "s1"),
    (7, prose(25), "s9"),
]
LABELS = [(i, 1, 0) for i in range(60)] + [(100 + i, 0, 1) for i in range(40)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumns({"lang": F.lit("en"), "n_chars": F.length("text"), "row": F.lit(1), "piece": F.lit("x")}).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, folder):
    docs, out = common.table(spark, folder, "documents"), {}
    for name, stage in pipeline.STAGES[:-1]:
        made = stage(spark, docs, folder)
        assert made.columns == docs.columns
        docs = out[name] = common.store(made, f"test-{name}")
    return out


def rows(df):
    return Counter((r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect())


def test_each_stage_takes_its_own(stages):
    every = Counter(ROWS)
    toxic = {r for r in ROWS if r[0] is not None and 100 <= r[0] < 140}
    kept = rows(stages["toxicity"])
    assert kept == Counter({r: n for r, n in every.items() if r not in toxic})
    # Of equal texts the least id stays, null ids last; the null and the empty text are alike.
    copies = {(200, BASE[0], "s2"), (None, BASE[1], "s1"), (204, "", "s0")}
    assert rows(stages["near_duplicates"]) == Counter({r: n for r, n in kept.items() if r not in copies})
    assert rows(stages["decontamination"]) == Counter({r: n for r, n in kept.items() if r not in copies and r[0] != 201})
    before, after = rows(stages["decontamination"]), rows(stages["secrets"])
    assert {r for r in before if r not in after} == {r for r in ROWS if r[0] == 202}
    (changed,) = (r for r in after if r not in before)
    assert changed[0] == 202 and "hunter2secret9" not in changed[1] and changed[1].split()[:50] == ROWS[-7][1].split()[:50]


def test_pieces_are_those_of_the_texts_that_are_left(spark, folder, stages):
    encode = tokens.Encoder(tokens.path("byte_bpe_50k.json"))._whole
    expected = Counter()
    for doc_id, text, _ in rows(stages["secrets"]).elements():
        ids = np.append(np.frombuffer(encode(text or ""), "<u4"), np.uint32(0))
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        expected.update((doc_id, i, a, e - a, zlib.crc32(ids[a:e].astype("<u4").tobytes())) for i, (a, e) in enumerate(zip(cuts, cuts[1:])))
    out = pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == expected
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and sum(n for _, n in s) <= 2048
    assert len(sequences) <= 1 + -(-sum(r.length for r in out) // 2048) + 1


