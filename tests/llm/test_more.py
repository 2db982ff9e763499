"""Further comparisons with plain versions: packing, added spans, ownership, masking, survivors of repeated passages, the classifier's fit."""

import math
import random
import time
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from proofmark.llm import chunks, common, packing, pii, secrets, simhash, tokens, toxicity

R = random.Random(77)
LONG_ID = 2**53 + 1
DDL = "doc_id long, text string, source string, n_chars int"


def words(n, r=R):
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n))


def test_pieces_equal_the_plain_version(spark):
    path, size = tokens.path("byte_bpe_50k.json"), 64
    rows = [(LONG_ID, words(100)), (None, words(90)), (None, None), (3, ""), (4, "same"), (4, "same"), (4, "same"), (-7, words(30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"group": F.lit(1), "row": F.lit(2), "piece": F.lit(3)})
    library = tokens.Encoder(path)
    expected = []
    for d, t in rows:
        ids = np.frombuffer(library._whole(t or ""), "<u4").tolist() + [0]
        first = len(ids) % size or size
        cuts = [0, *range(first, len(ids) + 1, size)]
        expected += [(d, i, a, e - a, zlib.crc32(np.array(ids[a:e], "<u4").tobytes())) for i, (a, e) in enumerate(zip(cuts, cuts[1:]))]
    out = packing.pack(docs, path, 0, size).collect()
    assert sorted((tuple(r)[:5] for r in out), key=str) == sorted(expected, key=str)
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for s in by.values():
        s.sort()
        assert all(a[0] + a[1] == b[0] for a, b in zip(s, s[1:])) and s[0][0] == 0 and sum(n for _, n in s) <= size


def plain_iban(part):
    bare = part.replace(" ", "")
    lengths = {c[:2]: int(c[2:]) for c in pii.COUNTRIES}
    return len(bare) == lengths.get(bare[:2]) and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def made_iban(country="GB", body=None):
    n = int(next(c[2:] for c in pii.COUNTRIES if c.startswith(country)))
    body = body or "".join(R.choice("0123456789ABCDEFXYZ") for _ in range(n - 4))
    check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
    return f"{country}{check:02d}{body}"


def spaced(s):
    return " ".join(s[i : i + 4] for i in range(0, len(s), 4))


def test_account_numbers_equal_a_plain_search():
    for _ in range(300):
        parts = []
        for _ in range(R.randint(1, 4)):
            one = made_iban(R.choice(["GB", "DE", "NO", "MT"]))
            parts += [R.choice(["or", "OR", "BIC COBADEFF", "x1", ""]), R.choice([one, spaced(one), one[:-1], one + "7", "ZZ" + one[2:]])]
        text = " ".join(parts + ["PAY"])
        found = {(m.start(), m.end()) for m in pii.ibans(text)}
        starts = [i for i in range(len(text)) if text[i].isalnum() and (i == 0 or not text[i - 1].isalnum())]
        ends = [e for e in range(1, len(text) + 1) if text[e - 1].isalnum() and (e == len(text) or not text[e].isalnum())]
        expected = {(a, e) for a in starts for e in ends if 15 <= e - a <= 45 and "  " not in text[a:e] and all(c == " " or c.isdigit() or "A" <= c <= "Z" for c in text[a:e]) and text[a : a + 4].isalnum() and text[a : a + 2].isalpha() and text[a + 2 : a + 4].isdigit() and plain_iban(text[a:e])}
        assert found == expected, text
    assert [pii.KINDS[k] for _, k, _, _ in pii.find("GB82 WEST 1234 5698 7654 32 BIC COBADEFF")] == ["iban"]
    assert not pii.find("order serial GB82 WEST 1234 5698 7654 32 sample")


def test_many_spans_take_time_in_proportion():
    line = "pay GB82 WEST 1234 5698 7654 32 mail a@b.org token = abcdef123 ghp_" + "a1B2" * 10 + "\n"
    for find in (pii.find, secrets.find):
        took = []
        for n in (2_000, 8_000):
            began = time.process_time()
            assert len(find(line * n)) >= 2 * n
            took.append(time.process_time() - began)
        assert took[1] < 8 * took[0] + 0.2


def test_meets_equals_a_plain_test():
    for _ in range(300):
        spans = [(a, a + R.randint(1, 9)) for a in (R.randint(0, 60) for _ in range(R.randint(0, 8)))]
        met = common.meets(spans)
        for _ in range(20):
            a = R.randint(0, 70)
            e = a + R.randint(1, 6)
            assert met(a, e) == any(x < e and a < y for x, y in spans)


def owned_rows():
    values = [f"token = value{i:03d}x" for i in range(30)]
    rows = [(R.choice([None, *range(90)]), " and ".join(R.sample(values, R.randint(0, 4))) or None, R.choice([None, "a", "b", "c", "d"]), 7) for _ in range(250)]
    return [*rows, *rows[:40], *((i, "token = onlyowner1", "a", 7) for i in range(100, 130)), *((i, "token = twoowners1", R.choice("ab"), 7) for i in range(130, 180))]


def test_ownership_equals_a_plain_count(spark, monkeypatch):
    rows = owned_rows()
    holders = defaultdict(set)
    for d, t, s, _ in rows:
        for *_, v in secrets.find(t or ""):
            holders[secrets.digest(v)].add((s, d))
    expected = {v: (len({s for s, _ in x}), len(x)) for v, x in holders.items()}
    docs = spark.createDataFrame(rows, DDL).withColumns({"row": F.lit(1), "owner": F.lit("x"), "value": F.lit("y"), "doc": F.lit(3)}).repartition(5)
    assert {r.value: (r.n_owners, r.n_repositories) for r in secrets.ownership(secrets.candidates(docs)).collect()} == expected
    wide = {v for v, (o, n) in expected.items() if o >= 4 or o > 1 and n >= 20}
    assert 0 < len(wide) < len(expected)
    assert secrets.digest("onlyowner1") not in wide and secrets.digest("twoowners1") in wide
    for r in secrets.scan(docs, min_owners=4, min_repositories=20).collect():
        assert all(x.n_owners < 4 and not (x.n_owners > 1 and x.n_repositories >= 20) for x in r.live) and all(x.n_owners >= 4 or x.n_repositories >= 20 for x in r.copied)

    def plain_mask(t):
        out = t or ""
        for a, _, e, v in reversed(secrets.find(out)):
            if secrets.digest(v) not in wide:
                out = f"{out[:a]}[SECRET]{out[e:]}"
        return t and out

    changed = sorted(((d, plain_mask(t), s, n if plain_mask(t) == t else len(plain_mask(t))) for d, t, s, n in rows), key=str)
    for most, slots in ((1 << 18, 1 << 28), (0, 1 << 12), (0, 8)):
        monkeypatch.setattr(secrets, "MOST_COPIED", most)
        out = secrets.redact(docs, min_owners=4, min_repositories=20, **({} if most else {"slots": slots}))
        assert out.columns == docs.columns and sorted((tuple(r)[:4] for r in out.collect()), key=str) == changed


def test_each_passage_stays_in_its_least_holder(spark):
    r = random.Random(3)
    a, b = (" ".join(r.choice("abcdefgh") * 3 + str(r.randint(0, 9999)) for _ in range(80)) for _ in range(2))
    rows = [(0, b), (1, f"{a} {b}"), (2, a), (3, f"{a} {b}"), (4, "alone " + words(30)), (None, None)]
    out = {x.doc_id: x.text for x in chunks.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0] == b and a in out[1] and b not in out[1] and out[4] == rows[4][1] and out[None] == ""
    assert all(len(out[i]) < 100 for i in (2, 3))
    # Whatever is cut from one document, its chunks are still in another.
    pool = [" ".join(r.choice("ijklmnop") * 2 + str(r.randint(0, 9999)) for _ in range(r.randint(30, 60))) for _ in range(6)]
    rows = [(i, " ".join(r.choice([*pool, words(20, r)]) for _ in range(r.randint(1, 5)))) for i in range(40)]
    out = {x.doc_id: x.text for x in chunks.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    held = " ".join(out.values())
    for _, t in rows:
        data = t.encode()
        ends = chunks.cuts(data)
        for x, y in zip([0, *ends[:-1]], ends):
            assert data[x:y].decode() in held


def test_survivors_keep_columns_of_any_name(spark):
    one, two = words(60), words(60)
    rows = [(None, one), (None, two), (None, one), (7, two), (7, words(50))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("doc", "id", "digest", "n", "kept_id", "kept_digest", "component", "print", "__digest")})
    out = simhash.clean(docs)
    assert out.columns == docs.columns and sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(None, one), (7, two), rows[4]], key=str)


def test_fit_is_at_the_least_of_the_plain_objective():
    r = np.random.default_rng(1)
    width, n = 12, 200
    xs = [sorted(r.choice(width, r.integers(1, 6), replace=False).tolist()) for _ in range(n)]
    y = np.array([float(0 in x or (1 in x and r.random() < 0.8)) for x in xs])
    before, after, times = [[1], [2, 3]], [[4], []], np.array([3.0, 1.0])

    def loss(w, bias):
        total = 0.0
        for x, t in zip(xs, y, strict=True):
            z = bias + sum(w[k] for k in x)
            total += (math.log1p(math.exp(-abs(z))) + max(z, 0) - t * z) / n
        for a, b, m in zip(before, after, times, strict=True):
            total += toxicity.PENALTY * m / times.sum() * (sum(w[k] for k in a) - sum(w[k] for k in b)) ** 2
        return total + toxicity.DECAY / 2 * float(w @ w)

    w, bias = toxicity.descend(y, xs, before, after, times, width)
    least = loss(w, bias)
    for _ in range(200):
        assert loss(w + r.normal(0, 0.05, width), bias + r.normal(0, 0.05)) > least - 1e-4


def test_identity_terms_are_words_of_texts():
    assert all(toxicity.words(t) == {t} for t in toxicity.KIND)
    assert [x for x in toxicity.swaps({"männer", "und"})][0][0] == {"männer"}


