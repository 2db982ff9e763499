"""Toxicity by a counterfactual-regularised linear classifier.

A document's features are its distinct words and their character 4- and 5-grams
(word ends marked), so the case and the length of a text don't matter.  Features
are chosen by their likelihood ratio with the label.  The weights minimise the
logistic loss plus a penalty on how much the score of a labelled text changes
when an identity term in it is swapped for another of its kind, so that merely
naming a group moves no score.

The model is fitted on at most ``SAMPLE`` labelled rows (those of the least
hash of ``doc_id``), with at most ``FEATURES`` features; both are arguments and bound what comes
to the driver.  Of swapped texts only the features that change come there, each
change once with its number of texts.  Every document is scored.  Only texts are inputs of a score.

Null texts count as empty; an empty text has the score of the bias alone.  A null
``doc_id`` is held out.  Of labels that repeat a ``doc_id`` the highest counts, of
documents that do, the text that sorts first is learned from.  Without labelled
rows every score is 0.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE, FEATURES = 20_000, 4_096
#: Least likelihood ratio (G squared) and least number of texts for a feature.
RATIO, SUPPORT = 20.0, 3
#: Weights of the counterfactual penalty and of the squared weights.
PENALTY, DECAY = 4.0, 1e-4
STEPS, RATE = 300, 0.1
KEPT = 500_000

# Identity terms by kind; a term is swapped for others of its kind.
IDENTITY = (
    ("women", "men", "woman", "man", "girls", "boys", "female", "male", "transgender", "nonbinary"),
    ("muslim", "muslims", "christian", "christians", "jewish", "jews", "hindu", "hindus", "buddhist", "buddhists", "atheist", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "heterosexual"),
    ("immigrant", "immigrants", "refugee", "refugees", "native", "foreigner", "foreigners"),
    ("disabled", "blind", "deaf", "autistic", "elderly", "young"),
    ("femmes", "hommes", "frauen", "männer", "mujeres", "hombres"),
)
KIND = {term: group for group in IDENTITY for term in group}

WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str) -> set[str]:
    return set(text.lower().encode("utf-8", "replace").translate(WORDS).decode("utf-8", "replace").split(" ")) - {""}


def features(word: str) -> set[str]:
    marked = f"<{word}>"
    return {word, *(marked[i : i + n] for n in (4, 5) for i in range(len(marked) - n + 1))}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


class Model:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.known = weights, bias, {}

    def score(self, text: str) -> float:
        if self.bias == -math.inf:
            return 0.0
        met: set[str] = set()
        for w in words(text):
            found = self.known.get(w)
            if found is None:
                if len(self.known) >= KEPT:
                    self.known.clear()
                found = self.known[w] = tuple(f for f in features(w) if f in self.weights)
            met.update(found)
        z = self.bias + sum(self.weights[f] for f in sorted(met))
        return 1 / (1 + math.exp(-z)) if z > -500 else 0.0


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` rows (text, toxic) to learn from."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    met = common.texts_of(docs).join(F.broadcast(chosen), "doc_id")
    return met.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def chosen_features(rows: DataFrame, toxic: int, clean: int, most: int | None = FEATURES) -> list[str]:
    """The ``most`` features (None: all) with the highest likelihood ratios, counted in Spark."""

    def counts(batches) -> Iterator[list[tuple]]:
        pos, neg = Counter(), Counter()

        def told() -> list[tuple]:
            return [(f, pos[f], neg[f]) for f in pos.keys() | neg.keys()]

        for b in batches:
            for text, y in zip(b["text"].to_pylist(), b["toxic"].to_pylist(), strict=True):
                (pos if y else neg).update(set().union(*map(features, words(text))))
            if len(pos) + len(neg) > 400_000:
                yield told()
                pos, neg = Counter(), Counter()
        yield told()

    summed = common.map_rows(rows.select("text", "toxic"), counts, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(F.col("pos") + F.col("neg") >= SUPPORT)
    n, p = float(toxic + clean), F.col("pos") + F.col("neg")
    part = lambda x, all_: F.when(x > 0, x * F.log(x * n / (p * all_))).otherwise(0.0)
    absent = lambda x, all_: F.when(all_ - x > 0, (all_ - x) * F.log((all_ - x) * n / ((n - p) * all_))).otherwise(0.0)
    ratio = 2 * (part(F.col("pos"), float(toxic)) + part(F.col("neg"), float(clean)) + absent(F.col("pos"), float(toxic)) + absent(F.col("neg"), float(clean)))
    best = summed.withColumn("ratio", ratio).where(F.col("ratio") >= RATIO).orderBy(F.desc("ratio"), "feature")
    return [r[0] for r in (best if most is None else best.limit(most)).select("feature").collect()]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int | None = FEATURES) -> Model:
    rows = common.store(labelled(docs, labels, sample), "toxicity-sample")
    toxic, clean = rows.agg(F.count_if(F.col("toxic") > 0), F.count_if(F.col("toxic") <= 0)).first()
    if not toxic or not clean:
        return Model({}, -math.inf if not toxic else 0.0)
    names = chosen_features(rows, toxic, clean, most)
    place = {f: i for i, f in enumerate(names)}

    def met(batches) -> Iterator[list[tuple]]:
        for b in batches:
            out = []
            for text, y in zip(b["text"].to_pylist(), b["toxic"].to_pylist(), strict=True):
                ws = words(text)
                of = lambda some: sorted({place[f] for w in some for f in features(w) if f in place})
                out.append((min(1, y), of(ws)))
            yield out

    def swapped(batches) -> Iterator[list[tuple]]:
        for b in batches:
            out: Counter = Counter()
            for text in b["text"].to_pylist():
                ws = words(text)
                for before, after in swaps(ws):
                    was, now = ({place[f] for w in some for f in features(w) if f in place} for some in (before, after))
                    rest = {place[f] for w in ws - before for f in features(w) if f in place} if was ^ now else set()
                    out[tuple(sorted(was - now - rest)), tuple(sorted(now - was - rest))] += 1
            yield [(list(lost), list(gained), n) for (lost, gained), n in out.items()]

    data = common.map_rows(rows.select("text", "toxic"), met, "y int, x array<int>").toPandas()
    pairs = common.map_rows(rows.select("text"), swapped, "lost array<int>, gained array<int>, n long").groupBy("lost", "gained").agg(F.sum("n").alias("n")).orderBy("lost", "gained").toPandas()
    weights, bias = descend(data["y"].to_numpy(float), data["x"].tolist(), pairs["lost"].tolist(), pairs["gained"].tolist(), pairs["n"].to_numpy(float), len(names))
    return Model(dict(zip(names, weights.tolist(), strict=True)), bias)


def swaps(ws: set[str]) -> Iterator[tuple[set[str], set[str]]]:
    """For each identity term among the words, two swaps: the term, and another of its kind; which ones, the term itself decides."""
    for term in sorted(ws & KIND.keys()):
        others = [t for t in KIND[term] if t != term]
        for k in (len(term), 2 * len(term) + 1):
            yield {term}, {others[k % len(others)]} - ws


def descend(y: np.ndarray, xs: list, before: list, after: list, times: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the whole sample; rows are added up in a fixed order.  A swap of features ``before`` for ``after`` counts ``times``."""
    share = times / times.sum() if len(times) else times
    order = sorted(range(len(y)), key=lambda i: (y[i], len(xs[i]), tuple(xs[i])))
    y, xs = y[order], [xs[i] for i in order]
    row = np.repeat(np.arange(len(xs)), [len(x) for x in xs])
    col = np.concatenate([np.asarray(x, np.int64) for x in xs]) if xs else np.zeros(0, np.int64)
    pair = np.concatenate([np.full(len(a) + len(b), i) for i, (a, b) in enumerate(zip(before, after, strict=True))]) if before else np.zeros(0, np.int64)
    place = np.concatenate([np.concatenate([a, b]) for a, b in zip(before, after, strict=True)]).astype(np.int64) if before else np.zeros(0, np.int64)
    sign = np.concatenate([np.concatenate([np.ones(len(a)), -np.ones(len(b))]) for a, b in zip(before, after, strict=True)]) if before else np.zeros(0)
    w, bias = np.zeros(width + 1), math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    w[-1] = bias
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        z = np.bincount(row, w[col], len(y)) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        grad = np.append(np.bincount(col, error[row], width) + DECAY * w[:-1], error.sum())
        if len(before):
            change = share * np.bincount(pair, sign * w[place], len(before))
            grad[:-1] += 2 * PENALTY * np.bincount(place, sign * change[pair], width)
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def report(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int | None = FEATURES) -> DataFrame:
    """One row per document: ``held_out``, ``score`` and ``predicted``."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample, most))

    def rows(batches) -> Iterator[list[tuple]]:
        for b in batches:
            scores = [sent.value.score(t) for t in b["text"].to_pylist()]
            yield [(d, s, int(s >= 0.5)) for d, s in zip(b["doc_id"].to_pylist(), scores, strict=True)]

    scored = common.map_rows(common.texts_of(docs), rows, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int | None = FEATURES) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample, most))

    def keeps(batches: Iterator[list[str]]) -> Iterator[list[bool]]:
        for texts in batches:
            yield [sent.value.score(t) < 0.5 for t in texts]

    return common.keep_rows(docs, "text", keeps)
