"""Secrets, told apart by corpus-wide ownership.

Patterns propose candidates.  Each candidate's value is hashed, and the hashes
are aggregated over the corpus by distinct repositories (``doc_id``) and owners
(``source``).  A value of many owners, or of many repositories of more than one
owner, is a widely copied example; any other looks live, however often its one
owner repeats it.

Three base kinds (assign, access, hex) are always reported.  The method adds
kinds with a fixed prefix (github, slack, google, jwt, pem).  A pem spans the
whole private key, header, body and end line; its value is the key without white
space, so keys are told apart, however they are wrapped.  Offsets are code
points, end exclusive.  Null texts count as empty; a null owner is one owner of
its own, and all its rows with a null ``doc_id`` are one repository; repeated rows
count once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "github", "slack", "google", "jwt", "pem")
BASE = KINDS[:3]

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MORE = (
    (3, "gh", re.compile(r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}")),
    (4, "xox", re.compile(r"(?<![A-Za-z0-9-])xox[abprs]-[A-Za-z0-9-]{10,}")),
    (5, "AIza", re.compile(r"(?<![A-Za-z0-9_-])AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])")),
    (6, "eyJ", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]*")),
    (7, "-----BEGIN", re.compile(r"""(?x: -----BEGIN\x20[A-Z]{0,16}\x20?PRIVATE\x20KEY-----
        (?: (?:(?!-----)[\s\S])*+ -----END\x20[A-Z]{0,16}\x20?PRIVATE\x20KEY-----  # whatever stands up to the end line
        | (?:(?:\s|\\[nrt]|["',])++ (?:Proc-Type|DEK-Info):[^\n\\]*+)*+  # no end line: whole words of base64 and a shorter last line
          (?:(?:(?:\s|\\[nrt]|["',])++ [A-Za-z0-9+/]{16,}+={0,2}+(?![A-Za-z0-9+/=_-]))++ (?:["']?(?:\r?\n|\\n)[\x20\t"']*+[A-Za-z0-9+/]++={0,2}+(?=["']?(?:\s*\Z|\r?\n|\\n)))?)?
        ))""")),
)
PEM = KINDS.index("pem")
WRAPPING = re.compile(r"\s+|\\[nrt]")

#: From so many distinct owners on, a value counts as a widely copied example.
MIN_OWNERS = 8
#: The same in distinct repositories, where more than one owner has it.
MIN_REPOSITORIES = 64
#: Copied values that are sent to tasks, and slots of the filter used beyond them.
MOST_COPIED, SLOTS = 1 << 18, 1 << 28


def find(text: str) -> list[tuple[int, int, int, str]]:
    """All candidates as (start, kind's place in KINDS, end, value), in that order."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    taken = common.meets([(a, b) for a, _, b, _ in found])
    for kind, sign, pattern in MORE:
        if sign in text:
            # A key holds more than a base span that it overlaps, so it stays.
            found += [(m.start(), kind, m.end(), WRAPPING.sub("", m[0]) if kind == PEM else m[0]) for m in pattern.finditer(text) if kind == PEM or not taken(m.start(), m.end())]
    return sorted(found)


def digest(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()[:32]


SCHEMA = "doc_id long, repository string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<start:int,end:int,kind:int,value:string>>"


def candidates(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """One row per document with its candidates; ``value`` is the hash of a candidate's value."""

    def rows(batches) -> Iterator[list[tuple]]:
        for b in batches:
            out = []
            for doc_id, text, where, who in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                spans = find(text)
                base = [f"{KINDS[k]}:{a}:{e}" for a, k, e, _ in spans if k < len(BASE)]
                n = [sum(k == i for _, k, _, _ in spans) for i in range(len(BASE))]
                hashed = [{"start": a, "end": e, "kind": k, "value": digest(v)} for a, k, e, v in spans]
                out.append((doc_id, where, who, *n, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e, _ in spans), hashed))
            yield out

    owned = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), docs[repository].cast("string").alias("repository"), docs[owner].cast("string").alias("owner"))
    return common.map_rows(owned, rows, SCHEMA)


def ownership(found: DataFrame) -> DataFrame:
    """Hash of each value with its numbers of distinct owners and repositories.

    ``found`` has ``repository``, ``owner`` and ``found``.  A repository is known
    by its owner and its name, so one that several rows hold counts once.  Each
    step is combined within tasks first, so a value that a third of all documents
    hold is reduced before it is shuffled by value alone.
    """
    each = found.select("owner", "repository", F.explode(F.array_distinct(F.transform("found", lambda x: x["value"]))).alias("value")).distinct()
    return each.groupBy("value", "owner").agg(F.count("*").alias("n")).groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))


def copied(counted: DataFrame, min_owners: int = MIN_OWNERS, min_repositories: int = MIN_REPOSITORIES) -> DataFrame:
    """The widely copied values: those of so many owners, or of so many repositories that more than one owner has."""
    return counted.where((F.col("n_owners") >= min_owners) | (F.col("n_owners") > 1) & (F.col("n_repositories") >= min_repositories))


def scan(docs: DataFrame, owner: str = "source", min_owners: int = MIN_OWNERS, repository: str = "doc_id", min_repositories: int = MIN_REPOSITORIES) -> DataFrame:
    """``candidates`` of each document with ``live`` and ``copied``: the spans of either verdict, ordered by start, each with its value's owners and repositories.

    The candidates are stored, not the texts, and read by the rest of the plan.
    Counts are joined back by value; both sides are plain shuffles, so a value
    with very many rows can be split.
    """
    found = common.store(candidates(docs, owner, repository).withColumn("row", F.monotonically_increasing_id()), "secret-candidates")
    counted = common.store(ownership(found), "secret-owners")
    wide = common.store(copied(counted, min_owners, min_repositories).select("value", F.lit(True).alias("is_copied")), "secret-copied")
    each = found.select("row", F.explode("found").alias("x")).select("row", "x.*")
    one = F.struct("start", "end", "kind", "n_owners", "n_repositories", F.coalesce("is_copied", F.lit(False)).alias("is_copied"))
    told = each.join(counted, "value").join(wide, "value", "left").groupBy("row").agg(F.sort_array(F.collect_list(one)).alias("told"))
    of = lambda which: F.transform(F.filter("told", which), lambda x: x.dropFields("is_copied"))
    none = F.array().cast("array<struct<start:int,end:int,kind:int,n_owners:bigint,n_repositories:bigint>>")
    joined = found.join(told, "row", "left")
    return joined.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", F.coalesce(of(lambda x: ~x["is_copied"]), none).alias("live"), F.coalesce(of(lambda x: x["is_copied"]), none).alias("copied"))


def masked(text: str, spared: Callable[[str], bool], sign: str) -> str:
    """The text with every candidate span replaced whose value's hash isn't spared; spans that overlap are replaced once."""
    out, at = [], 0
    for a, _, e, v in find(text):
        if not spared(digest(v)):
            if a >= at:
                out += [text[at:a], sign]
            at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, owner: str = "source", min_owners: int = MIN_OWNERS, sign: str = "[SECRET]", repository: str = "doc_id", min_repositories: int = MIN_REPOSITORIES, slots: int = SLOTS) -> DataFrame:
    """The documents with every live-looking span of the text replaced by ``sign``; all columns stay, ``n_chars`` is counted anew where a text changes.

    A first scan gathers the values and who holds them.  The widely copied ones
    are few; up to ``MOST_COPIED`` (32 MB) they are sent to all tasks and a second
    scan masks the rest in place, without a shuffle of texts.  If there are more,
    a filter of that size goes in their stead, and values that pass it are settled
    by a join of the texts that hold one.  Null texts stay null.
    """
    wide = common.store(copied(ownership(candidates(docs, owner, repository)), min_owners, min_repositories).select("value"), "secret-copied")
    spark, many = docs.sparkSession, wide.count() > MOST_COPIED
    if many:
        bits = np.zeros(slots // 8, np.uint8)
        for (slot,) in wide.select((F.conv(F.substring("value", 1, 7), 16, 10).cast("long") % slots).alias("slot")).distinct().toLocalIterator():
            bits[slot >> 3] |= 1 << (slot & 7)
        sent = spark.sparkContext.broadcast(bits)
    else:
        sent = spark.sparkContext.broadcast({r[0] for r in wide.collect()})
    text_at, chars_at = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def passes(v: str) -> bool:
        if many:
            slot = int(v[:7], 16) % slots
            return bool(sent.value[slot >> 3] >> (slot & 7) & 1)
        return v in sent.value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text_at).to_pylist()
            new = [t and masked(t, passes, sign) for t in texts]
            yield _changed(b, texts, new, text_at, chars_at)

    if not many:
        docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(common.BATCH_ROWS))
        return docs.mapInArrow(run, docs.schema)
    return _settled(docs, wide, passes, sign)


def _changed(b: pa.RecordBatch, texts: list, new: list, text_at: int, chars_at: int | None) -> pa.RecordBatch:
    """The batch with new texts, and their numbers of code points where they differ."""
    columns = list(b.columns)
    columns[text_at] = pa.array(new, b.schema.field(text_at).type)
    if chars_at is not None:
        columns[chars_at] = pa.array([n if t == x else len(x) for n, t, x in zip(columns[chars_at].to_pylist(), texts, new, strict=True)], b.schema.field(chars_at).type)
    return pa.RecordBatch.from_arrays(columns, schema=b.schema)


def _settled(docs: DataFrame, wide: DataFrame, passes: Callable[[str], bool], sign: str) -> DataFrame:
    """``redact`` where the copied values are too many to send: rows are numbered, and each row's candidates that pass the filter are joined with them."""
    whole = common.store(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "secret-rows")
    texts = whole.select("row", F.coalesce(F.col("doc")["text"].cast("string"), F.lit("")).alias("text"))

    def rows(batches) -> Iterator[list[tuple]]:
        for b in batches:
            yield [(row, v) for row, text in zip(b["row"].to_pylist(), b["text"].to_pylist(), strict=True) for v in {digest(v) for *_, v in find(text)} if passes(v)]

    spared = common.map_rows(texts, rows, "row long, value string").join(wide, "value").groupBy("row").agg(F.collect_set("value").alias("spared"))
    joined = whole.join(spared, "row", "left").select("doc.*", "spared")
    text_at, chars_at = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, known = b.column(text_at).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            new = [t and masked(t, frozenset(k or ()).__contains__, sign) for t, k in zip(texts, known, strict=True)]
            yield _changed(b.select(range(b.num_columns - 1)), texts, new, text_at, chars_at)

    return joined.mapInArrow(run, docs.schema)
