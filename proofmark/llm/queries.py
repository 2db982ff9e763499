"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmark.functions.text import let

from . import brown, chunks, common, dac, decontaminate, fim, licenses, minhash, packing, periodic, pii, secrets, simhash, tokens, toxicity
from .common import table


def op1_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents")).drop("masked")


def op3_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.read(dac.write(table(spark, sf_dir, "documents"), tokens.path("word_bpe_49k.json"), end=2))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    held = lambda c, of: F.array_join(F.transform(c, lambda x: x[of].cast("string")), ",")
    kinds = F.array(*map(F.lit, secrets.KINDS))
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["end"])), ",")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", F.size("live").cast("long").alias("n_live"), F.size("copied").cast("long").alias("n_copied"), told("live").alias("live_spans"), told("copied").alias("copied_spans"), held("live", "n_owners").alias("live_owners"), held("copied", "n_owners").alias("copied_owners"), held("copied", "n_repositories").alias("copied_repositories"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.report(table(spark, sf_dir, "documents"))


def op6_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.passages(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokens.path("byte_bpe_50k.json"), end=0, size=2048)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Documents of which every tenth by crc32 of the id repeats a unit of its words from some place on; a null id changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        return let(F.struct(words.alias("w"), n.alias("n"), (g % n).alias("a")), lambda x: let(F.struct(x["w"].alias("w"), x["n"].alias("n"), x["a"].alias("a"), (1 + F.floor((x["n"] - x["a"]) / (3 + g % 8))).alias("p")), joined))

    def joined(x: Column) -> Column:
        rest = (x["n"] - x["a"]).cast("int")
        unit = F.slice(x["w"], (x["a"] + 1).cast("int"), x["p"].cast("int"))
        again = F.flatten(F.array_repeat(unit, F.ceil(rest / x["p"]).cast("int")))
        return F.array_join(F.concat(F.slice(x["w"], F.lit(1), x["a"].cast("int")), F.slice(again, F.lit(1), rest)), " ")

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    planted = let(words, lambda w: F.when(F.size(w) > 0, repeated(w)))
    return common.texts_of(docs).withColumn("text", F.when(h % 10 == 0, F.coalesce(planted, F.col("text"))).otherwise(F.col("text")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.find(with_planted_runs(table(spark, sf_dir, "documents"))))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    place = lambda of: of("places").cast("long")
    return found.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), place(F.array_min).alias("first_word"), place(F.array_max).alias("last_word"), F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_brown, op2_pii, op3_token_codes, op4_secrets, op5_minhash, op6_chunks, op7_packing, op8_decontamination, op9_simhash, op10_toxicity, op11_fim, op12_periodic_runs, op13_licenses)}


#: Words as the contract has them: A-Z in lower case, runs of letters, digits and non-ASCII characters.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP8 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, ws, least({decontaminate.SPAN}, len(ws)) AS k FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
w AS (SELECT DISTINCT item_id, k, array_to_string(ws[s:s + k - 1], ' ') AS t FROM b, unnest(range(1, len(ws) - k + 2)) AS u(s)),
p AS (SELECT r, s, k, array_to_string(ws[s:s + k - 1], ' ') AS t FROM d, (SELECT DISTINCT k FROM w), unnest(range(1, len(ws) - k + 2)) AS u(s)),
h AS (SELECT r, s, k, item_id FROM p JOIN w USING (k, t)),
n AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT DISTINCT r, s, k FROM h), unnest(range(s, s + k)) AS u(place) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN i USING (r)
"""


OP11 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS us, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(us) AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(us[1:a], '') AS prefix, array_to_string(us[a + 1:b], '') AS middle, array_to_string(us[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM p
"""


#: The checksum goes byte by byte: each byte's code, then eight shifts (-1).
OP12 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
    xor(list_reduce(flatten([[ascii(c), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]), lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) WHEN acc & 1 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END, CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM documents),
a AS (SELECT *, len(ws) AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
w AS (SELECT r, i, n, CASE WHEN a IS NULL OR i < a THEN ws[i + 1] ELSE ws[a + (i - a) % p + 1] END AS w FROM p, unnest(range(n)) AS u(i)),
e AS (SELECT x.r, x.n, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
s AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS stretch FROM e) GROUP BY r, q, stretch),
m AS (SELECT r, start, length, min(q) AS period FROM s WHERE length >= greatest(12, 2 * q) GROUP BY r, start, length),
x AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS told, arg_max({'start': start, 'length': length, 'period': period}, (length, -start, -period)) AS best FROM m GROUP BY r),
g AS (SELECT DISTINCT r, i FROM m, unnest(range(start + period, start + length)) AS u(i)),
k AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS kept FROM w ANTI JOIN g USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, 1000 * best.length // best.period AS exponent_milli,
    sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN x USING (r) LEFT JOIN k USING (r)
"""


def _listed(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_PHRASES = ", ".join(f"('{label}', {_listed(licenses.words_of(p))})" for p, label in licenses.PHRASES)
_TEMPLATES = ", ".join(f"('{label}', {licenses.width_of(t)}, {_listed(sorted(set(licenses.words_of(t))))}, {licenses.need_of(len(set(licenses.words_of(t))), licenses.THRESHOLD)})" for label, t in licenses.TEMPLATES)
#: Every block is compared with every template of its width, without filters.
OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
p(label, ps) AS (VALUES {_PHRASES}),
t(label, width, ts, need) AS (VALUES {_TEMPLATES}),
b AS (SELECT r, label, i FROM d, p, unnest(range(len(ws))) AS u(i) WHERE ws[i + 1] = ps[1] AND ws[i + 1:i + len(ps)] = ps),
k AS (SELECT r, width, ws[j * width + 1:(j + 2) * width] AS bs FROM d, (SELECT DISTINCT width FROM t), unnest(range(greatest(1, CAST(ceil(len(ws) / width) AS BIGINT) - 1))) AS u(j)),
m AS (SELECT r, label, CAST(len(list_intersect(ts, bs)) AS DOUBLE) / len(ts) AS score FROM k JOIN t USING (width) WHERE len(list_intersect(ts, bs)) >= need),
n AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY r),
x AS (SELECT r, max(score) AS best FROM m GROUP BY r),
l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM b UNION ALL SELECT r, label FROM m) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
    CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN n USING (r) LEFT JOIN x USING (r) LEFT JOIN l USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_decontamination": OP8, "op11_fim": OP11, "op12_periodic_runs": OP12, "op13_licenses": OP13}
