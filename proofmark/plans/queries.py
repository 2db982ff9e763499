"""The registered queries over the tables at hand, each with its oracle where SQL can express it.

Most run on label records made from ``part`` (see ``labels``); keys begin with
the family of operators that they exercise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmark.config import CHECKS, FIELDS, SKIP_LINE, WEAK_STANDALONE
from proofmark.functions import parse, similarity, text
from proofmark.operators import evaluate, evidence, exports, extract, images, manifest, reconcile, rules, summary
from proofmark.plans import oracle as o
from proofmark.plans.labels import labels
from proofmark.plans.registry import ORACLES, QUERIES, register
from proofmark.sources import readers

L, q = o.L, o.q
def over(name: str, sql_columns: str | None, *columns, table: str = "labels", key: str = "item_id", where: str | None = None) -> None:
    """Registers a projection of label records (or a table) and its oracle's select list."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = labels(spark, sf_dir) if table == "labels" else spark.read.parquet(f"{sf_dir}/{table}.parquet")
        made = [c() if callable(c) else c for c in columns]
        return (df.where(where) if where else df).select(key, *made)

    source = f"{L} SELECT {key}, {sql_columns} FROM l" if table == "labels" else f"SELECT {key}, {sql_columns} FROM {table}"
    register(name, f"{source}{f' WHERE {where}' if where else ''}" if sql_columns else None)(run)


c = F.col

# Text.
over("txt_01_comparison_normalize", f"{o.norm('brand_line')} AS k", lambda: text.comparison_normalize(c("brand_line")).alias("k"))
over("txt_02_warning_normalize", f"lower({o.squash('warning_line')}) AS k", lambda: text.warning_normalize(c("warning_line")).alias("k"))
over("txt_03_comparison_key", f"nullif({o.squash('lower(brand_line)')}, '') AS k", lambda: text.comparison_key(c("brand_line")).alias("k"))
over("txt_04_eval_normalize", o.squash("regexp_replace(lower(abv_line), '[^a-z0-9_\\s.%/]', ' ', 'g')") + " AS k", lambda: text.eval_normalize(c("abv_line")).alias("k"))
over("txt_05_lines", "array_to_string(list_filter(list_transform(string_split(brand_line || chr(10) || '  ' || chr(10) || net_line, chr(10)), lambda x: trim(x)), lambda x: x <> ''), '|') AS k", lambda: F.array_join(text.lines(F.concat_ws("\n", "brand_line", F.lit("  "), "net_line")), "|").alias("k"))
over("txt_06_clean_display", """trim(regexp_replace(regexp_replace(trim(brand_line), '^[^\\w"'']+', ''), '[^\\w"''.!?-]+$', '')) AS k""", lambda: text.clean_display(c("brand_line")).alias("k"))
over("txt_07_dedupe_lines", "CASE WHEN lower(brand_line) = lower(app_brand) THEN brand_line ELSE brand_line || '|' || app_brand END AS k", lambda: F.array_join(text.dedupe_lines(F.array("brand_line", "app_brand", F.lower("brand_line"))), "|").alias("k"))
over("txt_08_ordered_distinct", "CASE WHEN app_class = class_line THEN class_line ELSE class_line || '|' || app_class END AS k", lambda: F.array_join(text.ordered_distinct(F.array("class_line"), F.array("app_class", "class_line")), "|").alias("k"))
over("txt_09_safe_filename", "CASE WHEN regexp_matches(trim(filename), '^[A-Za-z0-9._ -]+$') AND NOT contains(filename, '..') THEN trim(filename) END AS a, CASE item_id % 3 WHEN 0 THEN NULL WHEN 1 THEN filename END AS b", lambda: text.safe_filename(c("filename")).alias("a"), lambda: text.safe_filename(F.when(c("item_id") % 3 == 0, F.concat(F.lit("../"), "filename")).when(c("item_id") % 3 == 1, F.concat(F.lit(" "), "filename", F.lit("\n"))).otherwise(F.concat("filename", F.lit("é")))).alias("b"))
over("txt_10_extension", "lower(regexp_extract(filename, '(\\.[^.]+)$', 1)) AS k, lower(regexp_extract(filename, '(\\.[^.]+)$', 1)) IN ('.jpg', '.jpeg', '.png', '.webp') AS ok", lambda: text.extension(c("filename")).alias("k"), lambda: text.is_image_name(c("filename")).alias("ok"))
over("txt_11_preview", "substr(text, 1, 500) AS k", lambda: text.preview(c("text")).alias("k"), table="documents", key="doc_id")
over("txt_12_truncate", "CASE WHEN length(text) <= 80 THEN text ELSE substr(text, 1, 79) || '…' END AS k", lambda: text.truncate(c("text"), 80).alias("k"), table="documents", key="doc_id")
over("txt_13_quality_note", "trim(CASE WHEN item_id % 2 = 0 THEN 'Low variance.' ELSE 'Dark' END || CASE WHEN item_id % 3 = 0 THEN ' soft' ELSE '' END) AS k", lambda: text.quality_note(F.array(F.when(c("item_id") % 2 == 0, "Low Laplacian  variance.").otherwise("Dark"), F.when(c("item_id") % 3 == 0, " soft ").otherwise(""))).alias("k"))

# The same over whole texts in four languages, some of them missing.  Spark's and the oracle's lower case agree; sharp s is the one letter of these texts that case folding spells out.
MISSING = "CASE WHEN doc_id % 7 > 0 THEN text END"
FOLDED = f"replace(lower({MISSING}), 'ß', 'ss')"


def over_documents(name: str, sql: str, made: Callable) -> None:
    over(name, f"{sql} AS k", lambda: made(F.when(c("doc_id") % 7 > 0, c("text"))).alias("k"), table="documents", key="doc_id")


over_documents("txt_01_documents", o.norm(FOLDED), text.comparison_normalize)
over_documents("txt_02_documents", f"nullif({o.squash(FOLDED)}, '')", text.warning_normalize)
over_documents("txt_03_documents", f"nullif({o.squash(f'lower({MISSING})')}, '')", text.comparison_key)
over_documents("txt_04_documents", o.squash(f"regexp_replace(lower({MISSING}), '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s.%/]', ' ', 'g')"), text.eval_normalize)
over_documents("txt_05_documents", f"array_to_string(list_filter(list_transform(string_split({MISSING}, chr(10)), lambda x: {o.strip('x')}), lambda x: x <> ''), '|')", lambda x: F.array_join(text.lines(x), "|"))
over_documents("sim_05_documents", f"len(list_filter(string_split({o.norm(FOLDED)}, ' '), lambda w: length(w) >= {similarity.TELLING}))", lambda x: F.size(F.filter(similarity.tokens(text.comparison_normalize(x)), lambda w: F.length(w) >= similarity.TELLING)).cast("long"))
over_documents("snk_03_documents", f"CASE WHEN regexp_matches({MISSING}, '^[=+@\\t\\r-]') THEN chr(39) || text ELSE coalesce({MISSING}, '') END", lambda x: exports.safe_cell(x))

# Similarity.
over("sim_04_levenshtein", "levenshtein(brand_line, app_brand) AS d", lambda: F.levenshtein("brand_line", "app_brand").cast("long").alias("d"))
over("sim_05_character_error_rate", "CASE WHEN length(app_brand) = 0 THEN 1.0 ELSE levenshtein(app_brand, brand_line) / CAST(length(app_brand) AS DOUBLE) END AS cer", lambda: similarity.character_error_rate(c("app_brand"), c("brand_line")).alias("cer"))
register("sim_01_token_sort_ratio", f"{L}, {o.token_sort('l', 'brand_line', 'app_brand')} SELECT item_id, ratio FROM l LEFT JOIN r ON r.x IS NOT DISTINCT FROM {o.norm('brand_line')} AND r.y IS NOT DISTINCT FROM {o.norm('app_brand')}")(lambda s, d: labels(s, d).select("item_id", similarity.text_similarity(c("brand_line"), c("app_brand")).alias("ratio")))
register("sim_02_token_set_ratio", f"{L}, {o.token_set('l', 'lower(class_line)', 'lower(app_class)')} SELECT item_id, ratio FROM l JOIN r ON x = lower(class_line) AND y = lower(app_class)")(lambda s, d: labels(s, d).select("item_id", similarity.token_set_ratio(F.lower("class_line"), F.lower("app_class")).alias("ratio")))
LINES = "lower(brand_line || ' ' || class_line || ' ' || abv_line)"
register("sim_03_partial_ratio", f"{L}, {o.partial('l', 'lower(app_brand)', LINES)} SELECT item_id, ratio FROM l JOIN r ON x = lower(app_brand) AND y = {LINES}")(lambda s, d: labels(s, d).select("item_id", similarity.partial_ratio(F.lower("app_brand"), F.lower(F.concat_ws(" ", "brand_line", "class_line", "abv_line"))).alias("ratio")))
over("sim_06_agree", f"{o.agree(o.norm('brand_line'), o.norm('app_brand'))} AS ok", lambda: similarity.candidates_agree(c("brand_line"), c("app_brand")).alias("ok"))
over("sim_07_prefer_cleaner", f"CASE WHEN {o.agree(o.norm('brand_line'), o.norm('app_brand'))} AND length(trim(brand_line)) > length(trim(app_brand)) THEN app_brand ELSE brand_line END AS k", lambda: similarity.prefer_cleaner(c("brand_line"), c("app_brand")).alias("k"))
over("sim_08_prefer_agreeing", f"{o.prefer_agreeing('app_brand', 'brand_line')} AS k", lambda: similarity.prefer_agreeing(c("app_brand"), c("brand_line")).alias("k"))
over("sim_09_brand_recovered", "contains(lower(brand_line), lower(app_brand)) AS hit", lambda: similarity.brand_exact(c("app_brand"), c("brand_line")).alias("hit"))
register("sim_09_brand_recovered_fuzzy", f"{L}, {o.partial('l', o.eval_norm('app_brand'), o.eval_norm('brand_line'))} SELECT item_id, ratio >= 85 AS hit FROM l JOIN r ON x = {o.eval_norm('app_brand')} AND y = {o.eval_norm('brand_line')}")(lambda s, d: labels(s, d).select("item_id", similarity.brand_recovered(c("app_brand"), c("brand_line")).alias("hit")))
over("sim_10_category_conflict", f"len({o.categories('lower(class_line)')}) > 0 AND len({o.categories('lower(app_class)')}) > 0 AND NOT list_has_any({o.categories('lower(class_line)')}, {o.categories('lower(app_class)')}) AS apart", lambda: similarity.category_conflict(F.lower("class_line"), F.lower("app_class")).alias("apart"))
over("sim_11_visible_tokens", "len(list_filter(string_split(lower(app_brand), ' '), lambda t: contains(lower(brand_line), t))) AS n", lambda: F.size(F.filter(similarity.visible_tokens(c("app_brand"), c("brand_line")), lambda x: x["seen"])).cast("long").alias("n"))

# Parsing.
over("par_01_alcohol", f"{o.abv('abv_line')} AS abv, {o.proof('abv_line')} AS proof, {o.source('abv_line')} AS source, {o.abv_span('abv_line')} AS abv_span, {o.proof_span('abv_line')} AS proof_span", *(lambda k=k: parse.alcohol(c("abv_line"))[k].alias(k) for k in ("abv", "proof", "source", "abv_span", "proof_span")))
over("par_02_alcohol_display", f"{o.abv_display('abv_line')} AS k", lambda: parse.alcohol_display(parse.alcohol(c("abv_line"))).alias("k"))
over("par_03_net", f"{o.net_value('net_line')} AS value, {o.net_unit('net_line')} AS unit, {o.net_display('net_line')} AS display", *(lambda k=k: parse.net(c("net_line"))[k].alias(k) for k in ("value", "unit", "display")))
over("par_04_net_reliable", f"{o.net_reliable('net_line')} AS ok", lambda: parse.net_reliable(c("net_line"), parse.net(c("net_line"))["span"]).alias("ok"))
over("par_05_application_abv", f"{o.app_abv('app_abv')} AS a, {o.app_abv('app_net')} AS b", lambda: parse.application_abv(c("app_abv")).alias("a"), lambda: parse.application_abv(c("app_net")).alias("b"))
over("par_06_application_net", f"{o.net_ml('app_net')} AS ml", lambda: parse.application_net_ml(c("app_net")).alias("ml"))
over("par_07_authorized_abv", f"{o.authorized('abv_line')} AS ok", lambda: parse.authorized_abv(c("abv_line")).alias("ok"))
over("par_08_within", f"abs({o.app_abv('app_abv')} - size) <= 0.05 AS abv, abs({o.net_ml('app_net')} - {o.net_ml('net_line')}) <= 0.5 AS net", lambda: parse.within(parse.application_abv(c("app_abv")), c("size").cast("double"), 0.05).alias("abv"), lambda: parse.within(parse.application_net_ml(c("app_net")), parse.application_net_ml(c("net_line")), 0.5).alias("net"))
over("par_09_heading", "CASE item_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS upper", lambda: parse.heading_is_upper(c("warning_line")).alias("upper"))
over("par_10_evidence_json", "1 AS n, CASE WHEN item_id % 3 = 0 THEN 'HIGH' ELSE 'LOW' END AS confidence, trim(brand_line) AS value", *(
    lambda k=k, a=a: (F.size(_json()).cast("int") if k is None else F.get(_json(), 0)[k]).alias(a) for k, a in ((None, "n"), ("confidence", "confidence"), ("candidate_value", "value"))
))
over("par_11_fit_edge", "CASE WHEN greatest(size * 100, 1200) <= 1600 THEN size * 100 ELSE greatest(1, CAST(floor(size * 100 * (1600.0::DOUBLE / greatest(size * 100, 1200))) AS INT)) END AS w", lambda: parse.fit_edge(c("size") * 100, F.lit(1200), 1600)["width"].alias("w"))
over("par_12_box_edges", "CAST(size AS DOUBLE) AS l, CASE WHEN item_id % 2 = 0 THEN 5.0 ELSE 1e9 END AS t, CAST(20 AS DOUBLE) AS w", *(lambda k=k, a=a: parse.box_edges(F.struct(c("size").cast("double").alias("x_min"), F.when(c("item_id") % 2 == 0, 5.0).alias("y_min"), (c("size") + 20.0).alias("x_max"), F.lit(30.0).alias("y_max")))[k].alias(a) for k, a in (("left", "l"), ("top", "t"), ("width", "w"))))
over("par_13_overlay", "CAST(size AS DOUBLE) / 2 AS l, 10.0::DOUBLE AS w", *(lambda k=k, a=a: parse.overlay(F.struct(c("size").cast("double").alias("x_min"), F.lit(0.0).alias("y_min"), (c("size") + 20.0).alias("x_max"), F.lit(30.0).alias("y_max")), F.lit(800), F.lit(600), 400.0, 300.0)[k].alias(a) for k, a in (("left", "l"), ("width", "w"))))
over("src_10_polygon_box", "CAST(size AS DOUBLE) AS x0, CAST(size + 7 AS DOUBLE) AS x1", *(lambda k=k, a=a: parse.polygon_box(F.array(*(F.array(c("size") + F.lit(float(dx)), F.lit(float(dy))) for dx, dy in ((7, 1), (0, 2), (3, 9)))))[k].alias(a) for k, a in (("x_min", "x0"), ("x_max", "x1"))))


def _json():
    answer = F.to_json(F.struct(F.array(F.struct(F.lit("brand_name").alias("field"), c("brand_line").alias("candidate_value"), F.lit(" ").alias("raw_observed_text"), F.when(c("item_id") % 3 == 0, "high").otherwise("sure").alias("confidence")), F.struct(F.lit("other").alias("field"), c("brand_line").alias("candidate_value"), F.lit("").alias("raw_observed_text"), F.lit("HIGH").alias("confidence"))).alias("fields")))
    tidy = parse.evidence_json(answer, FIELDS)
    return F.transform(tidy, lambda x: F.struct(x["field"].alias("field"), x["confidence"].alias("confidence"), F.coalesce(x["candidate_value"], F.lit("")).alias("candidate_value")))


# Extraction: records with the lines in order; words carry confidence in two of three records.
def records(spark: SparkSession, sf_dir: str, of: Callable[[SparkSession, str], DataFrame] = labels) -> DataFrame:
    line = F.concat_ws("\n", "brand_line", "class_line", "abv_line", "net_line", "warning_line")
    conf = F.when(c("item_id") % 10 == 3, 0.3).otherwise(0.9)
    box = lambda x0, y0, x1, y1: F.struct(F.lit(float(x0)).alias("x_min"), F.lit(float(y0)).alias("y_min"), F.lit(float(x1)).alias("x_max"), F.lit(float(y1)).alias("y_max"))
    words = F.transform(F.array("abv_line", "net_line"), lambda w: F.struct(F.regexp_extract(w, r"^(\S+)", 1).alias("text"), conf.alias("confidence"), box(10, 200, 90, 220).alias("bbox")))
    return of(spark, sf_dir).withColumns({"full_text": line, "words": words.cast(extract.WORDS), "image_width_px": F.lit(800), "image_height_px": F.lit(600)})


def field_query(name: str, make: Callable, sql: str | None) -> None:
    @register(name, f"{L} SELECT item_id, {sql} FROM l" if sql else None)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return records(spark, sf_dir).select("item_id", make().alias("f")).select("item_id", "f.status", "f.raw_text", "f.normalized_value", "f.normalized_numeric")


LOW = "(item_id % 10 = 3)"
field_query("ext_01_alcohol", lambda: extract.alcohol(c("full_text"), c("words")), (
    f"CASE WHEN {o.source('a')} IS NULL THEN 'NOT_FOUND' WHEN {LOW} THEN 'UNCERTAIN' ELSE 'FOUND' END AS status, CASE {o.source('a')} WHEN 'both' THEN a WHEN 'abv' THEN {o.abv_span('a')} WHEN 'proof' THEN {o.proof_span('a')} END AS raw_text, "
    f"{o.abv_display('a')} AS normalized_value, {o.abv('a')} AS normalized_numeric"
))
# The strongest line: the alcohol line, unless it has less than the net contents line's proof.
ORACLES["ext_01_alcohol"] = ORACLES["ext_01_alcohol"].replace(f"{L} SELECT item_id,", f"{L}, m AS (SELECT *, CASE WHEN {o.source('abv_line')} IS NULL AND {o.source('net_line')} IS NOT NULL THEN net_line ELSE abv_line END AS a FROM l) SELECT item_id,").replace("FROM l", "FROM m").replace("AS a FROM m)", "AS a FROM l)").replace(f"WHEN {LOW}", f"WHEN {LOW} AND (a = abv_line OR a = net_line AND false)")
field_query("ext_02_net", lambda: extract.net(c("full_text"), c("words")), (
    f"CASE WHEN {o.net_value('net_line')} IS NULL THEN 'NOT_FOUND' WHEN NOT {o.net_reliable('net_line')} OR {LOW} THEN 'UNCERTAIN' ELSE 'FOUND' END AS status, CASE WHEN {o.net_value('net_line')} IS NOT NULL THEN net_line END AS raw_text, "
    f"{o.net_display('net_line')} AS normalized_value, {o.net_value('net_line')} AS normalized_numeric"
))
field_query("ext_03_class_type", lambda: extract.class_type(F.concat_ws("\n", F.lit("A NAME"), "class_line")), (
    f"CASE WHEN {o.class_hits('class_line')} > 0 THEN 'FOUND' WHEN {o.keyword_hits('class_line')} > 0 THEN 'UNCERTAIN' ELSE 'NOT_FOUND' END AS status, CASE WHEN {o.class_hits('class_line')} + {o.keyword_hits('class_line')} > 0 THEN class_line END AS raw_text, "
    f"CASE WHEN {o.class_hits('class_line')} + {o.keyword_hits('class_line')} > 0 THEN class_line END AS normalized_value, CAST(NULL AS DOUBLE) AS normalized_numeric"
))
field_query("ext_04_warning", lambda: extract.warning(F.concat_ws("\n", "net_line", "warning_line")), (
    f"CASE WHEN item_id % 4 = 3 THEN 'NOT_FOUND' WHEN {o.cues('warning_line')} >= 2 AND length(warning_line) > 80 THEN 'FOUND' ELSE 'UNCERTAIN' END AS status, CASE WHEN item_id % 4 <> 3 THEN warning_line END AS raw_text, "
    "CASE WHEN item_id % 4 <> 3 THEN 'GOVERNMENT WARNING' END AS normalized_value, CAST(NULL AS DOUBLE) AS normalized_numeric"
))


def brand_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two brand words and a descriptor in boxes whose size and place follow from the key."""
    n = c("item_id")
    word = lambda t, x, y, w, h, conf: F.struct(F.lit(t).alias("text"), conf.alias("confidence"), F.struct(x.cast("double").alias("x_min"), F.lit(float(y)).alias("y_min"), (x + w).cast("double").alias("x_max"), (F.lit(y) + h).cast("double").alias("y_max")).alias("bbox"))
    height, gap = n % 40 + 20, n % 90
    words = F.array(word("RIVER", n % 50, 20, 120, height, F.when(n % 7 == 0, 0.28).otherwise(0.9)), word("BEND", n % 50 + 120 + gap, 20, 110, height, F.lit(0.9)), word("DISTILLERY", F.lit(100), 300, 180, F.lit(30), F.lit(0.9)))
    return labels(spark, sf_dir).select("item_id", F.lit("RIVER BEND\nDISTILLERY").alias("full_text"), words.cast(extract.WORDS).alias("words"), F.lit(800).alias("image_width_px"), F.lit(600).alias("image_height_px"))


@register("ext_06_brand_scores", f"{L} SELECT item_id, (2.0 * (item_id % 40 + 20) + 40.0 * (1 - 20 / 600.0) + CASE WHEN item_id % 90 < 1.8 * (item_id % 40 + 20) THEN 10 ELSE 0 END + 8 + 5)::DOUBLE AS score, (60.0 + 40.0 * (1 - 300 / 600.0) + 5 - 28)::DOUBLE AS other FROM l")
def _(spark, sf_dir):
    scored = extract.brand_scores(c("full_text"), c("words"), c("image_height_px"))
    by = lambda name: F.get(F.filter("s", lambda x: x["line"] == name), 0)["score"]
    return brand_words(spark, sf_dir).select("item_id", scored.alias("s")).select("item_id", F.round(by("RIVER BEND"), 9).alias("score"), F.round(by("DISTILLERY"), 9).alias("other"))


ORACLES["ext_06_brand_scores"] = ORACLES["ext_06_brand_scores"].replace("SELECT item_id, (", "SELECT item_id, round((").replace("+ 8 + 5)::DOUBLE", "+ 8 + 5)::DOUBLE, 9)").replace("(60.0 +", "round((60.0 +").replace("- 28)::DOUBLE", "- 28)::DOUBLE, 9)")


@register("ext_07_brand_ambiguity", f"{L}, s AS (SELECT item_id, item_id % 60 + 40.0::DOUBLE AS one, size * 2 + 33.0::DOUBLE AS two FROM l) SELECT item_id, least(one, two) >= 0.88::DOUBLE * greatest(one, two) AS near_tie, (least(one, two) >= 0.72::DOUBLE * greatest(one, two))::INT AS suffix FROM s")
def _(spark, sf_dir):
    part = lambda line, at, score: F.struct(F.lit(line).alias("line"), F.lit(at).alias("at"), score.cast("double").alias("score"))
    one, two = part("OAK HILL", 0, c("item_id") % 60 + 40), part("PINE HILL", 1, c("size") * 2 + 33)
    scored = F.when(one["score"] >= two["score"], F.array(one, two)).otherwise(F.array(two, one))
    return labels(spark, sf_dir).select("item_id", extract.brand_conflicts(scored).alias("x")).select("item_id", "x.near_tie", F.size("x.suffix").alias("suffix"))


@register("ext_08_brand_issues", f"{L} SELECT item_id, CASE WHEN item_id % 7 = 0 THEN concat_ws(',', CASE WHEN size % 3 <> 2 THEN 'low_confidence_leading_word' END, CASE WHEN size % 3 = 0 OR item_id % 50 <= 16 THEN 'clipped_leading_edge' END) ELSE '' END AS issues FROM l")
def _(spark, sf_dir):
    # The first word's confidence is so low that it must be clipped, low, or only doubtful at the edge.
    unsure = F.when(c("size") % 3 == 0, 0.28).when(c("size") % 3 == 1, 0.45).otherwise(0.52)
    first = lambda w: F.when((w["text"] == "RIVER") & (c("item_id") % 7 == 0), w.withField("confidence", unsure)).otherwise(w)
    marked = brand_words(spark, sf_dir).join(labels(spark, sf_dir).select("item_id", "size"), "item_id").withColumn("words", F.transform("words", first))
    return marked.select("item_id", F.array_join(extract.brand_issues(c("full_text"), c("words"), c("image_width_px"), F.lit("RIVER BEND")), ",").alias("issues"))


@register("ext_09_words_of_line", f"{L} SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'RIVER BEND' WHEN 1 THEN 'BEND' WHEN 2 THEN '' ELSE 'RIVER DISTILLERY' END AS seen FROM l")
def _(spark, sf_dir):
    line = F.when(c("item_id") % 4 == 0, '"River" (bend)').when(c("item_id") % 4 == 1, "bend, bending").when(c("item_id") % 4 == 2, "rivers").otherwise("the DISTILLERY - river!")
    return brand_words(spark, sf_dir).select("item_id", F.array_join(F.transform(extract.words_of_line(c("words"), line), lambda w: w["text"]), " ").alias("seen"))


@register("ext_10_mean_confidence", f"{L} SELECT item_id, round((CASE WHEN item_id % 7 = 0 THEN 0.28 ELSE 0.9 END + 1.8) / 3, 9)::DOUBLE AS m FROM l")
def _(spark, sf_dir):
    return brand_words(spark, sf_dir).select("item_id", F.round(extract.mean_confidence(c("words")), 9).alias("m"))


BRAND_PARTS = "2.0::DOUBLE * (item_id % 40 + 20) AS size, (1 - 20 / 600::DOUBLE) * 40 AS position, CASE WHEN item_id % 90 < 1.8::DOUBLE * (item_id % 40 + 20) THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END AS continuity, 8.0::DOUBLE AS multi_word, 5.0::DOUBLE AS all_caps, 0.0::DOUBLE AS weak"
OTHER_PARTS = "60.0::DOUBLE AS size, 20.0::DOUBLE AS position, 0.0::DOUBLE AS continuity, 0.0::DOUBLE AS multi_word, 5.0::DOUBLE AS all_caps, -28.0::DOUBLE AS weak"
PARTS = f"SELECT item_id, 'RIVER BEND' AS line, 0 AS at, {BRAND_PARTS} FROM l UNION ALL SELECT item_id, 'DISTILLERY', 1, {OTHER_PARTS} FROM l"


@register("ext_12_brand_diagnostics", f"{L} SELECT *, size + position + continuity + multi_word + all_caps + weak AS score, 0.0::DOUBLE AS artifact FROM ({PARTS})")
def _(spark, sf_dir):
    return brand_words(spark, sf_dir).select("item_id", F.explode(extract.brand_scores(c("full_text"), c("words"), c("image_height_px"))).alias("x")).select("item_id", "x.*")


@register("joi_11_adjacent_fragment", f"{L} SELECT item_id, item_id % 60 <= 48 AS orphan FROM l")
def _(spark, sf_dir):
    gap = c("item_id") % 60
    word = lambda t, x, w: F.struct(F.lit(t).alias("text"), F.lit(0.9).alias("confidence"), F.struct(x.cast("double").alias("x_min"), F.lit(20.0).alias("y_min"), (x + w).cast("double").alias("x_max"), F.lit(60.0).alias("y_max")).alias("bbox"))
    words = F.array(word("M", F.lit(5), 15), word("APLE", gap + 20, 90), word("CREEK", gap + 120, 110)).cast(extract.WORDS)
    return labels(spark, sf_dir).select("item_id", extract.orphan_left(words, F.lit("APLE CREEK")).alias("orphan"))


over("fil_brand_line_filters", f"regexp_matches(abv_line, {q(SKIP_LINE)}, 'i') AS skip, regexp_matches(trim(brand_line), {q(WEAK_STANDALONE)}, 'i') AS weak", lambda: c("abv_line").rlike(f"(?i){SKIP_LINE}").alias("skip"), lambda: extract.is_weak(c("brand_line")).alias("weak"))


# Rules.
def found(value=None, number=None, unit=None, raw=None, status="FOUND", reason=None, source=None):
    text_ = lambda x: F.lit(None) if x is None else x
    return extract.field(status if not isinstance(status, str) else F.lit(status), text_(raw if raw is not None else value), text_(value), number, text_(unit), reason=reason, source=source)


def rule_query(name: str, make: Callable, sql: str | None, extra: str = "") -> None:
    @register(name, f"{L}{extra} SELECT item_id, {sql}" if sql else None)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return with_fields(labels(spark, sf_dir)).select("item_id", make().alias("r")).select("item_id", "r.status", "r.reason_code")


def with_fields(df: DataFrame) -> DataFrame:
    """Parsed statements and fields as columns of their own; exploding a single value keeps them from being worked out anew for each use."""
    a, n = c("p.a"), c("p.n")
    parsed = df.withColumn("p", F.explode(F.array(F.struct(parse.alcohol(c("abv_line")).alias("a"), parse.net(c("net_line")).alias("n"), extract.warning(c("warning_line")).alias("w")))))
    abv = F.when(a.isNotNull(), found(parse.alcohol_display(a), a["abv"], F.lit("%"), c("abv_line"), source=a["source"])).otherwise(found(status="NOT_FOUND"))
    net = F.when(n.isNotNull(), found(n["display"], n["value"], n["unit"], c("net_line"))).otherwise(found(status="NOT_FOUND"))
    made = F.struct(abv.alias("abv"), net.alias("net"), c("p.w").alias("warning"))
    return parsed.withColumn("f", F.explode(F.array(made))).drop("p")


MASK = "quality IN ('WARNING', 'POOR')"
MASKED = f"CASE WHEN {MASK} THEN 'OCR_LOW_QUALITY' ELSE 'EXTRACTION_NOT_FOUND' END"
rule_query("rul_01_gate", lambda: rules.gate(found(c("brand_line"), status=F.when(c("item_id") % 2 == 0, "UNCERTAIN").otherwise("NOT_FOUND"), reason=F.when(c("item_id") % 5 == 0, "brand_ambiguous")), c("quality")), f"'REVIEW' AS status, CASE WHEN item_id % 2 = 0 THEN CASE WHEN item_id % 5 = 0 THEN 'BRAND_AMBIGUOUS' WHEN {MASK} THEN 'OCR_LOW_QUALITY' ELSE 'EXTRACTION_UNCERTAIN' END WHEN {MASK} THEN 'OCR_LOW_QUALITY' ELSE 'EXTRACTION_NOT_FOUND' END AS reason_code FROM l")
PAIRED = f" FROM l LEFT JOIN r ON r.x IS NOT DISTINCT FROM {o.norm('app_brand')} AND r.y IS NOT DISTINCT FROM {o.norm('brand_line')}"
rule_query("rul_02_brand", lambda: rules.brand(c("app_brand"), found(c("brand_line")), c("quality")), f"CASE WHEN ratio >= 95 THEN 'PASS' WHEN ratio >= 85 THEN 'REVIEW' ELSE 'FAIL' END AS status, CASE WHEN ratio >= 95 THEN 'BRAND_MATCH' WHEN ratio >= 85 THEN 'BRAND_AMBIGUOUS' ELSE 'BRAND_MISMATCH' END AS reason_code{PAIRED}", f", {o.token_sort('l', 'app_brand', 'brand_line')}")
APART = f"len({o.categories('lower(class_line)')}) > 0 AND len({o.categories('lower(app_class)')}) > 0 AND NOT list_has_any({o.categories('lower(class_line)')}, {o.categories('lower(app_class)')}) AND ratio < 70"
rule_query("rul_03_class_type", lambda: rules.class_type(c("app_class"), found(c("class_line")), c("quality")), f"CASE WHEN ratio >= 97 THEN 'PASS' WHEN {APART} THEN 'FAIL' ELSE 'REVIEW' END AS status, CASE WHEN ratio >= 97 THEN 'CLASS_TYPE_MATCH' WHEN {APART} THEN 'CLASS_TYPE_MISMATCH' ELSE 'CLASS_TYPE_AMBIGUOUS' END AS reason_code FROM l LEFT JOIN r ON r.x = {o.norm('app_class')} AND r.y = {o.norm('class_line')}", f", {o.token_sort('l', 'app_class', 'class_line')}")


ABV_OK = o.authorized("abv_line")
ABV_CASE = lambda a, b, x, d, e: f"CASE WHEN {o.source('abv_line')} IS NULL THEN {a} WHEN {o.app_abv('app_abv')} IS NULL THEN {b} WHEN NOT {ABV_OK} THEN {x} WHEN abs({o.app_abv('app_abv')} - {o.abv('abv_line')}) <= 0.05 THEN {d} ELSE {e} END"
rule_query("rul_04_alcohol", lambda: rules.alcohol(c("app_abv"), c("f.abv"), c("quality")), f"{ABV_CASE(*map(q, ('REVIEW', 'REVIEW', 'REVIEW', 'PASS', 'FAIL')))} AS status, {ABV_CASE(MASKED, *map(q, ('APPLICATION_VALUE_INVALID', 'PROOF_ONLY_NO_PERCENT_STATEMENT', 'ABV_MATCH', 'ABV_MISMATCH')))} AS reason_code FROM l")


NET_CASE = lambda a, b, d, e: f"CASE WHEN {o.net_value('net_line')} IS NULL THEN {a} WHEN {o.net_ml('app_net')} IS NULL THEN {b} WHEN abs({o.net_ml('app_net')} - {o.net_ml('net_line')}) <= 0.5 THEN {d} ELSE {e} END"
rule_query("rul_05_net", lambda: rules.net(c("app_net"), c("f.net"), c("quality")), f"{NET_CASE(*map(q, ('REVIEW', 'REVIEW', 'PASS', 'FAIL')))} AS status, {NET_CASE(MASKED, *map(q, ('APPLICATION_VALUE_INVALID', 'NET_CONTENTS_MATCH', 'NET_CONTENTS_MISMATCH')))} AS reason_code FROM l")
WARNED = lambda a, b, d, e, f, g: f"CASE WHEN NOT contains(lower(warning_line), 'government warning') THEN {a} WHEN {o.cues('warning_line')} < 2 OR length(warning_line) <= 80 THEN {b} WHEN ratio < 75 THEN {d} WHEN ratio < 92 THEN {e} WHEN contains(warning_line, 'GOVERNMENT WARNING') THEN {f} ELSE {g} END"
LOWER_WARNING = f"lower({o.squash('warning_line')})"
rule_query("rul_06_warning", lambda: rules.warning(F.lit(None), c("f.warning"), c("quality")), f"{WARNED(*map(q, ('REVIEW', 'REVIEW', 'FAIL', 'REVIEW', 'PASS', 'REVIEW')))} AS status, {WARNED(MASKED.replace('EXTRACTION_NOT_FOUND', 'WARNING_MISSING'), *map(q, ('WARNING_PARTIAL', 'WARNING_WORDING_MISMATCH', 'WARNING_PARTIAL', 'WARNING_WORDING_MATCH', 'WARNING_CAPS_REVIEW')))} AS reason_code FROM l JOIN r ON y = {LOWER_WARNING}", f", {o.token_set('l', f'lower({o.squash(o.STATUTE)})', LOWER_WARNING)}")
rule_query("rul_06_warning_gates", lambda: rules.warning(F.lit(None), F.when(c("item_id") % 4 == 0, found(c("warning_line"))).when(c("item_id") % 4 == 3, found(status="NOT_FOUND")).otherwise(found(c("warning_line"), status="UNCERTAIN")), c("quality")), f"CASE WHEN item_id % 4 = 0 THEN 'PASS' ELSE 'REVIEW' END AS status, CASE item_id % 4 WHEN 0 THEN 'WARNING_WORDING_MATCH' WHEN 3 THEN CASE WHEN {MASK} THEN 'OCR_LOW_QUALITY' ELSE 'WARNING_MISSING' END ELSE 'WARNING_PARTIAL' END AS reason_code FROM l")
rule_query("rul_07_label_only", lambda: rules.present("alcohol_content")(F.lit(None), c("f.abv"), F.lit("GOOD")), f"CASE WHEN {ABV_OK} THEN 'PASS' ELSE 'REVIEW' END AS status, CASE WHEN {o.source('abv_line')} IS NULL THEN 'EXTRACTION_NOT_FOUND' WHEN {ABV_OK} THEN 'ABV_MATCH' ELSE 'PROOF_ONLY_NO_PERCENT_STATEMENT' END AS reason_code FROM l")


over("rul_09_mode", "CASE WHEN item_id % 2 = 0 THEN 'COMPARISON' ELSE 'LABEL_ONLY' END AS m", lambda: rules.mode(F.when(c("item_id") % 2 == 0, c("app_brand")).isNotNull()).alias("m"))
over("rul_10_citations", "CASE item_id % 2 WHEN 0 THEN '27 CFR § 16.21;27 CFR § 16.22' ELSE '27 CFR § 5.63;27 CFR § 5.65' END AS k", lambda: F.array_join(rules.citations(F.when(c("item_id") % 2 == 0, "government_warning").otherwise("alcohol_content")), ";").alias("k"))
register("rul_11_stub", f"{L} SELECT item_id, unnest({o.array(CHECKS)}) AS check_name, 'REVIEW' AS status, 'PIPELINE_STUB' AS reason_code FROM l")(lambda s, d: rules.stub(labels(s, d).select("item_id")))
over("rul_12_detected", "CASE WHEN item_id % 2 = 0 THEN brand_line ELSE app_brand END AS k", lambda: rules.detected(found(F.when(c("item_id") % 2 == 0, "").otherwise(c("app_brand")), raw=c("brand_line"))).alias("k"))
over("rul_14_evidence_method", "CASE WHEN item_id % 4 = 0 THEN 'ocr_plus_ai' WHEN item_id % 3 = 0 AND item_id % 2 = 0 THEN 'ocr_plus_enhanced_plus_brand_region' WHEN item_id % 3 = 0 THEN 'ocr_plus_brand_region' WHEN item_id % 2 = 0 THEN 'ocr_plus_enhanced' ELSE 'ocr_only' END AS k", lambda: rules.evidence_method(c("item_id") % 2 == 0, c("item_id") % 3 == 0, F.when(c("item_id") % 4 == 0, "filled")).alias("k"))


# Joins with images: the manifest is made from documents, the uploads from labels with some names shifted.
def batch_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name = F.concat(F.lit("label-"), F.when(c("doc_id") % 41 == 40, c("doc_id") - 1).otherwise(c("doc_id")), F.when(c("doc_id") % 29 == 0, "/x.jpg").otherwise(".jpg"))
    rows_ = docs.select((c("doc_id") + 2).alias("row_number"), name.alias("filename"), F.lit("A brand").alias("brand_name"), F.when(c("doc_id") % 31 == 0, " ").otherwise("Vodka").alias("class_type"), F.lit("40%").alias("alcohol_content"), F.lit("750 mL").alias("net_contents"))
    up = spark.read.parquet(f"{sf_dir}/labels.parquet")
    named = F.concat(F.lit("label-"), F.when(c("doc_id") % 17 == 0, c("doc_id") + 10_000_000).when(c("doc_id") % 13 == 0, F.floor(c("doc_id") / 26) * 26).otherwise(c("doc_id")), F.when(c("doc_id") % 37 == 0, ".gif").otherwise(".jpg"))
    return rows_, up.select(named.alias("filename"), c("doc_id").alias("ordinal"))


BATCH = """WITH m AS (SELECT doc_id + 2 AS row_number, 'label-' || CASE WHEN doc_id % 41 = 40 THEN doc_id - 1 ELSE doc_id END || CASE WHEN doc_id % 29 = 0 THEN '/x.jpg' ELSE '.jpg' END AS filename, doc_id % 31 = 0 AS bad FROM documents),
u AS (SELECT 'label-' || CASE WHEN doc_id % 17 = 0 THEN doc_id + 10000000 WHEN doc_id % 13 = 0 THEN (doc_id // 26) * 26 ELSE doc_id END || CASE WHEN doc_id % 37 = 0 THEN '.gif' ELSE '.jpg' END AS filename, doc_id AS ordinal FROM labels),
inv AS (SELECT filename AS safe, count(*) AS n, min(ordinal) AS ordinal FROM u WHERE filename LIKE '%.jpg' GROUP BY 1),
x AS (SELECT m.*, CASE WHEN filename LIKE '%/%' THEN NULL ELSE filename END AS safe FROM m),
y AS (SELECT x.*, inv.n AS uploads, row_number() OVER (PARTITION BY x.safe ORDER BY row_number) AS k FROM x LEFT JOIN inv ON inv.safe = x.safe),
z AS (SELECT *, CASE WHEN safe IS NULL THEN 'invalid_filename' WHEN k > 1 THEN 'duplicate_filename' WHEN bad THEN 'invalid_application_values' WHEN uploads IS NULL OR uploads > 1 THEN 'missing_image' END AS code FROM y),
ex AS (SELECT safe FROM inv WHERE n = 1 AND safe NOT IN (SELECT safe FROM z WHERE code IS NULL)),
iss AS (SELECT 1 AS phase, ordinal, 'unsupported_image' AS code, filename, CAST(NULL AS BIGINT) AS row_number FROM u WHERE filename NOT LIKE '%.jpg' UNION ALL SELECT 2, ordinal, 'duplicate_image', safe, NULL FROM inv WHERE n > 1
 UNION ALL SELECT 3, row_number, code, filename, row_number FROM z WHERE code IS NOT NULL UNION ALL SELECT 4, 0, 'unreferenced_image', safe, NULL FROM ex)
"""


def batch_query(name: str, make: Callable, sql: str) -> None:
    register(name, BATCH + sql)(lambda s, d: make(*batch_inputs(s, d)))


batch_query("joi_01_matched", lambda m, u: manifest.matched(m, u).select("row_number", "safe"), "SELECT row_number, safe FROM z WHERE code IS NULL")
batch_query("joi_02_missing", lambda m, u: manifest.missing(m, u).select("row_number", "safe"), "SELECT row_number, safe FROM y WHERE safe IS NOT NULL AND uploads IS NULL")
batch_query("joi_03_ambiguous", lambda m, u: manifest.ambiguous(m, u).select("row_number", "safe"), "SELECT row_number, safe FROM y WHERE uploads > 1")
batch_query("joi_04_unreferenced", manifest.unreferenced, "SELECT safe FROM ex")
batch_query("agg_12_duplicates", lambda m, u: manifest.rows(m, u).where("code = 'duplicate_filename'").select("row_number", "safe"), "SELECT row_number, safe FROM z WHERE code = 'duplicate_filename'")
batch_query("set_02_issues", manifest.issues, "SELECT phase, ordinal, code, filename, row_number FROM iss")
batch_query("src_02_validation", manifest.validate, "SELECT false AS valid, count(*) AS row_count, CASE WHEN count(*) <= 300 THEN (SELECT count(*) FROM u) ELSE 0 END AS image_count, CASE WHEN count(*) <= 300 THEN count(*) FILTER (code IS NULL) ELSE 0 END AS matched_count, CASE WHEN count(*) <= 300 THEN count(*) FILTER (code NOT IN ('invalid_filename', 'duplicate_filename')) ELSE 0 END AS missing_count, CASE WHEN count(*) <= 300 THEN (SELECT count(*) FROM ex) ELSE 0 END AS unreferenced_count FROM z")
register("src_03_sample", "SELECT * FROM (VALUES ('old-tom-001.jpg', 'OLD TOM DISTILLERY', 'Kentucky Straight Bourbon Whiskey', '45%', '750 mL'), ('stones-throw-002.jpg', 'Stone''s Throw', 'Straight Bourbon Whiskey', '40%', '750 mL'), ('demo-review-003.jpg', 'North Peak Distilling', 'Bourbon Whiskey', '45%', '750 mL')) t(filename, brand_name, class_type, alcohol_content, net_contents)")(lambda s, d: manifest.sample(s))
batch_query("src_04_latest_upload", lambda m, u: manifest.latest_content(u.withColumn("content", F.col("ordinal").cast("string"))), "SELECT filename AS safe, CAST(max(ordinal) AS VARCHAR) AS content FROM u GROUP BY 1")
over("src_06_application", "brand_line AS brand, item_id % 2 = 0 AS ok", lambda: F.coalesce(readers.applications(_application())["brand_name"], c("brand_line")).alias("brand"), lambda: readers.applications(_application()).isNotNull().alias("ok"))
over("src_13_has_text", "item_id % 2 = 0 AS ok, item_id % 3 = 0 AS boxes", lambda: readers.has_text(F.when(c("item_id") % 2 == 0, c("brand_line")).otherwise(" \t")).alias("ok"), lambda: readers.has_boxes(F.when(c("item_id") % 3 == 0, F.array(F.struct(F.struct(F.lit(1.0).alias("x_min")).alias("bbox"))))).alias("boxes"))
over("set_01_tokens", "len(list_intersect(string_split(lower(app_class), ' '), string_split(lower(class_line), ' '))) AS n", lambda: F.size(similarity.shared_tokens(c("app_class"), c("class_line"))).cast("long").alias("n"))


def _application():
    good = F.to_json(F.struct(c("brand_line").alias("brand_name"), c("app_class").alias("class_type")))
    return F.when(c("item_id") % 2 == 0, good).otherwise(F.concat(F.lit("{\"brand_name\": "), F.lit("oops")))


# Filters and images.
over("fil_05_image_gate", "CASE WHEN size = 1 THEN 'empty_file' WHEN size > 49 THEN 'file_too_large' WHEN size % 5 = 0 THEN 'pdf_not_supported' WHEN size % 7 = 0 THEN 'corrupt_image' WHEN size * 20 < 100 THEN 'image_too_small' END AS code", lambda: images.gate(F.when(c("size") == 1, 0).otherwise(c("size") * 320_000), F.when(c("size") % 5 == 0, "PDF").otherwise("JPEG"), F.when(c("size") % 7 != 0, "jpeg"), c("size") * 20, F.lit(500)).alias("code"))
over("fil_06_evidence_problem", f"CASE WHEN item_id % 13 = 0 THEN 'unable_to_determine' WHEN item_id % 5 = 0 THEN 'low_confidence' WHEN {o.source('abv_line')} IS NULL OR {o.source('abv_line')} = 'proof' THEN 'abv_unparseable' END AS code", lambda: evidence.problem(F.lit("alcohol_content"), c("abv_line"), F.lit(None).cast("string"), F.when(c("item_id") % 5 == 0, "LOW").otherwise("HIGH"), c("item_id") % 13 == 0).alias("code"))
over("fil_07_application", "length(app_brand) <= 200 AND item_id % 3 <> 0 AS ok", lambda: manifest.application_ok({"brand_name": c("app_brand"), "class_type": F.when(c("item_id") % 3 == 0, "  ").otherwise("x"), "alcohol_content": c("app_abv"), "net_contents": c("app_net")}).alias("ok"))
over("src_07_sniff", "CASE item_id % 5 WHEN 0 THEN 'JPEG' WHEN 1 THEN 'PNG' WHEN 2 THEN 'WEBP' WHEN 3 THEN 'PDF' ELSE 'UNKNOWN' END AS k, CASE item_id % 5 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'webp' END AS accepted", lambda: images.sniff(_bytes()).alias("k"), lambda: images.accepted(images.sniff(_bytes())).alias("accepted"))
over("img_05_deskew", "CASE WHEN size * 10 < 200 THEN 'skip_few_edges' WHEN abs(item_id % 30 - 15) < 0.5 THEN 'skip_straight' WHEN abs(item_id % 30 - 15) > 12 THEN 'skip_implausible' ELSE 'rotate' END AS k", lambda: images.deskew(c("size") * 10, c("item_id") % 30 - 15).alias("k"))


def _bytes():
    head = F.when(c("item_id") % 5 == 0, "FFD8FFE0").when(c("item_id") % 5 == 1, "89504E470D0A1A0A").when(c("item_id") % 5 == 2, "524946460000000057454250").when(c("item_id") % 5 == 3, "25504446").otherwise("00")
    return F.unhex(F.rpad(head, 40, "0"))


@register("img_01_quality", "SELECT event_id, CASE WHEN value < 40 OR value > 235 THEN 'POOR' WHEN value < 100 OR value > 210 THEN 'WARNING' ELSE 'GOOD' END AS status, CASE WHEN value < 100 THEN 'blur' ELSE '' END || CASE WHEN value < 100 AND (value < 45 OR value > 210) THEN ',' ELSE '' END || CASE WHEN value < 45 OR value > 210 THEN 'brightness' ELSE '' END AS warnings FROM events")
def _(spark, sf_dir):
    v = c("value")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", images.quality(F.lit(900), v, v, F.lit(40.0), F.lit(0.0), F.lit(0.01)).alias("x")).select("event_id", "x.status", F.array_join("x.warnings", ",").alias("warnings"))


GRAY = "(SELECT item_id, rpad(brand_line, 64, 'x') AS t FROM l)"
AT = lambda y, x: f"ascii(substr(t, 8 * (7 - abs(7 - abs({y}))) + (7 - abs(7 - abs({x}))) + 1, 1))"  # noqa: E731  the edge mirrored, the outermost row not repeated
PIXELS = f"p AS (SELECT item_id, {AT('y', 'x')}::DOUBLE AS g, ({AT('y - 1', 'x')} + {AT('y + 1', 'x')} + {AT('y', 'x - 1')} + {AT('y', 'x + 1')} - 4 * {AT('y', 'x')})::DOUBLE AS v FROM {GRAY}, unnest(range(0, 8)) AS a(y), unnest(range(0, 8)) AS b(x))"


@register("img_02_measure", f"{L}, {PIXELS} SELECT item_id, round_even(var_pop(v), 3) AS laplacian_variance, round_even(avg(g), 3) AS mean_brightness, round_even(stddev_pop(g), 3) AS contrast_std, round_even(avg((g <= 5)::INT), 4) AS near_black_fraction, round_even(avg((g >= 250)::INT), 4) AS near_white_fraction FROM p GROUP BY 1")
def _(spark, sf_dir):
    from proofmark.sources.providers import measured

    gray = F.encode(F.substring(F.rpad("brand_line", 64, "x"), 1, 64), "US-ASCII")
    return measured(labels(spark, sf_dir).select("item_id", F.lit(8).alias("width"), F.lit(8).alias("height"), gray.alias("gray")))


@register("ord_04_tallest_region", f"{L} SELECT item_id, CASE WHEN item_id % 40 + 20 >= 30 THEN 'BEND' ELSE 'DISTILLERY' END AS first, greatest(item_id % 50 + 120 + item_id % 90 + 110, 280) + 12.0::DOUBLE AS x_max FROM l")
def _(spark, sf_dir):
    top = images.tallest(c("words"), 4)
    box = images.padded(images.union_box(F.transform(top, lambda w: w["bbox"])), 12.0, F.lit(800), F.lit(600), 20.0, 12.0)
    return brand_words(spark, sf_dir).select("item_id", F.get(top, 0)["text"].alias("first"), box["x_max"].alias("x_max"))


@register("ord_05_union_crop", f"{L} SELECT item_id, CASE WHEN item_id % 9 > 0 THEN least(800.0, 124.0 + size) END::DOUBLE AS x_max FROM l")
def _(spark, sf_dir):
    box = lambda x: F.struct(F.lit(50.0).alias("x_min"), F.lit(50.0).alias("y_min"), x.cast("double").alias("x_max"), F.lit(90.0).alias("y_max"))
    boxes = F.array(box(F.lit(100)), F.when(c("item_id") % 9 > 0, box(c("size") + 100)))
    whole = F.when(F.forall(boxes, lambda b: b.isNotNull()), images.padded(images.union_box(boxes), 24.0, F.lit(800), F.lit(600), 40.0, 40.0))
    return labels(spark, sf_dir).select("item_id", whole["x_max"].alias("x_max"))


over("ord_06_region", "CASE WHEN item_id % 3 = 0 THEN 330.0 WHEN item_id % 3 = 1 THEN 77.0 ELSE 270.0 END::DOUBLE AS y_max", lambda: images.region(F.when(c("item_id") % 3 == 0, "UNCERTAIN").otherwise("FOUND"), F.when(c("item_id") % 3 == 1, F.struct(F.lit(0.0).alias("x_min"), F.lit(0.0).alias("y_min"), F.lit(9.0).alias("x_max"), F.lit(77.0).alias("y_max"))), F.lit(800), F.lit(600))["y_max"].alias("y_max"))
over("ord_07_caps", "array_to_string([brand_line, class_line, abv_line, net_line, app_brand][1:least(5, size % 8)], '|') AS k", lambda: F.array_join(extract.capped(F.slice(F.array("brand_line", "class_line", "abv_line", "net_line", "app_brand", "app_class", "app_net"), 1, c("size") % 8)), "|").alias("k"))


@register("ord_08_continuity", f"{L} SELECT item_id, CASE item_id % 5 WHEN 0 THEN false ELSE item_id % 90 < 1.8::DOUBLE * (item_id % 40 + 20) END AS close FROM l")
def _(spark, sf_dir):
    boxes = F.transform(F.slice("words", 1, F.when(c("item_id") % 5 == 0, 1).otherwise(2)), lambda w: parse.box_edges(w["bbox"]))
    return brand_words(spark, sf_dir).select("item_id", extract.continuous(boxes, c("item_id") % 40 + 20).alias("close"))


@register("ord_09_reading_order", "SELECT l_orderkey, array_to_string(list_slice(list(CAST(l_linenumber AS VARCHAR) ORDER BY l_quantity, l_linenumber), 1, 12), ' ') AS preview FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    x, y = c("l_linenumber").cast("double"), c("l_quantity").cast("double")
    word = F.struct(c("l_linenumber").cast("string").alias("text"), F.lit(0.9).alias("confidence"), F.struct(x.alias("x_min"), y.alias("y_min"), x.alias("x_max"), y.alias("y_max")).alias("bbox"))
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.collect_list(word).alias("words")).select("l_orderkey", extract.preview_of_words(c("words")).alias("preview"))


# Aggregates over checks and batch items made from orders and events.
STATUS = "CASE o_orderkey % 5 WHEN 0 THEN 'FAIL' WHEN 1 THEN 'REVIEW' WHEN 2 THEN 'REVIEW' ELSE 'PASS' END"
STATE = "CASE o_orderkey % 11 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'QUEUED' WHEN 2 THEN 'PROCESSING' ELSE 'COMPLETED' END"
ITEMS = f"SELECT o_orderkey AS item_id, o_orderpriority AS batch_id, 'label-' || o_orderkey || '.jpg' AS filename, 'Brand ' || o_custkey AS brand_name, {STATE} AS processing_state, CASE WHEN {STATE} = 'COMPLETED' THEN {STATUS} END AS overall_status, o_orderkey % 3 = 0 AS ai_assisted, o_totalprice AS processing_time_ms FROM orders"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("orders")
    return spark.sql(ITEMS)


def _synthetic_checks(spark, sf_dir):
    n = c("l_linenumber")
    status = F.when((c("l_orderkey") + n) % 9 == 0, "FAIL").when((c("l_orderkey") + n) % 4 == 0, "REVIEW").otherwise("PASS")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(c("l_orderkey").alias("item_id"), n.alias("field_at"), status.alias("status"), F.concat(F.lit("R"), n).alias("reason_code"))


SYN = "WITH k AS (SELECT l_orderkey AS item_id, l_linenumber AS field_at, CASE WHEN (l_orderkey + l_linenumber) % 9 = 0 THEN 'FAIL' WHEN (l_orderkey + l_linenumber) % 4 = 0 THEN 'REVIEW' ELSE 'PASS' END AS status, 'R' || l_linenumber AS reason_code FROM lineitem)"
register("agg_01_overall", f"{SYN} SELECT item_id, CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'REVIEW') THEN 'REVIEW' ELSE 'PASS' END AS overall_status FROM k GROUP BY 1")(lambda s, d: summary.items(_synthetic_checks(s, d), "item_id").select("item_id", "overall_status"))
register("agg_04_counts", f"{SYN} SELECT item_id, count(*) FILTER (status = 'PASS') AS pass_count, count(*) FILTER (status = 'REVIEW') AS review_count, count(*) FILTER (status = 'FAIL') AS fail_count FROM k GROUP BY 1")(lambda s, d: summary.items(_synthetic_checks(s, d), "item_id").select("item_id", "pass_count", "review_count", "fail_count"))
register("agg_13_reason_codes", f"{SYN} SELECT item_id, coalesce(string_agg(reason_code, ';' ORDER BY field_at, reason_code) FILTER (status = 'REVIEW'), '') AS review_reason_codes FROM k GROUP BY 1")(lambda s, d: summary.items(_synthetic_checks(s, d), "item_id").select("item_id", "review_reason_codes"))
register("agg_15_histogram", f"{SYN} SELECT reason_code, status, count(*) AS n FROM k GROUP BY 1, 2")(lambda s, d: summary.histogram(_synthetic_checks(s, d), "reason_code", "status"))
COUNT = lambda test, name: f"count(*) FILTER ({test}) AS {name}"
DONE = "processing_state = 'COMPLETED'"
register("agg_02_batch_summary", f"WITH i AS ({ITEMS}) SELECT batch_id, count(*) AS total, {', '.join(COUNT(f'processing_state = {q(s)}', s.lower()) for s in ('QUEUED', 'PROCESSING', 'ERROR', 'COMPLETED'))}, {', '.join(COUNT(f'{DONE} AND overall_status = {q(s)}', f'{s.lower()}_count') for s in ('PASS', 'REVIEW', 'FAIL'))}, {COUNT(f'{DONE} AND ai_assisted', 'ai_assisted')}, {COUNT('ai_assisted', 'ai_assisted_all')} FROM i GROUP BY 1")(lambda s, d: summary.batch(items(s, d), "batch_id"))
register("agg_03_median", "SELECT event_type, quantile_cont(value, 0.5) AS m FROM events GROUP BY 1")(lambda s, d: s.read.parquet(f"{d}/events.parquet").groupBy("event_type").agg(summary.median("value").alias("m")))
register("agg_03_nearest_rank", "SELECT event_type, list_sort(list(value))[CAST(round_even(0.95 * (count(value) - 1), 0) AS BIGINT) + 1] AS p FROM events WHERE value IS NOT NULL GROUP BY 1")(lambda s, d: summary.nearest_rank(s.read.parquet(f"{d}/events.parquet"), "value", 0.95, "event_type"))
over("agg_14_worst_quality", "CASE greatest(item_id % 3, size % 3) WHEN 2 THEN 'POOR' WHEN 1 THEN 'WARNING' ELSE 'GOOD' END AS k", lambda: images.worst_quality(F.array(*(F.when(x % 3 == 2, "POOR").when(x % 3 == 1, "WARNING").otherwise("GOOD") for x in (c("item_id"), c("size"))))).alias("k"))
register("fil_01_filters", f"WITH i AS ({ITEMS}) SELECT item_id, 'attention' AS choice FROM i WHERE processing_state = 'ERROR' OR overall_status IN ('REVIEW', 'FAIL') UNION ALL SELECT item_id, 'PASS' FROM i WHERE overall_status = 'PASS' UNION ALL SELECT item_id, 'ERROR' FROM i WHERE processing_state = 'ERROR'")(lambda s, d: items(s, d).select("item_id", F.explode(F.array_compact(F.array(*(F.when(summary.matches(k, c("processing_state"), c("overall_status")), k) for k in ("attention", "PASS", "ERROR"))))).alias("choice")))
register("fil_02_search", f"WITH i AS ({ITEMS}) SELECT item_id FROM i WHERE contains(lower(filename), '77') OR contains(lower(brand_name), '77')")(lambda s, d: items(s, d).where(summary.search(" 77 ", c("filename"), c("brand_name"))).select("item_id"))
register("fil_03_lookup", f"WITH i AS ({ITEMS}) SELECT item_id, processing_state FROM i WHERE batch_id = '1-URGENT' AND processing_state = 'ERROR'")(lambda s, d: summary.lookup(items(s, d), batch_id="1-URGENT", processing_state="ERROR").select("item_id", "processing_state"))
register("ord_01_attention", f"WITH i AS ({ITEMS}) SELECT item_id, row_number() OVER (PARTITION BY batch_id ORDER BY CASE WHEN processing_state = 'ERROR' THEN 0 WHEN overall_status = 'FAIL' THEN 1 WHEN overall_status = 'REVIEW' THEN 2 ELSE 3 END, filename) AS n FROM i")(lambda s, d: reconcile.ordered(items(s, d).withColumn("rank", summary.attention(c("processing_state"), c("overall_status"))), ["batch_id"], ["rank", "filename"]).select("item_id", F.col("n").cast("long").alias("n")))


# Recognition trials, made from events.
TRIALS = """SELECT event_id AS fixture_id, 'engine' || (event_id % 2) AS provider, CASE WHEN event_id % 3 = 0 THEN 'enhanced' ELSE 'fast' END AS profile, CASE event_id % 5 WHEN 0 THEN 2200 WHEN 1 THEN 1200 ELSE 1600 END AS edge,
 event_id % 7 <> 0 AS success, CASE event_id % 21 WHEN 0 THEN 'engine_error' WHEN 7 THEN 'timeout' END AS failure_kind, event_id % 6 AS fields_recovered, CASE WHEN event_id % 7 <> 0 THEN (event_id % 10) / 8.0 END AS cer, value AS total_ms, event_id % 4 = 0 AS has_boxes FROM events"""


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("events")
    return spark.sql(TRIALS).withColumn("cer", c("cer").cast("double"))


RATES = "count(*) AS n, avg(fields_recovered) AS mean_fields, coalesce(avg(cer), 1.0) AS mean_cer, quantile_cont(total_ms, 0.5) AS median_ms, quantile_cont(total_ms, 0.95) AS p95_ms, avg(has_boxes::INT) AS box_rate, avg(success::INT) AS success_rate"
T = f"WITH t AS ({TRIALS}), b AS (SELECT provider, profile, edge, {RATES} FROM t GROUP BY 1, 2, 3)"
register("agg_05_leaderboard", f"{T} SELECT * FROM b")(lambda s, d: evaluate.leaderboard(trials(s, d), "provider", "profile", "edge"))
register("agg_06_recovery_rate", f"{T} SELECT provider, avg((fields_recovered > 2)::INT) AS brand_name, avg((fields_recovered = 4)::INT) AS net_contents FROM t GROUP BY 1")(lambda s, d: evaluate.recovery_rates(trials(s, d).withColumn("field_recovery", F.create_map(F.lit("brand_name"), c("fields_recovered") > 2, F.lit("net_contents"), F.when(c("fields_recovered") == 4, True))), ["brand_name", "net_contents"], "provider"))
register("agg_07_marginals", f"{T} SELECT profile, edge, count(*) AS n, avg(fields_recovered) AS mean_fields, avg(cer) AS mean_cer FROM t GROUP BY GROUPING SETS ((profile), (edge))")(lambda s, d: evaluate.marginals(trials(s, d)))
register("agg_08_failures", f"{T} SELECT coalesce(failure_kind, 'unknown') AS failure_kind, count(*) AS n FROM t WHERE NOT success GROUP BY 1")(lambda s, d: evaluate.failures(trials(s, d)))
register("agg_09_successful", f"{T} SELECT provider, count(*) AS n, avg(success::INT) AS success_rate, avg(fields_recovered) FILTER (success) AS mean_fields, quantile_cont(total_ms, 0.5) FILTER (success) AS median_ms, quantile_cont(total_ms, 0.95) FILTER (success) AS p95_ms, max(total_ms) FILTER (success) AS max_ms FROM t GROUP BY 1")(lambda s, d: evaluate.successful(trials(s, d), "provider"))
BEST = "ORDER BY mean_fields DESC, median_ms, mean_cer, provider, profile, edge LIMIT 1"
register("ord_02_top", f"{T} SELECT provider, profile, edge FROM b {BEST}")(lambda s, d: evaluate.order(evaluate.leaderboard(trials(s, d), "provider", "profile", "edge")).limit(1).select("provider", "profile", "edge"))
register("ord_03_best_within", f"{T} SELECT provider, profile, edge FROM b WHERE median_ms <= 2000 AND mean_fields >= 2.5 {BEST}")(lambda s, d: evaluate.best_within(evaluate.leaderboard(trials(s, d), "provider", "profile", "edge"), 2000, 2.5).select("provider", "profile", "edge"))


@register("joi_09_matrix", "SELECT item_id, p AS provider, f AS profile, e AS edge FROM benchmark, (VALUES ('a'), ('b')) x(p), (VALUES ('fast'), ('enhanced')) y(f), (VALUES (1200), (1600), (2200)) z(e)")
def _(spark, sf_dir):
    axis = lambda name, kind, values: spark.createDataFrame([(v,) for v in values], f"{name} {kind}")
    return evaluate.matrix(spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id"), axis("provider", "string", "ab"), axis("profile", "string", ["fast", "enhanced"]), axis("edge", "int", [1200, 1600, 2200]))


RECOVERED = f"{L}, {o.partial('l', o.eval_norm('app_abv'), o.eval_norm('abv_line'))} SELECT item_id, coalesce(abs({o.app_abv('abv_line')} - {o.app_abv('app_abv')}) < 1e-6, false) OR ratio >= 80 AS hit FROM l JOIN r ON x = {o.eval_norm('app_abv')} AND y = {o.eval_norm('abv_line')}"
register("joi_10_field_recovery", RECOVERED)(lambda s, d: labels(s, d).select("item_id", evaluate.recovered(F.lit("alcohol_content"), c("app_abv"), parse.application_abv(c("app_abv")).cast("string"), c("abv_line")).alias("hit")))


# Reconciliation: two passes of the same records, the second read from perturbed lines.
def two_passes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = labels(spark, sf_dir)

    def long(brand, abv_text, status):
        a = parse.alcohol(abv_text)
        rows_ = F.array(
            F.struct(F.lit("brand_name").alias("field_name"), found(brand, status=status).alias("f")),
            F.struct(F.lit("alcohol_content").alias("field_name"), F.when(a.isNotNull(), found(parse.alcohol_display(a), a["abv"], F.lit("%"), abv_text)).otherwise(found(status="NOT_FOUND")).alias("f")),
        )
        return base.select("item_id", F.explode(rows_).alias("x")).select("item_id", "x.field_name", "x.f.*")

    state = F.when(c("item_id") % 6 == 5, "UNCERTAIN").otherwise("FOUND")
    return long(c("app_brand"), c("abv_line"), state), long(c("brand_line"), F.when(c("item_id") % 3 == 0, F.concat((c("size") + 1).cast("string"), F.lit("% ABV"))).otherwise(c("abv_line")), F.lit("FOUND"))


@register("rec_01_retry", f"{L} SELECT item_id, array_to_string(list_filter([CASE WHEN item_id % 4 = 3 THEN 'government_warning_not_found' END, CASE WHEN size % 4 >= 2 THEN 'critical_fields_not_found=' || (size % 4) END, CASE WHEN size % 3 >= 2 AND size % 4 >= 1 AND quality IN ('WARNING', 'POOR') THEN 'uncertain_fields_with_quality_issue_and_missing_field' END, CASE WHEN length(trim(brand_line)) < 20 THEN 'ocr_text_unusually_sparse' END], lambda x: x IS NOT NULL), ',') AS reasons FROM l")
def _(spark, sf_dir):
    return labels(spark, sf_dir).select("item_id", F.array_join(reconcile.retry_reasons(c("size") % 4, c("size") % 3, F.when(c("item_id") % 4 == 3, "NOT_FOUND").otherwise("FOUND"), c("quality"), c("brand_line"), F.lit(9)), ",").alias("reasons"))


PASSES = "WITH p AS (SELECT l_orderkey AS item_id, CASE WHEN l_linenumber % 2 = 1 THEN 'fast' ELSE 'enhanced' END AS profile, CASE l_partkey % 3 WHEN 0 THEN 'FOUND' WHEN 1 THEN 'UNCERTAIN' ELSE 'NOT_FOUND' END AS status FROM lineitem), s AS (SELECT item_id, profile, CAST(sum(CASE status WHEN 'FOUND' THEN 2 WHEN 'UNCERTAIN' THEN 1 ELSE 0 END) AS BIGINT) AS score, count(*) FILTER (status = 'FOUND') AS n_found, count(*) FILTER (status = 'UNCERTAIN') AS n_uncertain, count(*) FILTER (status = 'NOT_FOUND') AS n_not_found FROM p GROUP BY 1, 2)"


def _passes(spark, sf_dir):
    status = F.when(c("l_partkey") % 3 == 0, "FOUND").when(c("l_partkey") % 3 == 1, "UNCERTAIN").otherwise("NOT_FOUND")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(c("l_orderkey").alias("item_id"), F.when(c("l_linenumber") % 2 == 1, "fast").otherwise("enhanced").alias("profile"), status.alias("status"))


register("agg_10_pass_counts", f"{PASSES} SELECT item_id, profile, n_found, n_uncertain, n_not_found FROM s")(lambda s, d: reconcile.pass_scores(_passes(s, d), "item_id", "profile").drop("score"))
register("agg_11_pass_score", f"{PASSES} SELECT item_id, profile, score FROM s")(lambda s, d: reconcile.pass_scores(_passes(s, d), "item_id", "profile").select("item_id", "profile", "score"))
register("rec_02_select_pass", f"{PASSES} SELECT item_id, arg_max(profile, score * 1000000 - n_not_found * 10 + (profile = 'fast')::INT) AS selected_profile, max(score) FILTER (profile = 'fast') AS fast_score, max(score) FILTER (profile = 'enhanced') AS enhanced_score FROM s GROUP BY 1")(lambda s, d: reconcile.select_pass(reconcile.pass_scores(_passes(s, d), "item_id", "profile")))
CHANGED = f"(item_id % 3 = 0 AND {o.source('abv_line')} IS NOT NULL AND abs({o.abv('abv_line')} - (size + 1)) > 1e-6)"


@register("rec_03_merge_passes", f"{L} SELECT item_id, 'alcohol_content' AS field_name, CASE WHEN {o.source('abv_line')} IS NULL THEN 'NOT_FOUND' WHEN {CHANGED} THEN 'UNCERTAIN' ELSE 'FOUND' END AS status, CASE WHEN {CHANGED} THEN 'conflict' ELSE 'kept' END AS outcome FROM l")
def _(spark, sf_dir):
    return reconcile.merge_passes(*two_passes(spark, sf_dir)).where("field_name = 'alcohol_content'").select("item_id", "field_name", "status", "outcome")


BOTH = "item_id % 6 <> 5"
KEYS_AGREE = o.agree(o.norm("app_brand"), o.norm("brand_line"))
BETTER = o.prefer_agreeing("app_brand", "brand_line")
OUTCOME = f"CASE WHEN NOT ({BOTH}) THEN 'kept' WHEN {KEYS_AGREE} THEN CASE WHEN {BETTER} <> app_brand THEN 'cleaned' ELSE 'kept' END WHEN lower(trim(app_brand)) <> lower(trim(brand_line)) THEN 'conflict' ELSE 'kept' END"


@register("joi_07_merge_brands", f"{L}, m AS (SELECT *, {OUTCOME} AS outcome FROM l) SELECT item_id, CASE WHEN outcome = 'conflict' OR NOT ({BOTH}) THEN 'UNCERTAIN' ELSE 'FOUND' END AS status, CASE WHEN outcome = 'cleaned' THEN {BETTER} ELSE app_brand END AS normalized_value, outcome FROM m")
def _(spark, sf_dir):
    return reconcile.merge_passes(*two_passes(spark, sf_dir)).where("field_name = 'brand_name'").select("item_id", "status", "normalized_value", "outcome")


over("rec_04_escalation", "CASE item_id % 3 WHEN 0 THEN 'brand_not_found' WHEN 1 THEN 'uncertain:edge,integrity:edge' ELSE CASE WHEN item_id % 2 = 0 THEN 'left_inset' ELSE '' END END AS k", lambda: F.array_join(reconcile.escalation_reasons(F.when(c("item_id") % 3 == 0, "NOT_FOUND").when(c("item_id") % 3 == 1, "UNCERTAIN").otherwise("FOUND"), F.lit("edge"), F.when(c("item_id") % 3 == 1, F.array(F.lit("edge"))), F.lit(False), F.when(c("item_id") % 2 == 0, 0.2).otherwise(0.0), F.lit(False)), ",").alias("k"))
SB, SC = "CASE item_id % 3 WHEN 0 THEN 'FOUND' WHEN 1 THEN 'UNCERTAIN' ELSE 'NOT_FOUND' END", "CASE size % 3 WHEN 0 THEN 'FOUND' WHEN 1 THEN 'UNCERTAIN' ELSE 'NOT_FOUND' END"
SAME = f"{o.norm('app_brand')} IS NOT DISTINCT FROM {o.norm('brand_line')}"
over("rec_05_reconcile_brand", f"""CASE WHEN {SC} = 'NOT_FOUND' THEN 'no_text' WHEN {SB} = 'FOUND' AND {SC} = 'UNCERTAIN' THEN CASE WHEN item_id % 2 = 0 THEN 'conflict_uncertain' ELSE 'uncertain_kept_base' END
 WHEN {SB} <> 'FOUND' AND {SC} = 'FOUND' THEN 'replaced_weaker_base' WHEN {SB} <> 'FOUND' AND {SAME} THEN 'reinforced_uncertain' WHEN {SB} <> 'FOUND' THEN 'conflict_uncertain' WHEN {SAME} THEN 'reinforced'
 WHEN item_id % 2 = 0 AND length(brand_line) >= length(app_brand) THEN 'superseded_weaker' ELSE 'conflict_uncertain' END AS outcome""", lambda: reconcile.reconcile_brand(
    F.struct(F.when(c("item_id") % 3 == 0, "FOUND").when(c("item_id") % 3 == 1, "UNCERTAIN").otherwise("NOT_FOUND").alias("status"), c("app_brand").alias("value")),
    F.struct(F.when(c("size") % 3 == 0, "FOUND").when(c("size") % 3 == 1, "UNCERTAIN").otherwise("NOT_FOUND").alias("status"), c("brand_line").alias("value")), c("item_id") % 2 == 0, F.lit(0))["outcome"].alias("outcome"))


STATE_OF = lambda n: f"CASE item_id % {n} WHEN 0 THEN 'NOT_FOUND' WHEN 1 THEN 'UNCERTAIN' ELSE 'FOUND' END"
KEY_A, KEY_B = o.norm("value"), o.norm("brand_line")
TWO_WORDS = "len(string_split(trim(regexp_replace(brand_line, '\\s+', ' ', 'g')), ' ')) >= 2"


def _step(table: str, n: int, name: str) -> str:
    """One look at a brand that isn't found: its status, value and outcome."""
    weak = f"CASE WHEN cs = 'NOT_FOUND' THEN [status, value, 'no_text'] WHEN status = 'UNCERTAIN' AND cs = 'FOUND' AND NOT ({TWO_WORDS}) THEN ['UNCERTAIN', brand_line, 'partial_uncertain'] WHEN cs = 'FOUND' THEN ['FOUND', brand_line, 'replaced_weaker_base'] WHEN {KEY_A} IS NOT DISTINCT FROM {KEY_B} THEN [status, value, 'reinforced_uncertain'] ELSE ['UNCERTAIN', value, 'conflict_uncertain'] END"
    return f"SELECT item_id, brand_line, r[1] AS status, r[2] AS value, '{name}' || r[3] AS outcome FROM (SELECT *, {weak} AS r FROM (SELECT *, {STATE_OF(n)} AS cs FROM {table}))"


ESCALATED = f"{L}, b AS (SELECT item_id, brand_line, {STATE_OF(3)} AS status, app_brand AS value FROM l), f AS ({_step('(SELECT * FROM b WHERE item_id % 3 < 2)', 4, 'region_')}), w AS ({_step('(SELECT item_id, brand_line, status, value FROM f WHERE status <> {})'.format(q('FOUND')), 5, 'whole_')})"


@register("rec_06_escalate", f"{ESCALATED} SELECT item_id, status, value, 'skipped' AS outcome FROM b WHERE item_id % 3 = 2 UNION ALL SELECT item_id, status, value, outcome FROM f WHERE status = 'FOUND' UNION ALL SELECT item_id, status, value, outcome FROM w")
def _(spark, sf_dir):
    base = labels(spark, sf_dir)
    state = lambda n: F.when(c("item_id") % n == 0, "NOT_FOUND").when(c("item_id") % n == 1, "UNCERTAIN").otherwise("FOUND")
    b = base.select("item_id", state(3).alias("status"), c("app_brand").alias("value"), F.when(c("item_id") % 3 < 2, F.array(F.lit("why"))).otherwise(F.array().cast("array<string>")).alias("reasons"), F.lit(True).alias("suspicious"))
    other = lambda n: base.select("item_id", state(n).alias("status"), c("brand_line").alias("value"), F.lit(0).alias("issues"))
    return reconcile.escalate(b, other(4), other(5))


def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    confidence = F.when(c("item_id") % 3 == 0, "HIGH").when(c("item_id") % 3 == 1, "MEDIUM").otherwise("LOW")
    said = F.when(c("item_id") % 5 == 0, F.concat((c("size") + 3).cast("string"), F.lit("% Alc./Vol."))).otherwise(F.concat(c("size").cast("string"), F.lit("% Alc./Vol.")))
    return labels(spark, sf_dir).where("item_id % 4 <> 1").select("item_id", F.lit("alcohol_content").alias("field_name"), said.alias("candidate_value"), F.lit(None).cast("string").alias("raw_observed_text"), confidence.alias("confidence"), (c("item_id") % 17 == 0).alias("unable_to_determine"))


SAID = "CASE WHEN item_id % 5 = 0 THEN size + 3 ELSE size END"
NEAR_ABV = f"CASE WHEN {o.source('abv_line')} = 'proof' THEN abs({SAID} - {o.abv('abv_line')}) <= 0.6 ELSE abs({SAID} - {o.abv('abv_line')}) <= 0.5 END"
MERGED = f"CASE WHEN item_id % 4 = 1 THEN NULL WHEN item_id % 17 = 0 THEN 'rejected:unable_to_determine' WHEN item_id % 3 = 2 THEN 'rejected:low_confidence' WHEN {o.source('abv_line')} IS NULL THEN 'filled' WHEN {NEAR_ABV} THEN 'supplemented' WHEN abs({SAID} - {o.abv('abv_line')}) > 0.5 THEN 'conflict' ELSE 'kept_ocr' END"


@register("rec_07_merge_evidence", f"{L}, m AS (SELECT *, {MERGED} AS outcome FROM l) SELECT item_id, outcome, CASE outcome WHEN 'conflict' THEN 'UNCERTAIN' WHEN 'supplemented' THEN 'FOUND' WHEN 'filled' THEN CASE WHEN item_id % 3 = 0 THEN 'FOUND' ELSE 'UNCERTAIN' END ELSE CASE WHEN {o.source('abv_line')} IS NULL THEN 'NOT_FOUND' ELSE 'FOUND' END END AS status, CASE WHEN outcome IN ('supplemented', 'filled') THEN CAST({SAID} AS DOUBLE) ELSE {o.abv('abv_line')} END AS normalized_numeric FROM m")
def _(spark, sf_dir):
    fields_ = two_passes(spark, sf_dir)[0].where("field_name = 'alcohol_content'")
    return evidence.merge(fields_, evidence_rows(spark, sf_dir)).select("item_id", "outcome", "status", "normalized_numeric")


over("rec_09_reinforcing", f"coalesce({NEAR_ABV}, false) AS ok", lambda: reconcile.reinforcing(F.lit("alcohol_content"), c("abv_line"), F.lit(None).cast("string"), F.concat(F.when(c("item_id") % 5 == 0, c("size") + 3).otherwise(c("size")).cast("string"), F.lit("% Alc./Vol."))).alias("ok"))
over("fil_04_eligible", "CASE item_id % 5 WHEN 0 THEN 'WARNING_MISSING' WHEN 1 THEN NULL WHEN 2 THEN 'BRAND_AMBIGUOUS' WHEN 3 THEN 'EXTRACTION_UNCERTAIN' END AS k", lambda: reconcile.eligible_reason(F.when(c("item_id") % 5 == 4, "PASS").otherwise("REVIEW"), F.when(c("item_id") % 5 == 1, "WARNING_CAPS_REVIEW").when(c("item_id") % 5 == 2, "BRAND_AMBIGUOUS").otherwise("OCR_LOW_QUALITY"), F.lit(None).cast("string"), F.lit(CHECKS[4]), F.when(c("item_id") % 5 == 3, "UNCERTAIN").otherwise("NOT_FOUND")).alias("k"))


register("rec_11_budget", "SELECT o_orderkey AS item_id, row_number() OVER (ORDER BY o_orderkey) <= 25 AS granted FROM orders")(lambda s, d: reconcile.within_budget(s.read.parquet(f"{d}/orders.parquet").select(c("o_orderkey").alias("item_id")), 25))
over("rec_12_budget_reason", "CASE WHEN item_id % 2 = 0 THEN 'A;AI_BUDGET_EXHAUSTED' ELSE 'A' END AS k", lambda: F.array_join(reconcile.budget_reason(F.when(c("item_id") % 4 == 0, F.array(F.lit("A"), F.lit("AI_BUDGET_EXHAUSTED"))).otherwise(F.array(F.lit("A"))), F.when(c("item_id") % 2 == 0, "provider_unavailable")), ";").alias("k"))
over("joi_05_check_fields", f"{o.array(FIELDS)}[(item_id % 6 + 1)::INT] AS k", lambda: rules.field_of(F.get(F.array(*map(F.lit, CHECKS)), (c("item_id") % 6).cast("int"))).alias("k"))

# Exports.
over("snk_03_safe_cell", "CASE item_id % 4 WHEN 0 THEN '''=' || brand_line WHEN 1 THEN '''-' || brand_line WHEN 2 THEN '' ELSE brand_line END AS k", lambda: exports.safe_cell(F.when(c("item_id") % 4 == 0, F.concat(F.lit("="), "brand_line")).when(c("item_id") % 4 == 1, F.concat(F.lit("-"), "brand_line")).when(c("item_id") % 4 == 3, c("brand_line"))).alias("k"))
over("snk_07_display", "CASE WHEN item_id % 2 = 0 THEN 'Detected — ' || substr(warning_line, 1, 200) ELSE app_brand END AS k", lambda: F.when(c("item_id") % 2 == 0, exports.display(F.lit("government_warning"), c("warning_line"), F.lit("x"), F.lit("FOUND"))).otherwise(exports.display(F.lit("brand_name"), F.lit(""), c("app_brand"), F.lit("FOUND"))).alias("k"))
over("snk_10_audit", """'{"event":"checked","message":"' || trim(regexp_replace(brand_line, '\\s+', ' ', 'g')) || '"' || CASE WHEN item_id % 2 = 0 THEN ',"size":' || size ELSE '' END || '}' AS k""", lambda: exports.audit(F.lit("checked"), c("brand_line"), size=F.when(c("item_id") % 2 == 0, c("size"))).alias("k"))


@register("snk_02_check_statuses", "WITH k AS (SELECT l_orderkey AS item_id, l_linenumber AS n, max(CASE WHEN (l_orderkey + l_linenumber) % 4 = 0 THEN 'REVIEW' ELSE 'PASS' END) AS status FROM (SELECT l_orderkey, (l_linenumber - 1) % 5 + 1 AS l_linenumber FROM lineitem) GROUP BY 1, 2) SELECT item_id, " + ", ".join(f"max(status) FILTER (n = {i + 1}) AS {name}" for i, name in enumerate(("brand_status", "class_type_status", "alcohol_content_status", "net_contents_status", "government_warning_status"))) + " FROM k GROUP BY 1")
def _(spark, sf_dir):
    status = F.when((c("l_orderkey") + c("l_linenumber")) % 4 == 0, "REVIEW").otherwise("PASS")
    return exports.check_statuses(spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("l_linenumber", F.expr("(l_linenumber - 1) % 5 + 1")).select(c("l_orderkey").alias("item_id"), F.element_at(F.array(*map(F.lit, CHECKS)), c("l_linenumber").cast("int")).alias("check_name"), status.alias("status")))


register("snk_05_recount", f"WITH i AS ({ITEMS}) SELECT count(*) AS total, count(*) FILTER (ai_assisted) AS ai_assisted_all, count(*) FILTER ({DONE} AND ai_assisted) AS ai_assisted FROM i")(lambda s, d: summary.batch(items(s, d)).select("total", "ai_assisted_all", "ai_assisted"))
over("snk_08_flattened", "item_id % 2 = 0 AS field_brand_name, replace(brand_line || chr(10) || net_line, chr(10), ' | ') AS preview", *(
    lambda i=i: [c("field_brand_name"), c("preview")][i] for i in range(2)
))
QUERIES["snk_08_flattened"] = lambda s, d: exports.flattened(labels(s, d).select("item_id", F.create_map(F.lit("brand_name"), c("item_id") % 2 == 0).alias("field_recovery"), F.concat_ws("\n", "brand_line", "net_line").alias("preview")), ["brand_name"])
over("txt_general_format", f"{o.g('size / 8.0::DOUBLE')} AS a, printf('%.1f', size / 4.0::DOUBLE) AS b", lambda: text.general(c("size") / 8.0).alias("a"), lambda: text.fixed(c("size") / 4.0).alias("b"))


@register("rul_13_annotated", f"""{L}, k AS (SELECT item_id, unnest({o.array(CHECKS)}) AS check_name FROM l), m AS (SELECT *, item_id % 4 <> 0 AS told, item_id % 4 <> 0 AND item_id % 2 = 1 AND check_name = 'Net Contents' AS hit, item_id % 4 <> 0 AND item_id % 3 = 0 AS bad FROM k)
SELECT item_id, check_name, CASE WHEN told THEN 'ocr_only' END AS evidence_method, CASE WHEN told THEN 'no_usable_evidence' END AS outcome, CASE WHEN told THEN true END AS configured, CASE WHEN told THEN item_id % 5 = 0 END AS eligible, CASE WHEN hit THEN true END AS assisted, CASE WHEN hit THEN 'filled' END AS merged,
 CASE WHEN bad THEN true END AS unavailable, CASE WHEN bad THEN 'timeout' END AS failure, 'why' || CASE WHEN hit THEN {q(rules.CONSIDERED)} ELSE '' END AS explanation, CASE WHEN told AND check_name = 'Brand Name' THEN 'region_' || item_id END AS brand_escalation FROM m""")
def _(spark, sf_dir):
    n = c("item_id")
    made = rules.stub(labels(spark, sf_dir).select("item_id")).withColumn("explanation", F.lit("why"))
    # Answers on the brand were rejected, or left it as it was: they mark nothing.
    changed = F.when(n % 2 == 1, F.array(F.lit("net_contents"))).otherwise(F.array().cast("array<string>"))
    outcomes = F.create_map(F.lit("net_contents"), F.lit("filled"), F.lit("brand_name"), F.when(n % 3 == 0, "kept_ocr").otherwise("rejected:low_confidence"))
    told = labels(spark, sf_dir).where("item_id % 4 <> 0").select("item_id", F.lit("ocr_only").alias("evidence_method"), F.lit("no_usable_evidence").alias("outcome"), F.lit(True).alias("configured"), (n % 5 == 0).alias("eligible"), F.lit(True).alias("attempted"), (n % 3 != 0).alias("succeeded"), F.lit("timeout").alias("failure_category"), changed.alias("fields_updated"), outcomes.alias("merge_outcomes"), F.concat(F.lit("region_"), n).alias("brand_escalation"))
    marks = {"ai_assist_outcome": "outcome", "ai_configured": "configured", "ai_eligible_for_review": "eligible", "ai_assisted_evidence": "assisted", "ai_merge_outcome": "merged", "ai_attempted_but_unavailable": "unavailable", "ai_failure_category": "failure"}
    return rules.annotate(made, told).select("item_id", "check_name", "evidence_method", *(c(k).alias(v) for k, v in marks.items()), "explanation", "brand_escalation")


@register("rec_14_scripted", f"""{L}, r AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN ['brand_name', 'net_contents'] WHEN 1 THEN ['net_contents'] ELSE ['class_type'] END AS fs FROM l), s AS (SELECT * FROM (VALUES ('brand_name', 'A'), ('net_contents', 'B'), ('net_contents', 'C')) v(field_name, candidate_value))
SELECT item_id, field_name, candidate_value FROM r, s WHERE list_contains(fs, field_name) OR item_id % 3 = 2""")
def _(spark, sf_dir):
    names = F.when(c("item_id") % 3 == 0, F.array(F.lit("brand_name"), F.lit("net_contents"))).when(c("item_id") % 3 == 1, F.array(F.lit("net_contents"))).otherwise(F.array(F.lit("class_type")))
    asked = labels(spark, sf_dir).select("item_id", F.transform(names, lambda x: F.struct(x.alias("field"))).alias("fields"))
    script = spark.createDataFrame([("brand_name", "A"), ("net_contents", "B"), ("net_contents", "C")], "field_name string, candidate_value string")
    return reconcile.scripted_evidence(asked, script).select("item_id", "field_name", "candidate_value")


over("rec_14_none", "'evidence recovery skipped (' || size % 3 || ' field(s)). off' AS k", lambda: F.lit(None).cast("string").alias("k"))
QUERIES["rec_14_none"] = lambda s, d: reconcile.no_evidence(labels(s, d).select("item_id", F.slice(F.array(F.lit("a"), F.lit("b")), 1, c("size") % 3).alias("fields")), "off").select("item_id", c("explanation").alias("k"))
STEPS = "'exif_orientation' || CASE WHEN item_id % 2 = 0 THEN '+' ELSE '-' END || ' convert_rgb+ ocr_max_edge_resize' || CASE WHEN size > 25 THEN '+' ELSE '-' END || ' grayscale+ ' || CASE WHEN item_id % 3 = 0 THEN 'clahe_contrast+ mild_denoise+ perspective_correction- deskew' || CASE WHEN item_id % 5 = 0 THEN '+' ELSE '-' END || ' mild_unsharp+' ELSE 'enhanced_skipped-' END AS steps"
DETAIL = "CASE WHEN item_id % 3 <> 0 THEN NULL WHEN item_id % 5 = 0 THEN 'Rotated by ' || printf('%.2f', size / 8.0::DOUBLE) || ' degrees' ELSE 'angle_below_minimum_threshold' END AS tilt"


def _steps():
    return images.operations(F.when(c("item_id") % 3 == 0, "enhanced").otherwise("fast"), c("item_id") % 2 == 0, c("size") > 25, F.lit(1600), F.when(c("item_id") % 5 == 0, "rotate").otherwise("skip_straight"), c("size") / 8.0)


over("img_04_operations", f"{STEPS}, {DETAIL}", lambda: F.array_join(F.transform(_steps(), lambda x: F.concat(x["name"], F.when(x["applied"], "+").otherwise("-"))), " ").alias("steps"), lambda: F.get(F.filter(_steps(), lambda x: x["name"] == "deskew"), 0)["detail"].alias("tilt"))


JUDGED = ", ".join(f"max(CASE WHEN (l_linenumber - 1) % 5 = {i} THEN CASE WHEN (l_orderkey + l_linenumber) % 4 = 0 THEN 'REVIEW' ELSE 'PASS' END END) AS s{i}" for i in range(5))


@register("snk_04_report_rows", f"""WITH i AS ({ITEMS}), k AS (SELECT l_orderkey AS item_id, {JUDGED} FROM lineitem GROUP BY 1)
SELECT item_id, array_to_string([filename, coalesce(overall_status, processing_state), brand_name, '', chr(39) || '-' || item_id || '%', '', {", ".join(f"coalesce(s{i}, '')" for i in range(5))}, CASE WHEN ai_assisted THEN 'Yes' ELSE 'No' END, chr(39) || '=x', printf('%.1f', processing_time_ms::DOUBLE), CASE WHEN processing_state = 'ERROR' THEN 'no text' ELSE '' END], '|') AS line FROM i LEFT JOIN k USING (item_id)""")
def _(spark, sf_dir):
    status = F.when((c("l_orderkey") + c("l_linenumber")) % 4 == 0, "REVIEW").otherwise("PASS")
    judged = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(c("l_orderkey").alias("item_id"), F.element_at(F.array(*map(F.lit, CHECKS)), ((c("l_linenumber") - 1) % 5 + 1).cast("int")).alias("check_name"), status.alias("status"))
    none = F.lit(None).cast("string")
    rows = items(spark, sf_dir).withColumns({"class_type": none, "alcohol_content": F.concat(F.lit("-"), "item_id", F.lit("%")), "net_contents": none, "review_reason_codes": F.lit("=x"), "error_message": F.when(c("processing_state") == "ERROR", "no text"), "processing_time_ms": c("processing_time_ms").cast("double")})
    return exports.report_rows(rows, judged).select("item_id", F.array_join("cells", "|").alias("line"))


register("snk_04_summary_rows", f"WITH i AS ({ITEMS}), n AS (SELECT batch_id, count(*) AS t, {', '.join(COUNT(f'{DONE} AND overall_status = {q(s)}', s.lower()) for s in ('PASS', 'REVIEW', 'FAIL'))}, {COUNT('processing_state = ' + q('ERROR'), 'e')}, {COUNT('ai_assisted', 'x')} FROM i GROUP BY 1) SELECT batch_id, unnest(range(6)) AS place, unnest(['Total', 'PASS', 'REVIEW', 'FAIL', 'ERROR', 'AI-assisted count']) AS name, unnest([t, pass, review, fail, e, x])::VARCHAR AS value FROM n")(lambda s, d: exports.summary_rows(summary.batch(items(s, d), "batch_id")).withColumnRenamed("at", "place"))


over("snk_08_json", """'{"item_id":' || item_id || ',"cer":' || CASE WHEN item_id % 2 = 0 THEN 'null' ELSE '0.5' END || '}' AS line""", lambda: F.lit(None).alias("line"))
QUERIES["snk_08_json"] = lambda s, d: exports.trial_json(labels(s, d).select("item_id", F.when(c("item_id") % 2 == 1, 0.5).alias("cer"))).select(F.get_json_object("line", "$.item_id").cast("long").alias("item_id"), "line")


# The flagship: statements parsed, compared, and counted by batch.
FLAG = f"""{L}, v AS (SELECT batch_id, {ABV_CASE("'REVIEW'", "'REVIEW'", "'REVIEW'", "'PASS'", "'FAIL'")} AS a, {NET_CASE("'REVIEW'", "'REVIEW'", "'PASS'", "'FAIL'")} AS n FROM l),
w AS (SELECT batch_id, CASE WHEN a = 'FAIL' OR n = 'FAIL' THEN 'FAIL' WHEN a = 'REVIEW' OR n = 'REVIEW' THEN 'REVIEW' ELSE 'PASS' END AS overall_status FROM v)
SELECT batch_id, overall_status, count(*) AS n FROM w GROUP BY 1, 2"""


@register("flagship_verdicts", FLAG)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = with_fields(labels(spark, sf_dir)).select("batch_id", rules.alcohol(c("app_abv"), c("f.abv"), c("quality"))["status"].alias("a"), rules.net(c("app_net"), c("f.net"), c("quality"))["status"].alias("n"))  # noqa: E741
    return l.select("batch_id", rules.worst(F.array("a", "n")).alias("overall_status")).groupBy("batch_id", "overall_status").agg(F.count("*").alias("n"))
