"""SQL for whole verification runs over label records (DuckDB): extraction, checks, and what rests on them.

``FIELDS`` defines the CTE ``f``, one row per record and field; ``checks`` adds ``k``,
one row per record and check.  Both follow the rules for any lines that the
records of ``labels`` can have, with the words and boxes that ``queries.records`` gives them.
"""

from __future__ import annotations

from proofmark.config import CHECKS, CLASS_KEYWORDS, CLASS_PHRASES, EDGE_JUNK, FIELDS, OCR_ARTIFACT, SKIP_LINE, WARNING_FRAGMENTS, WEAK_STANDALONE
from proofmark.plans import oracle as o

q = o.q
TOKENS = lambda t: f"list_filter(string_split_regex({t}, '\\s+'), lambda w: w <> '')"
LETTER = "\\p{L}\\p{M}\\p{N}_"
BARE = lambda t: f"lower(regexp_replace({t}, '^[^{LETTER}]+|[^{LETTER}]+$', '', 'g'))"
HOLDS = lambda words, t: f"len(list_filter({o.array(words)}, lambda p: contains(lower({t}), p))) > 0"
WEAK = lambda t: f"regexp_matches(trim({t}), {q(WEAK_STANDALONE)}, 'i')"
FIRST_WORD = "'^(\\S+)'"

# Lines in order; those that can be a brand, with their place among these and the boxes of words that they hold.
LINES = f"""b AS (SELECT *, list_filter([{o.strip('brand_line')}, {o.strip('class_line')}, {o.strip('abv_line')}, {o.strip('net_line')}, {o.strip('warning_line')}], lambda x: x <> '') AS ls, item_id % 10 = 3 AS low,
  [regexp_extract(abv_line, {FIRST_WORD}, 1), regexp_extract(net_line, {FIRST_WORD}, 1)] AS ws, concat_ws(chr(10), brand_line, class_line, abv_line, net_line, warning_line) AS full_text FROM l),
bl AS (SELECT item_id, low, ws, i, line FROM (SELECT item_id, low, ws, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line, ls FROM b) WHERE list_position(list_transform(ls, lambda x: lower(x)), lower(line)) = i
  AND length(line) BETWEEN 3 AND 60 AND NOT regexp_matches(line, {q(SKIP_LINE)}, 'i') AND NOT ({HOLDS(CLASS_PHRASES, 'line')} OR ({HOLDS(CLASS_KEYWORDS, 'line')} AND len({TOKENS('line')}) <= 6)) AND NOT {HOLDS(WARNING_FRAGMENTS, 'line')}),
bo AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) - 1 AS pos, len(list_filter(ws, lambda w: list_contains(list_filter(list_transform({TOKENS('line')}, lambda t: {BARE('t')}), lambda t: t <> ''), {BARE('w')}))) AS own FROM bl),
bs AS (SELECT *, CASE WHEN own > 0 THEN 2 * 20.0::DOUBLE + (1 - 200 / 600::DOUBLE) * 40 ELSE 30.0::DOUBLE - pos END + CASE WHEN own >= 2 THEN 10 ELSE 0 END + CASE WHEN len({TOKENS('line')}) >= 2 THEN 8 ELSE 0 END
  + CASE WHEN line = upper(line) AND line <> lower(line) AND length(line) > 4 THEN 5 ELSE 0 END + CASE WHEN {WEAK('line')} THEN -28 ELSE 0 END + CASE WHEN regexp_matches(line, {q(OCR_ARTIFACT)}) OR regexp_matches(line, {q(EDGE_JUNK)}) THEN -20 ELSE 0 END AS score FROM bo),
br AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, pos) AS place, first_value(line) OVER (PARTITION BY item_id ORDER BY score DESC, pos) AS top, max(score) OVER (PARTITION BY item_id) AS best FROM bs),
bc AS (SELECT item_id, max(top) AS line, max(own) FILTER (place = 1) AS own, bool_or(low) AS low, list(line ORDER BY place)[1:5] AS seen,
  count(DISTINCT lower(line)) FILTER (score >= best * 0.88::DOUBLE AND NOT {WEAK('line')}) > 1
  OR count(*) FILTER (place > 1 AND len({TOKENS('top')}) >= 2 AND length({TOKENS('top')}[-1]) >= 4 AND score >= best * 0.72::DOUBLE AND NOT {WEAK('line')} AND len({TOKENS('line')}) >= 2 AND lower({TOKENS('line')}[-1]) = lower({TOKENS('top')}[-1]) AND lower({TOKENS('line')}[1]) <> lower({TOKENS('top')}[1])) > 0 AS unclear FROM br GROUP BY 1),
bi AS (SELECT *, concat_ws(',', CASE WHEN regexp_matches(line, {q(OCR_ARTIFACT)}) THEN 'ocr_artifact_symbol' END, CASE WHEN regexp_matches(line, {q(EDGE_JUNK)}) THEN 'edge_punctuation' END, CASE WHEN regexp_matches(line, '^\\p{{Ll}}.*\\p{{L}}') THEN 'leading_lowercase' END,
  CASE WHEN regexp_matches(line, '\\s[=|_]\\s*$') OR line LIKE '%=' THEN 'trailing_ocr_artifact' END, CASE WHEN own > 0 AND low THEN 'low_confidence_leading_word,low_confidence_trailing_word,clipped_leading_edge' END) AS issues FROM bc)"""

CLEAN = f"trim(regexp_replace(regexp_replace(line, '^[^{LETTER}\"'']+', ''), '[^{LETTER}\"''.!?-]+$', ''))"
BRAND = f"""SELECT b.item_id, 0 AS field_at, CASE WHEN line IS NULL THEN 'NOT_FOUND' WHEN unclear OR {WEAK('line')} OR issues <> '' THEN 'UNCERTAIN' ELSE 'FOUND' END AS status, line AS raw_text, coalesce(nullif({CLEAN}, ''), trim(line)) AS normalized_value, CAST(NULL AS DOUBLE) AS normalized_numeric, CAST(NULL AS VARCHAR) AS unit,
  CASE WHEN line IS NULL THEN 'brand_missing' WHEN unclear THEN 'brand_ambiguous' WHEN {WEAK('line')} THEN 'brand_weak_standalone' WHEN issues <> '' THEN issues END AS reason, CAST(NULL AS VARCHAR) AS source, coalesce(seen, []) AS candidates FROM b LEFT JOIN bi USING (item_id)"""

CLASS_FIELD = """SELECT item_id, 1, CASE WHEN len(hit) + len(weak) = 0 THEN 'NOT_FOUND' WHEN len(hit) = 1 AND NOT regexp_matches(hit[1], '\\.\\.\\.|…|( Whis| WHIS| Bourb)\\s*$') THEN 'FOUND' ELSE 'UNCERTAIN' END,
  coalesce(hit[1], weak[1]), coalesce(hit[1], weak[1]), CAST(NULL AS DOUBLE), CAST(NULL AS VARCHAR),
  CASE WHEN len(hit) + len(weak) = 0 THEN 'class_type_missing' WHEN len(hit) = 0 THEN CASE WHEN len(weak) > 1 THEN 'class_type_ambiguous' END WHEN len(hit) > 1 THEN 'class_type_ambiguous' WHEN regexp_matches(hit[1], '\\.\\.\\.|…|( Whis| WHIS| Bourb)\\s*$') THEN 'class_type_partial' END, CAST(NULL AS VARCHAR),
  CASE WHEN len(hit) = 0 THEN weak[1:5] ELSE hit[1:5] END FROM ch"""
# The first line of each phrase in the order of phrases, without repeats.
CLASS = f"""cp AS (SELECT item_id, ls, unnest(range({len(CLASS_PHRASES)})) AS n, unnest({o.array(CLASS_PHRASES)}) AS p, full_text FROM b),
cx AS (SELECT item_id, min(n) AS n, x FROM (SELECT item_id, n, coalesce(list_filter(ls, lambda y: contains(lower(y), p))[1], p) AS x FROM cp WHERE contains(lower(full_text), p)) GROUP BY item_id, x),
cz AS (SELECT item_id, list(x ORDER BY n) AS hit FROM cx GROUP BY 1),
ch AS (SELECT item_id, coalesce(hit, []) AS hit, list_filter(ls, lambda x: {HOLDS(CLASS_KEYWORDS, 'x')}) AS weak FROM b LEFT JOIN cz USING (item_id))"""

# The alcohol line, unless it says nothing and the line of net contents states a proof.
ABV = f"a AS (SELECT *, CASE WHEN {o.source('abv_line')} IS NULL AND {o.source('net_line')} IS NOT NULL THEN net_line ELSE abv_line END AS a FROM b)"
ABV_RAW = f"CASE {o.source('a')} WHEN 'both' THEN a WHEN 'abv' THEN {o.abv_span('a')} WHEN 'proof' THEN {o.proof_span('a')} END"
ABV_FIELD = f"""SELECT item_id, 2, CASE WHEN {o.source('a')} IS NULL THEN 'NOT_FOUND' WHEN low AND a = abv_line THEN 'UNCERTAIN' ELSE 'FOUND' END, {ABV_RAW}, {o.abv_display('a')}, {o.abv('a')}, CASE WHEN {o.source('a')} IS NOT NULL THEN '%' END, CASE WHEN {o.source('a')} IS NULL THEN 'abv_pattern_missing' END, {o.source('a')},
  CASE WHEN {o.source('a')} IS NULL THEN [] ELSE list_filter([abv_line, net_line], lambda x: {o.source('x')} IS NOT NULL) END FROM a"""
NET_FIELD = f"""SELECT item_id, 3, CASE WHEN {o.net_value('net_line')} IS NULL THEN 'NOT_FOUND' WHEN NOT {o.net_reliable('net_line')} OR low THEN 'UNCERTAIN' ELSE 'FOUND' END, CASE WHEN {o.net_value('net_line')} IS NOT NULL THEN net_line END, {o.net_display('net_line')}, {o.net_value('net_line')}, {o.net_unit('net_line')},
  CASE WHEN {o.net_value('net_line')} IS NULL THEN 'net_contents_pattern_missing' WHEN NOT {o.net_reliable('net_line')} THEN 'net_contents_noisy_context' END, CAST(NULL AS VARCHAR), CASE WHEN {o.net_value('net_line')} IS NULL THEN [] ELSE [net_line] END FROM b"""
FULL = f"{o.cues('warning_line')} >= 2 AND length(warning_line) > 80"
HEADED = "coalesce(regexp_matches(warning_line, 'government\\s+warning', 'i'), false)"
WARNING_FIELD = f"""SELECT item_id, 4, CASE WHEN NOT {HEADED} THEN 'NOT_FOUND' WHEN {FULL} THEN 'FOUND' ELSE 'UNCERTAIN' END, CASE WHEN {HEADED} THEN warning_line END, CASE WHEN {HEADED} THEN 'GOVERNMENT WARNING' END, CAST(NULL AS DOUBLE), CAST(NULL AS VARCHAR),
  CASE WHEN NOT {HEADED} THEN 'warning_header_missing' WHEN NOT ({FULL}) THEN 'warning_for_ai' END, CAST(NULL AS VARCHAR), [] FROM b"""
FIELDS_SQL = f"""{o.L}, {LINES}, {CLASS}, {ABV},
f AS (SELECT u.*, {o.array(FIELDS)}[field_at + 1] AS field_name, {o.array(CHECKS)}[field_at + 1] AS check_name FROM ({BRAND} UNION ALL {CLASS_FIELD} UNION ALL {ABV_FIELD} UNION ALL {NET_FIELD} UNION ALL {WARNING_FIELD}) u)"""


def checks(comparison: bool = True) -> str:
    """CTEs up to ``k``: status, reason_code, underlying (the reason beneath) and eligible of every check, beside its field."""
    shown = "coalesce(nullif(normalized_value, ''), raw_text)"
    named = f"""g AS (SELECT f.*, {shown} AS shown, concat_ws(' ', nullif(raw_text, ''), nullif(normalized_value, '')) AS ev, l.batch_id, l.quality, l.quality IN ('WARNING', 'POOR') AS poor,
  CASE field_at WHEN 0 THEN app_brand WHEN 1 THEN app_class WHEN 2 THEN app_abv WHEN 3 THEN app_net END AS app FROM f JOIN l USING (item_id))"""
    pairs = "(SELECT app, shown FROM g WHERE field_at < 2)"
    ratios = f"rn AS (WITH {o.token_sort(pairs, 'app', 'shown')} SELECT * FROM r), rw AS (WITH {o.token_set('(SELECT DISTINCT raw_text FROM g WHERE field_at = 4 AND raw_text IS NOT NULL)', f'lower({o.squash(o.STATUTE)})', f'lower({o.squash("raw_text")})')} SELECT * FROM r)"
    joined = f"h AS (SELECT g.*, CASE field_at WHEN 4 THEN rw.ratio ELSE rn.ratio END AS ratio FROM g LEFT JOIN rn ON field_at < 2 AND rn.x IS NOT DISTINCT FROM {o.norm('app')} AND rn.y IS NOT DISTINCT FROM {o.norm('shown')} LEFT JOIN rw ON field_at = 4 AND rw.y = lower({o.squash('raw_text')}))"
    # Each verdict is a list of status, reason, reason beneath and whether evidence may be asked for.
    said = lambda status, reason, eligible=False, beneath="NULL": f"[{q(status)}, {reason if reason.startswith('CASE') else q(reason)}, {beneath}, '{int(eligible)}']"
    unsure = "CASE WHEN reason IN ('CONFLICTING_EVIDENCE', 'brand_ocr_conflict') THEN 'CONFLICTING_EVIDENCE' WHEN reason = 'brand_ambiguous' THEN 'BRAND_AMBIGUOUS' ELSE 'EXTRACTION_UNCERTAIN' END"
    masked = lambda missing: f"CASE WHEN poor THEN 'OCR_LOW_QUALITY' ELSE {q(missing)} END"
    gate = f"WHEN field_at < 4 AND status = 'UNCERTAIN' THEN {said('REVIEW', f'CASE WHEN poor AND {unsure} = {q("EXTRACTION_UNCERTAIN")} THEN {q("OCR_LOW_QUALITY")} ELSE {unsure} END', True, unsure)} WHEN field_at < 4 AND status = 'NOT_FOUND' THEN {said('REVIEW', masked('EXTRACTION_NOT_FOUND'), True, q('EXTRACTION_NOT_FOUND'))}"
    warning = f"WHEN status = 'NOT_FOUND' THEN {said('REVIEW', masked('WARNING_MISSING'), True, q('WARNING_MISSING'))} WHEN status = 'UNCERTAIN' THEN {said('REVIEW', 'WARNING_PARTIAL', True)} WHEN ratio < 75 THEN {said('FAIL', 'WARNING_WORDING_MISMATCH')} WHEN ratio < 92 THEN {said('REVIEW', 'WARNING_PARTIAL', True)} WHEN contains(raw_text, 'GOVERNMENT WARNING') THEN {said('PASS', 'WARNING_WORDING_MATCH')} ELSE {said('REVIEW', 'WARNING_CAPS_REVIEW')}"
    proof = f"(source = 'proof' OR {o.source('ev')} = 'proof')"
    unstated = f"CASE WHEN {proof} THEN {said('REVIEW', 'PROOF_ONLY_NO_PERCENT_STATEMENT', True)} ELSE {said('REVIEW', 'ABV_FORMAT_REVIEW', True)} END"
    if comparison:
        apart = f"len({o.categories(o.norm('shown'))}) > 0 AND len({o.categories(o.norm('app'))}) > 0 AND NOT list_has_any({o.categories(o.norm('shown'))}, {o.categories(o.norm('app'))}) AND ratio < 70"
        by = {
            0: f"WHEN ratio >= 95 THEN {said('PASS', 'BRAND_MATCH')} WHEN ratio >= 85 THEN {said('REVIEW', 'BRAND_AMBIGUOUS', True)} ELSE {said('FAIL', 'BRAND_MISMATCH')}",
            1: f"WHEN ratio >= 97 THEN {said('PASS', 'CLASS_TYPE_MATCH')} WHEN {apart} THEN {said('FAIL', 'CLASS_TYPE_MISMATCH')} ELSE {said('REVIEW', 'CLASS_TYPE_AMBIGUOUS', True)}",
            2: f"WHEN {o.app_abv('app')} IS NULL THEN {said('REVIEW', 'APPLICATION_VALUE_INVALID')} WHEN normalized_numeric IS NULL THEN {said('REVIEW', 'EXTRACTION_UNCERTAIN', True)} WHEN NOT {o.authorized('ev')} THEN {unstated} WHEN abs({o.app_abv('app')} - normalized_numeric) <= 0.05 THEN {said('PASS', 'ABV_MATCH')} ELSE {said('FAIL', 'ABV_MISMATCH')}",
            3: f"WHEN {o.net_ml('app')} IS NULL THEN {said('REVIEW', 'APPLICATION_VALUE_INVALID')} WHEN abs({o.net_ml('app')} - normalized_numeric * CASE WHEN unit = 'L' THEN 1000 ELSE 1 END) <= 0.5 THEN {said('PASS', 'NET_CONTENTS_MATCH')} ELSE {said('FAIL', 'NET_CONTENTS_MISMATCH')}",
        }
    else:
        by = {i: f"ELSE {said('PASS', r)}" for i, r in ((0, "BRAND_MATCH"), (1, "CLASS_TYPE_MATCH"), (3, "NET_CONTENTS_MATCH"))} | {2: f"WHEN {o.authorized('ev')} THEN {said('PASS', 'ABV_MATCH')} ELSE {unstated}"}
    each = " ".join(f"WHEN {i} THEN CASE {gate if i < 4 else ''} {rule} END" for i, rule in sorted((by | {4: warning}).items()))
    return f"{FIELDS_SQL}, {named}, {ratios}, {joined}, v AS (SELECT *, CASE field_at {each} END AS v FROM h), k AS (SELECT * EXCLUDE (v, status), status AS extraction_status, v[1] AS status, v[2] AS reason_code, v[3] AS underlying, v[4] = '1' AS eligible FROM v)"
