"""SQL fragments from which the oracles of the registered queries are put together (DuckDB)."""

from __future__ import annotations

from proofmark.config import ABV_PATTERNS, AUTHORIZED_ABV, CATEGORIES, CLASS_KEYWORDS, CLASS_PHRASES, NET_BENIGN, NET_PATTERN, PROOF_PATTERN, STATUTORY_WARNING, WARNING_CUES
from proofmark.plans.labels import LABELS

L = f"WITH l AS ({LABELS})"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def array(words: tuple[str, ...]) -> str:
    return f"[{', '.join(map(q, words))}]"


def extract(t: str, pattern: str, group: int) -> str:
    return f"nullif(regexp_extract({t}, {q(pattern)}, {group}, 'i'), '')"


def squash(t: str) -> str:
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


def norm(t: str) -> str:
    kept = f"regexp_replace(lower(replace({t}, '`', '''')), '[^a-z0-9''\\s]', ' ', 'g')"
    return f"nullif({squash(kept)}, '')"


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"


def abv_only(t: str) -> str:
    return f"CAST(coalesce({', '.join(extract(t, p, 2) for p in ABV_PATTERNS)}) AS DOUBLE)"


def proof(t: str) -> str:
    return f"CAST({extract(t, PROOF_PATTERN, 2)} AS DOUBLE)"


def source(t: str) -> str:
    a, p = abv_only(t), proof(t)
    return f"CASE WHEN {a} IS NOT NULL AND {p} IS NOT NULL THEN 'both' WHEN {p} IS NOT NULL THEN 'proof' WHEN {a} IS NOT NULL THEN 'abv' END"


def abv(t: str) -> str:
    return f"coalesce({abv_only(t)}, {proof(t)} / 2)"


def abv_span(t: str) -> str:
    return strip(f"coalesce({', '.join(extract(t, p, 1) for p in ABV_PATTERNS)})")


def proof_span(t: str) -> str:
    return strip(extract(t, PROOF_PATTERN, 1))


def g(x: str) -> str:
    return f"format('{{:g}}', {x})"


def abv_display(t: str) -> str:
    return f"CASE {source(t)} WHEN 'proof' THEN 'proof=' || {g(proof(t))} WHEN 'both' THEN {g(abv(t))} || '% Alc./Vol. (proof=' || {g(proof(t))} || ')' WHEN 'abv' THEN {g(abv(t))} || '% Alc./Vol.' END"


def net_value(t: str) -> str:
    return f"CAST({extract(t, NET_PATTERN, 2)} AS DOUBLE)"


def net_unit(t: str) -> str:
    return f"CASE WHEN {net_value(t)} IS NULL THEN NULL WHEN regexp_replace(lower({extract(t, NET_PATTERN, 3)}), '[\\s.]', '', 'g') = 'ml' THEN 'mL' ELSE 'L' END"


def net_span(t: str) -> str:
    return strip(extract(t, NET_PATTERN, 1))


def net_display(t: str) -> str:
    return f"{g(net_value(t))} || ' ' || {net_unit(t)}"


def net_ml(t: str) -> str:
    return f"CASE WHEN {net_unit(t)} = 'L' THEN {net_value(t)} * 1000 ELSE {net_value(t)} END"


def net_reliable(t: str) -> str:
    """For spans that occur once, in the case at hand."""
    return f"coalesce(NOT regexp_matches(regexp_replace(replace({t}, {net_span(t)}, ' '), {q(NET_BENIGN)}, ' ', 'gi'), '\\p{{L}}'), false)"


def app_abv(t: str) -> str:
    return f"coalesce({abv(t)}, CAST(nullif(regexp_extract({t}, '(\\d{{1,2}}(?:\\.\\d+)?)\\s*%?', 1), '') AS DOUBLE))"


def authorized(t: str) -> str:
    return f"(coalesce({t}, '') <> '' AND (regexp_matches({t}, {q(AUTHORIZED_ABV)}, 'i') OR coalesce({source(t)} IN ('abv', 'both'), false)))"


def common(a: str, b: str) -> str:
    """Length of the longest common subsequence, row by row."""
    return (
        f"list_last(list_reduce(string_split({a}, ''), lambda row, ch: list_reduce(range(1, length({b}) + 1), lambda acc, j: list_append(acc, greatest(acc[-1], row[j + 1], "
        f"row[j] + CASE WHEN substr({b}, j, 1) = ch THEN 1 ELSE 0 END)), [CAST(0 AS BIGINT)]), list_transform(range(0, length({b}) + 1), lambda z: CAST(0 AS BIGINT))))"
    )


def sorted_tokens(t: str) -> str:
    return f"array_to_string(list_sort(string_split({t}, ' ')), ' ')"


def token_sort(pairs: str, a: str, b: str) -> str:
    """A table of distinct pairs (x, y) of the keys ``a`` and ``b`` of ``pairs`` with their ratio, as CTE ``r``."""
    return (
        f"d AS (SELECT DISTINCT {norm(a)} AS x, {norm(b)} AS y FROM {pairs}), s AS (SELECT x, y, {sorted_tokens('x')} AS xs, {sorted_tokens('y')} AS ys FROM d), "
        f"r AS (SELECT x, y, CASE WHEN x IS NULL OR y IS NULL THEN 0.0 WHEN x = y THEN 100.0 ELSE 200.0 * {common('xs', 'ys')} / (length(xs) + length(ys)) END AS ratio FROM s)"
    )


def token_set(pairs: str, a: str, b: str) -> str:
    """The same with the ratio of word sets, as CTE ``r``, for the expressions ``a`` and ``b`` of ``pairs``; x and y have words."""
    both, left, right = "list_sort(list_intersect(xs, ys))", "list_sort(list_filter(xs, lambda w: NOT list_contains(ys, w)))", "list_sort(list_filter(ys, lambda w: NOT list_contains(xs, w)))"
    ratio = lambda p, q: f"200.0 * {common(p, q)} / (length({p}) + length({q}))"
    return (
        f"d AS (SELECT DISTINCT {a} AS x, {b} AS y FROM {pairs}), s AS (SELECT x, y, list_distinct(string_split({squash('x')}, ' ')) AS xs, list_distinct(string_split({squash('y')}, ' ')) AS ys FROM d), "
        f"t AS (SELECT x, y, len({both}) AS n, len({left}) AS n_left, len({right}) AS n_right, array_to_string({both}, ' ') AS head, array_to_string(list_concat({both}, {left}), ' ') AS one, array_to_string(list_concat({both}, {right}), ' ') AS two FROM s), "
        f"r AS (SELECT x, y, CASE WHEN n > 0 AND least(n_left, n_right) = 0 THEN 100.0 WHEN n = 0 THEN {ratio('one', 'two')} ELSE greatest({ratio('one', 'two')}, {ratio('head', 'one')}, {ratio('head', 'two')}) END AS ratio FROM t)"
    )


def partial(pairs: str, a: str, b: str) -> str:
    """The same with the best ratio of the shorter text and any window of the longer one, as CTE ``r``; neither is empty."""
    return (
        f"d AS (SELECT DISTINCT {a} AS x, {b} AS y FROM {pairs}), s AS (SELECT x, y, CASE WHEN length(x) <= length(y) THEN x ELSE y END AS one, CASE WHEN length(x) <= length(y) THEN y ELSE x END AS two FROM d), "
        f"w AS (SELECT DISTINCT one, substr(two, greatest(i, 0) + 1, i + length(one) - greatest(i, 0)) AS part, two FROM (SELECT DISTINCT one, two FROM s WHERE NOT contains(two, one)), unnest(range(1 - length(one), length(two))) AS u(i)), "
        f"best AS (SELECT one, two, max(200.0 * {common('one', 'part')} / (length(one) + length(part))) AS ratio FROM w GROUP BY one, two), "
        f"r AS (SELECT x, y, coalesce(ratio, 100.0) AS ratio FROM s LEFT JOIN best USING (one, two))"
    )


def eval_norm(t: str) -> str:
    return squash(f"regexp_replace(lower({t}), '[^a-z0-9_\\s.%/]', ' ', 'g')")


def long_tokens(t: str) -> str:
    return f"list_filter(string_split({t}, ' '), lambda w: length(w) >= 4)"


def agree(a: str, b: str) -> str:
    """For keys without points or bars."""
    first, second = long_tokens(a), long_tokens(b)
    met = f"len(list_filter({first}, lambda t: len(list_filter({second}, lambda u: starts_with(u, t) OR starts_with(t, u))) > 0)) = len({first})"
    return f"coalesce({a} = {b} OR contains({a}, {b}) OR contains({b}, {a}) OR (len({first}) > 0 AND {met}), false)"


def prefer_agreeing(a: str, b: str) -> str:
    """For texts that are not missing; ``a`` and ``b`` are columns."""
    x, y = norm(a), norm(b)
    more = f"len({long_tokens(y)}) - len({long_tokens(x)})"
    extra = lambda p, q: f"list_filter(string_split({p}, ' '), lambda w: NOT list_contains(string_split({q}, ' '), w))"
    junk = lambda p, q: f"(len({long_tokens(p)}) <= len({long_tokens(q)}) AND len({extra(p, q)}) > 0 AND len({long_tokens(array_of(extra(p, q)))}) = 0)"
    return (
        f"CASE WHEN NOT {agree(x, y)} THEN {a} WHEN contains({y}, {x}) AND length({y}) > length({x}) + 1 THEN CASE WHEN {junk(y, x)} THEN {a} ELSE {b} END "
        f"WHEN contains({x}, {y}) AND length({x}) > length({y}) + 1 THEN CASE WHEN {junk(x, y)} THEN {b} ELSE {a} END "
        f"WHEN {more} > 0 THEN {b} WHEN {more} < 0 THEN {a} WHEN length(trim({a})) <= length(trim({b})) THEN {a} ELSE {b} END"
    )


def array_of(words: str) -> str:
    return f"array_to_string({words}, ' ')"


def categories(t: str) -> str:
    return f"list_distinct(list_transform(list_filter({array(CATEGORIES)}, lambda w: contains({t}, w)), lambda w: CASE WHEN w IN ('whiskey', 'whisky', 'bourbon') THEN 'whiskey' ELSE w END))"


def class_hits(t: str) -> str:
    """The number of known phrases in one line."""
    return f"len(list_filter({array(CLASS_PHRASES)}, lambda p: contains(lower({t}), p)))"


def keyword_hits(t: str) -> str:
    return f"len(list_filter({array(CLASS_KEYWORDS)}, lambda p: contains(lower({t}), p)))"


def cues(t: str) -> str:
    return f"len(list_filter({array(WARNING_CUES)}, lambda p: contains(lower({t}), p)))"


STATUTE = q(STATUTORY_WARNING)
