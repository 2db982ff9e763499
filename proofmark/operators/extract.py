"""Field extraction: recognised text to five fields, as column expressions over a record.

A record has ``full_text`` and ``words``
(array of struct text, confidence, bbox(x_min, y_min, x_max, y_max)), and
``image_width_px``, ``image_height_px``.  A field is a struct of status,
raw_text, normalized_value, normalized_numeric, normalized_unit, candidates,
reason and source.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmark.config import CLASS_KEYWORDS, CLASS_PHRASES, EDGE_JUNK, FIELDS, OCR_ARTIFACT, SKIP_LINE, WARNING_CUES, WARNING_FRAGMENTS, WARNING_HEADER, WEAK_STANDALONE
from proofmark.functions import parse
from proofmark.functions.similarity import tokens
from proofmark.functions.text import clean_display, dedupe_lines, let, lines, strip

WORDS = "array<struct<text:string,confidence:double,bbox:struct<x_min:double,y_min:double,x_max:double,y_max:double>>>"


def field(status: Column, raw: Column | None = None, value: Column | None = None, number: Column | None = None, unit: Column | None = None, candidates: Column | None = None, reason: Column | None = None, source: Column | None = None) -> Column:
    text = lambda c: (F.lit(None) if c is None else c).cast("string")
    return F.struct(
        status.alias("status"),
        text(raw).alias("raw_text"),
        text(value).alias("normalized_value"),
        (F.lit(None) if number is None else number).cast("double").alias("normalized_numeric"),
        text(unit).alias("normalized_unit"),
        (F.array().cast("array<string>") if candidates is None else candidates).alias("candidates"),
        text(reason).alias("reason"),
        text(source).alias("source"),
    )


def low_confidence(words: Column, snippet: Column, below: float = 0.45) -> Column:
    """Whether a word of the snippet was recognised with little confidence."""
    doubtful = F.filter(words, lambda w: w["confidence"] < below)
    return F.coalesce(let(tokens(F.lower(snippet)), lambda wanted: F.exists(doubtful, lambda w: F.array_contains(wanted, F.lower(strip(w["text"]))))), F.lit(False))


def numbered_lines(every: Column) -> Column:
    """Lines with a digit; no others state alcohol or quantities."""
    return F.filter(every, lambda x: x.rlike("[0-9]"))


def _lines(text: Column, every: Column | None) -> Column:
    """Lines that the caller has worked out already, else the text's."""
    return lines(text) if every is None else every


def mean_confidence(words: Column) -> Column:
    known = F.filter(F.transform(words, lambda w: w["confidence"]), lambda c: c.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, c: a + c) / F.size(known))


def alcohol(text: Column, words: Column, every: Column | None = None) -> Column:
    """The line with the strongest statement (both over abv over proof); the first of equals, but the last of those with both."""
    rank = lambda x: F.when(x["p"]["source"] == "both", 2).when(x["p"]["source"] == "abv", 1).otherwise(0)
    each = F.filter(F.transform(numbered_lines(_lines(text, every)), lambda x: F.struct(x.alias("line"), parse.alcohol(x).alias("p"))), lambda x: x["p"].isNotNull())
    ranked = let(each, lambda e: F.struct(e.alias("e"), F.array_max(F.transform(e, rank)).alias("top")))
    chosen = let(ranked, lambda r: let(F.filter(r["e"], lambda x: rank(x) == r["top"]), lambda a: F.struct(F.transform(r["e"], lambda x: x["line"]).alias("seen"), F.when(r["top"] == 2, F.get(a, F.size(a) - 1)).otherwise(F.get(a, 0)).alias("best"))))

    def whole(p: Column) -> Column:
        return F.when(p.isNotNull(), F.struct(F.array(F.coalesce(p["abv_span"], p["proof_span"])).alias("seen"), F.struct(F.coalesce(p["abv_span"], p["proof_span"]).alias("line"), p.alias("p")).alias("best")))

    picked = let(chosen, lambda x: F.when(x["best"].isNotNull(), x).otherwise(let(parse.alcohol(text), whole)))

    def told(x: Column) -> Column:
        b, line = x["best"]["p"], x["best"]["line"]
        raw = F.when(b["source"] == "both", line).when(b["source"] == "abv", F.coalesce(b["abv_span"], line)).otherwise(F.coalesce(b["proof_span"], line))
        made = let(raw, lambda r: field(F.when(low_confidence(words, r), "UNCERTAIN").otherwise("FOUND"), r, parse.alcohol_display(b), b["abv"], F.lit("%"), x["seen"], None, b["source"]))
        return F.when(x["best"].isNotNull(), made).otherwise(field(F.lit("NOT_FOUND"), reason=F.lit("abv_pattern_missing")))

    return let(picked, told)


def net(text: Column, words: Column, every: Column | None = None) -> Column:
    """The first reliable line, else the first with a quantity, else the whole text."""
    one = lambda x, p: F.when(p.isNotNull(), F.struct(x.alias("line"), p.alias("p"), parse.net_reliable(x, p["span"]).alias("sure")))
    each = F.filter(F.transform(numbered_lines(_lines(text, every)), lambda x: let(parse.net(x), lambda p: one(x, p))), lambda x: x.isNotNull())

    def choose(e: Column) -> Column:
        at = F.coalesce(F.array_position(F.transform(e, lambda x: x["sure"]), True), F.lit(0)).cast("int")
        # Lines are looked at up to the first reliable one.
        return let(at, lambda n: F.struct(F.transform(F.slice(e, 1, F.when(n > 0, n).otherwise(F.size(e))), lambda x: x["line"]).alias("seen"), F.get(e, F.greatest(n - 1, F.lit(0))).alias("best")))

    whole = let(parse.net(text), lambda p: F.when(p.isNotNull(), F.struct(F.array(p["span"]).alias("seen"), F.struct(p["span"].alias("line"), p.alias("p"), parse.net_reliable(text, p["span"]).alias("sure")).alias("best"))))
    picked = let(each, lambda e: F.when(F.size(e) > 0, choose(e)).otherwise(whole))

    def told(x: Column) -> Column:
        b = x["best"]
        status = F.when(~b["sure"] | low_confidence(words, b["line"]), "UNCERTAIN").otherwise("FOUND")
        made = field(status, b["line"], b["p"]["display"], b["p"]["value"], b["p"]["unit"], x["seen"], F.when(~b["sure"], "net_contents_noisy_context"))
        return F.when(b.isNotNull(), made).otherwise(field(F.lit("NOT_FOUND"), reason=F.lit("net_contents_pattern_missing")))

    return let(picked, told)


def class_type(text: Column, every: Column | None = None) -> Column:
    """One line with a known phrase; several, or a keyword alone, are uncertain."""

    def hits(every: Column) -> Column:
        # Whole text and lines in small letters, once for all phrases.
        return let(F.struct(every.alias("every"), F.transform(every, F.lower).alias("low"), F.lower(text).alias("all")), found)

    def found(x: Column) -> Column:
        every, low = x["every"], x["low"]
        phrases = F.filter(F.array(*map(F.lit, CLASS_PHRASES)), lambda p: x["all"].contains(p))
        at = lambda p: F.coalesce(F.array_position(F.transform(low, lambda y: y.contains(p)), True), F.lit(0)).cast("int")
        unique = F.array_distinct(F.transform(phrases, lambda p: let(at(p), lambda n: F.when(n > 0, F.get(every, n - 1)).otherwise(p))))
        # Keywords count only where no phrase does.
        weak = F.filter(every, lambda y, i: F.exists(F.array(*map(F.lit, CLASS_KEYWORDS)), lambda k: F.get(low, i).contains(k)))
        return let(unique, lambda u: F.struct(u.alias("unique"), F.when(F.size(u) == 0, weak).alias("weak")))

    def told(h: Column) -> Column:
        unique, weak = h["unique"], h["weak"]
        first, only = F.get(unique, 0), F.get(weak, 0)
        partial = first.contains("...") | first.contains("…") | first.rlike(r"( Whis| WHIS| Bourb)\s*$")
        unsure = F.lit("UNCERTAIN")
        return (
            F.when((F.size(unique) == 0) & (F.size(weak) == 0), field(F.lit("NOT_FOUND"), reason=F.lit("class_type_missing")))
            .when(F.size(unique) == 0, field(unsure, only, only, candidates=F.slice(weak, 1, 5), reason=F.when(F.size(weak) > 1, "class_type_ambiguous")))
            .when(F.size(unique) > 1, field(unsure, first, first, candidates=F.slice(unique, 1, 5), reason=F.lit("class_type_ambiguous")))
            .when(partial, field(unsure, first, first, candidates=unique, reason=F.lit("class_type_partial")))
            .otherwise(field(F.lit("FOUND"), first, first, candidates=unique))
        )

    return let(let(_lines(text, every), hits), told)


def warning(text: Column, every: Column | None = None) -> Column:
    """From the first line with the heading to the end; found if at least two cues follow in over 80 characters."""

    def body(every: Column) -> Column:
        at = F.array_position(F.transform(every, lambda x: x.rlike(f"(?i){WARNING_HEADER}")), True).cast("int")
        return let(at, lambda n: F.when(n > 0, F.array_join(F.slice(every, n, F.size(every)), " ")))

    def told(raw: Column) -> Column:
        cues = let(F.lower(raw), lambda low: F.size(F.filter(F.array(*map(F.lit, WARNING_CUES)), lambda c: low.contains(c))))
        full = (cues >= 2) & (F.length(raw) > 80)
        heading = F.lit("GOVERNMENT WARNING")
        return (
            F.when(raw.isNotNull(), field(F.when(full, "FOUND").otherwise("UNCERTAIN"), raw, heading, reason=F.when(~full, "warning_for_ai")))
            .when(text.rlike(f"(?i){WARNING_HEADER}"), field(F.lit("UNCERTAIN"), F.substring(text, 1, 500), heading, reason=F.lit("warning_partial_structure")))
            .otherwise(field(F.lit("NOT_FOUND"), reason=F.lit("warning_header_missing")))
        )

    return let(let(_lines(text, every), body), told)


def bare(c: Column) -> Column:
    return F.lower(_edged(c))


def _edged(c: Column) -> Column:
    """Without signs at its edges."""
    return F.regexp_replace(c, r"(?U)^\W+|\W+$", "")


def bare_tokens(line: Column) -> Column:
    """The line's words without signs at their edges, in small letters; the whole line at once."""
    return F.filter(F.transform(F.split(_edged(line), r"(?U)\W*[ \t\n\x0B\f\r]\W*"), F.lower), lambda t: t != "")


def keyed(words: Column) -> Column:
    """Words with what lines are looked up by, worked out once for all lines."""
    return F.transform(words, lambda w: F.struct(w.alias("word"), bare(w["text"]).alias("bare"), F.lower(w["text"]).alias("low")))


def _of_line(known: Column, line: Column) -> Column:
    return let(bare_tokens(line), lambda wanted: F.transform(F.filter(known, lambda k: F.array_contains(wanted, k["bare"]) | F.array_contains(wanted, k["low"])), lambda k: k["word"]))


def words_of_line(words: Column, line: Column) -> Column:
    """The recognised words that are words of the line, edge signs aside."""
    return _of_line(keyed(words), line)


def continuous(boxes: Column, height: Column) -> Column:
    """Whether two boxes or more (see ``parse.box_edges``) stand side by side, each within 1.8 heights of the one before."""
    placed = F.array_sort(boxes, lambda a, b: F.when(a["left"] < b["left"], -1).when(a["left"] > b["left"], 1).otherwise(0))
    gaps = F.zip_with(F.slice(placed, 1, F.greatest(F.size(placed) - 1, F.lit(0))), F.slice(placed, 2, F.greatest(F.size(placed), F.lit(1))), lambda a, b: b["left"] - (a["left"] + a["width"]))
    return (F.size(boxes) >= 2) & F.forall(gaps, lambda g: g < height * 1.8)


def capped(seen: Column, n: int = 5) -> Column:
    """At most the first ``n``: candidates 5, lines and warnings 12."""
    return F.slice(seen, 1, n)


def preview_of_words(words: Column, n: int = 12) -> Column:
    """The first words from top to bottom, then left to right."""
    placed = F.array_sort(F.transform(words, lambda w: F.struct(F.coalesce(w["bbox"]["y_min"], F.lit(0.0)).alias("y"), F.coalesce(w["bbox"]["x_min"], F.lit(0.0)).alias("x"), w["text"].alias("text"))))
    return F.array_join(F.transform(capped(placed, n), lambda w: w["text"]), " ")


def brand_lines(text: Column, every: Column | None = None) -> Column:
    """Lines that can be a brand: 3 to 60 characters, nothing of another field."""
    holds = lambda lower, words: F.exists(F.array(*map(F.lit, words)), lambda p: lower.contains(p))

    def of_another(x: Column) -> Column:
        return let(F.lower(x), lambda lower: holds(lower, CLASS_PHRASES) | (holds(lower, CLASS_KEYWORDS) & (F.size(tokens(x)) <= 6)) | holds(lower, WARNING_FRAGMENTS))

    return F.filter(dedupe_lines(_lines(text, every)), lambda x: F.length(x).between(3, 60) & ~x.rlike(f"(?i){SKIP_LINE}") & ~of_another(x))


def is_weak(line: Column) -> Column:
    return _is_weak(strip(line))


def _is_weak(line: Column) -> Column:
    """``is_weak`` of a line that is stripped already."""
    return line.rlike(f"(?i){WEAK_STANDALONE}")


def _mean_of(own: Column, part: str) -> Column:
    return _mean(F.transform(own, lambda e: e[part]))


def _mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values))


def brand_scores(text: Column, words: Column, image_height: Column, every: Column | None = None) -> Column:
    """Candidate lines with score and its parts, the best first, equals in order of lines."""

    def one(known: Column, line: Column, i: Column) -> Column:
        own = F.transform(_of_line(known, line), lambda w: parse.box_edges(w["bbox"]))
        facts = let(own, lambda x: F.struct(x.alias("own"), _mean_of(x, "height").alias("height"), _mean_of(x, "top").alias("top")))
        return let(facts, lambda x: scored(line, i, x["own"], x["height"], x["top"]))

    def scored(line: Column, i: Column, own: Column, height: Column, top: Column) -> Column:
        has = F.size(own) > 0
        size = F.when(has, 2 * height).otherwise(0.0)
        position = F.when(has, F.greatest(F.lit(0.0), 1 - top / F.coalesce(image_height, F.lit(1)).cast("double")) * 40).otherwise(30.0 - i)
        close = F.when(continuous(own, height), 10.0).otherwise(0.0)
        many = F.when(line.rlike(r"\S\s+\S"), 8.0).otherwise(0.0)
        caps = F.when((line == F.upper(line)) & (line != F.lower(line)) & (F.length(line) > 4), 5.0).otherwise(0.0)
        weak = F.when(_is_weak(line), -28.0).otherwise(0.0)
        artifact = F.when(line.rlike(OCR_ARTIFACT) | line.rlike(EDGE_JUNK), -20.0).otherwise(0.0)
        parts = F.struct(size.alias("size"), position.alias("position"), close.alias("continuity"), many.alias("multi_word"), caps.alias("all_caps"), weak.alias("weak"), artifact.alias("artifact"))
        return let(parts, lambda x: summed(line, i, x))

    def summed(line: Column, i: Column, x: Column) -> Column:
        # Lambdas work out again what an expression names twice, so the sum is made of parts that are there.
        names = ("size", "position", "continuity", "multi_word", "all_caps", "weak", "artifact")
        return F.struct(line.alias("line"), i.alias("at"), reduce(operator.add, (x[n] for n in names)).alias("score"), *(x[n].alias(n) for n in names))

    ranked = let(keyed(words), lambda known: F.transform(brand_lines(text, every), lambda line, i: one(known, line, i)))
    order = lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(a["at"] - b["at"])
    return F.array_sort(ranked, order)


def brand_conflicts(scored: Column) -> Column:
    """Other lines that may be the brand as well: nearly the best score, or the same last word after another first one."""
    return let(scored, lambda x: _conflicts(x, lambda s: is_weak(s["line"])))


def _conflicts(scored: Column, weak: Callable[[Column], Column]) -> Column:
    first = F.get(scored, 0)
    own = let(tokens(first["line"]), lambda t: F.struct(first["line"].alias("line"), first["score"].alias("score"), F.size(t).alias("n"), F.lower(F.get(t, 0)).alias("head"), F.lower(F.element_at(t, -1)).alias("tail")))
    return let(own, lambda top: _compared(scored, top, weak))


def _compared(scored: Column, top: Column, weak: Callable[[Column], Column]) -> Column:
    head, tail = top["head"], top["tail"]
    rest = F.slice(scored, 2, F.greatest(F.size(scored), F.lit(1)))
    near = F.filter(scored, lambda x: (x["score"] >= top["score"] * 0.88) & ~weak(x))
    near_lines = F.array_distinct(F.transform(near, lambda x: F.lower(x["line"])))
    suffix = F.filter(
        rest,
        lambda x: (top["n"] >= 2)
        & (F.length(tail) >= 4)
        & (x["score"] >= top["score"] * 0.72)
        & ~weak(x)
        & (F.size(tokens(x["line"])) >= 2)
        & (F.lower(F.element_at(tokens(x["line"]), -1)) == tail)
        & (F.lower(F.get(tokens(x["line"]), 0)) != head),
    )
    return F.struct((F.size(near_lines) > 1).alias("near_tie"), F.transform(suffix, lambda x: x["line"]).alias("suffix"))


def orphan_left(words: Column, line: Column) -> Column:
    """Whether a short word stands just left of the line's first one, on its band (a join of words with words on nearness)."""
    return _orphan_left(words, line, words_of_line(words, line))


def _orphan_left(words: Column, line: Column, own: Column) -> Column:
    edges = F.transform(own, lambda w: parse.box_edges(w["bbox"]))
    start = let(F.array_min(F.transform(edges, lambda e: F.struct(e["left"], e["top"], e["height"]))), lambda x: F.struct(x.alias("first"), F.when(x["height"] > 0, x["height"]).otherwise(10.0).alias("height"), tokens(F.lower(line)).alias("mine")))

    def beside(x: Column, w: Column) -> Column:
        first, height = x["first"], x["height"]
        e, t = parse.box_edges(w["bbox"]), strip(w["text"])
        gap = first["left"] - (e["left"] + e["width"])
        # Short words first: hardly any word gets further.
        return (F.length(t) <= 2) & (t != "") & ~F.array_contains(x["mine"], F.lower(t)) & t.rlike(r"\p{L}") & (F.abs(e["top"] - first["top"]) <= height * 0.6) & gap.between(0, height * 1.2)

    return F.coalesce(let(start, lambda x: F.exists(words, lambda w: beside(x, w))), F.lit(False))


def brand_issues(text: Column, words: Column, width: Column, line: Column) -> Column:
    """Codes of what makes a brand reading doubtful."""
    return let(words_of_line(words, line), lambda own: _issues(words, width, line, own))


def _issues(words: Column, width: Column, line: Column, own: Column) -> Column:
    facts = let(F.transform(own, lambda w: F.struct(parse.box_edges(w["bbox"]).alias("e"), w["confidence"].alias("confidence"))), _edges)
    return let(facts, lambda x: let(strip(line), lambda s: _flags(words, width, line, s, own, x)))


def _edges(placed: Column) -> Column:
    """The first and the last word of a line by their edges, and mean height and whole width."""
    edges = F.transform(placed, lambda p: F.struct(p["e"]["left"].alias("left"), (p["e"]["left"] + p["e"]["width"]).alias("right"), p["confidence"].alias("confidence")))
    by = lambda part, sign: F.get(F.array_sort(edges, lambda a, b: F.when(a[part] * sign < b[part] * sign, -1).when(a[part] * sign > b[part] * sign, 1).otherwise(0)), 0)
    height = _mean(F.transform(placed, lambda p: p["e"]["height"]))
    total = F.aggregate(F.transform(placed, lambda p: p["e"]["width"]), F.lit(0.0), lambda a, v: a + v)
    return F.struct(by("left", 1).alias("left"), by("right", -1).alias("right"), height.alias("height"), total.alias("total"))


def _flags(words: Column, width: Column, line: Column, s: Column, own: Column, x: Column) -> Column:
    left, right, height, total = x["left"], x["right"], x["height"], x["total"]
    wide = F.coalesce(width, F.lit(800)).cast("double")
    flag = lambda code, test: F.when(F.coalesce(test, F.lit(False)), code)
    return F.array_compact(
        F.array(
            flag("ocr_artifact_symbol", s.rlike(OCR_ARTIFACT)),
            flag("edge_punctuation", s.rlike(EDGE_JUNK)),
            flag("leading_lowercase", F.substring(s, 1, 1).rlike(r"\p{Ll}") & F.substring(s, 2, 10_000).rlike(r"\p{L}")),
            flag("trailing_ocr_artifact", s.rlike(r"\s[=|_]\s*$") | s.endswith("=")),
            flag("low_confidence_leading_word", left["confidence"] < 0.5),
            flag("low_confidence_trailing_word", right["confidence"] < 0.5),
            flag("clipped_leading_edge", ((left["confidence"] < 0.55) & (left["left"] <= F.greatest(F.lit(4.0), wide * 0.02))) | (left["confidence"] < 0.35)),
            flag("clipped_trailing_edge", (right["right"] >= wide * 0.98) & (right["confidence"] < 0.55)),
            flag("left_adjacent_orphan_fragment", (F.size(own) > 0) & _orphan_left(words, line, own)),
            flag("truncated_text_box", (F.size(own) >= 2) & (height > 0) & (total < height * 1.2 * F.size(own) * 0.35)),
        )
    )


def brand(text: Column, words: Column, width: Column, height: Column, every: Column | None = None) -> Column:
    def facts(scored: Column) -> Column:
        weak = lambda x: x["weak"] < 0
        return let(F.get(scored, 0), lambda top: F.struct(top["line"].alias("line"), weak(top).alias("weak"), capped(F.transform(scored, lambda x: x["line"])).alias("seen"), _conflicts(scored, weak).alias("conflict"), clean_display(top["line"]).alias("shown")))

    def told(x: Column) -> Column:
        unsure = lambda reason: field(F.lit("UNCERTAIN"), x["line"], x["shown"], candidates=x["seen"], reason=reason)
        # What makes a reading doubtful is asked for only where nothing else has decided.
        settled = lambda issues: F.when(F.size(issues) > 0, unsure(F.array_join(issues, ","))).otherwise(field(F.lit("FOUND"), x["line"], x["shown"], candidates=x["seen"]))
        return (
            F.when(x["line"].isNull(), field(F.lit("NOT_FOUND"), reason=F.lit("brand_missing")))
            .when(x["conflict"]["near_tie"] | (F.size(x["conflict"]["suffix"]) > 0), unsure(F.lit("brand_ambiguous")))
            .when(x["weak"], unsure(F.lit("brand_weak_standalone")))
            .otherwise(let(brand_issues(text, words, width, x["line"]), settled))
        )

    return let(let(brand_scores(text, words, height, every), facts), told)


def fields(records: DataFrame, names: Sequence[str] = FIELDS) -> DataFrame:
    """The records in long form: one row per record and field of ``names``, in the fixed order of fields; other columns stay.  No other field is worked out."""
    # Each step is a projection of its own: text, words and lines are worked out once for all fields, and a field is one
    # column, so only what is within lambdas is left to Spark's interpreter.  Names that no column of the records has.
    own = lambda name: f"_extract_{name}"
    t, w, width, height, every = (F.col(own(n)) for n in ("text", "words", "width", "height", "lines"))
    kept = [F.col(f"`{c}`") for c in records.columns if c not in ("full_text", "words", "image_width_px", "image_height_px")]
    read = records.select(*kept, F.coalesce("full_text", F.lit("")).alias(own("text")), F.coalesce("words", F.array().cast(WORDS)).alias(own("words")), F.col("image_width_px").alias(own("width")), F.col("image_height_px").alias(own("height")))
    lined = read.select("*", lines(t).alias(own("lines")))
    made = {"brand_name": lambda: brand(t, w, width, height, every), "class_type": lambda: class_type(t, every), "alcohol_content": lambda: alcohol(t, w, every), "net_contents": lambda: net(t, w, every), "government_warning": lambda: warning(t, every)}
    wanted = [(i, name) for i, name in enumerate(FIELDS) if name in names]
    found = lined.select(*kept, *(made[name]().alias(own(name)) for _, name in wanted))
    each = F.array(*(F.struct(F.lit(i).alias("field_at"), F.lit(name).alias("field_name"), F.col(own(name)).alias("f")) for i, name in wanted))
    return found.select(*kept, F.explode(each).alias(own("x"))).select(*kept, *(F.col(f"{own('x')}.{n}") for n in ("field_at", "field_name", "f.*")))
