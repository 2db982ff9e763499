"""Personal data: patterns propose spans, validators confirm them, context words adjust the score.

Four base kinds (email, ip, card, phone) are always reported once their
validator accepts them.  The method adds kinds that need a mod-97 checksum
(iban) or supporting context (ssn), where their score allows.  All offsets are code points, end exclusive.

Null texts count as empty.  Empty texts have no spans.  Repeated rows are
handled one by one, so equal texts get equal spans.  Every pattern runs in time
linear in the text: each consumes the whole run that it starts in.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from . import common

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]

# Each pattern takes a whole run even where the kind's own pattern fails, so no run is scanned twice.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)?")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){0,3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}")
# The length of each country's account numbers, by the public registry.
COUNTRIES = """
AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28
HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25
QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20
""".split()
WHOLE = {c[:2]: re.compile(rf"[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{{int(c[2:]) - 4}}}(?![A-Za-z0-9])") for c in COUNTRIES}
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
DIGIT = re.compile(r"[0-9]")
DOTTED = re.compile(r"[0-9]\.[0-9]")
PUNCTUATION = str.maketrans("", "", " -")

#: Score of a confirmed span without context, and how far context words move it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.7, "ssn": 0.3}
STEP = 0.25
#: Added kinds are reported from this score on.
LEAST = 0.5
#: Code points on either side of a span in which context words count.
NEAR = 48
FOR = {
    "email": ("mail", "contact", "write", "reply"),
    "ip": ("ip", "host", "server", "login", "address"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "contact"),
    "iban": ("iban", "account", "bank", "transfer", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
}
AGAINST = ("version", "release", "isbn", "example", "sample", "order", "serial", "part")
WORD = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    for d in digits[-2::-2]:
        twice = 2 * int(d)
        total += twice - 9 if twice > 9 else twice
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def small(part: str) -> bool:
    """Whether a run of digits is at most 255, however many leading zeros it has."""
    bare = part.lstrip("0")
    return len(bare) < 3 or len(bare) == 3 and bare <= "255"


def score(text: str, kind: str, start: int, end: int) -> float:
    near = set(WORD.findall(f"{text[max(0, start - NEAR) : start]} {text[end : end + NEAR]}".lower()))
    moved = PRIOR[kind] + STEP * any(w in near for w in FOR[kind]) - STEP * any(w in near for w in AGAINST)
    return round(min(1.0, max(0.0, moved)), 2)


def ibans(text: str) -> Iterator[re.Match]:
    """Account numbers of their country's length that pass the checksum, whatever follows after a space."""
    for m in IBAN.finditer(text):
        whole = WHOLE[m[1]].match(text, m.start()) if m[1] in WHOLE else None
        if whole and mod97(whole[0].replace(" ", "")):
            yield whole


def find(text: str) -> list[tuple[int, int, int, float]]:
    """All spans as (start, kind's place in KINDS, end, score), in that order."""
    found = []
    if "@" in text:
        found += [(m.start(), 0, m.end()) for m in EMAIL.finditer(text) if m[1]]
    if DIGIT.search(text):
        if DOTTED.search(text):
            found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if m[0].count(".") == 3 and all(map(small, m[0].split(".")))]
        for m in CARD.finditer(text):
            digits = m[0].translate(PUNCTUATION)
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
        more = [(m.start(), 4, m.end()) for m in ibans(text)]
        more += [(m.start(), 5, m.end()) for m in SSN.finditer(text) if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000"]
        if more:
            taken = common.meets([(a, b) for a, _, b in found])
            found += [x for x in more if score(text, KINDS[x[1]], x[0], x[2]) >= LEAST and not taken(x[0], x[2])]
    return [(a, k, b, score(text, KINDS[k], a, b)) for a, k, b in sorted(found)]


def mask(text: str) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans are replaced once."""
    out, at = [], 0
    for a, k, b, _ in find(text):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string, scores string, masked string"


def detect(docs: DataFrame, masked: bool = False) -> DataFrame:
    """Spans, counts and scores of each document's text; with ``masked`` also the text without them (else null).

    One pass, no shuffle.  Null text: as an empty text.
    """

    def rows(batches) -> Iterator[list[tuple]]:
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                spans = find(text)
                base = [f"{KINDS[k]}:{a}:{e}" for a, k, e, _ in spans if k < len(BASE)]
                n = [sum(k == i for _, k, _, _ in spans) for i in range(len(BASE))]
                out.append((doc_id, *n, len(spans) - len(base), hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e, _ in spans), ",".join(f"{s:.2f}" for *_, s in spans), mask(text) if masked else None))
            yield out

    return common.map_rows(common.texts_of(docs), rows, SCHEMA)
