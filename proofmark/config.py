"""Fixed values and settings of label verification."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

# Names, word lists, patterns and texts that results depend on.
FIELDS = ("brand_name", "class_type", "alcohol_content", "net_contents", "government_warning")
CHECKS = ("Brand Name", "Class / Type", "Alcohol Content / ABV", "Net Contents", "Government Health Warning")
CLASS_PHRASES = (
    "straight bourbon whiskey", "bourbon whiskey", "tennessee whiskey", "irish whiskey", "scotch whisky", "single malt",
    "blended whiskey", "blended whisky", "rye whiskey", "canadian whisky", "cognac", "armagnac", "brandy", "vodka", "gin",
    "rum", "tequila", "mezcal", "liqueur", "cordial", "neutral spirits", "grain spirits", "whiskey", "whisky",
)
CLASS_KEYWORDS = ("bourbon", "whiskey", "whisky", "vodka", "gin", "rum", "tequila", "mezcal", "brandy", "cognac", "liqueur", "scotch", "rye")
CATEGORIES = ("bourbon", "whiskey", "whisky", "vodka", "gin", "rum", "tequila", "mezcal", "brandy", "cognac", "liqueur")
WHISKEY_FAMILY = ("whiskey", "whisky", "bourbon")
WARNING_CUES = ("surgeon general", "pregnancy", "machinery", "health problems", "birth defects")
WARNING_FRAGMENTS = ("surgeon general", "birth defects", "operate machinery", "health problems", "alcoholic beverages")
STATUTORY_WARNING = (
    "GOVERNMENT WARNING: (1) According to the Surgeon General, women should not drink alcoholic beverages during pregnancy because of the risk of birth defects. "
    "(2) Consumption of alcoholic beverages impairs your ability to drive a car or operate machinery, and may cause health problems."
)
WARNING_HEADER = r"government\s+warning"
NUMBER = r"\d{1,2}(?:\.\d+)?"
BY_VOLUME = r"alc\.?/?\s*vol\.?|alcohol\s+by\s+volume"
#: Tried in order; group 1 is the whole span, group 2 the number.
ABV_PATTERNS = (
    rf"(({NUMBER})\s*%\s*(?:{BY_VOLUME}|abv)\b)",
    rf"(({NUMBER})\s*%?\s*(?:{BY_VOLUME})\b)",
    rf"((?:{BY_VOLUME}|abv)\s*[:=]?\s*({NUMBER})\s*%?)",
    rf"(alc\.?\s*({NUMBER})\s*%?\s*by\s*vol\.?\b)",
    rf"(({NUMBER})\s*%\s*(?:alc|alcohol|abv)\b)",
)
PROOF_PATTERN = r"(\(?\s*(\d{1,3}(?:\.\d+)?)\s*proof\s*\)?)"
NET_PATTERN = r"((\d+(?:\.\d+)?)\s*(m\.?\s*l\.?|ml|l\.?|liter|litre|liters|litres)\b)"
NET_BENIGN = r"[\s()\[\]{},;:/\\\-–—·•]|\d{1,3}(?:\.\d+)?\s*proof|net\s*contents?|volume|contains?"
AUTHORIZED_ABV = (
    rf"({NUMBER})\s*%\s*({BY_VOLUME})|({BY_VOLUME})\s*[:=]?\s*({NUMBER})\s*%?|({NUMBER})\s*%?\s*alcohol\s+by\s+volume|alcohol\s+({NUMBER})\s*(percent|%)\s*(by\s+)?vol"
)
SAFE_FILENAME = r"^[A-Za-z0-9._ -]+$"
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp")
SKIP_LINE = r"government\s+warning|surgeon\s+general|birth\s+defects|operate\s+machinery|alcoholic\s+beverages|health\s+problems|pregnancy|alc\.?/?\s*vol|abv|\bproof\b|\d+\s*m\.?\s*l|\d+\s*l(?:iter|itre)?s?\b"
WEAK_STANDALONE = r"^(?:the\s+)?(?:distillery|distilling\s+co\.?|distilling\s+company|brewing\s+co\.?|brewing\s+company|brewery|winery|vineyards?|spirits|liqueurs?|company|incorporated|llc|inc\.?|co\.?)$"
OCR_ARTIFACT = r"[=|_~^`<>{}\[\]\\]|/{2,}|\*{2,}"
EDGE_JUNK = r"""^[^A-Za-z0-9"']+|[^A-Za-z0-9"'.!?-]+$"""
ELIGIBLE_REASONS = (
    "BRAND_AMBIGUOUS", "CLASS_TYPE_AMBIGUOUS", "WARNING_PARTIAL", "WARNING_MISSING", "EXTRACTION_UNCERTAIN", "EXTRACTION_NOT_FOUND",
    "ABV_FORMAT_REVIEW", "PROOF_ONLY_NO_PERCENT_STATEMENT", "CONFLICTING_EVIDENCE",
)
HUMAN_ONLY_REASONS = ("FORMAT_NOT_MACHINE_VERIFIABLE", "NOT_MACHINE_VERIFIABLE", "WARNING_CAPS_REVIEW")
CITATIONS = {
    "cfr_5_63": "27 CFR § 5.63",
    "cfr_5_64": "27 CFR § 5.64",
    "cfr_5_65": "27 CFR § 5.65",
    "cfr_5_70": "27 CFR § 5.70",
    "cfr_5_subpart_i": "27 CFR Part 5 Subpart I",
    "cfr_16_21": "27 CFR § 16.21",
    "cfr_16_22": "27 CFR § 16.22",
}
MANIFEST_COLUMNS = ("filename", "brand_name", "class_type", "alcohol_content", "net_contents")
APPLICATION_LENGTHS = {"brand_name": 200, "class_type": 200, "alcohol_content": 50, "net_contents": 50}
EXPORT_COLUMNS = (
    "filename", "processing_state", "overall_status", "brand_name", "class_type", "alcohol_content", "net_contents", "brand_status",
    "class_type_status", "alcohol_content_status", "net_contents_status", "government_warning_status", "ai_assisted",
    "processing_time_ms", "review_reason_codes", "error_code", "error",
)


@dataclass(frozen=True)
class Settings:
    """Thresholds and limits; each can be set by an environment variable of its name in capitals with the prefix PROOFMARK_."""

    brand_pass: float = 95.0
    brand_review: float = 85.0
    class_pass: float = 97.0
    class_conflict: float = 70.0
    warning_fail: float = 75.0
    warning_pass: float = 92.0
    abv_epsilon: float = 0.05
    net_epsilon_ml: float = 0.5
    low_confidence: float = 0.45
    batch_max_items: int = 300
    evidence_calls: int = 25
    upload_max_bytes: int = 15 * 1024 * 1024
    min_dimension: int = 100
    max_dimension: int = 8000

    @classmethod
    def from_env(cls, file: str | None = None) -> Settings:
        """Settings from the environment and, for what it doesn't set, from a file of NAME=value lines."""
        told = (dotenv(file) if file else {}) | dict(os.environ)
        given = {f.name: told[name] for f in fields(cls) if (name := f"PROOFMARK_{f.name.upper()}") in told}
        return cls(**{k: type(getattr(cls, k))(v) for k, v in given.items()})


def dotenv(path: str) -> dict[str, str]:
    """NAME=value lines of a file; names in any case.

    Blank lines and comments are passed over, ``export`` and quotes around values are dropped, and so is
    a comment behind an unquoted value.  A file that isn't there sets nothing.
    """
    if not os.path.exists(path):
        return {}
    found = {}
    with open(path, encoding="utf-8") as lines:
        for line in lines:
            name, given, value = line.strip().removeprefix("export ").partition("=")
            if given and name.strip() and not name.startswith("#"):
                value = value.strip()
                quoted = value[:1] in "\"'" and value.find(value[:1], 1) > 0 if value else False
                found[name.strip().upper()] = value[1 : value.index(value[0], 1)] if quoted else value.split(" #", 1)[0].strip()
    return found


DEFAULT = Settings()
