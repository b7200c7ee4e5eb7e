"""Classification rules held as data (S6, C17) and the regexes they compile to."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, replace

WEIGHT_NAMES = (
    "broad_bonus",
    "strict_bonus",
    "include_keyword_hit",
    "include_cpv_hit",
    "exclude_keyword_hit",
    "exclude_cpv_hit",
    "mixed_bundle_bonus",
    "near_keyword_hit",
    "near_cpv_hit",
)

_LITERAL_START = re.compile(r"\\b([a-z0-9])(?![?*{])")
_CODE_DIGITS = 8


@dataclass(frozen=True)
class RuleSet:
    include_keyword_patterns: tuple[str, ...]
    include_cpv_prefixes: tuple[str, ...]
    exclude_keyword_patterns: tuple[str, ...]
    exclude_cpv_prefixes: tuple[str, ...]
    near_miss_keyword_patterns: tuple[str, ...]
    near_miss_cpv_prefixes: tuple[str, ...]
    weights: Mapping[str, int] = field(hash=False)
    score_min: int = 0
    score_max: int = 100
    high_threshold: int = 70
    medium_threshold: int = 45
    top_signal_count: int = 3

    def with_thresholds_of(self, other: RuleSet) -> RuleSet:
        return replace(self, high_threshold=other.high_threshold, medium_threshold=other.medium_threshold)

    def to_dict(self) -> dict:
        lists = {k: list(v) for k, v in asdict(self).items() if isinstance(v, tuple)}
        return {
            **lists,
            "scoring": {
                "scale": {"min": self.score_min, "max": self.score_max},
                "weights": dict(self.weights),
                "confidence_thresholds": {"high": self.high_threshold, "medium": self.medium_threshold},
                "top_signal_count": self.top_signal_count,
            },
        }


def rules_from_dict(data: Mapping) -> RuleSet:
    scoring = data["scoring"]
    missing = [name for name in WEIGHT_NAMES if name not in scoring["weights"]]
    if missing:
        raise ValueError(f"rule weights missing: {', '.join(missing)}")
    return RuleSet(
        include_keyword_patterns=tuple(data["include_keyword_patterns"]),
        include_cpv_prefixes=tuple(data["include_cpv_prefixes"]),
        exclude_keyword_patterns=tuple(data["exclude_keyword_patterns"]),
        exclude_cpv_prefixes=tuple(data["exclude_cpv_prefixes"]),
        near_miss_keyword_patterns=tuple(data["near_miss_keyword_patterns"]),
        near_miss_cpv_prefixes=tuple(data["near_miss_cpv_prefixes"]),
        weights={name: int(scoring["weights"][name]) for name in WEIGHT_NAMES},
        score_min=int(scoring["scale"]["min"]),
        score_max=int(scoring["scale"]["max"]),
        high_threshold=int(scoring["confidence_thresholds"]["high"]),
        medium_threshold=int(scoring["confidence_thresholds"]["medium"]),
        top_signal_count=int(scoring.get("top_signal_count", 3)),
    )


def load_rules(path: str) -> RuleSet:
    """A rule file is configuration, read once on the driver."""
    with open(path, encoding="utf-8") as handle:
        return rules_from_dict(json.load(handle))


def keyword_regex(patterns: tuple[str, ...]) -> str:
    """One alternation over all patterns, so that hits are leftmost and never overlap.

    When every pattern opens with a word boundary, the boundary is tested once
    per position instead of once per pattern, and a look-ahead on the possible
    first letters skips most positions. Matches and their order stay the same.
    """
    if patterns and all(p.startswith(r"\b") and "|" not in p for p in patterns):
        body = r"\b(?:" + "|".join(p[2:] for p in patterns) + ")"
        starts = [_LITERAL_START.match(p) for p in patterns]
        if all(starts):
            letters = "".join(sorted({m.group(1) for m in starts}))
            body = f"(?=[{letters}])" + body
        return "(?iU)" + body
    return "(?iU)" + "|".join(patterns)


def code_regex(prefixes: tuple[str, ...]) -> str | None:
    """Codes starting with any prefix; None when no prefix can match."""
    usable = [p for p in prefixes if re.fullmatch(r"[0-9]{0,8}", p)]
    if not usable:
        return None
    starts = "|".join(rf"{p}\d{{{_CODE_DIGITS - len(p)}}}" for p in usable)
    return rf"(?U)\b(?:{starts})-\d\b"


# The standard rule set.
DEFAULT_RULES = RuleSet(
    include_keyword_patterns=(
        r"\bsoftware\b",
        r"\bsoftuer\w*\b",
        r"\bsaas\b",
        r"\bweb\b",
        r"\bwebsite\b",
        r"\bfaqe\s+web\b",
        r"\bhostim\w*\b",
        r"\bhosting\b",
        r"\baplikacion\w*\b",
        r"\bapplication\w*\b",
        r"\bplatform\w*\b",
        r"\bportal\w*\b",
        r"\bdigital\w*\b",
        r"\bdixhital\w*\b",
        r"\binternet\w*\b",
        r"\bcloud\b",
        r"\bcyber\w*\b",
        r"\bantivirus\b",
        r"\bdatabaz\w*\b",
        r"\bdatabase\w*\b",
        r"\bprogram\w*\b",
        r"\bzhvillim\w*\b",
        r"\bmirembajtje\s+(?:te\s+)?software\b",
        r"\bteknologji\w*\s+te\s+informacionit\b",
        r"\binformatik\w*\b",
        r"\bit\b",
    ),
    include_cpv_prefixes=("48", "72", "5031", "50312", "5032"),
    exclude_keyword_patterns=(
        r"\briparim\w*\b",
        r"\bmirembajtje\s+dhe\s+riparim\b",
        r"\bkompjuter\w*\b",
        r"\bpajisje\w*\s+kompjuter\w*\b",
        r"\bhardware\b",
        r"\bprinter\w*\b",
        r"\blaptop\w*\b",
        r"\bserver\w*\b",
    ),
    exclude_cpv_prefixes=("5030", "5031", "5032"),
    near_miss_keyword_patterns=(
        r"\bsistem\w*\b",
        r"\belektronik\w*\b",
        r"\bautomatiz\w*\b",
        r"\brrjet\w*\b",
        r"\bteknologji\b",
    ),
    near_miss_cpv_prefixes=("302", "324", "325", "480", "722"),
    weights={
        "broad_bonus": 4,
        "strict_bonus": 8,
        "include_keyword_hit": 14,
        "include_cpv_hit": 18,
        "exclude_keyword_hit": -16,
        "exclude_cpv_hit": -22,
        "mixed_bundle_bonus": 10,
        "near_keyword_hit": 8,
        "near_cpv_hit": 10,
    },
    score_min=0,
    score_max=100,
    high_threshold=70,
    medium_threshold=45,
    top_signal_count=3,
)
