"""Rates, calendar and thresholds from YAML, refused unless complete and exact."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass
from datetime import date
from decimal import Decimal, InvalidOperation
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

METHODS = ("card", "upi", "netbanking", "wallet")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


class ConfigError(ValueError):
    pass


def _read(path: str) -> dict:
    try:
        import yaml
    except ImportError as e:  # the loader is the only part that needs it
        raise ConfigError("reading YAML needs the yaml package") from e
    found = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    _no_floats(found, path)
    return found


def _no_floats(value, at: str) -> None:
    if isinstance(value, float | date):
        raise ConfigError(f"{at}: quote numbers with a point, and dates")
    for k, v in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
        _no_floats(v, f"{at}.{k}")


def _keys(found: dict, names: tuple[str, ...], at: str) -> dict:
    if not isinstance(found, dict) or set(found) != set(names):
        raise ConfigError(f"{at}: expected {sorted(names)}, got {sorted(found) if isinstance(found, dict) else found}")
    return found


def _decimal(text, at: str) -> Decimal:
    if not isinstance(text, str):
        raise ConfigError(f"{at}: a quoted number is needed")
    try:
        value = Decimal(text)
    except InvalidOperation:
        raise ConfigError(f"{at}: {text} is no number") from None
    if not value.is_finite():
        raise ConfigError(f"{at}: {text} is not finite")
    return value


@dataclass(frozen=True)
class Rates:
    version: str
    gst: Decimal
    rates: dict[str, dict[str, Decimal]]

    @classmethod
    def load(cls, path: str) -> Rates:
        found = _keys(_read(path), ("version", "gst_rate", "profiles"), path)
        rates = {p: {m: _decimal(r, f"{p}.{m}") for m, r in _keys(_keys(x, ("methods",), p)["methods"], METHODS, p).items()} for p, x in found["profiles"].items()}
        return cls(found["version"], _decimal(found["gst_rate"], "gst_rate"), rates)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(p, m, r) for p, x in self.rates.items() for m, r in x.items()], "profile string, method string, rate decimal(6,4)")


@dataclass(frozen=True)
class Calendar:
    version: str
    timezone: str
    weekly_off: tuple[int, ...]
    holidays: tuple[str, ...]
    window: tuple[str, str]
    cycles: dict[str, int]

    @classmethod
    def load(cls, path: str) -> Calendar:
        found = _keys(_read(path), ("version", "timezone", "weekly_offs", "holidays", "simulation_window", "settlement_cycles"), path)
        window = _keys(found["simulation_window"], ("start", "end"), "simulation_window")
        try:
            off = tuple(WEEKDAYS.index(x) for x in found["weekly_offs"])
            dates = [date.fromisoformat(x) for x in (window["start"], window["end"], *found["holidays"])]
        except (ValueError, TypeError) as e:
            raise ConfigError(f"{path}: {e}") from None
        if dates[0] > dates[1] or len(set(dates[2:])) < len(dates[2:]):
            raise ConfigError(f"{path}: the window is empty or a holiday comes twice")
        if any(not isinstance(n, int) or isinstance(n, bool) or n < 0 for n in found["settlement_cycles"].values()):
            raise ConfigError(f"{path}: cycles are whole working days")
        return cls(found["version"], found["timezone"], off, tuple(found["holidays"]), (window["start"], window["end"]), dict(found["settlement_cycles"]))

    def frame(self, spark: SparkSession, margin_days: int = 60) -> DataFrame:
        from datetime import timedelta

        from ledgerloom.operators.calendar import calendar

        first, last = (date.fromisoformat(x) for x in self.window)
        return calendar(spark, str(first - timedelta(margin_days)), str(last + timedelta(margin_days)), self.holidays, self.weekly_off)


THRESHOLDS = {
    "fuzzy_utr": ("weight_prefix", "weight_edit", "weight_amount", "score_quantum", "accept_score", "min_separation", "weight_amount_no_utr", "weight_date_no_utr", "accept_score_no_utr", "date_window_days", "fragment_min_chars"),
    "tolerance": ("rounding_rupees", "verifier_rupees"),
    "confidence": ("weight_verification_passed", "weight_residual_within_tolerance", "weight_evidence_completeness", "weight_candidate_separation", "weight_freshness", "auto_confirm"),
    "hypothesis": ("max_per_exception", "llm_max_retries"),
    "safety_budgets": ("max_residual_false_match_rate", "max_gross_exposure_false_match_rupees", "max_cost_per_1000_rows_rupees"),
    "reporting": ("assumed_review_minutes_per_exception",),
}


def load_thresholds(path: str) -> dict[str, dict[str, Decimal | int]]:
    """Sections of numbers. Weights of one score add up to 1, and the score without a reference has the higher bar."""
    found = _keys(_read(path), ("version", *THRESHOLDS), path)
    out = {s: {k: v if isinstance(v, int) and not isinstance(v, bool) else _decimal(v, f"{s}.{k}") for k, v in _keys(found[s], names, s).items()} for s, names in THRESHOLDS.items()}
    fuzzy, sure = out["fuzzy_utr"], out["confidence"]
    sums = {"prefix, edit and amount": fuzzy["weight_prefix"] + fuzzy["weight_edit"] + fuzzy["weight_amount"], "amount and date": fuzzy["weight_amount_no_utr"] + fuzzy["weight_date_no_utr"], "confidence": sum(v for k, v in sure.items() if k.startswith("weight_"))}
    for name, total in sums.items():
        if total != 1:
            raise ConfigError(f"{path}: the weights of {name} add up to {total}")
    if fuzzy["accept_score_no_utr"] <= fuzzy["accept_score"]:
        raise ConfigError(f"{path}: the bar without a reference must be the higher one")
    return out


def config_hash(*parts) -> str:
    """16 hex characters over all settings, in sorted order."""
    plain = [asdict(p) if hasattr(p, "__dataclass_fields__") else p for p in parts]
    return hashlib.sha256(json.dumps(plain, sort_keys=True, default=str, separators=(",", ":")).encode()).hexdigest()[:16]
