"""The gate that a forecast has to pass before it is shown: every check must hold, and anything unknown fails."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import present

#: Fixed thresholds; those that are None have to be set before anything passes.
THRESHOLDS = {"ece_max": None, "min_class_samples": None, "min_folds": 3, "min_effective_n": 20 * 2 * 22, "min_effective_test_n": 250, "min_test_span_days": 60, "min_regime_days": 30, "min_delisted_coverage": 0.9}


def _number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)


def evaluate_gate(report: dict | None, thresholds: dict | None = None) -> tuple[bool, list[str]]:
    """(passed, reasons) of a report with ``folds`` (bss each), ``pooled``, ``random_p95``, ``leak`` and ``universe``."""
    t = THRESHOLDS | (thresholds or {})
    try:
        reasons = _reasons(report, t)
    except Exception as e:  # noqa: BLE001 - a broken report must not pass
        reasons = [f"report could not be judged: {e}"]
    return not reasons, reasons


def _reasons(report: dict | None, t: dict) -> list[str]:
    if not report or not isinstance(report.get("pooled"), dict) or not isinstance(report.get("folds"), list):
        return ["report absent or incomplete"]
    p, p95 = report["pooled"], report.get("random_p95")
    out = [f"limit {k} has no number" for k, v in t.items() if not _number(v)]

    def check(name: str, ok) -> None:
        value = p.get(name)
        if not _number(value):
            out.append(f"{name} missing")
        elif not ok(value):
            out.append(f"{name} {value} fails")

    if not _number(p95):
        out.append("random-feature baseline missing")
    check("bss", lambda v: _number(p95) and v > max(0.0, p95))
    check("residual_bss", lambda v: v > 0)
    check("ece", lambda v: _number(t["ece_max"]) and v < t["ece_max"])
    for name, key in (("effective_n", "min_effective_n"), ("effective_test_n", "min_effective_test_n"), ("test_span_days", "min_test_span_days")):
        check(name, lambda v, key=key: _number(t[key]) and v >= t[key])
    counts = p.get("class_counts") or []
    if len(counts) < 2 or not all(map(_number, counts)):
        out.append("class counts missing")
    elif min(counts) < max(1, t["min_class_samples"] or 1):
        out.append("a class has too few test samples")
    if len(report["folds"]) < (t["min_folds"] or 1):
        out.append("too few folds")
    out += [f"fold {i} bss fails" for i, b in enumerate(report["folds"]) if not _number(b) or b <= 0]
    regimes = p.get("regime_days") or {}
    for axis in ("trend", "vol"):
        for b in ("low", "high"):
            n = (regimes.get(axis) or {}).get(b)
            if not _number(n) or n < (t["min_regime_days"] or math.inf):
                out.append(f"regime {axis} {b} not covered")
    u = report.get("universe") or {}
    known, got, gone = u.get("identified"), u.get("obtained"), u.get("unobtained")
    if not _number(known) or not _number(got) or not 0 <= got <= known or known < 1:
        out.append("training universe not stated")
    else:
        if got == 0 or got / known < (t["min_delisted_coverage"] or math.inf):
            out.append("too few delisted contracts")
        if not isinstance(gone, list) or len(gone) != known - got or any(not g.get("symbol") or not (g.get("reason") or "").strip() for g in gone):
            out.append("unobtained contracts not explained")
    if report.get("leak") != "clean":
        out.append(f"shuffled-label control is {report.get('leak') or 'missing'}")
    return out


REGIMES = ("trend_low", "trend_high", "vol_low", "vol_high")


def reasons(thresholds: dict | None = None) -> Column:
    """The same as an expression over rows of reports: all reasons against each, in order; none passes without every threshold.

    Columns: ``bss, random_p95, residual_bss, ece, class_counts`` and ``folds`` (arrays), ``effective_n, effective_test_n, test_span_days, same_cutpoints, sampling_days``, the
    days of ``REGIMES``, ``identified, obtained, listed`` and ``unexplained`` delisted contracts, and ``leak``. What is null or NaN counts as missing.
    """
    t = THRESHOLDS | (thresholds or {})
    c = lambda name: F.when(~F.isnan(name), F.col(name))
    unset = [(F.lit(not _number(v)), f"limit {k} has no number") for k, v in t.items()]
    limit = {k: F.lit(v if _number(v) else None).cast("double") for k, v in t.items()}

    def needed(name: str, text: str, low: str, ok: Column) -> list[tuple[Column, str]]:
        return [(c(name).isNull(), f"{text} missing"), (~ok, f"{text} {low}")]

    counts = F.col("class_counts")
    least, folds = F.array_min(counts), F.col("folds")
    worst = F.array_min(F.filter(folds, lambda b: b.isNotNull()))
    known, got = F.col("identified"), F.col("obtained")
    stated = (known >= 1) & (got >= 0) & (got <= known)
    sound = F.coalesce(stated, F.lit(False))
    bins = [x for b in REGIMES for x in needed(b, f"regime {b.replace('_', ' ')}", "thin", c(b) >= limit["min_regime_days"])]
    return present(
        *unset, (c("random_p95").isNull(), "baseline missing"), (c("bss").isNull(), "skill missing"), (~(c("bss") > F.greatest(F.lit(0.0), c("random_p95"))) & c("random_p95").isNotNull(), "skill below baseline"),
        (c("residual_bss").isNull(), "residual skill missing"), (~(c("residual_bss") > 0), "residual skill not positive"), (c("ece").isNull(), "calibration missing"), (~(c("ece") < limit["ece_max"]), "calibration error high"),
        (counts.isNull() | (F.size(counts) < 2) | F.exists(counts, lambda n: n.isNull()), "class counts missing"), (least < 1, "class without samples"), ((least >= 1) & (least < limit["min_class_samples"]), "class too small"),
        (F.size(folds) < limit["min_folds"], "too few folds"), (F.exists(folds, lambda b: b.isNull()), "fold skill missing"), (~(worst > 0) & ~F.exists(folds, lambda b: b.isNull()), "fold skill not positive"),
        *needed("effective_n", "training sample", "small", c("effective_n") >= limit["min_effective_n"]), *needed("effective_test_n", "test sample", "small", c("effective_test_n") >= limit["min_effective_test_n"]),
        *needed("test_span_days", "test span", "short", c("test_span_days") >= limit["min_test_span_days"]), (~F.coalesce("same_cutpoints", F.lit(False)), "regimes of other cutpoints"), (F.coalesce("sampling_days", F.lit(0)) != 1, "test days not daily"),
        *[x for x in bins if x[1].endswith("missing")], *[x for x in bins if x[1].endswith("thin")], (~sound, "universe not stated"), (sound & (got / known < limit["min_delisted_coverage"]), "delisted too few"),
        (sound & (F.col("listed") != known - got), "unobtained not listed"), (sound & (F.col("listed") == known - got) & (F.col("unexplained") > 0), "unobtained unexplained"), (~F.coalesce(F.col("leak") == "clean", F.lit(False)), "control not clean"),
    )
