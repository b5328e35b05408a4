"""Feature blocks over a request, its entity and what was asked for; and rules that score them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.functions import scalars as X


def prefixed(df: DataFrame, prefix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """All columns but the kept ones renamed with a prefix, before a join."""
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns if c not in keep})


def amount_features(df: DataFrame, lo: str, hi: str, value: str, name: str) -> DataFrame:
    """Midpoint, width, log, direction and distance of a value against an interval."""
    low, high, v = F.col(lo), F.col(hi), F.col(value)
    mid = (low + high) / 2
    return df.withColumns(
        {
            f"{name}_mid": mid,
            f"{name}_width": high - low,
            f"{name}_log": F.log1p(F.greatest(v, F.lit(0.0))),
            f"{name}_ratio": X.safe_ratio(v, mid),
            f"{name}_direction": F.when(v.isNull() | mid.isNull(), X.UNKNOWN).when(v < low, "below").when(v > high, "above").otherwise("inside"),
            f"{name}_distance": X.interval_distance(v, low, high),
            f"{name}_state": X.budget_state(v.isNotNull(), low, high),
        }
    )


def calendar_features(df: DataFrame, time: str) -> DataFrame:
    t = F.col(time)
    return df.withColumns({"hour": F.hour(t), "weekday": F.weekday(t), "day_name": F.date_format(t, "EEEE"), "month": F.month(t), "is_weekend": F.weekday(t) >= 5})


def gated(applies: Column, value: Column) -> Column:
    """A category's value, or a placeholder where it cannot apply."""
    return F.when(applies, F.coalesce(value.cast("string"), F.lit(X.UNKNOWN))).otherwise(X.NOT_APPLICABLE)


def gated_number(applies: Column, value: Column) -> Column:
    """0 where a number cannot apply, null where it applies and is unknown."""
    return F.when(~applies, F.lit(0.0)).otherwise(value.cast("double"))


def interaction_flag(*conditions: Column) -> Column:
    """1 where all conditions are known to hold."""
    out = F.lit(True)
    for c in conditions:
        out = out & F.coalesce(c, F.lit(False))
    return out.cast("int")


def derived_mode(rent: Column, sale: Column) -> Column:
    """What is wanted, from which amounts are given."""
    return F.when(rent.isNotNull() & sale.isNotNull(), "both").when(rent.isNotNull(), "rent").when(sale.isNotNull(), "sale")


def rule_score(*points: tuple[float, Column]) -> Column:
    """Weighted share of the rules that hold; unknown ones do not."""
    total = sum(w for w, _ in points)
    return sum((F.when(F.coalesce(c, F.lit(False)), F.lit(float(w))).otherwise(F.lit(0.0)) for w, c in points), F.lit(0.0)) / total


def shifted_odds(base_rate: Column, points: Column, step: float = 0.3, neutral: float = 2.0) -> Column:
    """Base-rate odds moved by a step a point over the neutral number."""
    p = X.clip(base_rate, 1e-6, 1 - 1e-6)
    return 1 / (1 + F.exp(-(F.log(p / (1 - p)) + step * (points - neutral))))


def best_by_stage(scores: DataFrame, stage: str, model: str, metric: str) -> DataFrame:
    """The best model of each stage; the first name on ties."""
    best = F.min(F.struct((-F.col(metric)).alias("m"), F.col(model).alias("model")))
    return scores.groupBy(stage).agg(best.alias("b")).select(stage, F.col("b.model").alias(model), (-F.col("b.m")).alias(metric))


def intake_features(df: DataFrame, mode: str, budgets: dict[str, tuple[str, str]], places: list[str], core: list[str], size: str) -> DataFrame:
    """What a request says before any contact: for each mode's budget its state, midpoint and width; whether bounds are consistent,
    how specific the place is, how many constraints there are, how complete the request is, and the log of the size.

    `budgets` maps a mode (or "both") to its lower and upper bound; `core` are the fields that always apply.
    """
    out, consistent, constraints, rated = {}, F.lit(True), F.lit(0), [(F.lit(True), F.col(c)) for c in core]
    for kind, (lo, hi) in budgets.items():
        applies = F.coalesce(F.col(mode).isin(kind, "both"), F.lit(False))
        low, high, some = F.col(lo), F.col(hi), F.coalesce(F.col(lo), F.col(hi))
        out |= {f"{kind}_applies": applies, f"{kind}_state": X.budget_state(applies, low, high), f"{kind}_mid": (low + high) / 2, f"{kind}_width": high - low}
        consistent &= ~applies | low.isNull() | high.isNull() | (low <= high)
        constraints += (applies & some.isNotNull()).cast("int")
        rated.append((applies, some))
    present = lambda names: sum((F.col(c).isNotNull().cast("int") for c in names), F.lit(0))
    out |= {
        "bounds_consistent": consistent,
        "place_specificity": present(places),
        "constraint_count": constraints + present([size, *places]),
        "completeness": X.completeness(rated),
        "log_size": F.log1p(F.greatest(F.col(size).cast("double"), F.lit(0.0))),
    }
    return df.withColumns(out)


def change_features(df: DataFrame, mode: str, wanted: str, size: str, message: str, budgets: dict[str, tuple[str, str, str]], core: list[str], before: str, near: float = 0.05, material: float = 0.10) -> DataFrame:
    """What an enquiry says over what was known at intake.

    `budgets` maps a mode (or "both") to the bounds of the intake and the amount asked now. For each: state of the amount, whether it lies inside
    (null if anything is unknown), its ratio to the middle and its distance from the bounds. Sizes asked and wanted give ratio, gap, its log, and
    a direction, SAME within `near` or unknown. Amounts are consistent with the mode if no other mode's is given, or some is where both are
    wanted; an unknown mode is not. `need_changes` counts a size off by more than `material` and each amount that applies and lies outside;
    completeness over `core` and the amounts that apply, and its gain over the column `before`.
    """
    ratio = X.safe_ratio(F.col(size), F.col(wanted))
    gap = F.abs(F.col(size).cast("double") - F.col(wanted))
    holds = lambda c: F.coalesce(c, F.lit(False))
    out, rated = {}, [(F.lit(True), F.col(c)) for c in core]
    changes = holds(F.abs(ratio - 1) > material).cast("int")
    consistent = F.when(F.col(mode) == "both", F.coalesce(*[F.col(asked) for _, _, asked in budgets.values()]).isNotNull())
    for kind, (lo, hi, asked) in budgets.items():
        applies = holds(F.col(mode).isin(kind, "both"))
        low, high, now = F.col(lo), F.col(hi), F.col(asked)
        inside = X.within_interval(now, low, high)
        out |= {
            f"{kind}_asked_state": F.when(~applies, "NOT_APPLICABLE").when(now.isNull(), "UNKNOWN").otherwise("OBSERVED"),
            f"{kind}_asked_inside": inside,
            f"{kind}_asked_ratio": X.safe_ratio(now, (low + high) / 2),
            f"{kind}_asked_distance": X.interval_distance(now, low, high),
        }
        changes += (applies & holds(~inside)).cast("int")
        rated.append((applies, now))
        others = [F.col(o) for k, (_, _, o) in budgets.items() if k != kind]
        consistent = consistent.when(F.col(mode) == kind, F.coalesce(*others).isNull() if others else F.lit(True))
    complete = X.completeness(rated)
    out |= {
        "size_ratio": ratio,
        "size_gap": gap,
        "log_size_gap": F.log1p(gap),
        "size_direction": F.when(ratio < 1 - near, "LOWER").when(ratio > 1 + near, "HIGHER").otherwise("SAME"),
        "log_asked_size": F.log1p(F.greatest(F.col(size).cast("double"), F.lit(0.0))),
        "log_message": F.log1p(F.greatest(F.col(message).cast("double"), F.lit(0.0))),
        "mode_consistent": consistent.otherwise(False),
        "asked_completeness": complete,
        "completeness_gain": complete - F.col(before),
        "need_changes": changes,
    }
    return df.withColumns(out)


def density_features(df: DataFrame, counts: dict[str, float], area: str) -> DataFrame:
    """log1p of each count and its density per so many units of area; null without a positive area."""
    size = F.when(F.col(area) > 0, F.col(area).cast("double"))
    logs = {f"log_{c}": F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))) for c in counts}
    return df.withColumns(logs | {f"{c}_per_{int(per)}": F.col(c) / size * per for c, per in counts.items()})


def level_bucket(applies: Column, value: Column, edges: tuple[float, ...] = (0, 3, 10), names: tuple[str, ...] = ("ground", "low", "mid", "high")) -> Column:
    """The name of the right-closed bucket; placeholders for unknown values and where it cannot apply."""
    out = F.when(~F.coalesce(applies, F.lit(False)), X.NOT_APPLICABLE).when(value.isNull(), X.UNKNOWN)
    for edge, name in zip(edges, names):
        out = out.when(value <= edge, name)
    return out.otherwise(names[-1])


def match_features(df: DataFrame, pairs: dict[str, tuple[str, str]], item: str, budgets: dict[str, tuple[str, str]]) -> DataFrame:
    """Whether wanted and offered values agree (null without an item or a wish), and for each budget its ratio to the cost and its headroom."""
    out = {f"same_{k}": F.when(F.col(item).isNotNull() & F.col(a).isNotNull(), F.coalesce(F.col(a).cast("string") == F.col(b).cast("string"), F.lit(False)).cast("int")) for k, (a, b) in pairs.items()}
    for k, (budget, cost) in budgets.items():
        out |= {f"{k}_budget_ratio": X.safe_ratio(F.col(budget), F.col(cost)), f"{k}_headroom": X.safe_ratio(F.col(budget) - F.col(cost), F.col(budget))}
    return df.withColumns(out)
