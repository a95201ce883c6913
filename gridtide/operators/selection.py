"""Ranking candidates: selection score, run selection, acceptance gate, trial leaderboard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtide.functions.layout import core_rows, halo_blocks, halo_window
from gridtide.operators.evaluate import median_of
from gridtide.session import materialize, measured

# Fixed value: the share of members that must pass every absolute check.
MIN_MEMBER_FRACTION = 0.8
# (metric, scope, limit) entries of a configuration.
Limits = Sequence[tuple[str, str, float]]
STABLE, MEMBER_MAX, OVERALL_MAX, OVERALL_MIN = "stable", "member_max", "max", "min"


def _finite(c: Column) -> Column:
    return ~(F.isnan(c) | (F.abs(c) == float("inf")))


def peak_ratio_term(peak: Column, n_steps: Column) -> Column:
    """n / (1 + log10 of the peak ratio), at most n; 0 for a non-finite one."""
    return F.when(_finite(peak), n_steps / (1.0 + F.log10(F.greatest(peak, F.lit(1.0))))).otherwise(0.0)


def stable_fraction_bonus(fraction: Column, stable_steps: Column, n_steps: Column, n_forecasts: Column) -> Column:
    return F.when(stable_steps < n_steps, 0.0).otherwise(fraction * (n_steps + 1) * n_forecasts * n_forecasts)


def selection_score(
    skill: Column,
    crps: Column,
    stable_steps: Column,
    n_steps: Column,
    peak: Column,
    fraction: Column | None = None,
    n_forecasts: Column | None = None,
) -> Column:
    """Stable steps first, then stable fraction, skill and CRPS; an unstable forecast by its peak."""
    fraction = F.lit(0.0) if fraction is None else fraction
    n_forecasts = F.lit(1) if n_forecasts is None else n_forecasts
    base = stable_steps * (n_steps + 1)
    shortfall = F.when(crps == float("inf"), 1.0).otherwise(crps / (1.0 + crps))
    return (
        F.when(F.isnan(crps), float("-inf"))
        .when(stable_steps < n_steps, base + peak_ratio_term(peak, n_steps))
        .otherwise(
            base + stable_fraction_bonus(fraction, stable_steps, n_steps, n_forecasts) + skill - shortfall
        )
    )


def selection_scores(curves: DataFrame, stable: DataFrame, threshold: float, tie_break_lead: int) -> DataFrame:
    """One row per (model, dataset) with everything the selection rule reads.

    `curves` has the CRPS per lead, `stable` one row per member.
    """
    key = ["model", "dataset"]
    above = F.min(F.when(~(F.col("crps") <= threshold), F.col("lead")))
    curve = curves.groupBy(*key).agg(
        F.max("lead").alias("forecast_steps"),
        F.coalesce(above - 1, F.max("lead")).cast("int").alias("skill_horizon"),
        # The tie-break lead, or the last one of a shorter forecast.
        F.max_by("crps", F.when(F.col("lead") <= tie_break_lead, F.col("lead"))).alias("tie_break_crps"),
    )
    # greatest ranks NaN highest, so a member with one NaN ratio has a NaN peak.
    members = stable.withColumn("peak", F.greatest("energy_peak_ratio", "enstrophy_peak_ratio"))
    medians = members.groupBy(*key).agg(
        *[
            median_of(F.collect_list(c)).alias(c)
            for c in ("stable_steps", "energy_peak_ratio", "enstrophy_peak_ratio", "peak")
        ],
        F.count("*").cast("double").alias("members"),
        F.count_if(F.col("stable_steps") >= F.col("forecast_steps")).cast("double").alias("stable_members"),
    )
    table = curve.join(medians, key)
    score = selection_score(
        F.col("skill_horizon"), F.col("tie_break_crps"), F.col("stable_steps"), F.col("forecast_steps"), F.col("peak")
    )
    return table.withColumn("selection_score", score)


def run_selection(validations: DataFrame, neighbors: int) -> DataFrame:
    """Per validation (run, idx): window, pooled stable fraction, settled flag, score, best flag.

    A validation is judged with the 2m+1 nearest, shifted inward at the run's ends. Blocks of indices with a halo hold every
    window, so a long run is no single group, and no window becomes rows.
    """
    if neighbors < 0:
        raise ValueError(f"neighbors must be >= 0, got {neighbors}")
    size = 2 * neighbors + 1
    kept = validations.where("run IS NOT NULL AND idx IS NOT NULL")
    lengths = measured(kept.groupBy("run").agg((F.max("idx") + 1).alias("len")), "lengths")
    m = F.least(F.lit(size), F.col("len"))
    start = F.least(F.greatest(F.col("idx") - neighbors, F.lit(0)), F.col("len") - m)
    read = kept.select("run", "idx", "stable_members", "members", "selection_score", "stable_steps", "forecast_steps")
    reach = halo_window(["run"], "idx").rangeBetween(1 - size, size - 1)
    near = F.collect_list(F.struct(F.col("idx").alias("near"), "stable_members", "members")).over(reach)
    placed = core_rows(halo_blocks(read, "idx", size - 1, size - 1).withColumn("_near", near))
    placed = placed.join(lengths, "run").withColumn("start", start).withColumn("m", m)
    votes = F.filter("_near", lambda v: v["near"].between(F.col("start"), F.col("start") + F.col("m") - 1))

    def total(name: str) -> Column:
        known = F.filter(F.transform(votes, lambda v: v[name].cast("double")), lambda v: v.isNotNull())
        return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, v: s + v))

    pooled = placed.withColumn("stable_fraction", total("stable_members") / total("members")).drop("_near")
    bonus = stable_fraction_bonus(
        F.col("stable_fraction"), F.col("stable_steps"), F.col("forecast_steps"), size * F.col("members")
    )
    score = F.col("selection_score") if neighbors == 0 else F.col("selection_score") + bonus
    scored = pooled.select(
        "run", "idx", "start", "m", "stable_fraction",
        (F.col("len") >= F.greatest(F.lit(size), F.col("idx") + neighbors + 1)).alias("settled"),
        score.alias("score"),
    )
    scored = materialize(scored, "scored")
    best = scored.groupBy("run").agg(F.max_by("idx", F.struct("score", -F.col("idx"))).alias("_best"))
    return scored.join(best, "run").withColumn("best", F.col("idx") == F.col("_best")).drop("_best")


def _over(scores: DataFrame, limits: Limits, scope: str, keys: list[str]) -> DataFrame:
    """Broken limits of one scope: every subject against every limit, missing or NaN fails."""
    bounds = [(metric, limit) for metric, where, limit in limits if where == scope]
    entry = lambda metric, limit: F.struct(F.lit(metric).alias("metric"), F.lit(float(limit)).alias("limit"))
    subjects = scores.select(*keys).distinct()
    wanted = (
        subjects.select(*keys, F.explode(F.array(*[entry(*b) for b in bounds])).alias("b"))
        if bounds
        else subjects.select(*keys, F.struct(F.lit("").alias("metric"), F.lit(0.0).alias("limit")).alias("b")).limit(0)
    ).select(*keys, "b.metric", "b.limit")
    found = wanted.join(scores.select(*keys, "metric", "value"), [*keys, "metric"], "left")
    kept = F.col("value") >= F.col("limit") if scope == OVERALL_MIN else F.col("value") <= F.col("limit")
    broken = F.col("value").isNull() | F.isnan("value") | ~kept
    return found.filter(broken).select(*keys, F.lit(scope).alias("check"), "metric", "value", "limit")


def members(member_scores: DataFrame, rollouts: DataFrame) -> DataFrame:
    """(model, member) of either side: a member without scores or without a rollout counts, and is broken."""
    keys = ["model", "member"]
    return member_scores.select(*keys).unionByName(rollouts.select(*keys)).distinct()


def member_failures(
    member_scores: DataFrame, rollouts: DataFrame, limits: Limits, scored_steps: int, rollout_steps: int
) -> DataFrame:
    """(model, member, check, metric, value, limit): why a member is broken."""
    keys = ["model", "member"]
    def unstable(rows, steps, name):
        return rows.filter(F.col("value").isNull() | F.isnan("value") | ~(F.col("value") >= steps)).select(
            *keys, F.lit(STABLE).alias("check"), F.lit(name).alias("metric"), "value",
            F.lit(float(steps)).alias("limit"),
        )
    subjects = members(member_scores, rollouts)
    forecast = subjects.join(
        member_scores.filter("metric = 'stable_steps'").select(*keys, "value"), keys, "left"
    )
    rolled = rollouts.select(*keys, F.col("stable_steps").alias("value"))
    return (
        unstable(forecast, scored_steps, "validation forecast")
        .unionByName(unstable(subjects.join(rolled, keys, "left"), rollout_steps, "rollout"))
        .unionByName(_over(member_scores, limits, MEMBER_MAX, keys))
    )


def gate(
    scores: DataFrame,
    member_scores: DataFrame,
    rollouts: DataFrame,
    limits: Limits,
    scored_steps: int,
    rollout_steps: int,
    min_fraction: float = MIN_MEMBER_FRACTION,
) -> DataFrame:
    """(model, members, usable, failed_limits, passed, reasons).

    `scores` and `member_scores` are long (model[, member], metric, value), `rollouts` one row per
    member, `limits` a list of (metric, scope, limit) with scope max, min or member_max, as configured.
    """
    broken = member_failures(member_scores, rollouts, limits, scored_steps, rollout_steps)
    reason = F.concat(
        F.lit("member "), F.col("member").cast("string"), F.lit(": "), F.col("check"), F.lit(" "), F.col("metric")
    )
    told = broken.groupBy("model").agg(F.array_sort(F.collect_set(reason)).alias("member_reasons"))
    bad = broken.select("model", "member").distinct().withColumn("bad", F.lit(1))
    usable = (
        members(member_scores, rollouts)
        .join(bad, ["model", "member"], "left")
        .groupBy("model")
        .agg(F.count("*").alias("members"), F.count_if(F.col("bad").isNull()).alias("usable"))
    )
    overall = _over(scores, limits, OVERALL_MAX, ["model"]).unionByName(
        _over(scores, limits, OVERALL_MIN, ["model"])
    ).groupBy("model").agg(
        F.count("*").alias("failed_limits"),
        F.array_sort(F.collect_set(F.concat_ws(" ", "check", "metric"))).alias("limit_reasons"),
    )
    enough = F.col("usable") >= min_fraction * F.col("members")
    none = F.array().cast("array<string>")
    reasons = F.concat(
        F.when(enough, none).otherwise(F.coalesce("member_reasons", none)), F.coalesce("limit_reasons", none)
    )
    return usable.join(told, "model", "left").join(overall, "model", "left").select(
        "model", "members", "usable",
        F.coalesce("failed_limits", F.lit(0)).alias("failed_limits"),
        (enough & F.col("failed_limits").isNull()).alias("passed"),
        F.concat_ws("; ", reasons).alias("reasons"),
    )


def leaderboard(trials: DataFrame, reports: DataFrame, params: list[str]) -> DataFrame:
    """One row per trial: params, validations, score and stable fraction of its best validation,
    its last score, whether it ended with an error; best first, unscored last."""
    facts = reports.groupBy("trial").agg(
        F.count("score").alias("validations"),
        F.max("score").alias("best_score"),
        F.max_by("stable_fraction", F.struct("score", -F.col("idx"))).alias("stable_fraction"),
        F.max_by("score", F.when(F.col("score").isNotNull(), F.col("idx"))).alias("last_score"),
    )
    return (
        trials.select("trial", *params, "error")
        .join(facts, "trial", "left")
        .withColumn("validations", F.coalesce("validations", F.lit(0)))
        .orderBy(F.desc_nulls_last("best_score"), "trial")
    )
