"""Layout helpers: bounded groups for ordered work, exact quantiles without a global sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridtide.session import measured

HALO_BLOCK = 4096


def halo_blocks(df: DataFrame, order: str, before: int, after: int, block: int = HALO_BLOCK):
    """Copy each row into every block of `order` whose rows can see it.

    A row at position p is seen by positions p - after .. p + before. Ordered windows over
    (keys, _block) then stay bounded however long one series is; keep only `_core` rows after.
    """
    if block < 1:
        raise ValueError(f"block must be >= 1, got {block}")
    p = F.col(order)
    first = F.floor((p - after) / F.lit(block)).cast("long")
    last = F.floor((p + before) / F.lit(block)).cast("long")
    home = F.floor(p / F.lit(block)).cast("long")
    return df.withColumn("_block", F.explode(F.sequence(first, last))).withColumn(
        "_core", F.col("_block") == home
    )


def halo_window(keys: Sequence[str], order: str):
    return Window.partitionBy(*keys, "_block").orderBy(order)


def core_rows(df: DataFrame) -> DataFrame:
    return df.filter("_core").drop("_core", "_block")


def channels(field: DataFrame, *keep: str) -> DataFrame:
    """Long form: one row per cell and channel, columns (*keep, channel, u)."""
    return field.select(
        *keep, F.expr("stack(2, 'u_x', u_x, 'u_y', u_y) as (channel, u)")
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], buckets: int = 1024, small: int = 1 << 16
) -> DataFrame:
    """Exact linear-interpolation quantiles per key, rows (*keys, prob, quantile).

    Equal values are counted first, so ties cost one row. A wanted rank lies in a range of values, at first all of them.
    A range of more than `small` different values is cut in buckets, and the rank's range becomes what its bucket holds,
    from its least to its largest value. A range over many magnitudes is cut by magnitude first, so outliers cost one
    round. Only the values of small ranges are ranked; nothing orders a whole group.
    """
    keys = list(keys)
    counts = measured(
        df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n")), "counts"
    )
    facts = (F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_rows"), F.count("*").alias("_values"), F.min(F.when(F.col("_v") != 0, F.abs("_v"))).alias("_least"))
    spans = counts.groupBy(*keys).agg(*facts)
    want = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("prob"), (F.lit(float(p)) * (F.col("_rows") - 1)).alias("_pos")) for p in probs]))
    placed = spans.withColumn("_w", want).select(*keys, "_lo", "_hi", "_values", "_least", "_w.prob", "_w._pos", F.lit(0).cast("bigint").alias("_start"))
    ranks = F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos"))))
    targets = measured(placed.withColumn("_rank", ranks), "ranks")
    while True:
        wide = (F.col("_values") > small) & (F.col("_hi") > F.col("_lo"))
        if targets.where(wide).isEmpty():
            break
        ranges = measured(targets.where(wide).select(*keys, "_lo", "_hi", "_start", "_least").distinct(), "ranges")
        inside = counts.join(ranges, keys).where("_v BETWEEN _lo AND _hi")
        ends = F.abs("_lo"), F.abs("_hi")
        far = (F.col("_lo") < 0) & (F.col("_hi") > 0) | (F.greatest(*ends) / buckets > F.least(*ends))
        # Magnitudes over the least one with their sign, zero between them; or halves, as a difference of large numbers may be none.
        size = lambda c: F.when(F.col(c) == 0, 0.0).otherwise(F.signum(c) * (F.ln(F.abs(c)) - F.ln("_least") + 1))
        at = lambda c: F.when(far, size(c)).otherwise(F.col(c) / 2)
        share = (at("_v") - at("_lo")) / (at("_hi") - at("_lo"))
        bucket = F.least(F.floor(share * buckets), F.lit(buckets - 1)).alias("_b")
        per = inside.groupBy(*keys, F.col("_lo").alias("_from"), "_start", bucket).agg(*facts)
        run = Window.partitionBy(*keys, "_from").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
        per = per.withColumn("_end", F.col("_start") + F.sum("_rows").over(run)).select(
            *keys, "_from", "_lo", "_hi", "_values", "_least", (F.col("_end") - F.col("_rows")).alias("_start"), "_end"
        )
        narrowed = (
            targets.where(wide).select(*keys, F.col("_lo").alias("_from"), "prob", "_pos", "_rank")
            .join(per, [*keys, "_from"]).where("_rank >= _start AND _rank < _end").select(targets.columns)
        )
        targets = measured(targets.where(~wide).unionByName(narrowed), "ranks")
    ranges = targets.select(*keys, "_lo", "_hi", "_start").distinct()
    within = Window.partitionBy(*keys, "_lo").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.join(ranges, keys).where("_v BETWEEN _lo AND _hi").withColumn("_cum", F.col("_start") + F.sum("_n").over(within))
    hits = targets.select(*keys, "_lo", "prob", "_pos", "_rank").join(
        ranked.select(*keys, "_lo", "_v", "_n", "_cum"), [*keys, "_lo"]
    ).where("_rank < _cum AND _rank >= _cum - _n")
    frac = F.max("_pos") - F.floor(F.max("_pos"))
    low = F.min_by("_v", "_rank")
    high = F.max_by("_v", "_rank")
    return hits.groupBy(*keys, "prob").agg((low + (high - low) * frac).alias("quantile"))
