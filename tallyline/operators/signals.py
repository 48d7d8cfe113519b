"""Z-scores against peers and signals built of them; tagged weekly sums; trend lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import clip, mean, measure, rounded, std_samp, sums_are_exact, total


def zscores(df: DataFrame, *, within: list[str], measures: list[str], flat: float | None = 1.0) -> DataFrame:
    """Adds <m>_z: (m - mean) / sample deviation of the group. A null or zero deviation counts as ``flat``, or gives null.
    An aggregate joined back, not a window: a few large groups would make a few large tasks."""
    keys = [F.col(k).alias(f"__{k}") for k in within]
    stats = df.groupBy(*keys).agg(*[x for m in measures for x in (mean(m).alias(f"__{m}_mean"), std_samp(m).alias(f"__{m}_std"))])
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in within]
    joined = df.join(stats, on)

    def spread(m: str) -> Column:
        s = F.col(f"__{m}_std")
        return F.when(s > 0, s) if flat is None else F.when(s > 0, s).otherwise(flat)

    return joined.select(*df.columns, *[((F.col(m) - F.col(f"__{m}_mean")) / spread(m)).alias(f"{m}_z") for m in measures])


def composite_signal(scored: DataFrame, *, weights: dict[str, float], step: float = 0.04, low: float | None = 0.9, high: float | None = 1.1, digits: int | None = None) -> DataFrame:
    """Adds signal: 1 + step x the weighted sum of z-scores (null as 0), within [low, high]."""
    z = sum((F.coalesce(F.col(f"{m}_z"), F.lit(0.0)) * w for m, w in weights.items()), F.lit(0.0))
    return scored.withColumn("signal", rounded(clip(1 + step * z, low, high), digits))


def later_wins(signals: list[DataFrame], *, key: list[str]) -> DataFrame:
    """Union of signal tables (key, signal); of a key in several, that of the last."""
    out = None
    for k, df in enumerate(signals):
        one = df.select(*key, "signal", F.lit(k).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(*key).agg(F.max_by("signal", "n").alias("signal"))


def tagged_sums(facts: DataFrame, *, keys: list[str], segment: str, tags: dict[str, Column], measure: str) -> DataFrame:
    """Sums by key and segment where a row also counts in each tag whose condition it meets: tags are further segments."""
    marks = F.array_compact(F.array(F.col(segment), *[F.when(condition, F.lit(tag)) for tag, condition in tags.items()]))
    return facts.select(*keys, F.explode(marks).alias(segment), measure).groupBy(*keys, segment).agg(total(measure).alias(f"{measure}_sum"), F.count("*").alias("n"))


def over_league(weekly: DataFrame, *, unit: str, segment: str, week: str, measure: str) -> DataFrame:
    """Adds the league's mean of the week and segment, and the difference to it."""
    league = weekly.groupBy(week, segment).agg(mean(measure).alias("league_mean"))
    return weekly.join(league, [week, segment]).withColumn("over_league", F.col(measure) - F.col("league_mean"))


def trend_line(facts: DataFrame, *, keys: list[str], x: str, y: str, least: int = 4) -> DataFrame:
    """Least-squares slope and intercept of y over x by key, for keys with enough rows that are not all at one x.
    Where sums are exact, the order of the rows does not matter."""
    used = facts.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if not sums_are_exact():
        a, b = F.col(x).cast("double"), F.col(y).cast("double")
        fitted = used.groupBy(*keys).agg(F.count("*").alias("n"), F.var_pop(a).alias("spread"), F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"))
        return fitted.where((F.col("n") >= least) & (F.col("spread") > 0)).drop("spread")
    xx, yy = measure(x), measure(y)
    sums = used.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(xx).cast("double").alias("sx"), F.sum(yy).cast("double").alias("sy"), F.sum(xx * xx).cast("double").alias("sxx"), F.sum(xx * yy).cast("double").alias("sxy"))
    base = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    fitted = sums.where((F.col("n") >= least) & (base > 0)).withColumn("slope", (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / base)
    return fitted.select(*keys, "n", "slope", ((F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n")).alias("intercept"))
