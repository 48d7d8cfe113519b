"""Weekly features that see earlier rows only, labels and summaries of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import chunked, prefixed
from ..functions.stats import clip, mean, measure, rounded, safe_div, std_samp, sums_are_exact, total0


def lagged(facts: DataFrame, *, keys: list[str], order: list[str], measures: list[str], window: int = 3) -> DataFrame:
    """Adds, for each measure, the mean and sample deviation of the ``window`` rows before (<m>_roll, <m>_roll_std) and
    of all rows before (<m>_past, <m>_past_std), by rows in ``order`` within a key. Null under one or two rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    near, past = w.rowsBetween(-window, -1), w.rowsBetween(Window.unboundedPreceding, -1)
    added = {}
    for m in measures:
        added |= {f"{m}_roll": mean(m, near), f"{m}_roll_std": std_samp(m, near), f"{m}_past": mean(m, past), f"{m}_past_std": std_samp(m, past)}
    return facts.withColumns(added)


def lagged_of_large_keys(facts: DataFrame, *, keys: list[str], order: list[str], measures: list[str], window: int = 3, chunk: int | None = None) -> DataFrame:
    """``lagged`` for keys that hold more rows than a task should: rows are numbered by ranges, the near rows are looked at in chunks
    of a key, each with the last ``window`` rows before it, and counts, sums and squares of all rows before are prefix sums.

    Where sums aren't exact, squares are taken of the distance to the measure's overall mean, so that a key's deviation keeps its
    digits unless its mean is very far from that.
    """
    exact = sums_are_exact()
    middle = [0.0] * len(measures) if exact else [x or 0.0 for x in facts.agg(*[F.avg(F.col(m).cast("double")) for m in measures]).first()]
    added, sums = {}, {}
    for k, (m, c) in enumerate(zip(measures, middle, strict=True)):
        x = measure(m) if exact else F.col(m).cast("double") - c
        added |= {f"__x{k}": x, f"__q{k}": x * x, f"__c{k}": F.col(m).isNotNull().cast("int")}
        sums |= {f"__s{part}{k}": f"__{part}{k}" for part in "xqc"}
    numbered = prefixed(facts.withColumns(added), within=keys, order=order, number="__n", sums=sums)

    near = Window.partitionBy(*keys, "__chunk").orderBy("__n").rowsBetween(-window, -1)
    out = {}
    for k, (m, c) in enumerate(zip(measures, middle, strict=True)):
        n, s, q = F.col(f"__sc{k}"), F.col(f"__sx{k}").cast("double"), F.col(f"__sq{k}").cast("double")
        spread = F.when(n >= 2, F.sqrt(F.greatest(q - s * s / n, F.lit(0.0)) / (n - 1)))
        out |= {f"{m}_roll": mean(m, near), f"{m}_roll_std": std_samp(m, near), f"{m}_past": safe_div(s, n) if exact else safe_div(s, n) + c, f"{m}_past_std": spread}
    told = chunked(numbered, number="__n", halo=window, size=chunk).withColumns(out).where("__own")
    return told.select(*facts.columns, *out)


def threshold_of(segment: str, thresholds: dict[str, float]) -> Column:
    """The segment's threshold; null for a segment without one."""
    out = F.lit(None).cast("double")
    for name, value in thresholds.items():
        out = F.when(F.col(segment) == name, F.lit(float(value))).otherwise(out)
    return out


def labelled(facts: DataFrame, *, segment: str, measure: str, thresholds: dict[str, float], week: str | None = None) -> DataFrame:
    """Adds boom: 1 if the measure reaches its segment's threshold, else 0; first weeks are dropped afterwards."""
    out = facts.withColumn("boom", F.when(F.col(measure) >= threshold_of(segment, thresholds), 1).otherwise(0))
    return out if week is None else out.where(F.col(week) > 1)


def boom_summary(scored: DataFrame, *, keys: list[str], probability: str, actual: str, points: str, predicted_at: float = 0.35) -> DataFrame:
    """Weeks, expected booms, predicted booms, actual booms, mean and best points by key."""
    return scored.groupBy(*keys).agg(
        F.count("*").alias("weeks"),
        total0(probability).alias("expected_booms"),
        F.count_if(F.col(probability) >= predicted_at).alias("predicted_booms"),
        F.sum(actual).cast("bigint").alias("actual_booms"),
        mean(points).alias("mean_points"),
        F.max(points).alias("best_points"),
    )


def boom_rate(facts: DataFrame, *, keys: list[str], segment: str, measure: str, thresholds: dict[str, float], digits: int | None = 1) -> DataFrame:
    """Percent of rows at or above the segment's threshold; segments without one are left out."""
    known = facts.withColumn("threshold", threshold_of(segment, thresholds)).where("threshold IS NOT NULL")
    return known.groupBy(*keys).agg(F.count("*").alias("n"), rounded(safe_div(F.count_if(F.col(measure) >= F.col("threshold")) * 100, F.count("*")), digits).alias("boom_rate"))


def variance(facts: DataFrame, *, keys: list[str], measure: str, least: int = 6) -> DataFrame:
    """Mean, sample deviation and count by key, for keys with enough rows."""
    return facts.groupBy(*keys).agg(mean(measure).alias("mean_points"), std_samp(measure).alias("std_points"), F.count(measure).alias("n")).where(F.col("n") >= least)


def consistency(facts: DataFrame, *, keys: list[str], measure: str, least: int = 4, least_mean: float = 1.0, share: str | None = None, digits: tuple[int, int] | None = None) -> DataFrame:
    """Coefficient of variation by key; null unless the mean is above ``least_mean``. With ``share``, its sample deviation
    as well (share_std), null under ``least`` values. ``digits``: of cv and share_std."""
    known = facts.where(F.col(measure).isNotNull())
    more = [] if share is None else [rounded(std_samp(share, least=least), digits and digits[1]).alias("share_std")]
    spread = known.groupBy(*keys).agg(mean(measure).alias("mean_points"), std_samp(measure).alias("std_points"), F.count(measure).alias("n"), *more).where(F.col("n") >= least)
    return spread.withColumn("cv", rounded(F.when(F.col("mean_points") > least_mean, F.col("std_points") / F.col("mean_points")), digits and digits[0]))


def boom_outlook(prior: DataFrame, matchups: DataFrame, *, on: list[str], rate: str, advantage: str, most: float = 0.95) -> DataFrame:
    """Prior boom rate x (1 + advantage), within [0, most]; matchups without a prior keep a null outlook."""
    one = prior.groupBy(*on).agg(F.max(rate).alias(rate))  # a key once, so that nothing fans out
    return matchups.join(one, on, "left").withColumn("outlook", clip(F.col(rate) * (1 + F.col(advantage)), 0.0, most))
