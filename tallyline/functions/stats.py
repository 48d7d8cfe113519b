"""Aggregates and scalar helpers with one null rule each.

Aggregates are in double precision. Within ``exact_sums(places)``, for measures whose scale is known, sums are taken over
DECIMAL(18, places), so that they do not depend on the order of the rows, and means and deviations follow from them. Every
aggregate works on groups or, given ``over``, on a window.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

_PLACES: ContextVar[int | None] = ContextVar("places", default=None)


@contextmanager
def exact_sums(places: int | None) -> Iterator[None]:
    """Columns built within it sum over decimals of so many places; None: in double precision."""
    token = _PLACES.set(places)
    try:
        yield
    finally:
        _PLACES.reset(token)


def sums_are_exact() -> bool:
    return _PLACES.get() is not None


def measure_type(digits: int = 18, places: int | None = None) -> str:
    """Type in which measures are added up; ``places`` in place of the setting's, where sums are exact."""
    return "double" if _PLACES.get() is None else f"decimal({digits},{_PLACES.get() if places is None else places})"


def measure(x: str | Column, places: int | None = None) -> Column:
    """A value as it is added up. A double becomes a decimal as SQL's CAST makes it: times 10 ** places in double precision, then to the
    nearest whole number, halves away from zero. Spark's own cast rounds the shortest decimal form instead, which differs where
    that form ends in a half that the product does not have, such as means of eight prices."""
    kind = measure_type(places=places)
    if not sums_are_exact():
        return col(x).cast(kind)
    scale = 10.0 ** (_PLACES.get() if places is None else places)
    scaled = col(x).cast("double") * scale
    whole = F.rint(scaled)
    nearest = F.when(F.abs(scaled - whole) == 0.5, scaled + 0.5 * F.signum(scaled)).otherwise(whole)
    return F.when(F.typeof(col(x)).isin("double", "float"), (nearest / scale).cast(kind)).otherwise(col(x).cast(kind))


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _of(aggregate: Column, over: WindowSpec | None) -> Column:
    return aggregate if over is None else aggregate.over(over)


def total(x: str | Column, over: WindowSpec | None = None) -> Column:
    """Sum; null where there is no value."""
    return _of(F.sum(measure(x)), over).cast("double")


def total0(x: str | Column, over: WindowSpec | None = None) -> Column:
    """Sum; 0 where there is no value."""
    return F.coalesce(total(x, over), F.lit(0.0))


def mean(x: str | Column, over: WindowSpec | None = None) -> Column:
    return safe_div(total(x, over), _of(F.count(col(x)), over))


def squared_deviations(x: str | Column, over: WindowSpec | None = None) -> Column:
    """Sum of the squared differences to the mean."""
    n = _of(F.count(col(x)), over)
    if not sums_are_exact():
        return _of(F.var_pop(col(x).cast("double")), over) * n
    s = total(x, over)
    return _of(F.sum(measure(x) * measure(x)), over).cast("double") - s * s / n


def _spread(x: str | Column, over: WindowSpec | None, less: int, least: int) -> Column:
    n = _of(F.count(col(x)), over)
    return F.when(n >= least, F.sqrt(F.greatest(squared_deviations(x, over), F.lit(0.0)) / (n - less)))


def std_samp(x: str | Column, over: WindowSpec | None = None, least: int = 2) -> Column:
    """Sample deviation; null under ``least`` values."""
    return _spread(x, over, 1, max(2, least))


def std_pop(x: str | Column, over: WindowSpec | None = None, least: int = 1) -> Column:
    return _spread(x, over, 0, max(1, least))


def safe_div(a: str | Column, b: str | Column) -> Column:
    """a / b in double precision; null where b is 0."""
    return col(a).cast("double") / F.nullif(col(b).cast("double"), F.lit(0.0))


def clip(x: str | Column, low: float | None = None, high: float | None = None) -> Column:
    """Null stays null, which greatest and least alone would skip."""
    out = col(x)
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(col(x).isNotNull(), out)


def rounded(x: Column, digits: int | None) -> Column:
    return x if digits is None else F.round(x, digits)


def number(x: str | Column, kind: str = "double") -> Column:
    """Text to a number; bad text gives null."""
    return col(x).try_cast(kind)


def right_closed(x: str | Column, edges: list[float], labels: list[str]) -> Column:
    """Label of the interval (edges[i], edges[i+1]] that holds x; outside null."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges, edges[1:], labels, strict=False))):
        out = F.when((col(x) > low) & (col(x) <= high), F.lit(label)).otherwise(out)
    return out


def decay_weight(offset: Column, decay: float, lookback: int) -> Column:
    """decay ** offset for offsets 0 .. lookback - 1, else null."""
    powers = F.array(*[F.lit(float(decay**k)) for k in range(lookback)])
    return F.when((offset >= 0) & (offset < lookback), F.element_at(powers, (offset + 1).cast("int")))


def existing(df: DataFrame, names: Iterable[str]) -> list[str]:
    """Those of ``names`` that are columns, in the order given."""
    return [n for n in names if n in df.columns]


def name_key(x: str | Column) -> Column:
    """Comparison key of a name: lower case, no dots, double spaces as one, one suffix of jr, sr, ii, iii, iv cut."""
    plain = F.regexp_replace(F.replace(F.lower(F.trim(col(x))), F.lit("."), F.lit("")), "  ", " ")
    return F.regexp_replace(plain, r" (jr|sr|ii|iii|iv)$", "")


def title_case(x: str | Column) -> Column:
    """A name for show: single spaces, the first letter of each word in upper case."""
    return F.initcap(F.lower(F.regexp_replace(F.trim(col(x)), r"\s+", " ")))


def label(fmt: str, *parts: str | Column) -> Column:
    """Text from numbers and names, as printf does."""
    return F.format_string(fmt, *map(col, parts))


def notes(*parts: str | Column, separator: str = " | ") -> Column:
    """Parts joined, nulls left out."""
    return F.concat_ws(separator, *map(col, parts))
