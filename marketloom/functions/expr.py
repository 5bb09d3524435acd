"""Column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

TRADING_DAYS = 252



def clip(x: Column, low: float, high: float) -> Column:
    """Null-preserving clamp (least/greatest alone would swallow a null)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def safe_div(a: Column, b: Column) -> Column:
    """Null instead of an error when the divisor is 0."""
    return F.try_divide(a, b)


def correlation(x: str | Column, y: str | Column, frame: WindowSpec | None = None) -> Column:
    """Pearson correlation over the rows that have both values; null if one side is constant."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    parts = [F.covar_pop(a, b), F.stddev_pop(a), F.stddev_pop(b)]
    if frame is not None:
        parts = [p.over(frame) for p in parts]
    return F.try_divide(parts[0], parts[1] * parts[2])


def truth(cond: Column) -> Column:
    """A comparison with a null is false."""
    return F.coalesce(cond, F.lit(False))


def points(*pairs: tuple[Column, float]) -> Column:
    """Sum of the points whose condition holds."""
    return reduce(lambda a, b: a + b, [F.when(truth(c), F.lit(float(p))).otherwise(F.lit(0.0)) for c, p in pairs])


def notes(*pairs: tuple[Column, str | Column]) -> Column:
    """Array of the texts whose condition holds, in the given order."""
    return F.array_compact(
        F.array(*[F.when(truth(c), t if isinstance(t, Column) else F.lit(t)) for c, t in pairs])
    )


def mean_of(*xs: Column) -> Column:
    """Mean over the non-null arguments of one row."""
    total = reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in xs])
    count = reduce(lambda a, b: a + b, [x.isNotNull().cast("int") for x in xs])
    return total / F.nullif(count, F.lit(0))


# fixed values: double-precision rational form of the normal tail (Hart 1968, as in West 2005)
TAIL_TOP = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376,
)
TAIL_BOTTOM = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
TAIL_LIMIT, TAIL_SCALE = 7.07106781186547, 2.506628274631


def norm_cdf(x: Column) -> Column:
    """Standard normal distribution function to about 1e-15."""
    z = F.abs(x)
    horner = lambda cs: reduce(lambda acc, c: acc * z + c, cs[1:], F.lit(cs[0]))
    far = reduce(lambda acc, k: z + k / acc, (4.0, 3.0, 2.0, 1.0), z + 0.65)
    e = F.exp(-z * z / 2.0)
    tail = F.when(z > 37, F.lit(0.0)).when(z < TAIL_LIMIT, e * horner(TAIL_TOP) / horner(TAIL_BOTTOM)).otherwise(e / far / TAIL_SCALE)
    return F.when(x > 0, 1.0 - tail).otherwise(tail)


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2.0) / F.sqrt(F.lit(2.0) * F.pi())


def product(x: Column) -> Column:
    """Product of growth factors as an aggregate; zero or negative factors are handled exactly."""
    negative = F.sum((x < 0).cast("int")) % 2 == 1
    magnitude = F.exp(F.sum(F.log(F.abs(F.nullif(x, F.lit(0.0))))))
    return F.when(F.max((x == 0).cast("int")) == 1, F.lit(0.0)).when(negative, -magnitude).otherwise(magnitude)
