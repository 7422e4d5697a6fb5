"""Scores, intervals and vector arithmetic as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two-sided 95 % normal quantile.
Z95 = 1.959963984540054

# Calibration bands, fixed values: least raw score, calibrated score, anchor.
BANDS = ((0.95, 0.975, "very certain"), (0.80, 0.87, "fairly certain"), (0.60, 0.70, "directional"))
LOWEST = (0.30, "uncertain")


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def calibrated(raw: Column) -> Column:
    out = F.lit(LOWEST[0])
    for least, value, _ in reversed(BANDS):
        out = F.when(clamp(raw) >= least, F.lit(value)).otherwise(out)
    return out


def anchor(raw: Column) -> Column:
    out = F.lit(LOWEST[1])
    for least, _, name in reversed(BANDS):
        out = F.when(clamp(raw) >= least, F.lit(name)).otherwise(out)
    return out


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null where whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def wilson(hits: Column, total: Column) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval at 95 %, null without trials."""
    n, z2 = total.cast("double"), Z95 * Z95
    p = ratio(hits, total)
    spread = F.try_divide(F.lit(Z95) * F.sqrt(p * (1 - p) / F.when(n > 0, n) + z2 / (4 * F.when(n > 0, n * n))), 1 + z2 / F.when(n > 0, n))
    middle = F.try_divide(p + z2 / (2 * F.when(n > 0, n)), 1 + z2 / F.when(n > 0, n))
    bound = lambda x: F.when(total > 0, clamp(x))
    return bound(middle - spread), bound(middle + spread)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for empty, unlike or zero vectors."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.coalesce(F.try_divide(dot(a, b), norms), F.lit(0.0))).otherwise(0.0)


def fuse(latest: Column, context: Column, weight: float = 0.6) -> Column:
    """Weighted sum of two embeddings; the latest alone where there is no context."""
    return F.when(context.isNull(), latest).otherwise(F.zip_with(latest, context, lambda x, y: F.lit(weight) * x + F.lit(round(1 - weight, 12)) * y))
