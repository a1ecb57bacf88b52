"""Time, bins, prices and probabilities as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def day(ts: Column, cutoff: str) -> Column:
    """Fractional days relative to the cutoff, negative before it."""
    return (F.unix_micros(ts) - F.unix_micros(F.lit(cutoff).cast("timestamp"))).cast("double") / DAY_US


def divided(a: Column, b: Column) -> Column:
    """``a / b`` in IEEE arithmetic: a zero divisor gives an infinity, or NaN for 0 / 0, and no error."""
    return F.when(b == 0, a * float("inf")).otherwise(a / b)


def log(x: Column) -> Column:
    """Natural logarithm in IEEE arithmetic: minus infinity for 0, NaN below it."""
    return F.when(x == 0, float("-inf")).when(x < 0, float("nan")).otherwise(F.ln(x))


def floor_mod(a: Column, b) -> Column:
    return F.pmod(a, F.lit(float(b)) if isinstance(b, (int, float)) else b)


def next_month(ts: Column) -> Column:
    """The same day of the next month, clamped to its end, same time of day."""
    return ts + F.expr("INTERVAL 1 MONTH")


def business_day(ts: Column) -> Column:
    """Saturday and Sunday roll forward to Monday, same time of day."""
    shift = F.when(F.weekday(ts) == 5, 2).when(F.weekday(ts) == 6, 1).otherwise(0)
    return ts + F.make_dt_interval(shift)


def right_closed(x: Column, edges: list[float], lowest: bool = False) -> Column:
    """Index of the bin ``(edge, next]``; null outside; ``lowest`` closes the first bin."""
    out = F.lit(None).cast("int")
    for k in range(len(edges) - 2, -1, -1):
        low = x >= edges[k] if lowest and k == 0 else x > edges[k]
        out = F.when(low & (x <= edges[k + 1]), k).otherwise(out)
    return out


def price_support(amount: Column, low: Column, high: Column) -> Column:
    a = F.greatest(amount, F.lit(0.01))
    return F.exp(-8 * F.greatest(F.lit(0.0), log(low / a), log(divided(a, high))))


def softmax(score: Column, window) -> Column:
    e = F.exp(score - F.max(score).over(window))
    return e / F.sum(e).over(window)


def biased(p: Column, bias: Column, window) -> Column:
    """Renormalised probabilities after a log bias."""
    return softmax(F.ln(F.greatest(p, F.lit(1e-12))) + bias, window)


def substitute_none(p: Column, none: Column, is_none: Column, window) -> Column:
    """Families share ``1 - none`` in proportion; the none row gets ``none``."""
    families = F.sum(F.when(~is_none, p)).over(window)
    return F.when(is_none, none).otherwise(p * (1 - none) / families)


def circular(t: Column, period: float) -> tuple[Column, Column]:
    """Aggregates: strength and phase of event times on a clock of ``period``."""
    angle = t * (2 * 3.141592653589793 / period)
    c, s = F.avg(F.cos(angle)), F.avg(F.sin(angle))
    return F.sqrt(c * c + s * s), floor_mod(F.atan2(s, c) * (period / (2 * 3.141592653589793)), period)


def cadence_error(gap: Column, period: float) -> Column:
    """Aggregate: median distance of the gaps from multiples of ``period``."""
    r = floor_mod(gap, period)
    return F.median(F.least(r, period - r))


def draw(*key: str, salt: int) -> Column:
    """A reproducible number below 2**32 for a key: depends on no row order.

    MD5 of the key's text, which any SQL engine computes alike.
    """
    return F.conv(F.substring(F.md5(F.concat_ws("|", *key, F.lit(salt))), 1, 8), 16, 10).cast("long")


def uniform(*key: str, salt: int) -> Column:
    """A reproducible number in [0, 1) for a key."""
    return draw(*key, salt=salt) / float(1 << 32)


def per(*columns: str):
    return Window.partitionBy(*columns)


def label(period: float) -> str:
    """A period as part of a column name: ``30_4375``."""
    return f"{period:g}".replace(".", "_")
