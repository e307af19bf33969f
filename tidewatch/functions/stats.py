"""Test statistics on aggregated moments."""

import math

from pyspark.sql import Column, functions as F


def welch_t(m1: Column, v1: Column, n1: Column, m2: Column, v2: Column, n2: Column) -> Column:
    error = v1 / n1 + v2 / n2
    return F.when(error > 0, (m1 - m2) / F.sqrt(error))


def welch_df(v1: Column, n1: Column, v2: Column, n2: Column) -> Column:
    a, b = v1 / n1, v2 / n2
    return F.when(a + b > 0, (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1)))


def pooled_d(m1: Column, v1: Column, n1: Column, m2: Column, v2: Column, n2: Column) -> Column:
    """Cohen's d with the size-weighted pooled variance; null on thin samples."""
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    return F.when((n1 >= 4) & (n2 >= 10) & (pooled > 0), (m1 - m2) / F.sqrt(pooled))


def raw_d(m1: Column, v1: Column, m2: Column, v2: Column) -> Column:
    """Unweighted form: 0 without variance."""
    return F.when(v1 + v2 > 0, (m1 - m2) / F.sqrt((v1 + v2) / 2)).otherwise(0.0)


def _gamma_ratio(a: Column, shift: int = 24) -> Column:
    """log(gamma(a + 1/2) / gamma(a)) for a > 0: by the asymptotic series at ``a + shift``, taken down again by recurrence."""
    b = a + shift
    down = F.lit(0.0)
    for k in range(shift):
        down = down + F.log((a + k) / (a + (k + 0.5)))
    return F.log(b) / 2 - 1 / (8 * b) + 1 / (192 * b * b * b) - 1 / (640 * F.pow(b, F.lit(5))) + down


def two_sided_p(t: Column, df: Column, steps: int = 800) -> Column:
    """Two-sided p of Student's t: the regularised incomplete beta function I_x(df / 2, 1 / 2) at x = df / (df + t * t).

    A column expression: its continued fraction is followed over a fixed sequence of steps (one numerator each), which it leaves
    untouched once settled; the symmetric form is used where that converges faster.  Null where it does not settle.
    """
    a, ratio = df / 2, t * t / df
    x, y = 1 / (1 + ratio), ratio / (1 + ratio)
    swap = x > (a + 1) / (a + 2.5)
    guard = lambda v: F.when(F.abs(v) < 1e-300, 1e-300).otherwise(v)
    start = F.struct(
        F.when(swap, 0.5).otherwise(a).alias("p"), F.when(swap, a).otherwise(0.5).alias("q"), F.when(swap, y).otherwise(x).alias("z"),
        F.lit(1.0).alias("c"), F.lit(0.0).alias("d"), F.lit(1.0).alias("h"), F.lit(2.0).alias("last"),
    )

    def step(acc: Column, j: Column) -> Column:
        p, q, z, m = acc["p"], acc["q"], acc["z"], F.floor(j / 2)
        even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        term = F.when(j % 2 == 0, even).otherwise(odd)
        # the first term has no numerator before it, so c starts at 1 and d at 0
        d = 1 / guard(1 + term * F.when(j == 1, F.lit(1.0)).otherwise(acc["d"]))
        c = F.when(j == 1, F.lit(1.0)).otherwise(guard(1 + term / acc["c"]))
        new = F.struct(p.alias("p"), q.alias("q"), z.alias("z"), c.alias("c"), d.alias("d"), (acc["h"] * c * d).alias("h"), (c * d).alias("last"))
        return F.when((j > 2) & (F.abs(acc["last"] - 1) < 2e-16), acc).otherwise(new)

    done = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
    front = F.exp(_gamma_ratio(a) - a * F.log1p(ratio)) * F.sqrt(y / math.pi)
    part = F.transform(F.array(done), lambda r: F.when(F.abs(r["last"] - 1) < 1e-12, r["h"] / r["p"]))[0] * front
    p = F.when(t == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(swap, 1 - part).otherwise(part))))
    return F.when(t.isNotNull() & df.isNotNull() & ~F.isnan(t) & (df > 0), F.when(part.isNotNull() | (t == 0), p))
