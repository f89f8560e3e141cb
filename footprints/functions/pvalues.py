"""Two-sided p-values of correlations as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Lanczos' coefficients for g = 7, accurate to some fifteen digits.
_G = 7
_LANCZOS = [
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012,
    9.9843695780195716e-6, 1.5056327351493116e-7,
]


def log_gamma(x: Column) -> Column:
    """Natural logarithm of the gamma function of x >= 0.5."""
    y = x - 1
    series = sum((F.lit(c) / (y + k) for k, c in enumerate(_LANCZOS[1:], 1)), F.lit(_LANCZOS[0]))
    t = y + (_G + 0.5)
    return F.lit(0.5 * math.log(2 * math.pi)) + (y + 0.5) * F.log(t) - t + F.log(series)


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """Lentz' continued fraction of the incomplete beta function, as one aggregate over its steps."""
    tiny = F.lit(1e-300)
    safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)
    state = lambda c, d, h: F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

    def turned(s, step):
        """One step of the fraction; the struct keeps each value from being worked out again."""
        return F.transform(
            F.array(F.struct((1 / safe(1 + step * s["d"])).alias("d"), safe(1 + step / s["c"]).alias("c"))), lambda v: state(v["c"], v["d"], s["h"] * v["c"] * v["d"])
        )[0]

    def both(s, m):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.transform(F.array(turned(s, even)), lambda v: turned(v, odd))[0]

    first = 1 / safe(1 - (a + b) * x / (a + 1))
    # The fraction settles after a few times the square root of its larger parameter.
    steps = F.sequence(F.lit(1), (F.lit(40) + 4 * F.sqrt(F.greatest(a, b))).cast("int"))
    return F.aggregate(F.transform(steps, lambda m: m.cast("double")), state(F.lit(1.0), first, first), both, lambda s: s["h"])


def correlation_p_value(r: Column, n: Column) -> Column:
    """P(|R| >= |r|) for n pairs without correlation, by Student's t with n - 2 degrees of freedom.

    Null where r or n is null, r is not a number or n is below 3; 0 where |r| is 1 and 1 where r is 0.
    """
    r = r.cast("double")
    a, b, x = (n.cast("double") - 2) / 2, F.lit(0.5), 1 - r * r
    front = F.exp(log_gamma(a + b) - log_gamma(a) - F.lit(math.lgamma(0.5)) + a * F.log(x) + b * F.log(r * r))
    tail = F.when(x < (a + 1) / (a + b + 2), front * _beta_fraction(a, b, x) / a).otherwise(1 - front * _beta_fraction(b, a, r * r) / b)
    return F.when(r.isNull() | F.isnan(r) | n.isNull() | (n < 3), F.lit(None).cast("double")).when(F.abs(r) >= 1, F.lit(0.0)).when(r == 0, F.lit(1.0)).otherwise(tail)
