"""Distribution functions and hashed draws as DuckDB expressions, by finite sums and series.

They are other formulas than those of ``tidemark.functions.stats``, so that the
two check each other.
"""

from __future__ import annotations

#: Terms of the normal series: enough for |x| up to 8.
TERMS = 200


def normal_cdf(x: str) -> str:
    """1/2 + density times the sum of x^(2k+1) over the product of odd numbers to 2k+1."""
    log_odds = "((k + 1) * ln(2) + lgamma(k + 1.5) - ln(pi()) / 2)"
    total = f"list_sum(list_transform(range({TERMS}), lambda k: exp((2 * k + 1) * ln(greatest(abs({x}), 1e-12)) - {log_odds} - ({x}) * ({x}) / 2)))"
    return f"(CASE WHEN ({x}) > 8 THEN 1 WHEN ({x}) < -8 THEN 0 ELSE 0.5 + sign({x}) * {total} / sqrt(2 * pi()) END)"


def t_sf(t: str, df: str) -> str:
    """P(T > t) for whole df, by the finite sums for even and odd degrees of freedom."""
    cos2 = f"(({df}) / (({df}) + ({t}) * ({t})))"
    sin = f"(({t}) / sqrt(({df}) + ({t}) * ({t})))"
    even = f"{sin} * list_sum(list_transform(range(CAST(({df}) // 2 AS BIGINT)), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1) + k * ln({cos2})) / sqrt(pi())))"
    odd = f"2 / pi() * (atan(({t}) / sqrt({df})) + {sin} * coalesce(list_sum(list_transform(range(CAST((({df}) - 1) // 2 AS BIGINT)), lambda k: exp(lgamma(k + 1) - lgamma(k + 1.5) + (k + 0.5) * ln({cos2})) * sqrt(pi()) / 2)), 0))"
    return f"(0.5 - 0.5 * CASE WHEN ({df}) % 2 = 0 THEN {even} ELSE {odd} END)"


def t_two_sided(t: str, df: str) -> str:
    return f"(2 * {t_sf(f'abs({t})', df)})"


def binom_sf(k: str, n: str, p: str) -> str:
    """P(X >= k) as a sum of terms."""
    return f"(CASE WHEN ({k}) <= 0 THEN 1 ELSE coalesce(list_sum(list_transform(range(CAST({k} AS BIGINT), CAST({n} AS BIGINT) + 1), lambda i: exp(lgamma(({n}) + 1) - lgamma(i + 1) - lgamma(({n}) - i + 1) + i * ln({p}) + (({n}) - i) * ln(1 - ({p}))))), 0) END)"


def draw(n: str, *parts: str) -> str:
    """The number from 0 to n - 1 that ``overfit.draw`` gives."""
    return f"(CAST('0x' || substr(md5(concat_ws('-', {', '.join(parts)})), 1, 15) AS BIGINT) % ({n}))"
