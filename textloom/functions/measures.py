"""Association measures of word triples as Column expressions of doubles.

f: count of the triple; c1, c2, c3: counts of its words; n: corpus size, as each measure defines it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

EPSILON = 1e-5


def _d(*cols: Column) -> list[Column]:
    return [c.cast("double") for c in cols]


def t_score(f, c1, c2, c3, n) -> Column:
    f, c1, c2, c3, n = _d(f, c1, c2, c3, n)
    return (f - c1 * c2 * c3 / (n * n)) / F.sqrt(f)


def t_score_smoothed(f, c1, c2, c3, n) -> Column:
    """For counts of words in first position and the number of distinct words."""
    f, c1, c2, c3, n = _d(f, c1, c2, c3, n)
    return (f - c1 * c2 * c3 / (n * n)) / F.sqrt(f + EPSILON)


def t_score_document(triples, tokens) -> Column:
    """One value for a document from its totals of triples and words."""
    t, u = _d(triples, tokens)
    return (t - u / (u * u)) / F.sqrt(t + EPSILON)


def mutual_information(f, c1, c2, c3, n) -> Column:
    f, c1, c2, c3, n = _d(f, c1, c2, c3, n)
    return F.when(f == 0, 0.0).otherwise(F.log2(f * n * n / (c1 * c2 * c3)))


def mutual_information_marginal(f, c1, c2, c3, n) -> Column:
    f, c1, c2, c3, n = _d(f, c1, c2, c3, n)
    return F.log2(f * n * n) - F.log2(c1 * c2 * c3)


def mutual_information_two(f, c1, c2, c3, n) -> Column:
    """The third word is left out of the denominator."""
    f, c1, c2, n = _d(f, c1, c2, n)
    return F.log2(f * n * n / (c1 * c2))


def mutual_information_root(f, c1, c2, c3, n) -> Column:
    f, c1, c2, c3, n = _d(f, c1, c2, c3, n)
    return F.log(f * n * n / F.sqrt(c1 * c2 * c3))


def mutual_information_single(f, c1, c2, c3, n) -> Column:
    f, c1, c2, c3, n = _d(f, c1, c2, c3, n)
    return F.log2(f * n / (c1 * c2 * c3))


def log_likelihood(f, c1, c2, c3, n) -> Column:
    f, c1, c2, c3, n = _d(f, c1, c2, c3, n)
    return 2 * f * F.log2(f / (c1 * c2 * c3 / n))


def log_likelihood_top(total, p, x, y, z) -> Column:
    """From a share p and the shares of a text's three most frequent words; the third counts twice."""
    total, p, x, y, z = _d(total, p, x, y, z)
    return 2 * total * (p * F.log2(p / (x * z * y * z)))


def mi_like(f, c1, c2, c3, n) -> Column:
    f, c1, c2, c3 = _d(f, c1, c2, c3)
    return f * f * f / (c1 * c2 * c3)


def pmi(f, c1, c2, c3, n) -> Column:
    """The library's pointwise mutual information of a triple."""
    f, c1, c2, c3, n = _d(f, c1, c2, c3, n)
    return F.log2(f * n * n) - F.log2(c1 * c2 * c3)


def student_t(f, c1, c2, c3, n) -> Column:
    """The library's t-score; its smallest number keeps the root from being zero."""
    f, c1, c2, c3, n = _d(f, c1, c2, c3, n)
    return (f - c1 * c2 * c3 / (n * n)) / F.sqrt(f + 1e-20)


MEASURES: dict[str, Callable[..., Column]] = {
    "t_score": t_score,
    "t_score_smoothed": t_score_smoothed,
    "mi": mutual_information,
    "mi_marginal": mutual_information_marginal,
    "mi_two": mutual_information_two,
    "mi_root": mutual_information_root,
    "mi_single": mutual_information_single,
    "log_likelihood": log_likelihood,
    "mi_like": mi_like,
    "pmi": pmi,
    "student_t": student_t,
}
