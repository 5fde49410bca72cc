"""Exact null distributions of a draw of K distinct numbers out of 1..N, and the tests that use them.

All of it depends on N, K and sample sizes alone, never on data, so it is computed on the driver and joined as small
tables. A distribution is a dict from value to probability, in rising order.
"""

from __future__ import annotations

import math
from functools import cache
from math import comb

from subsetlab.model import K, LOW, N

Z95 = 1.959964


@cache
def _subset_counts(n: int, k: int) -> tuple[tuple[int, ...], ...]:
    """Return, for each size up to k, how many subsets of 1..n have each sum."""
    top = sum(range(n - k + 1, n + 1))
    ways = [[0] * (top + 1) for _ in range(k + 1)]
    ways[0][0] = 1
    for value in range(1, n + 1):
        for size in range(k, 0, -1):
            smaller, own = ways[size - 1], ways[size]
            for total in range(top, value - 1, -1):
                own[total] += smaller[total - value]
    return tuple(map(tuple, ways))


def sum_pmf(n: int = N, k: int = K) -> dict[int, float]:
    return {s: w / comb(n, k) for s, w in enumerate(_subset_counts(n, k)[k]) if w}


def min_pmf(n: int = N, k: int = K) -> dict[int, float]:
    return {m: comb(n - m, k - 1) / comb(n, k) for m in range(1, n - k + 2)}


def max_pmf(n: int = N, k: int = K) -> dict[int, float]:
    return {m: comb(m - 1, k - 1) / comb(n, k) for m in range(k, n + 1)}


def range_pmf(n: int = N, k: int = K) -> dict[int, float]:
    return {r: (n - r) * comb(r - 1, k - 2) / comb(n, k) for r in range(k - 1, n)}


def hypergeom_pmf(n: int, marked: int, k: int = K) -> dict[int, float]:
    low, high = max(0, k - (n - marked)), min(k, marked)
    return {x: comb(marked, x) * comb(n - marked, k - x) / comb(n, k) for x in range(low, high + 1)}


def odd_pmf(n: int = N, k: int = K) -> dict[int, float]:
    return hypergeom_pmf(n, (n + 1) // 2, k)


def low_pmf(n: int = N, k: int = K, low: int = LOW) -> dict[int, float]:
    return hypergeom_pmf(n, low, k)


def consecutive_pmf(n: int = N, k: int = K) -> dict[int, float]:
    """Pairs of neighbours that differ by one: k numbers in k - c blocks."""
    return {c: comb(k - 1, c) * comb(n - k + 1, k - c) / comb(n, k) for c in range(k) if k - c <= n - k + 1}


def gap_pmf(n: int = N, k: int = K) -> dict[int, float]:
    """The difference of two neighbours, any of the k - 1 alike."""
    return {g: comb(n - g, k - 1) / comb(n, k) for g in range(1, n - k + 2)}


def min_gap_pmf(n: int = N, k: int = K) -> dict[int, float]:
    """All gaps are at least g in comb(n - (k - 1)(g - 1), k) subsets."""
    def above(g: int) -> int:
        room = n - (k - 1) * (g - 1)
        return comb(room, k) if room >= k else 0

    top = (n - 1) // (k - 1)
    return {g: (above(g) - above(g + 1)) / comb(n, k) for g in range(1, top + 1)}


def max_gap_pmf(n: int = N, k: int = K) -> dict[int, float]:
    """Subsets whose gaps are all at most g, by the total width of k - 1 gaps."""
    def within(g: int) -> int:
        ways = [1] + [0] * (n - 1)
        for _ in range(k - 1):
            ways = [sum(ways[w - x] for x in range(1, min(g, w) + 1)) for w in range(n)]
        return sum(c * (n - w) for w, c in enumerate(ways))

    counts = [within(g) for g in range(n - k + 2)]
    return {g: (counts[g] - counts[g - 1]) / comb(n, k) for g in range(1, n - k + 2)}


def geometric_pmf(p: float, top: int) -> dict[int, float]:
    return {g: p * (1 - p) ** (g - 1) for g in range(1, top + 1)}


PMFS = {
    "sum": sum_pmf, "min": min_pmf, "max": max_pmf, "range": range_pmf, "odd": odd_pmf, "low": low_pmf,
    "consecutive": consecutive_pmf, "gap": gap_pmf, "min_gap": min_gap_pmf, "max_gap": max_gap_pmf,
}


def moments(pmf: dict[int, float]) -> tuple[float, float]:
    mean = sum(v * p for v, p in pmf.items())
    return mean, math.sqrt(max(0.0, sum((v - mean) ** 2 * p for v, p in pmf.items())))


def quantile(pmf: dict[int, float], q: float) -> int:
    """Return the smallest value whose cumulative probability reaches q."""
    total = 0.0
    for v, p in pmf.items():
        total += p
        if total >= q - 1e-12:
            return v
    return max(pmf)


def _log_binomial(n: int, p: float, x: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) + x * math.log(p) + (n - x) * math.log1p(-p)


def binomial_band(n: int, p: float, low: float = 0.025, high: float = 0.975) -> tuple[int, int]:
    """Return the central quantiles of Binomial(n, p)."""
    if n <= 0:
        return 0, 0
    total, first, x = 0.0, None, 0
    while x <= n:
        total += math.exp(_log_binomial(n, p, x))
        if first is None and total >= low:
            first = x
        if total >= high:
            break
        x += 1
    return first if first is not None else n, min(x, n)


def binomial_test(x: int, n: int, p: float) -> float:
    """Return the exact two-sided p-value: all outcomes no likelier than the observed one."""
    own = math.exp(_log_binomial(n, p, x)) * (1 + 1e-7)
    return min(1.0, sum(w for k in range(n + 1) if (w := math.exp(_log_binomial(n, p, k))) <= own))


def chi2_sf(x: float, df: int) -> float:
    """Return the upper tail of the chi-squared distribution in closed form."""
    if x <= 0:
        return 1.0
    half = x / 2
    if df % 2 == 0:
        term = total = math.exp(-half)
        for k in range(1, df // 2):
            term *= half / k
            total += term
        return min(1.0, total)
    total = math.erfc(math.sqrt(half))
    term = math.exp(-half) * math.sqrt(half) / math.gamma(1.5)
    for k in range(1, (df - 1) // 2 + 1):
        total += term
        term *= half / (k + 0.5)
    return min(1.0, total)


def wilson(x: int, n: int) -> tuple[float, float]:
    if n <= 0:
        return 0.0, 0.0
    share, z2 = x / n, Z95 * Z95
    centre = (share + z2 / (2 * n)) / (1 + z2 / n)
    half = Z95 * math.sqrt(share * (1 - share) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return max(0.0, centre - half), min(1.0, centre + half)


Cell = tuple[int, int, float]


def merge_ends(pmf: dict[int, float], n: int, least: float = 5.0) -> list[Cell]:
    """Pool cells for the tests: from each end, an outer cell with too few expected joins its neighbour, one by one."""
    cells = [(v, v, p) for v, p in pmf.items()]
    while len(cells) > 1 and n * cells[0][2] < least:
        cells[:2] = [(cells[0][0], cells[1][1], cells[0][2] + cells[1][2])]
    while len(cells) > 1 and n * cells[-1][2] < least:
        cells[-2:] = [(cells[-2][0], cells[-1][1], cells[-2][2] + cells[-1][2])]
    return cells


def pool_tails(cells: list[Cell], n: int, least: float = 5.0) -> list[Cell]:
    """Pool cells for the tables: single cells must reach ``least`` expected, and so must each tail as a whole.

    A tail holds the outer cells that are short, and takes in further ones until it has enough. If the tails meet
    first, everything is one cell.
    """
    short = [n * p < least for _, _, p in cells]
    last = len(cells) - 1
    left = next((i for i, s in enumerate(short) if not s), last)
    right = next((i for i in range(last, left, -1) if not short[i]), left)

    def total(a: int, b: int) -> float:
        return sum(p for _, _, p in cells[a:b])

    while 0 < left < right and n * total(0, left) < least:
        left += 1
    while left < right < last and n * total(right + 1, last + 1) < least:
        right -= 1
    lacking = (left > 0 and n * total(0, left) < least) or (right < last and n * total(right + 1, last + 1) < least)
    if left >= right and lacking:
        return [(cells[0][0], cells[-1][1], total(0, last + 1))] if cells else []
    out = list(cells[left : right + 1])
    if left > 0:
        out.insert(0, (cells[0][0], cells[left - 1][1], total(0, left)))
    if right < last:
        out.append((cells[right + 1][0], cells[-1][1], total(right + 1, last + 1)))
    return out


def label(cells: list[Cell], units: set[tuple[int, int]]) -> list[str]:
    """Name cells: a single unit by itself, a pooled tail by its inner end."""
    out = []
    for i, (a, b, _) in enumerate(cells):
        if (a, b) in units:
            out.append(str(a) if a == b else f"{a}-{b}")
        elif i == 0:
            out.append(f"<={b}")
        elif i == len(cells) - 1:
            out.append(f">={a}")
        else:
            out.append(f"{a}-{b}")
    return out


def metric_cells(metric: str, n: int) -> list[tuple[str, int, int, float]]:
    """Return label, first and last value, and probability of the cells of a metric's table.

    Sums are in bins of ten, consecutive pairs in the fixed cells 0, 1, 2 and >=3; the rest are single values.
    """
    pmf = PMFS[metric]()
    if metric == "consecutive":
        cells = [(0, 0, pmf[0]), (1, 1, pmf[1]), (2, 2, pmf[2]), (3, max(pmf), sum(p for v, p in pmf.items() if v >= 3))]
        return [(x, *c) for x, c in zip(("0", "1", "2", ">=3"), cells, strict=True)]
    if metric == "sum":
        first, last = min(pmf) // 10 * 10 + 1, max(pmf)
        edges = [(a, min(a + 9, last)) for a in range(first, last + 1, 10)]
        units = [(a, b, sum(p for v, p in pmf.items() if a <= v <= b)) for a, b in edges]
    else:
        units = [(v, v, p) for v, p in pmf.items()]
    cells = pool_tails(units, n)
    return [(x, *c) for x, c in zip(label(cells, {(a, b) for a, b, _ in units}), cells, strict=True)]


def test_cells(metric: str, n: int) -> list[tuple[str, int, int, float]]:
    """Return the cells of the goodness-of-fit tests, pooled from the ends."""
    pmf = PMFS[metric]()
    cells = merge_ends(pmf, n)
    return [(x, *c) for x, c in zip(label(cells, {(v, v) for v in pmf}), cells, strict=True)]
