"""A brute-force set model of the dependency semantics, straight from the definitions, for small relations."""

from itertools import combinations as pairs_of
from statistics import median

INF = float("inf")


def vectors(rows, distances):
    """Set of distance vectors of all row pairs."""
    return {tuple(d(a, b) for d, a, b in zip(distances, x, y)) for x, y in pairs_of(rows, 2)}


def number(a, b):
    if a is None and b is None:
        return 0.0
    if a is None or b is None:
        return INF
    return float(abs(a - b))


def text(a, b):
    if a is None or b is None:
        return 0.0 if a is None and b is None else INF
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return float(row[-1])


def minimal(points):
    points = set(points)
    return {p for p in points if not any(q != p and all(a <= b for a, b in zip(q, p)) for q in points)}


def dependencies(d, rhs, lhs, integral=False):
    """Set of (level, lhs thresholds or None ...) for one split of the vector set ``d`` (tuples by position)."""
    d = list(d)
    if not d:
        return set()
    med = lambda c: median(v[c] for v in d)
    m_b, m_l = med(rhs), [med(c) for c in lhs]
    view = [(v[rhs], tuple(v[c] for c in lhs)) for v in d]
    if integral:
        view = [(b, v) for b, v in view if b > m_b or b == int(b)]
    k = len(lhs)
    out = set()
    for b in sorted({b for b, _ in view if b <= m_b}):
        above = [v for x, v in view if x > b]
        if not above:
            continue
        pool = minimal(above)
        sel = minimal(v for x, v in view if x == b)
        sel = {v for v in sel if not any(all(p[j] <= v[j] for j in range(k)) for p in pool)}
        prior = [min(v[j] for v in above) for j in range(k)]
        best = []
        for j in range(k):
            capped = [v[j] for v in sel if v[j] <= m_l[j]]
            best.append(min(capped) if capped and min(capped) < prior[j] else None)
            if best[j] is not None:
                out.add((b, tuple(best[j] if i == j else None for i in range(k))))
        for v in sel:
            free = [j for j in range(k) if best[j] is None or v[j] != best[j]]
            if len(free) < 2:
                continue
            if len(free) < k and any(all(p[j] <= v[j] for j in free) for p in pool):
                continue
            found = False
            for x in pool:
                s = [j for j in free if v[j] <= x[j]]
                if not any(z != x and all(z[j] <= v[j] for j in s) for z in pool):
                    found = True
                    out.add((b, tuple(v[j] if j in s else None for j in range(k))))
            if not found:
                out.add((b, tuple(v[j] if j in free else None for j in range(k))))
    return {(b, tuple(None if t == INF else t for t in v)) for b, v in out}
