"""SQL twins, written from the definitions: pairs by a plain self-join, pools level by level."""

from __future__ import annotations

from catalog.relations import Relation


def distance(kind: str, a: str, b: str) -> str:
    measured = f"abs({a} - {b})"
    if kind == "text":
        measured = f"levenshtein({a}, {b})"
    if kind == "days":
        measured = f"abs(datesub('day', {a}, {b}))"
    missing = f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN 0.0 ELSE 'Infinity'::DOUBLE END"
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN {missing} ELSE CAST({measured} AS DOUBLE) END"


def vectors(rel: Relation) -> str:
    """CTEs ``r`` (numbered distinct rows with their number), ``d`` (distinct distance vectors) and ``med``."""
    order = ", ".join(rel.names)
    terms = ", ".join(f"{distance(k, f'x.{c}', f'y.{c}')} AS {c}" for c, k in rel.columns)
    zeros = ", ".join("0.0" for _ in rel.names)
    return f"""r AS MATERIALIZED (SELECT {order}, count(*) AS copies, row_number() OVER (ORDER BY {order}) AS rid
  FROM ({rel.sql}) GROUP BY {order}),
d AS MATERIALIZED (SELECT {terms} FROM r x JOIN r y ON x.rid < y.rid UNION SELECT {zeros} FROM r WHERE copies > 1),
med AS MATERIALIZED (SELECT {', '.join(f'median({c}) AS {c}' for c in rel.names)} FROM d)"""


def both(parts: list[str]) -> str:
    return " AND ".join(parts)


def either(parts: list[str]) -> str:
    return "(" + " OR ".join(parts) + ")"


def front(rel: Relation, rhs: str, tag: str) -> str:
    """CTEs ``m`` (largest rhs per lhs vector) and ``s`` (the front)."""
    lhs = [c for c in rel.names if c != rhs]
    beat = both([f"q.{c} <= p.{c}" for c in lhs] + [f"q.{rhs} >= p.{rhs}"])
    differ = either([f"q.{c} < p.{c}" for c in lhs] + [f"q.{rhs} > p.{rhs}"])
    cols = ", ".join(lhs)
    return f"""m{tag} AS MATERIALIZED (SELECT {cols}, max({rhs}) AS {rhs} FROM d GROUP BY {cols}),
s{tag} AS MATERIALIZED (SELECT * FROM m{tag} p WHERE NOT EXISTS (SELECT 1 FROM m{tag} q WHERE {beat} AND {differ}))"""


def levels(rel: Relation, rhs: str, tag: str) -> str:
    """CTEs ``lev`` (levels up to the median with something above), ``pool`` and ``v`` (selected rows with open flags)."""
    lhs = [c for c in rel.names if c != rhs]
    below = both([f"z.{c} <= x.{c}" for c in lhs])
    differ = either([f"z.{c} < x.{c}" for c in lhs])
    prior = ", ".join(f"min(x.{c}) AS p_{c}" for c in lhs)
    capped = ", ".join(f"min(CASE WHEN s.{c} <= (SELECT {c} FROM med) THEN s.{c} END) AS m_{c}" for c in lhs)
    keep = ", ".join(f"CASE WHEN m_{c} < p_{c} THEN m_{c} END AS b_{c}" for c in lhs)
    flags = ", ".join(f"NOT coalesce(s.{c} = best.b_{c}, FALSE) AS o_{c}" for c in lhs)
    return f"""lev{tag} AS MATERIALIZED (SELECT DISTINCT {rhs} AS b FROM s{tag} WHERE {rhs} <= (SELECT {rhs} FROM med)
  AND {rhs} < (SELECT max({rhs}) FROM s{tag})),
pool{tag} AS MATERIALIZED (SELECT lev.b, {', '.join(f'x.{c}' for c in lhs)} FROM lev{tag} lev JOIN s{tag} x ON x.{rhs} > lev.b
  WHERE NOT EXISTS (SELECT 1 FROM s{tag} z WHERE z.{rhs} > lev.b AND {below} AND {differ})),
best{tag} AS MATERIALIZED (SELECT b, {keep}
  FROM (SELECT s.{rhs} AS b, {capped} FROM s{tag} s GROUP BY s.{rhs}) JOIN
       (SELECT lev.b, {prior} FROM lev{tag} lev JOIN s{tag} x ON x.{rhs} > lev.b GROUP BY lev.b) USING (b)),
v{tag} AS MATERIALIZED (SELECT s.{rhs} AS b, {', '.join(f's.{c}' for c in lhs)}, {flags} FROM s{tag} s JOIN best{tag} best ON best.b = s.{rhs})"""


def wide(rel: Relation, rhs: str, values: dict[str, str]) -> str:
    cols = ", ".join(f"nullif(CAST({values.get(c, 'NULL')} AS DOUBLE), 'Infinity'::DOUBLE) AS {c}" for c in rel.names)
    return f"'{rhs}' AS rhs, b AS rhs_threshold, {cols}"


def singles(rel: Relation, rhs: str, tag: str) -> str:
    lhs = [c for c in rel.names if c != rhs]
    return "\nUNION ".join(
        f"SELECT {wide(rel, rhs, {c: f'b_{c}'})} FROM best{tag} WHERE b_{c} IS NOT NULL" for c in lhs
    )


def composites(rel: Relation, rhs: str, tag: str) -> str:
    lhs = [c for c in rel.names if c != rhs]
    n_open = " + ".join(f"CAST(o_{c} AS INT)" for c in lhs)
    taken = both([f"(NOT v.o_{c} OR x.{c} <= v.{c})" for c in lhs])
    part_open = "NOT (" + both([f"v.o_{c}" for c in lhs]) + ")"
    usable = f"({n_open}) >= 2 AND NOT ({part_open} AND EXISTS (SELECT 1 FROM pool{tag} x WHERE x.b = v.b AND {taken}))"
    other = either([f"z.{c} <> x.{c}" for c in lhs])
    inside = both([f"(NOT (v.o_{c} AND v.{c} <= x.{c}) OR z.{c} <= v.{c})" for c in lhs])
    sound = f"NOT EXISTS (SELECT 1 FROM pool{tag} z WHERE z.b = v.b AND {other} AND {inside})"
    sliced = wide(rel, rhs, {c: f"CASE WHEN v.o_{c} AND v.{c} <= x.{c} THEN v.{c} END" for c in lhs}).replace("b AS", "v.b AS", 1)
    whole = wide(rel, rhs, {c: f"CASE WHEN v.o_{c} THEN v.{c} END" for c in lhs}).replace("b AS", "v.b AS", 1)
    return f"""SELECT {sliced} FROM v{tag} v JOIN pool{tag} x ON x.b = v.b WHERE {usable} AND {sound}
UNION SELECT {whole} FROM v{tag} v WHERE {usable}
  AND NOT EXISTS (SELECT 1 FROM pool{tag} x WHERE x.b = v.b AND {sound})"""


def rules(rel: Relation, rhs: list[str] | None = None, parts: str = "both") -> str:
    """CTE ``rules``: all dependencies of the chosen right sides, wide."""
    ctes, selects = [vectors(rel)], []
    for i, c in enumerate(rhs or rel.names):
        tag = f"_{i}"
        ctes += [front(rel, c, tag), levels(rel, c, tag)]
        if parts in ("both", "singles"):
            selects.append(singles(rel, c, tag))
        if parts in ("both", "composites"):
            selects.append(composites(rel, c, tag))
    body = "\nUNION ".join(selects)
    return ",\n".join(ctes) + f",\nrules AS MATERIALIZED ({body})"


