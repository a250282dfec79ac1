"""SQL twin of every registered query that plain SQL can express over whole tables."""

from __future__ import annotations

from catalog import sql as S
from catalog.queries import LEXICON, LHS, RHS
from catalog.relations import (
    BRANDS,
    CUSTOMERS,
    GAPS,
    GRID,
    HOURS,
    LINES,
    MONTHS,
    NATIONS,
    PARTS,
    SEGMENTS,
    SHIPPING,
    SUPPLIER,
    USERS,
    Relation,
)

MONTH_CTES = f"{S.vectors(MONTHS)},\n{S.front(MONTHS, RHS, '')},\n{S.levels(MONTHS, RHS, '')}"
COLS = ", ".join(LHS)


def month(select: str) -> str:
    return f"WITH {MONTH_CTES}\n{select}"


def matrix(rel: Relation) -> str:
    return f"WITH {S.vectors(rel)} SELECT * FROM d"


def rules(rel: Relation, rhs: list[str] | None = None, parts: str = "both", select: str = "SELECT * FROM rules") -> str:
    return f"WITH {S.rules(rel, rhs, parts)}\n{select}"


def cap(c: str, row: str = "s") -> str:
    return f"CASE WHEN {row}.{c} <= (SELECT {c} FROM med) THEN {row}.{c} END"


def label(rel: Relation) -> str:
    arms = " ".join(
        "WHEN '{}' THEN '{}'".format(
            r, '{"lhs":[' + ",".join(f'"{c}"' for c in rel.names if c != r) + f'],"rhs":["{r}"]}}'
        )
        for r in rel.names
    )
    return f"CASE rhs {arms} END"


def rule_text(rel: Relation) -> str:
    parts = ", ".join(
        f"CASE WHEN {c} IS NOT NULL THEN '{c}(<= ' || CAST(round({c}, 2) AS VARCHAR) || ')' END" for c in rel.names
    )
    return f"concat_ws(', ', {parts}) || ' -> ' || rhs || '(<= ' || CAST(round(rhs_threshold, 2) AS VARCHAR) || ')'"


def minimal(rel: Relation) -> str:
    weaker = " AND ".join(f"(q.{c} IS NULL OR coalesce(q.{c} >= p.{c}, FALSE))" for c in rel.names)
    other = " OR ".join(f"q.{c} IS DISTINCT FROM p.{c}" for c in rel.names)
    return (
        f"SELECT * FROM rules p WHERE NOT EXISTS (SELECT 1 FROM rules q WHERE q.rhs = p.rhs AND {weaker} "
        f"AND q.rhs_threshold <= p.rhs_threshold AND (q.rhs_threshold <> p.rhs_threshold OR {other}))"
    )


def with_kind(rel: Relation, columns, sql: str) -> Relation:
    return Relation(rel.name, columns, rel.load, sql)


# Months with the order count halved, and the fractional distances up to the median left out.
HALVES = with_kind(
    MONTHS, (("month", "days"), ("half", "num"), ("buyers", "num")),
    f"SELECT month, orders / 2 AS half, buyers FROM ({MONTHS.sql})",
)


def integral() -> str:
    whole = S.rules(HALVES, ["half"])
    kept = "FROM (SELECT * FROM d WHERE half > (SELECT half FROM med) OR half = floor(half)) GROUP BY"
    return f"WITH {whole.replace('FROM d GROUP BY', kept)}\nSELECT * FROM rules"


# Segments measured by nation name; the tree nation -> region -> world gives paths of 0, 2 or 4 edges.
NAMED = f"""SELECT n_name, c_mktsegment, customers, balance, n_regionkey FROM ({SEGMENTS.sql}) JOIN nation ON c_nationkey = n_nationkey"""


def path_distance(a: str, b: str) -> str:
    return (
        f"CASE WHEN {a}.n_name = {b}.n_name THEN 0.0 WHEN {a}.n_regionkey = {b}.n_regionkey "
        "THEN CAST(1.0 AS DOUBLE) - CAST(1.0 AS DOUBLE) / 3 ELSE CAST(1.0 AS DOUBLE) - CAST(1.0 AS DOUBLE) / 5 END"
    )


def taxonomy_rules() -> str:
    rel = with_kind(SEGMENTS, (("n_name", "text"), ("c_mktsegment", "text"), ("customers", "num"), ("balance", "num")), NAMED)
    text = S.rules(rel)
    text = text.replace("CAST(levenshtein(x.n_name, y.n_name) AS DOUBLE)", path_distance("x", "y"))
    text = text.replace("count(*) AS copies", "any_value(n_regionkey) AS n_regionkey, count(*) AS copies", 1)
    return f"WITH {text}\nSELECT * FROM rules"


TAXONOMY = f"""WITH t AS (SELECT s_name, n_name, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT x.s_name AS term_a, y.s_name AS term_b, {path_distance('x', 'y')} AS distance
FROM t x JOIN t y ON x.s_name < y.s_name"""

UPPER = f"""up AS MATERIALIZED (SELECT DISTINCT {COLS} FROM d WHERE {RHS} > (SELECT {RHS} FROM med)),
pool0 AS MATERIALIZED (SELECT * FROM up p WHERE NOT EXISTS (SELECT 1 FROM up q WHERE
  {' AND '.join(f'q.{c} <= p.{c}' for c in LHS)} AND ({' OR '.join(f'q.{c} < p.{c}' for c in LHS)}))),
low AS (SELECT month, orders, buyers, top_price FROM d WHERE {RHS} <= (SELECT {RHS} FROM med))"""


def subset(compare: str) -> str:
    cond = " AND ".join(f"(y.{c} IS NULL OR x.{c} {compare} y.{c})" for c in LHS)
    return month("").rstrip() + f""",
{UPPER},
part AS (SELECT DISTINCT CASE WHEN month <= 400 THEN month END AS month, orders, buyers, top_price FROM low)
SELECT * FROM part y WHERE EXISTS (SELECT 1 FROM pool0 x WHERE {cond})"""


SINGLETONS = "\nUNION ".join(
    f"SELECT s.{RHS} AS rhs, '{c}' AS attribute, {cap(c)} AS threshold FROM s WHERE {cap(c)} IS NOT NULL" for c in LHS
)
HIT = {c: f"CASE WHEN {cap(c)} = b_{c} THEN s.{c} END" for c in LHS}
LEXICON_ROWS = ", ".join(f"('{w}', {n})" for w, n in LEXICON.items())
PAIRS = {"supplier": "supplier x JOIN supplier y ON x.s_suppkey < y.s_suppkey"}


def profile() -> str:
    parts = []
    for rel in (SEGMENTS, MONTHS):
        names = " UNION ALL ".join(f"SELECT '{c}' AS rhs" for c in rel.names)
        parts.append(
            f"""SELECT '{rel.name}' AS ds_name, (SELECT count(*) FROM ({rel.sql})) AS ds_len, CAST({len(rel.names)} AS BIGINT) AS ds_attr_size,
  (SELECT count(*) * (count(*) - 1) // 2 FROM ({rel.sql})) AS pairs, {label(rel)} AS combination, coalesce(n, 0) AS rfd_count
FROM ({names}) LEFT JOIN (SELECT rhs, count(*) AS n FROM ({rules(rel)}) GROUP BY rhs) USING (rhs)"""
        )
    return "\nUNION ALL ".join(parts)


def file_line(name: str, columns: list[str], types: str, sep: str) -> str:
    """A table's line in the corpus: its bytes are those of its cells, separators and line ends."""
    bytes_ = " + ".join(f"octet_length(encode(CAST({c} AS VARCHAR)))" for c in columns)
    return (
        f"SELECT '{name}.csv' AS ds_name, '{sep}' AS sep, FALSE AS header, count(*) AS ds_len, CAST({len(columns)} AS BIGINT) AS ds_attr_size, "
        f"'{types}' AS types, CAST(sum({bytes_} + {len(columns)}) AS BIGINT) AS ds_file_size_B, count(*) * (count(*) - 1) // 2 AS pairs FROM {name}"
    )


def size_line(name: str, columns: int) -> str:
    return (
        f"SELECT '{name}' AS ds_name, count(*) AS ds_len, CAST({columns} AS BIGINT) AS ds_attr_size, "
        f"count(*) * (count(*) - 1) // 2 AS pairs FROM {name}"
    )


WORDS = "string_split(text, ' ')"
FLAT = f"""SELECT '2024-01-01' AS created_at, md5(text) AS text, n_chars AS retweet_count, doc_id AS favourite_count,
  CAST(quality AS DOUBLE) AS sentiment_score, CAST(len({WORDS}) AS BIGINT) AS sentiment_tokens,
  CAST(quality AS DOUBLE) / 4 * 100 AS sentiment_comparative,
  CAST(len(list_filter({WORDS}, lambda w: length(w) > 9)) AS BIGINT) AS sentiment_positive_count,
  CAST(len(list_filter({WORDS}, lambda w: length(w) < 3)) AS BIGINT) AS sentiment_negative_count,
  CAST(len(list_filter({WORDS}, lambda w: length(w) > 6)) AS BIGINT) AS sentiment_word_count,
  CAST(doc_id AS VARCHAR) AS _msgid
FROM documents LEFT JOIN labels USING (doc_id)"""

SCORES = f"""WITH lex(word, weight) AS (VALUES {LEXICON_ROWS}),
w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}'']+')) AS word FROM documents),
s AS (SELECT doc_id, count(*) AS n, sum(coalesce(weight, 0)) AS score, count(*) FILTER (WHERE weight > 0) AS pos,
  count(*) FILTER (WHERE weight < 0) AS neg FROM w LEFT JOIN lex USING (word) GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS sentiment_tokens, CAST(coalesce(score, 0) AS DOUBLE) AS sentiment_score,
  coalesce(pos, 0) AS sentiment_positive_count, coalesce(neg, 0) AS sentiment_negative_count,
  CASE WHEN n > 0 THEN CAST(score AS DOUBLE) / n * 100 ELSE 0.0 END AS sentiment_comparative
FROM documents LEFT JOIN s USING (doc_id)"""

WINDOWS = """SELECT window_start, rank, ts, event_id, value FROM (SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS window_start, ts, event_id, value,
      row_number() OVER (PARTITION BY time_bucket(INTERVAL 10 MINUTE, ts) ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 5"""

ORACLES = {
    "distance_numeric": f"""SELECT x.s_suppkey AS s_suppkey_a, y.s_suppkey AS s_suppkey_b,
      CAST(abs(x.s_nationkey - y.s_nationkey) AS DOUBLE) AS s_nationkey, abs(x.s_acctbal - y.s_acctbal) AS s_acctbal FROM {PAIRS['supplier']}""",
    "distance_edit": f"""SELECT x.s_suppkey AS s_suppkey_a, y.s_suppkey AS s_suppkey_b,
      CAST(levenshtein(x.s_name, y.s_name) AS DOUBLE) AS s_name FROM {PAIRS['supplier']}""",
    "distance_days": f"""WITH m AS (SELECT month, strftime(month, '%Y-%m') AS id FROM ({MONTHS.sql}))
      SELECT x.id AS id_a, y.id AS id_b, CAST(abs(datesub('day', x.month, y.month)) AS DOUBLE) AS month FROM m x JOIN m y ON x.id < y.id""",
    "distance_null_rule": """WITH u AS (SELECT user_id, CASE WHEN n > 12 THEN n END AS few FROM
      (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS n FROM events GROUP BY user_id))
      SELECT x.user_id AS user_id_a, y.user_id AS user_id_b, CAST(CASE WHEN x.few IS NULL AND y.few IS NULL THEN 0
        WHEN x.few IS NULL OR y.few IS NULL THEN -1 ELSE abs(x.few - y.few) END AS DOUBLE) AS few
      FROM u x JOIN u y ON x.user_id < y.user_id""",
    "distance_matrix_supplier": matrix(SUPPLIER),
    "distance_matrix_lines": matrix(LINES),
    "distance_matrix_parts": matrix(PARTS),
    "distance_matrix_grid": matrix(GRID),
    "tiled_pairs_count": "SELECT count(*) * (count(*) - 1) // 2 AS pairs FROM customer",
    "value_distances": """WITH v AS (SELECT DISTINCT p_name AS n FROM part)
      SELECT x.n AS value_a, y.n AS value_b, CAST(levenshtein(x.n, y.n) AS DOUBLE) AS distance FROM v x JOIN v y ON x.n < y.n""",
    "memo_lookup": """SELECT user_id, first_type, last_type, CAST(levenshtein(first_type, last_type) AS DOUBLE) AS distance FROM
      (SELECT user_id, arg_min(event_type, event_id) AS first_type, arg_max(event_type, event_id) AS last_type
       FROM (SELECT user_id, event_type, row_number() OVER (ORDER BY ts, event_id) AS event_id FROM events) GROUP BY user_id)""",
    "medians": month("SELECT * FROM med"),
    "approximate_medians": month(f"SELECT {', '.join(f'quantile_disc({c}, 0.5) AS {c}' for c in MONTHS.names)} FROM d"),
    "narrowed_medians": month("SELECT * FROM med"),
    "levels": month(f"SELECT DISTINCT {RHS} FROM d"),
    "above_median": month(f"SELECT * FROM d WHERE {RHS} > (SELECT {RHS} FROM med)"),
    "up_to_median": month(f"SELECT * FROM d WHERE {RHS} <= (SELECT {RHS} FROM med)"),
    "split_sides": month(f"SELECT {RHS} AS rhs, month, buyers FROM d"),
    "max_reduce": month("SELECT * FROM m"),
    "skyline": month("SELECT * FROM s"),
    "skyline_tiled": month("SELECT * FROM s"),
    "pools": month(
        f"""SELECT p.b AS level, {', '.join(f'p.{c}' for c in LHS)}, max(s.{RHS}) AS rhs FROM pool p
        JOIN s ON {' AND '.join(f's.{c} = p.{c}' for c in LHS)} AND s.{RHS} > p.b GROUP BY ALL"""
    ),
    "prior_min": month(
        f"""SELECT {RHS} AS rhs, {', '.join(f'min({c}) AS {c}' for c in LHS)},
        {', '.join(f'min(min({c})) OVER (ORDER BY {RHS} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_{c}' for c in LHS)}
        FROM s GROUP BY {RHS}"""
    ),
    "range_min": month(f"SELECT {RHS} AS rhs, {', '.join(f'min({cap(c)}) AS {c}' for c in LHS)} FROM s GROUP BY {RHS}"),
    "cap_at_median": month(f"SELECT {RHS} AS rhs, {', '.join(f'{cap(c)} AS {c}' for c in LHS)} FROM s"),
    "min_hits": month(f"SELECT s.{RHS} AS rhs, {', '.join(f'{HIT[c]} AS {c}' for c in LHS)} FROM s JOIN best ON best.b = s.{RHS}"),
    "complement": month(
        f"""SELECT s.{RHS} AS rhs, CAST({' + '.join(f'CAST(({HIT[c]}) IS NULL AS INT)' for c in LHS)} AS BIGINT) AS open,
        {', '.join(f'CASE WHEN ({HIT[c]}) IS NULL THEN s.{c} END AS {c}' for c in LHS)} FROM s JOIN best ON best.b = s.{RHS}"""
    ),
    "singletons": month(SINGLETONS),
    "slices": month(
        f"SELECT DISTINCT v.b AS rhs, {', '.join(f'CASE WHEN v.{c} <= x.{c} THEN v.{c} END AS {c}' for c in LHS)} FROM v JOIN pool x ON x.b = v.b"
    ),
    "not_dominating": month("").rstrip()
    + f",\n{UPPER}\nSELECT * FROM low y WHERE NOT EXISTS (SELECT 1 FROM pool0 x WHERE {' AND '.join(f'x.{c} <= y.{c}' for c in LHS)})",
    "dominates_subset": subset("<="),
    "dominates_subset_strict": subset("<"),
    "single_rfds": rules(MONTHS, [RHS], "singles"),
    "composite_rfds": rules(MONTHS, [RHS], "composites"),
    "discover_supplier": rules(SUPPLIER),
    "discover_months": rules(MONTHS),
    "discover_segments": rules(SEGMENTS),
    "discover_customers": rules(CUSTOMERS),
    "discover_lines": rules(LINES),
    "discover_parts": rules(PARTS),
    "discover_grid": rules(GRID),
    "discover_users": rules(USERS),
    "discover_brands": rules(BRANDS),
    "discover_shipping": rules(SHIPPING),
    "discover_hours": rules(HOURS),
    "discover_gaps": rules(GAPS),
    "discover_nations": rules(NATIONS),
    "discover_given_sides": None,
    "discover_one_rhs": rules(MONTHS, ["top_price"]),
    "discover_given_medians": rules(MONTHS),
    "discover_given_medians_customers": rules(CUSTOMERS),
    "discover_integral_levels": integral(),
    "discover_from_vectors": rules(SEGMENTS, ["customers"]),
    "discover_taxonomy": taxonomy_rules(),
    "discover_all": rules(MONTHS, select=f"SELECT *, {label(MONTHS)} AS combination FROM rules"),
    "minimal_rfds": rules(MONTHS, select=minimal(MONTHS)),
    "discover_strategies": rules(SEGMENTS, select=minimal(SEGMENTS)),
    "format_rfd": rules(MONTHS, select=f"SELECT {rule_text(MONTHS)} AS rule FROM rules"),
    "to_wide": rules(SEGMENTS),
    "rfd_counts": rules(MONTHS, select="SELECT rhs, count(*) AS rfd_count FROM rules GROUP BY rhs"),
    "order_sides": rules(
        SEGMENTS, ["customers"], select="SELECT c_nationkey, c_mktsegment, balance, rhs_threshold FROM rules"
    ),
    "taxonomy_distance": TAXONOMY,
    "rfd_violations": """SELECT x.o_orderkey AS o_orderkey_a, y.o_orderkey AS o_orderkey_b,
      CAST(abs(x.o_custkey - y.o_custkey) AS DOUBLE) AS o_custkey, CAST(abs(datesub('day', x.o_orderdate, y.o_orderdate)) AS DOUBLE) AS o_orderdate,
      abs(x.o_totalprice - y.o_totalprice) AS o_totalprice
      FROM orders x JOIN orders y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey
      WHERE abs(datesub('day', x.o_orderdate, y.o_orderdate)) <= 3 AND abs(x.o_totalprice - y.o_totalprice) > 250000""",
    "rfd_check_lines": """WITH l AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS rid FROM lineitem)
      SELECT count(*) AS violations, count(*) = 0 AS holds FROM l x JOIN l y ON x.l_quantity = y.l_quantity
      AND x.l_discount = y.l_discount AND x.rid < y.rid WHERE abs(x.l_extendedprice - y.l_extendedprice) > 80000""",
    "rfd_check_customers": f"""WITH c AS ({CUSTOMERS.sql}) SELECT count(*) AS violations, count(*) = 0 AS holds
      FROM c x JOIN c y ON x.o_custkey < y.o_custkey WHERE abs(x.orders - y.orders) <= 1 AND abs(x.spend - y.spend) <= 1
      AND abs(datesub('day', x.last_month, y.last_month)) > 900""",
    "rfd_holds": """SELECT count(*) AS violations, count(*) = 0 AS holds FROM part x JOIN part y ON x.p_partkey < y.p_partkey
      WHERE abs(x.p_retailprice - y.p_retailprice) <= 0.01 AND abs(x.p_size - y.p_size) > 60""",
    "rfd_check_names": """SELECT count(*) AS violations, count(*) = 0 AS holds FROM customer x JOIN customer y ON x.c_custkey < y.c_custkey
      WHERE levenshtein(x.c_name, y.c_name) <= 1 AND abs(x.c_nationkey - y.c_nationkey) > 20""",
    "edit_pairs": """SELECT x.v AS value_a, y.v AS value_b, levenshtein(x.v, y.v)::INTEGER AS distance
      FROM (SELECT DISTINCT c_name AS v FROM customer) x JOIN (SELECT DISTINCT c_name AS v FROM customer) y ON x.v < y.v WHERE levenshtein(x.v, y.v) <= 1""",
    "dependency_profile": profile(),
    "table_profile": f"{size_line('lineitem', 11)} UNION ALL {size_line('orders', 6)}",
    "metrics_summary": """SELECT l_returnflag AS ds_name, l_linenumber AS rfd_count, avg(l_quantity) AS time_elapsed
      FROM lineitem GROUP BY ALL""",
    "top_k_per_window": f"SELECT window_start, rank, event_id, value FROM ({WINDOWS})",
    # One micro-batch: every window that ends before the latest time less the delay is closed.
    "stream_top_k": f"""SELECT * FROM ({WINDOWS})
      WHERE window_start + INTERVAL 10 MINUTE < date_trunc('milliseconds', (SELECT max(ts) FROM events)) - INTERVAL 10 MINUTE""",
    "top_k": "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 5",
    "filter_records": "SELECT doc_id, n_chars FROM documents WHERE lang = 'en'",
    "escape_newlines": "SELECT doc_id, md5(replace(text, chr(10), '\\n')) AS digest FROM documents",
    "event_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "flatten_message": FLAT,
    "route_by_word_count": f"""SELECT _msgid, CASE WHEN sentiment_word_count < 1 THEN 'none' ELSE 'some' END AS route, sentiment_word_count FROM ({FLAT})""",
    "score_lexicon": SCORES,
    "read_table": "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier",
    "read_table_dates": """SELECT o_orderkey, date_trunc('day', o_orderdate) AS day, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status,
      o_totalprice FROM orders""",
    "corpus_profile": " UNION ALL ".join(map(file_line, *zip(
        ("customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], "bigint,string,bigint,string", ";"),
        ("orders", ["o_orderkey", "o_custkey", "o_orderstatus"], "bigint,bigint,string", ","),
        ("part", ["p_partkey", "p_name", "p_size"], "bigint,string,bigint", "|"),
    ))),
    "decimal_comma": "SELECT s_suppkey, replace(CAST(s_acctbal AS VARCHAR), '.', ',') AS s_acctbal FROM supplier",
}
ORACLES["discover_given_sides"] = (
    f"WITH {S.rules(with_kind(MONTHS, tuple(c for c in MONTHS.columns if c[0] != 'top_price'), MONTHS.sql), ['buyers'])}\n"
    "SELECT rhs, rhs_threshold, month, orders, buyers, CAST(NULL AS DOUBLE) AS top_price FROM rules"
)
