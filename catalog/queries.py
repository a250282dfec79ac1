"""Registered queries: name -> (spark, sf_dir) -> DataFrame.  Every query runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

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
    table,
)
from softdeps.functions.formatting import format_rfd, order_sides, to_long, to_wide
from softdeps.functions.lexicon import score_lexicon
from softdeps.operators import levels as L
from softdeps.operators import stats as St
from softdeps.operators.cover import minimal_rfds
from softdeps.operators.edits import edit_pairs
from softdeps.operators.pairs import distance_matrix, distance_vectors, lookup_distance, row_pairs, value_distances
from softdeps.operators.skyline import max_reduce, skyline
from softdeps.operators.taxonomy import taxonomy_distance
from softdeps.operators.topk import append, top_k, top_k_per_window
from softdeps.operators.verify import rfd_check, rfd_violations
from softdeps.plans.discover import (
    candidate_levels,
    composite_rfds,
    discover_all,
    discover_from_vectors,
    discover_rfds,
    relational_front,
    single_rfds,
    split_sides,
    to_attributes,
    vector_front,
)
from softdeps.plans.report import dependency_profile
from softdeps.session import scratch_dir, stage, stage_counted
from softdeps.sources.messages import (
    MESSAGE_SCHEMA,
    escape_newlines,
    filter_records,
    flatten_message,
    parse_messages,
    route_by_word_count,
)
from softdeps.sources.sinks import decimal_comma, write_rfds
from softdeps.sources.tables import corpus_profile, infer_dialect, read_table
from softdeps.streaming.topk import run_until, start_sink, stream_top_k

# A small word list with weights, for texts of any language in the tables.
LEXICON = {"the": 1, "and": 1, "is": 2, "that": -1, "with": 1, "of": -1, "le": -2, "la": 2, "der": -1, "und": 1, "que": -1}

RHS, LHS = "orders", ["month", "buyers", "top_price"]
SUPPLIER_NAMES = SUPPLIER.names


# -- distances ----------------------------------------------------------------


def distance_numeric(spark: SparkSession, d: str) -> DataFrame:
    return distance_matrix(table(spark, d, "supplier"), dedup=False, key="s_suppkey", columns=["s_nationkey", "s_acctbal"])


def distance_edit(spark, d):
    return distance_matrix(table(spark, d, "supplier"), dedup=False, key="s_suppkey", columns=["s_name"])


def distance_days(spark, d):
    months = MONTHS.load(spark, d).withColumn("id", F.date_format("month", "yyyy-MM"))
    return distance_matrix(months, dedup=False, key="id", columns=["month"])


def distance_null_rule(spark, d):
    e = table(spark, d, "events")
    purchases = F.count_if(F.col("event_type") == "purchase")
    users = e.groupBy("user_id").agg(F.when(purchases > 12, purchases).alias("few"))
    pairs = distance_matrix(users, dedup=False, key="user_id", columns=["few"])
    return pairs.withColumn("few", F.when(F.col("few") == float("inf"), F.lit(-1.0)).otherwise(F.col("few")))


def part_names(spark, d):
    return value_distances(table(spark, d, "part"), "p_name")


def memo_lookup(spark, d):
    e = table(spark, d, "events")
    ends = e.groupBy("user_id").agg(
        F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"),
        F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"),
    )
    return lookup_distance(ends, value_distances(e, "event_type"), "first_type", "last_type", "distance")


def matrix_of(rel: Relation):
    return lambda spark, d: distance_vectors(rel.load(spark, d), rel.names)


def tiled_pairs_count(spark, d):
    customers = table(spark, d, "customer").select("c_custkey")
    return row_pairs(customers, "c_custkey").agg(F.count(F.lit(1)).alias("pairs"))


# -- operators on distance vectors ----------------------------------------------


def _month_vectors(spark, d) -> DataFrame:
    return stage(distance_vectors(MONTHS.load(spark, d), MONTHS.names), "months")


def medians(spark, d):
    return St.medians(distance_vectors(MONTHS.load(spark, d), MONTHS.names))


def sketched_medians(spark, d):
    return St.approximate_medians(distance_vectors(MONTHS.load(spark, d), MONTHS.names))


def narrowed_medians(spark, d):
    vectors = _month_vectors(spark, d)
    values = St.median_values(vectors, limit=100, size=1_000_000)
    return spark.range(1).select(*[F.lit(values[c]).alias(c) for c in MONTHS.names])


def levels(spark, d):
    return St.levels(distance_vectors(MONTHS.load(spark, d), MONTHS.names), RHS)


def above_median(spark, d):
    v = _month_vectors(spark, d)
    return St.above_median(v, RHS, St.median_values(v)[RHS])


def up_to_median(spark, d):
    v = _month_vectors(spark, d)
    return St.up_to_median(v, RHS, St.median_values(v)[RHS])


def sides(spark, d):
    return split_sides(_month_vectors(spark, d), RHS, ["month", "buyers"])


def reduced(spark, d):
    return max_reduce(distance_vectors(MONTHS.load(spark, d), MONTHS.names), LHS, RHS)


def month_skyline(spark, d):
    return skyline(_month_vectors(spark, d), LHS, RHS)


def tiled_skyline(spark, d):
    return skyline(_month_vectors(spark, d), LHS, RHS, tile_rows=64)


def _front(spark, d):
    v = _month_vectors(spark, d)
    medians_ = St.median_values(v)
    front, n = vector_front(v, [(RHS, LHS)], medians_)
    return front, n, medians_


def _named(df: DataFrame, prefix: str = "") -> DataFrame:
    return df.withColumnsRenamed({f"{prefix}l{j}": f"{prefix}{c}" for j, c in enumerate(LHS)})


def pools(spark, d):
    front, _, medians_ = _front(spark, d)
    lev = front.where(F.col("rhs") <= medians_[RHS]).select("rhs_name", F.col("rhs").alias("level")).distinct()
    return _named(L.pools(front, 3, lev).drop("rhs_name"))


def prior_min(spark, d):
    front, _, _ = _front(spark, d)
    minima = front.groupBy("rhs_name", "rhs").agg(*[F.min(f"l{j}").alias(f"l{j}") for j in range(3)])
    out = L.prior_min(minima, ["l0", "l1", "l2"], "rhs_name", "rhs")
    return _named(_named(out.drop("rhs_name")), "prior_")


def range_min(spark, d):
    front, _, medians_ = _front(spark, d)
    capped = L.cap_at_median(_named(front), LHS, medians_)
    return L.range_minima(capped, LHS, ["rhs"])


def cap_at_median(spark, d):
    front, _, medians_ = _front(spark, d)
    return L.cap_at_median(_named(front).drop("rhs_name"), LHS, medians_)


def _levels(spark, d):
    front, n, medians_ = _front(spark, d)
    return candidate_levels(front, n, [(RHS, LHS)], medians_), front


def min_hits(spark, d):
    rows, _ = _levels(spark, d)
    capped = rows.drop("l0", "l1", "l2").withColumnsRenamed({f"capped_l{j}": f"l{j}" for j in range(3)})
    return _named(L.min_hits(capped, ["l0", "l1", "l2"]).select("rhs", "l0", "l1", "l2"))


def complement(spark, d):
    rows, _ = _levels(spark, d)
    hits = L.min_hits(
        rows.withColumns({f"o{j}": F.col(f"l{j}") for j in range(3)}).withColumns({f"l{j}": F.col(f"capped_l{j}") for j in range(3)}),
        ["l0", "l1", "l2"],
    )
    counted = hits.withColumn("open", L.null_count(["l0", "l1", "l2"]).cast("bigint"))
    return _named(L.complement(counted, ["l0", "l1", "l2"], ["o0", "o1", "o2"]).select("rhs", "open", "l0", "l1", "l2"))


def singletons(spark, d):
    front, _, medians_ = _front(spark, d)
    return L.singletons(L.cap_at_median(_named(front), LHS, medians_), LHS, ["rhs"]).distinct()


def slices(spark, d):
    """Selected rows against the rows of their pool, cut where the pool row is lower; distinct slices."""
    rows, front = _levels(spark, d)
    tiles = L.tiles_for(front)
    intervals = L.pool_intervals(front, 3, tiles)
    alive = (F.col("b.rhs") > F.col("a.rhs")) & (F.col("b.kill").isNull() | (F.col("b.kill") <= F.col("a.rhs")))
    met = L.cross_cells(rows.select(*front.columns), intervals, ["rhs_name"], alive, (tiles, tiles))
    cut = L.slice_row(met, ["l0", "l1", "l2"])
    return cut.select("a.rhs", *[F.col(f"slice_l{j}").alias(c) for j, c in enumerate(LHS)]).distinct()


def _upper_pool(spark, d):
    """Vectors up to the rhs median, and the least vectors above it."""
    v = _month_vectors(spark, d)
    median = St.median_values(v)[RHS]
    above = St.above_median(v, RHS, median).withColumn("g", F.lit(0.0))
    pool = skyline(above, LHS, "g").withColumn("grp", F.lit(1))
    return St.up_to_median(v, RHS, median).withColumn("grp", F.lit(1)), pool


def not_dominating(spark, d):
    rows, pool = _upper_pool(spark, d)
    return L.not_dominating(rows, pool, LHS, ["grp"]).drop("grp")


def dominates_subset(spark, d):
    rows, pool = _upper_pool(spark, d)
    part = rows.withColumn("month", F.when(F.col("month") <= 400, F.col("month")))
    return L.dominates_subset(part, pool, LHS, ["grp"]).drop("grp").distinct()


def dominates_subset_strict(spark, d):
    rows, pool = _upper_pool(spark, d)
    part = rows.withColumn("month", F.when(F.col("month") <= 400, F.col("month")))
    return L.dominates_subset(part, pool, LHS, ["grp"], strict=True).drop("grp").distinct()


# -- dependencies -----------------------------------------------------------------


def rules_of(rel: Relation, **options):
    return lambda spark, d: discover_rfds(rel.load(spark, d), columns=rel.names, **options)


def single(spark, d):
    rows, _ = _levels(spark, d)
    return to_attributes(single_rfds(rows, 3), [(RHS, LHS)], MONTHS.names)


def composite(spark, d):
    rows, front = _levels(spark, d)
    found = composite_rfds(rows, L.pool_intervals(front, 3), 3)
    return to_attributes(found, [(RHS, LHS)], MONTHS.names).distinct()


def every_combination(spark, d):
    return discover_all(MONTHS.load(spark, d), columns=MONTHS.names)


def given_medians(spark, d):
    """The same dependencies without materialised vectors: medians given, tile pairs pruned by their bounds."""
    known = St.median_values(_month_vectors(spark, d))
    return discover_rfds(MONTHS.load(spark, d), columns=MONTHS.names, medians=known)


def given_medians_customers(spark, d):
    rows = CUSTOMERS.load(spark, d)
    known = St.median_values(stage(distance_vectors(rows, CUSTOMERS.names), "customers"))
    return discover_rfds(rows, columns=CUSTOMERS.names, medians=known)


def integral_levels(spark, d):
    rows = MONTHS.load(spark, d).withColumn("half", F.col("orders") / 2)
    return discover_rfds(rows, rhs="half", lhs=["month", "buyers"], columns=["month", "half", "buyers"], integral_levels=True)


def from_vectors(spark, d):
    v, n = stage_counted(distance_vectors(SEGMENTS.load(spark, d), SEGMENTS.names), "segments")
    return discover_from_vectors(v, [("customers", ["c_nationkey", "c_mktsegment", "balance"])], size=n)


def minimal(spark, d):
    return minimal_rfds(discover_rfds(MONTHS.load(spark, d), columns=MONTHS.names))


def own_strategies(spark, d):
    """A front of joins alone, and only the rules that no other implies."""
    return discover_rfds(SEGMENTS.load(spark, d), columns=SEGMENTS.names, front=relational_front, rules=minimal_rfds)


def formatted(spark, d):
    return format_rfd(discover_rfds(MONTHS.load(spark, d), columns=MONTHS.names)).select("rule")


def wide_again(spark, d):
    return to_wide(to_long(discover_rfds(SEGMENTS.load(spark, d), columns=SEGMENTS.names)), SEGMENTS.names)


def counted(spark, d):
    return St.rfd_counts(discover_rfds(MONTHS.load(spark, d), columns=MONTHS.names))


def ordered_sides(spark, d):
    found = discover_rfds(SEGMENTS.load(spark, d), rhs="customers", columns=SEGMENTS.names)
    return order_sides(found, ["c_nationkey", "c_mktsegment", "balance"], "rhs_threshold")


def nation_taxonomy(spark, d, terms: DataFrame):
    """Senses of ``terms(term, nationkey)`` and the tree nation -> region -> world."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    senses = terms.join(nation, F.col("nationkey") == F.col("n_nationkey")).select("term", F.col("n_name").alias("node"))
    up = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("child"), F.col("r_name").alias("parent")
    )
    return senses, up.unionByName(region.select(F.col("r_name").alias("child"), F.lit("world").alias("parent")))


def taxonomy(spark, d):
    terms = table(spark, d, "supplier").select(F.col("s_name").alias("term"), F.col("s_nationkey").alias("nationkey"))
    return taxonomy_distance(terms, *nation_taxonomy(spark, d, terms))


def taxonomy_rules(spark, d):
    nation = table(spark, d, "nation")
    rows = (
        SEGMENTS.load(spark, d)
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("n_name", "c_mktsegment", "customers", "balance")
    )
    terms = nation.select(F.col("n_name").alias("term"), F.col("n_nationkey").alias("nationkey"))
    return discover_rfds(rows, taxonomies={"n_name": nation_taxonomy(spark, d, terms)})


def violations(spark, d):
    return rfd_violations(table(spark, d, "orders"), {"o_custkey": 0, "o_orderdate": 3}, "o_totalprice", 250000, "o_orderkey")


def check_lines(spark, d):
    return rfd_check(table(spark, d, "lineitem"), {"l_quantity": 0, "l_discount": 0}, "l_extendedprice", 80000)


def check_customers(spark, d):
    return rfd_check(CUSTOMERS.load(spark, d), {"orders": 1, "spend": 1}, "last_month", 900)


def check_holds(spark, d):
    return rfd_check(table(spark, d, "part"), {"p_retailprice": 0.01}, "p_size", 60)


def check_names(spark, d):
    """Texts within one edit, by the index of texts."""
    return rfd_check(table(spark, d, "customer"), {"c_name": 1}, "c_nationkey", 20)


def similar_names(spark, d):
    return edit_pairs(table(spark, d, "customer").select(F.col("c_name").alias("v")), 1)


def profile(spark, d):
    tables = {r.name: r.load(spark, d).select(*r.names) for r in (SEGMENTS, MONTHS)}
    return dependency_profile(tables).drop("ds_file_size_B")


def table_profile(spark, d):
    return append(
        St.table_profile(table(spark, d, "lineitem"), "lineitem"), St.table_profile(table(spark, d, "orders"), "orders")
    ).drop("ds_file_size_B")


def metrics(spark, d):
    lines = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("ds_name"), F.col("l_linenumber").alias("rfd_count"), F.col("l_quantity").alias("time_elapsed")
    )
    return St.metrics_summary(lines, ["time_elapsed"], ["ds_name", "rfd_count"], "time_elapsed")


# -- messages, windows, streams --------------------------------------------------------


def window_top(spark, d):
    rows = top_k_per_window(table(spark, d, "events"), "ts", "10 minutes", [F.desc("value"), F.asc("event_id")], 5)
    return rows.select("window_start", F.col("rank").cast("bigint").alias("rank"), "event_id", "value")


def best_events(spark, d):
    return top_k(table(spark, d, "events").select("event_id", "value"), [F.desc("value"), F.asc("event_id")], 5)


def english_documents(spark, d):
    return filter_records(table(spark, d, "documents")).select("doc_id", "n_chars")


def escaped(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(escape_newlines(F.col("text"))).alias("digest"))


def event_props(spark, d):
    events = table(spark, d, "events").select("event_id", "props")
    parsed = events.withColumn("p", F.from_json("props", "k bigint"))
    return parsed.select("event_id", F.col("p.k").alias("k"))


def _messages(spark, d):
    """Documents as nested JSON messages."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    words = F.split("text", r" ")
    tweet = F.struct(
        F.lit("2024-01-01").alias("created_at"), F.col("text"), F.col("n_chars").alias("retweet_count"), F.col("doc_id").alias("favourite_count")
    )
    sentiment = F.struct(
        F.col("quality").cast("double").alias("score"), (F.col("quality") / 4).alias("comparative"), words.alias("tokens"),
        F.filter(words, lambda w: F.length(w) > 6).alias("words"),
        F.filter(words, lambda w: F.length(w) > 9).alias("positive"),
        F.filter(words, lambda w: F.length(w) < 3).alias("negative"),
    )
    return docs.select(F.to_json(F.struct("lang", F.col("doc_id").cast("string").alias("_msgid"), tweet.alias("tweet"), sentiment.alias("sentiment"))).alias("value"))


def _records(spark, d):
    return flatten_message(parse_messages(_messages(spark, d), "value", MESSAGE_SCHEMA))


def flattened(spark, d):
    return _records(spark, d).withColumn("text", F.md5("text"))


def routed(spark, d):
    empty, full = route_by_word_count(_records(spark, d))
    side = lambda df, name: df.select("_msgid", F.lit(name).alias("route"), "sentiment_word_count")
    return append(side(empty, "none"), side(full, "some"))


def scored(spark, d):
    lexicon = spark.createDataFrame(list(LEXICON.items()), "word string, weight int")
    return score_lexicon(table(spark, d, "documents"), "doc_id", "text", lexicon)


def streamed(spark, d):
    """The stream form of ``top_k_per_window``: windows closed by the watermark."""
    schema = table(spark, d, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    events = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    best = stream_top_k(events, "ts", "10 minutes", ["value", "event_id"], 5, ascending=("event_id",))
    out = f"{scratch_dir(spark)}/stream-{spark.sparkContext.applicationId}-{id(best)}"
    query = start_sink(best, f"{out}/rows", f"{out}/checkpoint", every=None)
    run_until(query, 600)
    local = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("window_start", "ts")]
    return spark.read.parquet(f"{out}/rows").select(local[0], F.col("rank").cast("bigint").alias("rank"), local[1], "event_id", "value")


# -- files -------------------------------------------------------------------------------


def _csv(spark, df: DataFrame, name: str, decimal: str = ".") -> str:
    path = f"{scratch_dir(spark)}/{name}-{spark.sparkContext.applicationId}-{id(df)}"
    write_rfds(df, path, ";", decimal, "csv", "overwrite")
    return path


def csv_round_trip(spark, d):
    path = _csv(spark, table(spark, d, "supplier"), "supplier-csv")
    sep, header = infer_dialect(spark, path)
    return read_table(spark, path, sep, header)


def csv_orders(spark, d):
    """Dates, missing markers and types through a delimited file."""
    orders = table(spark, d, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy/MM/dd").alias("day"),
        F.when(F.col("o_orderstatus") == "P", F.lit("?")).otherwise(F.col("o_orderstatus")).alias("status"), "o_totalprice",
    )
    back = read_table(spark, _csv(spark, orders, "orders-csv"), datetime_cols=["day"])
    return back.withColumn("day", F.col("day").cast("timestamp_ntz"))


CORPUS = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus"],
    "part": ["p_partkey", "p_name", "p_size"],
}


def corpus(spark, d):
    """A folder of delimited tables without header lines, one separator each, beside a file that is no table."""
    folder = f"{scratch_dir(spark)}/corpus-{spark.sparkContext.applicationId}-{id(object())}"
    for (name, columns), sep in zip(CORPUS.items(), (";", ",", "|")):
        table(spark, d, name).select(*columns).write.csv(f"{folder}/{name}.csv", sep=sep, header=False)
    table(spark, d, "nation").select("n_nationkey").write.csv(f"{folder}/distance_nation.csv")
    return corpus_profile(spark, folder).drop("ds_files")


def comma_decimals(spark, d):
    return decimal_comma(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"))


QUERIES = {
    "distance_numeric": distance_numeric,
    "distance_edit": distance_edit,
    "distance_days": distance_days,
    "distance_null_rule": distance_null_rule,
    "distance_matrix_supplier": matrix_of(SUPPLIER),
    "distance_matrix_lines": matrix_of(LINES),
    "distance_matrix_parts": matrix_of(PARTS),
    "distance_matrix_grid": matrix_of(GRID),
    "tiled_pairs_count": tiled_pairs_count,
    "value_distances": part_names,
    "memo_lookup": memo_lookup,
    "medians": medians,
    "approximate_medians": sketched_medians,
    "narrowed_medians": narrowed_medians,
    "levels": levels,
    "above_median": above_median,
    "up_to_median": up_to_median,
    "split_sides": sides,
    "max_reduce": reduced,
    "skyline": month_skyline,
    "skyline_tiled": tiled_skyline,
    "pools": pools,
    "prior_min": prior_min,
    "range_min": range_min,
    "cap_at_median": cap_at_median,
    "min_hits": min_hits,
    "complement": complement,
    "singletons": singletons,
    "slices": slices,
    "not_dominating": not_dominating,
    "dominates_subset": dominates_subset,
    "dominates_subset_strict": dominates_subset_strict,
    "single_rfds": single,
    "composite_rfds": composite,
    "discover_supplier": rules_of(SUPPLIER),
    "discover_months": rules_of(MONTHS),
    "discover_segments": rules_of(SEGMENTS),
    "discover_customers": rules_of(CUSTOMERS),
    "discover_lines": rules_of(LINES),
    "discover_parts": rules_of(PARTS),
    "discover_grid": rules_of(GRID),
    "discover_users": rules_of(USERS),
    "discover_brands": rules_of(BRANDS),
    "discover_shipping": rules_of(SHIPPING),
    "discover_hours": rules_of(HOURS),
    "discover_gaps": rules_of(GAPS),
    "discover_nations": rules_of(NATIONS),
    "discover_given_sides": rules_of(MONTHS, rhs="buyers", lhs=["orders", "month"]),
    "discover_one_rhs": rules_of(MONTHS, rhs="top_price"),
    "discover_given_medians": given_medians,
    "discover_given_medians_customers": given_medians_customers,
    "discover_integral_levels": integral_levels,
    "discover_from_vectors": from_vectors,
    "discover_taxonomy": taxonomy_rules,
    "discover_all": every_combination,
    "minimal_rfds": minimal,
    "discover_strategies": own_strategies,
    "format_rfd": formatted,
    "to_wide": wide_again,
    "rfd_counts": counted,
    "order_sides": ordered_sides,
    "taxonomy_distance": taxonomy,
    "rfd_violations": violations,
    "rfd_check_lines": check_lines,
    "rfd_check_customers": check_customers,
    "rfd_check_names": check_names,
    "edit_pairs": similar_names,
    "rfd_holds": check_holds,
    "dependency_profile": profile,
    "table_profile": table_profile,
    "metrics_summary": metrics,
    "top_k_per_window": window_top,
    "top_k": best_events,
    "filter_records": english_documents,
    "escape_newlines": escaped,
    "event_props": event_props,
    "flatten_message": flattened,
    "route_by_word_count": routed,
    "score_lexicon": scored,
    "stream_top_k": streamed,
    "read_table": csv_round_trip,
    "read_table_dates": csv_orders,
    "corpus_profile": corpus,
    "decimal_comma": comma_decimals,
}
