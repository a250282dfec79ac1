"""Relations the queries measure, each with its Spark form and its SQL form over whole tables."""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Relation:
    """``columns`` pairs each measured column with its kind: num, text or days."""

    name: str
    columns: tuple[tuple[str, str], ...]
    load: Callable[[SparkSession, str], DataFrame]
    sql: str

    @property
    def names(self) -> list[str]:
        return [c for c, _ in self.columns]


def _supplier(spark, d):
    return table(spark, d, "supplier").select("s_name", "s_nationkey", "s_acctbal")


def _segments(spark, d):
    c = table(spark, d, "customer")
    return c.groupBy("c_nationkey", "c_mktsegment").agg(
        F.count(F.lit(1)).alias("customers"),
        F.floor(F.sum(F.col("c_acctbal").cast("decimal(18,2)")) / 1000).cast("bigint").alias("balance"),
    )


def _months(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")).agg(
        F.count(F.lit(1)).alias("orders"),
        F.countDistinct("o_custkey").alias("buyers"),
        F.floor(F.max("o_totalprice") / 1000).cast("bigint").alias("top_price"),
    )


def _customers(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("orders"),
        F.floor(F.sum(F.col("o_totalprice").cast("decimal(18,2)")) / 200000).cast("bigint").alias("spend"),
        F.date_trunc("month", F.max("o_orderdate")).cast("timestamp_ntz").alias("last_month"),
    )


def _lines(spark, d):
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint")
    return table(spark, d, "lineitem").select(
        cents("l_discount").alias("discount"), cents("l_tax").alias("tax"), "l_returnflag", "l_linestatus"
    )


def _parts(spark, d):
    return table(spark, d, "part").select(
        "p_brand", "p_type", "p_size", F.floor(F.col("p_retailprice") / 50).cast("bigint").alias("price_band")
    )


def _grid(spark, d):
    return table(spark, d, "customer").select(
        "c_nationkey", F.floor(F.col("c_acctbal") / 500).cast("bigint").alias("balance_band"), "c_mktsegment"
    )


def _users(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("event_type") == "purchase").alias("purchases"),
        F.floor(F.max("value") / 20).cast("bigint").alias("top_value"),
    )


def _brands(spark, d):
    return table(spark, d, "part").groupBy("p_brand", "p_type").agg(
        F.count(F.lit(1)).alias("parts"),
        F.floor(F.sum(F.col("p_retailprice").cast("decimal(18,2)")) / 1000).cast("bigint").alias("worth"),
        F.max("p_size").alias("largest"),
    )


def _shipping(spark, d):
    cents = lambda c: F.sum(F.col(c).cast("decimal(18,2)"))
    return table(spark, d, "lineitem").groupBy(F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("month")).agg(
        F.count(F.lit(1)).alias("lines"),
        F.floor(cents("l_quantity") / 100).cast("bigint").alias("quantity"),
        F.floor(cents("l_extendedprice") / 100000).cast("bigint").alias("revenue"),
    )


def _hours(spark, d):
    return table(spark, d, "events").groupBy(F.hour("ts").cast("bigint").alias("hour"), "event_type").agg(
        F.count(F.lit(1)).alias("events"),
        F.countDistinct("user_id").alias("users"),
        F.floor(F.sum(F.col("value").cast("decimal(18,2)")) / 100).cast("bigint").alias("worth"),
    )


def _gaps(spark, d):
    """Segments of nations whose balance, or whose number of customers, is only told within limits."""
    balance, customers = F.sum(F.col("c_acctbal").cast("decimal(18,2)")), F.count(F.lit(1))
    return table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(
        F.when(customers % 4 != 0, customers).alias("customers"),
        F.when(balance > 20000, F.floor(balance / 1000)).cast("bigint").alias("balance"),
        F.when(customers % 3 != 0, F.max("c_mktsegment")).alias("segment"),
    )


def _nations(spark, d):
    """Eight figures of each nation: wide, few rows."""
    worth = lambda c, unit: F.floor(F.sum(F.col(c).cast("decimal(18,2)")) / unit).cast("bigint")
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    own = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"), worth("c_acctbal", 1000).alias("balance"))
    bought = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("n")).agg(
        F.count(F.lit(1)).alias("orders"), worth("o_totalprice", 1000000).alias("spend"), F.countDistinct("o_custkey").alias("buyers")
    )
    sold = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"), worth("s_acctbal", 1000).alias("credit"))
    named = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    met = own.join(bought, F.col("c_nationkey") == F.col("n")).join(sold, F.col("c_nationkey") == F.col("s_nationkey"))
    return met.join(named, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "customers", "balance", "orders", "spend", "buyers", "suppliers", "credit", "n_regionkey"
    )


SUPPLIER = Relation(
    "supplier", (("s_name", "text"), ("s_nationkey", "num"), ("s_acctbal", "num")), _supplier,
    "SELECT s_name, s_nationkey, s_acctbal FROM supplier",
)
SEGMENTS = Relation(
    "segments", (("c_nationkey", "num"), ("c_mktsegment", "text"), ("customers", "num"), ("balance", "num")), _segments,
    """SELECT c_nationkey, c_mktsegment, count(*) AS customers,
              CAST(floor(sum(CAST(c_acctbal AS DECIMAL(18,2))) / 1000) AS BIGINT) AS balance
       FROM customer GROUP BY c_nationkey, c_mktsegment""",
)
MONTHS = Relation(
    "months", (("month", "days"), ("orders", "num"), ("buyers", "num"), ("top_price", "num")), _months,
    """SELECT date_trunc('month', o_orderdate) AS month, count(*) AS orders, count(DISTINCT o_custkey) AS buyers,
              CAST(floor(max(o_totalprice) / 1000) AS BIGINT) AS top_price
       FROM orders GROUP BY 1""",
)
CUSTOMERS = Relation(
    "customers", (("orders", "num"), ("spend", "num"), ("last_month", "days")), _customers,
    """SELECT o_custkey, count(*) AS orders,
              CAST(floor(sum(CAST(o_totalprice AS DECIMAL(18,2))) / 200000) AS BIGINT) AS spend,
              date_trunc('month', max(o_orderdate)) AS last_month
       FROM orders GROUP BY o_custkey""",
)
LINES = Relation(
    "lines", (("discount", "num"), ("tax", "num"), ("l_returnflag", "text"), ("l_linestatus", "text")), _lines,
    """SELECT CAST(round(l_discount * 100) AS BIGINT) AS discount, CAST(round(l_tax * 100) AS BIGINT) AS tax,
              l_returnflag, l_linestatus FROM lineitem""",
)
PARTS = Relation(
    "parts", (("p_brand", "text"), ("p_type", "text"), ("p_size", "num"), ("price_band", "num")), _parts,
    "SELECT p_brand, p_type, p_size, CAST(floor(p_retailprice / 50) AS BIGINT) AS price_band FROM part",
)
GRID = Relation(
    "grid", (("c_nationkey", "num"), ("balance_band", "num"), ("c_mktsegment", "text")), _grid,
    "SELECT c_nationkey, CAST(floor(c_acctbal / 500) AS BIGINT) AS balance_band, c_mktsegment FROM customer",
)
USERS = Relation(
    "users", (("events", "num"), ("purchases", "num"), ("top_value", "num")), _users,
    """SELECT user_id, count(*) AS events, count(*) FILTER (WHERE event_type = 'purchase') AS purchases,
              CAST(floor(max(value) / 20) AS BIGINT) AS top_value
       FROM events GROUP BY user_id""",
)
BRANDS = Relation(
    "brands", (("p_type", "text"), ("parts", "num"), ("worth", "num"), ("largest", "num")), _brands,
    """SELECT p_brand, p_type, count(*) AS parts, CAST(floor(sum(CAST(p_retailprice AS DECIMAL(18,2))) / 1000) AS BIGINT) AS worth,
              max(p_size) AS largest
       FROM part GROUP BY p_brand, p_type""",
)
SHIPPING = Relation(
    "shipping", (("month", "days"), ("lines", "num"), ("quantity", "num"), ("revenue", "num")), _shipping,
    """SELECT date_trunc('month', l_shipdate) AS month, count(*) AS lines,
              CAST(floor(sum(CAST(l_quantity AS DECIMAL(18,2))) / 100) AS BIGINT) AS quantity,
              CAST(floor(sum(CAST(l_extendedprice AS DECIMAL(18,2))) / 100000) AS BIGINT) AS revenue
       FROM lineitem GROUP BY 1""",
)
HOURS = Relation(
    "hours", (("hour", "num"), ("events", "num"), ("users", "num"), ("worth", "num")), _hours,
    """SELECT hour(ts) AS hour, event_type, count(*) AS events, count(DISTINCT user_id) AS users,
              CAST(floor(sum(CAST(value AS DECIMAL(18,2))) / 100) AS BIGINT) AS worth
       FROM events GROUP BY hour(ts), event_type""",
)
GAPS = Relation(
    "gaps", (("c_nationkey", "num"), ("customers", "num"), ("balance", "num"), ("segment", "text")), _gaps,
    """SELECT c_nationkey, c_mktsegment, CASE WHEN count(*) % 4 <> 0 THEN count(*) END AS customers,
              CASE WHEN sum(CAST(c_acctbal AS DECIMAL(18,2))) > 20000 THEN CAST(floor(sum(CAST(c_acctbal AS DECIMAL(18,2))) / 1000) AS BIGINT) END AS balance,
              CASE WHEN count(*) % 3 <> 0 THEN max(c_mktsegment) END AS segment
       FROM customer GROUP BY c_nationkey, c_mktsegment""",
)
NATIONS = Relation(
    "nations", tuple((c, "num") for c in ("customers", "balance", "orders", "spend", "buyers", "suppliers", "credit", "n_regionkey")), _nations,
    """SELECT customers, balance, orders, spend, buyers, suppliers, credit, n_regionkey
       FROM (SELECT c_nationkey AS k, count(*) AS customers, CAST(floor(sum(CAST(c_acctbal AS DECIMAL(18,2))) / 1000) AS BIGINT) AS balance
             FROM customer GROUP BY 1)
       JOIN (SELECT c_nationkey AS k, count(*) AS orders, CAST(floor(sum(CAST(o_totalprice AS DECIMAL(18,2))) / 1000000) AS BIGINT) AS spend,
             count(DISTINCT o_custkey) AS buyers FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) USING (k)
       JOIN (SELECT s_nationkey AS k, count(*) AS suppliers, CAST(floor(sum(CAST(s_acctbal AS DECIMAL(18,2))) / 1000) AS BIGINT) AS credit
             FROM supplier GROUP BY 1) USING (k)
       JOIN nation ON n_nationkey = k""",
)
