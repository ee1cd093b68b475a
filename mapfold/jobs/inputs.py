"""Map data derived from the given tables, by the same expressions in Spark and in SQL.

Each view is a list of expressions over one table; `view(spark, sf_dir, name)`
reads it and `sql(name)` is the same view as a SQL subquery.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LON = "((event_id * 7919 + user_id * 104729) % 360000) / 1000e0 - 180"
_LAT = "((event_id * 6271 + user_id * 1299709) % 170000) / 1000e0 - 85"

#: name -> (table, columns); MS(x) is the epoch milliseconds of a timestamp.
VIEWS: dict[str, tuple[str, list[str]]] = {
    "pts_world": ("events", ["event_id", "user_id", "event_type", f"{_LON} AS lon", f"{_LAT} AS lat", "value AS weight", "MS(ts) AS time_ms"]),
    "pts_city": ("events", ["event_id", "user_id", "event_type", "11.4e0 + (user_id % 20) * 0.02e0 + ((event_id * 37) % 1000) / 100000e0 AS lon", "48e0 + (user_id % 13) * 0.02e0 + ((event_id * 53) % 1000) / 100000e0 AS lat", "value AS weight", "MS(ts) AS time_ms"]),
    "keyframes": ("events", ["user_id AS entity_id", "MS(ts) AS time_ms", f"{_LON} AS lon", f"{_LAT} AS lat", "event_type AS status", "event_id"]),
    "zones": (
        "nation",
        [
            "n_nationkey AS zone_id", "n_name AS name", "n_regionkey AS region",
            "-180e0 + (n_nationkey % 5) * 72 AS w", "-120e0 + (n_nationkey % 5) * 72 AS e",
            "-80e0 + floor(n_nationkey / 5e0) * 32 AS s", "-56e0 + floor(n_nationkey / 5e0) * 32 AS n",
        ],
    ),
    "gnodes": ("customer", ["c_custkey AS node_id", "10e0 + (c_custkey % 200) / 100e0 AS lon", "47e0 + floor(c_custkey / 200e0) / 100e0 AS lat"]),
    "views": ("events", ["event_id", f"{_LON} AS lon", f"{_LAT} AS lat", "CAST(event_id % 12 AS INT) AS zoom"]),
    "osm_nodes": ("part", ["p_partkey AS node_id", "11e0 + (p_partkey % 100) / 100e0 AS lon", "48e0 + floor(p_partkey / 100e0) / 100e0 AS lat", "CASE WHEN p_size % 7 = 0 THEN p_type END AS tag"]),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = VIEWS[name]
    return table(spark, sf_dir, source).selectExpr(*(c.replace("MS(ts)", "unix_millis(CAST(ts AS TIMESTAMP))") for c in columns))


def sql(name: str) -> str:
    source, columns = VIEWS[name]
    return f"(SELECT {', '.join(c.replace('MS(ts)', '(epoch_us(ts) // 1000)') for c in columns)} FROM {source})"


def scaled(col, factor: int = 1000) -> F.Column:
    """A number as an integer count of 1/factor, so that engines that differ in the last bit agree."""
    return F.floor(col * factor + 0.5).cast("long")


def scaled_sql(text: str, factor: int = 1000) -> str:
    return f"CAST(floor(({text}) * {factor} + 0.5) AS BIGINT)"


def gedges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed graph edges made of orders, between the nodes made of customers."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    n = customers.agg(F.count("*").alias("n_nodes"))
    edges = orders.crossJoin(F.broadcast(n)).selectExpr(  # one row
        "o_orderkey AS edge_id", "o_custkey AS from_id", "(o_orderkey * 31 + 7) % n_nodes AS to_id", "CAST(round(o_totalprice * 100) AS BIGINT) AS cost",
        "o_orderkey % 5 = 0 AS one_way", "o_orderkey % 97 = 0 AS closed", "CASE WHEN o_orderpriority LIKE '1%' THEN 'foot' WHEN o_orderpriority LIKE '2%' THEN 'bike' ELSE 'car' END AS mode",
    )
    return edges.filter("from_id <> to_id")


GEDGES_SQL = """(SELECT * FROM (SELECT o_orderkey AS edge_id, o_custkey AS from_id, (o_orderkey * 31 + 7) % (SELECT count(*) FROM customer) AS to_id,
 CAST(round(o_totalprice * 100) AS BIGINT) AS cost, o_orderkey % 5 = 0 AS one_way, o_orderkey % 97 = 0 AS closed,
 CASE WHEN o_orderpriority LIKE '1%' THEN 'foot' WHEN o_orderpriority LIKE '2%' THEN 'bike' ELSE 'car' END AS mode FROM orders) WHERE from_id <> to_id)"""


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way_id, pos, node_id: orders as ways over the nodes made of parts."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("way_id"), (F.row_number().over(order) - 1).alias("pos"), F.col("l_partkey").alias("node_id"))


WAYS_SQL = "(SELECT l_orderkey AS way_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INTEGER) AS pos, l_partkey AS node_id FROM lineitem)"
