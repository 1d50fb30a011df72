"""Queries of the record-pipeline operators and the DuckDB SQL that checks each one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import scalars
from sluice.operators import joins, order, quantiles, reduce, rows, setops
from sluice.operators.joins import JoinMode
from sluice.streaming import windows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend and first/last order date of every customer who bought a part of one brand."""
    part = table(spark, sf_dir, "part").where(F.col("p_brand") == "Brand#1").select("p_partkey")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return (
        line.join(part, line.l_partkey == part.p_partkey)
        .join(orders, line.l_orderkey == orders.o_orderkey)
        .groupBy("o_custkey")
        .agg(
            F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("total_spent"),
            F.min("o_orderdate").alias("first_purchase"),
            F.max("o_orderdate").alias("last_purchase"),
        )
    )




# Inputs that tell the join modes apart: some keys in one table only, some in two, few in all.
def _left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k"), "c_name")


def _rights(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    orders = table(spark, sf_dir, "orders").where("o_orderpriority like '1%' and o_orderstatus = 'F'")
    events = table(spark, sf_dir, "events").where("event_type = 'error'")
    return [orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id")), events.select(F.col("user_id").alias("k"), F.col("event_id").alias("id"))]


_INPUTS = """
    l AS (SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING'),
    r0 AS (SELECT o_custkey AS k, o_orderkey AS id FROM orders WHERE o_orderpriority LIKE '1%' AND o_orderstatus = 'F'),
    r1 AS (SELECT user_id AS k, event_id AS id FROM events WHERE event_type = 'error'),
    a AS (SELECT k, count(*) AS n FROM l GROUP BY k), b AS (SELECT k, count(*) AS n, sum(id) AS s FROM r0 GROUP BY k),
    c AS (SELECT k, count(*) AS n, sum(id) AS s FROM r1 GROUP BY k)"""
_KEEPS = {
    JoinMode.LEFT: "n_left > 0",
    JoinMode.INNER: "n_left > 0 AND n_right0 + n_right1 > 0",
    JoinMode.FULL_INNER: "n_left > 0 AND n_right0 > 0 AND n_right1 > 0",
    JoinMode.OUTER: "true",
}


def _counted(records: DataFrame) -> DataFrame:
    """Scalar columns of nested records."""
    size = lambda i: F.coalesce(F.size(F.try_element_at("right", F.lit(i))), F.lit(0)).cast("long")
    ids = F.flatten(F.map_values("right"))
    total = F.aggregate(F.transform(ids, lambda r: r["id"].cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
    return records.select(F.col("key").cast("long").alias("k"), F.size("left").cast("long").alias("n_left"), size(0).alias("n_right0"), size(1).alias("n_right1"), total.alias("id_sum"))


def _record_join(mode: JoinMode, ordered: bool) -> Callable:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _counted(joins.join_records(_left(spark, sf_dir), _rights(spark, sf_dir), "k", "k", mode, ordered))

    return query


def _lookup_join(mode: JoinMode) -> Callable:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _counted(joins.lookup_join(_left(spark, sf_dir), _rights(spark, sf_dir), "k", "k", mode))

    return query


def _record_sql(mode: JoinMode) -> str:
    return f"""
        WITH {_INPUTS}, j AS (
            SELECT k, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right0, coalesce(c.n, 0) AS n_right1,
                   CAST(coalesce(b.s, 0) + coalesce(c.s, 0) AS BIGINT) AS id_sum
            FROM a FULL JOIN b USING (k) FULL JOIN c USING (k))
        SELECT CAST(k AS BIGINT) AS k, n_left, n_right0, n_right1, id_sum FROM j WHERE {_KEEPS[mode]}"""


def _lookup_sql(mode: JoinMode) -> str:
    alone = """
        UNION ALL SELECT CAST(k AS BIGINT), 0, coalesce(b.n, 0), coalesce(c.n, 0), CAST(coalesce(b.s, 0) + coalesce(c.s, 0) AS BIGINT)
        FROM b FULL JOIN c USING (k) WHERE k NOT IN (SELECT k FROM l)"""
    return f"""
        WITH {_INPUTS}, j AS (
            SELECT l.k, 1 AS n_left, coalesce(b.n, 0) AS n_right0, coalesce(c.n, 0) AS n_right1,
                   CAST(coalesce(b.s, 0) + coalesce(c.s, 0) AS BIGINT) AS id_sum
            FROM l LEFT JOIN b USING (k) LEFT JOIN c USING (k))
        SELECT CAST(k AS BIGINT) AS k, CAST(n_left AS BIGINT) AS n_left, n_right0, n_right1, id_sum FROM j WHERE {_KEEPS[mode]} {alone * (mode is JoinMode.OUTER)}"""


def right_only_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without a left input."""
    return _counted(joins.join_records(None, _rights(spark, sf_dir), None, "k"))


def flat_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _left(spark, sf_dir), _rights(spark, sf_dir)[0].withColumnRenamed("k", "rk")
    return joins.flat_join(left, right, "k", "rk", "left").select("k", "c_name", "id")


def flat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records taken apart again."""
    records = joins.join_records(_left(spark, sf_dir), _rights(spark, sf_dir), "k", "k", JoinMode.INNER)
    return joins.flat_records(records.where(F.map_contains_key("right", F.lit(0)))).select(F.col("key").alias("k"), "left.c_name", "right.id")


def filter_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = rows.filter_rows(table(spark, sf_dir, "lineitem"), "l_quantity >= 45 and l_returnflag = 'R'")
    return rows.map_rows(line, "l_orderkey", "l_linenumber", F.upper("l_linestatus").alias("status"), (F.col("l_quantity") * 2).alias("twice"))


def flat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("words"))
    return rows.flat_map(part, F.col("words"), "word", "place").select("p_partkey", F.col("place").cast("long").alias("place"), "word")


def parse_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines to typed, trimmed columns in a flow."""
    lines = table(spark, sf_dir, "supplier").select(F.concat_ws(" , ", "s_suppkey", F.lit("  x y"), "s_nationkey").alias("line"))
    return rows.parse_csv(lines, "line", "s_suppkey long, tag string, nation int")


def validated_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return rows.validate_order(orders, ["o_orderkey"], "o_orderkey", ["o_custkey"])


def observed_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, _ = rows.observed(table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey"), n=F.count(F.lit(1)))
    return df


def reduce_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    money = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double")
    return reduce.reduce_by(line, ["l_returnflag", "l_linestatus"], n=F.count(F.lit(1)), price=money, first=F.min("l_shipdate"))


def fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold in order: the highest rise from one order of a customer to the next, in whole units."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").alias("price"))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).cast("long").alias("best"))
    step = lambda acc, v: F.struct(v.alias("last"), F.greatest(acc["best"], F.coalesce(v - acc["last"], F.lit(0))).alias("best"))
    return reduce.fold(orders, ["o_custkey"], "price", ["o_orderkey"], start, step, lambda acc: acc["best"], "rise")


def distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.distinct(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber"))


def count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.count(table(spark, sf_dir, "lineitem"))


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.event_counts(table(spark, sf_dir, "events"), "event_type").select("event_type", "events")


def reduce_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal event types of each user."""
    events = table(spark, sf_dir, "events")
    out = reduce.reduce_runs(events, "event_type", ["ts", "event_id"], ["user_id"], n=F.count(F.lit(1)), first=F.min("event_id"))
    return out.select("user_id", "run", "event_type", "n", "first")


def collect_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two events of each run."""
    out = reduce.collect_runs(table(spark, sf_dir, "events"), "event_type", "event_id", ["ts", "event_id"], 2, partition_by=["user_id"])
    return out.select("user_id", "run", F.size("items").cast("long").alias("n"), F.get("items", 0).alias("head"), F.get("items", 1).alias("second"))


def group_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.group_contiguous(table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey"), ["o_orderstatus"], ["o_orderkey"])


def percentile_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.percentile(table(spark, sf_dir, "lineitem"), "l_quantity", 0.3)


def percentile_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.percentile(table(spark, sf_dir, "lineitem"), "l_extendedprice", 0.95, ["l_returnflag"])


def sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.sort(table(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey"), F.desc("o_totalprice"), "o_orderkey")


def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.top_k(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 20, F.desc("o_totalprice"), F.asc("o_orderkey"))


def head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.head(table(spark, sf_dir, "orders").select("o_orderkey"), 50, "o_orderkey")


def skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.skip(table(spark, sf_dir, "orders").select("o_orderkey"), 50, "o_orderkey")


def sorted_distinct_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.sorted_distinct_lines(table(spark, sf_dir, "part").select(F.col("p_type").alias("value")))


def _keys(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    left, (r0, r1) = _left(spark, sf_dir), _rights(spark, sf_dir)
    return [df.select(F.col("k").cast("long").alias("k")) for df in (left, r0, r1)]


def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setops.union(_keys(spark, sf_dir), ordered=True)


def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setops.intersect(_keys(spark, sf_dir), ordered=True)


def set_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right, _ = _keys(spark, sf_dir)
    return setops.subtract(right, left, ordered=True)


def set_by_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of exactly two of three inputs."""
    return setops.by_membership(_keys(spark, sf_dir), lambda tags: F.size(tags) == 2)


def merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setops.merge(_keys(spark, sf_dir), "k")


def concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setops.concat(_keys(spark, sf_dir), "k")


def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setops.union_all(_keys(spark, sf_dir))


def item_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("shard")).agg(F.count(F.lit(1)).alias("rows"))


def shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows dealt out by key, each key whole in one partition."""
    dealt = table(spark, sf_dir, "orders").select("o_custkey").repartition(8, "o_custkey")
    spread = dealt.select("o_custkey", F.spark_partition_id().alias("p")).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p").alias("partitions"))
    return spread


def union_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    chances = F.array(F.col("l_discount"), F.col("l_tax"), F.lit(0.5))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(scalars.union_probability(chances), 9).alias("p"))


def uuid_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 8), F.lit("-0000-4000-8000-000000000000"))
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.uuid_range_shard(made, 10).alias("shard"))


def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = scalars.bucket_path("gs", F.lit("bucket"), F.concat(F.lit("/a/"), "n_name"))
    return table(spark, sf_dir, "nation").select("n_nationkey", made.alias("path"), scalars.path_parts(made)["key"].alias("key"))


def sliding_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sliding_average(table(spark, sf_dir, "events"), "ts", "value", "1 hour", "10 minutes")


def sliding_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sliding_rate(table(spark, sf_dir, "events"), "ts", "1 hour", "10 minutes", 60, ["event_type"])


def last_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return windows.last_values(events, "ts", 3, ["user_id"], ["event_id"])


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.sources import readers

    return readers.generated(spark, 1000, lambda i: i * i, "square")


_PLAIN = [
    customer_summary, right_only_records, flat_join, flat_records, filter_map, flat_map, parse_csv, validated_order, observed_count, reduce_by, fold, distinct, count,
    event_counts, reduce_runs, collect_runs, group_contiguous, percentile_nearest, percentile_by, sort, top_k, head, skip,
    sorted_distinct_lines, set_union, set_intersect, set_subtract, set_by_membership, merge, concat, union_all, item_shards, shuffle,
    union_probability, uuid_shards, path_parts, sliding_average, sliding_rate, last_values, generated,
]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _PLAIN}
for _mode in JoinMode:
    QUERIES[f"record_join_{_mode.value}"] = _record_join(_mode, False)
    QUERIES[f"sorted_join_{_mode.value}"] = _record_join(_mode, True)
    QUERIES[f"lookup_join_{_mode.value}"] = _lookup_join(_mode)

_SLIDES = "time_bucket(INTERVAL '10 minutes', ts) - CAST(i AS INTEGER) * INTERVAL '10 minutes'"
_THREE = f"WITH {_INPUTS}, u AS (SELECT DISTINCT 0 AS t, k FROM l UNION ALL SELECT DISTINCT 1, k FROM r0 UNION ALL SELECT DISTINCT 2, k FROM r1)"
_ALL = f"WITH {_INPUTS}, u AS (SELECT 0 AS t, k FROM l UNION ALL SELECT 1, k FROM r0 UNION ALL SELECT 2, k FROM r1)"
_RUNS = """
    WITH e AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS new FROM events
               WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS run FROM e),
    p AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS place FROM r)"""

ORACLES = {
    "customer_summary": """
        SELECT o_custkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_spent,
               min(o_orderdate) AS first_purchase, max(o_orderdate) AS last_purchase
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
        WHERE p_brand = 'Brand#1' GROUP BY o_custkey""",
    "right_only_records": f"""
        WITH {_INPUTS} SELECT CAST(k AS BIGINT) AS k, CAST(0 AS BIGINT) AS n_left, coalesce(b.n, 0) AS n_right0, coalesce(c.n, 0) AS n_right1,
               CAST(coalesce(b.s, 0) + coalesce(c.s, 0) AS BIGINT) AS id_sum FROM b FULL JOIN c USING (k)""",
    "flat_join": """
        SELECT c_custkey AS k, c_name, o_orderkey AS id FROM customer
        LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority LIKE '1%' AND o_orderstatus = 'F') ON o_custkey = c_custkey
        WHERE c_mktsegment = 'BUILDING'""",
    "flat_records": """
        SELECT c_custkey AS k, c_name, o_orderkey AS id FROM customer JOIN orders ON o_custkey = c_custkey
        WHERE c_mktsegment = 'BUILDING' AND o_orderpriority LIKE '1%' AND o_orderstatus = 'F'""",
    "filter_map": """
        SELECT l_orderkey, l_linenumber, upper(l_linestatus) AS status, l_quantity * 2 AS twice
        FROM lineitem WHERE l_quantity >= 45 AND l_returnflag = 'R'""",
    "flat_map": """
        SELECT p_partkey, CAST(i - 1 AS BIGINT) AS place, w[i] AS word
        FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), range(1, 100) t(i) WHERE i <= len(w)""",
    "parse_csv": "SELECT s_suppkey, 'x y' AS tag, s_nationkey AS nation FROM supplier",
    "validated_order": "SELECT o_orderkey, o_custkey FROM orders",
    "observed_count": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'",
    "reduce_by": """
        SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price,
               min(l_shipdate) AS first FROM lineitem GROUP BY 1, 2""",
    "fold": """
        SELECT o_custkey, CAST(greatest(max(coalesce(rise, 0)), 0) AS BIGINT) AS rise FROM (
            SELECT o_custkey, floor(o_totalprice) - lag(floor(o_totalprice)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rise FROM orders)
        GROUP BY o_custkey""",
    "distinct": "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem",
    "count": "SELECT count(*) AS count FROM lineitem",
    "event_counts": "SELECT event_type, count(*) AS events FROM events GROUP BY 1",
    "reduce_runs": f"{_RUNS} SELECT user_id, run, event_type, count(*) AS n, min(event_id) AS first FROM r GROUP BY user_id, run, event_type",
    "collect_runs": f"""{_RUNS}
        SELECT user_id, run, least(count(*), 2) AS n, max(CASE WHEN place = 1 THEN event_id END) AS head,
               max(CASE WHEN place = 2 THEN event_id END) AS second FROM p GROUP BY user_id, run""",
    "group_contiguous": "SELECT o_orderstatus, o_orderkey FROM orders",
    "percentile_nearest": """
        SELECT min(v) AS percentile FROM (SELECT l_quantity AS v, sum(count(*)) OVER (ORDER BY l_quantity) AS c FROM lineitem GROUP BY 1)
        WHERE c >= (SELECT greatest(1, floor(0.3 * count(*) + 0.5)) FROM lineitem)""",
    "percentile_by": """
        SELECT l_returnflag, min(v) AS percentile FROM (
            SELECT l_returnflag, l_extendedprice AS v, sum(count(*)) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS c,
                   sum(count(*)) OVER (PARTITION BY l_returnflag) AS n FROM lineitem GROUP BY 1, 2)
        WHERE c >= greatest(1, floor(CAST(0.95 AS DOUBLE) * n + 0.5)) GROUP BY 1""",
    "sort": "SELECT o_totalprice, o_orderkey FROM orders ORDER BY 1 DESC, 2",
    "top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "head": "SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 50",
    "skip": "SELECT o_orderkey FROM orders ORDER BY 1 OFFSET 50",
    "sorted_distinct_lines": "SELECT DISTINCT p_type AS value FROM part ORDER BY 1",
    "set_union": f"{_THREE} SELECT DISTINCT CAST(k AS BIGINT) AS k FROM u",
    "set_intersect": f"{_THREE} SELECT CAST(k AS BIGINT) AS k FROM u GROUP BY k HAVING count(*) = 3",
    "set_subtract": f"WITH {_INPUTS} SELECT CAST(k AS BIGINT) AS k FROM r0 EXCEPT SELECT k FROM l",
    "set_by_membership": f"{_THREE} SELECT CAST(k AS BIGINT) AS k FROM u GROUP BY k HAVING count(*) = 2",
    "merge": f"{_ALL} SELECT CAST(k AS BIGINT) AS k FROM u ORDER BY 1",
    "concat": f"{_ALL} SELECT CAST(k AS BIGINT) AS k, t AS input FROM u ORDER BY 2, 1",
    "union_all": f"{_ALL} SELECT CAST(k AS BIGINT) AS k FROM u",
    "item_shards": 'SELECT o_orderpriority AS shard, count(*) AS "rows" FROM orders GROUP BY 1',
    "shuffle": "SELECT o_custkey, count(*) AS n, CAST(1 AS BIGINT) AS partitions FROM orders GROUP BY 1",
    "union_probability": "SELECT l_orderkey, l_linenumber, round(1 - (1 - l_discount) * (1 - l_tax) * 0.5::DOUBLE, 9) AS p FROM lineitem",
    "uuid_shards": "SELECT o_orderkey, CAST(floor(CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8)) AS BIGINT) * 10 / 4294967296) AS INTEGER) AS shard FROM orders",
    "path_parts": "SELECT n_nationkey, 'gs://bucket/a/' || n_name AS path, 'a/' || n_name AS key FROM nation",
    "sliding_average": f"""
        SELECT w AS window_start, w + INTERVAL '1 hour' AS window_end, count(value) AS events,
               round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value), 6) AS average
        FROM (SELECT value, {_SLIDES} AS w FROM events, range(6) r(i)) GROUP BY w""",
    "sliding_rate": f"""
        SELECT w AS window_start, w + INTERVAL '1 hour' AS window_end, event_type, count(*) AS events, round(count(*) / CAST(60 AS DOUBLE), 6) AS rate
        FROM (SELECT event_type, {_SLIDES} AS w FROM events, range(6) r(i)) GROUP BY w, event_type""",
    "last_values": """
        SELECT user_id, ts, event_id, value FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3""",
    "generated": "SELECT i * i AS square FROM range(1000) t(i)",
} | {f"{kind}_join_{m.value}": (_lookup_sql if kind == "lookup" else _record_sql)(m) for m in JoinMode for kind in ("record", "sorted", "lookup")}
