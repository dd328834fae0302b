"""Registration of queries and their SQL, and the analogue views they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            if f.__name__ in self.queries:
                raise ValueError(f.__name__)
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Rounded to 6 places, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + 0.0


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the number k of their properties and an action text; a trajectory is a user's rows by (ts, event_id)."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    part = lambda m: F.concat(F.lit("k"), F.pmod(F.col("k"), F.lit(m)).cast("string"))
    rows = table(spark, sf_dir, "events").withColumn("k", k)
    return rows.withColumn("action", F.when(F.pmod(F.col("k"), F.lit(3)) == 0, F.concat(part(4), F.lit(" | "), part(5))).otherwise(part(4)))


EVENTS = """ev AS (SELECT *, 'k' || (k % 4) || CASE WHEN k % 3 = 0 THEN ' | k' || (k % 5) ELSE '' END AS action
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events) e0)"""


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as metric rows: position and angle errors, length and a flag that can be missing."""
    li = table(spark, sf_dir, "lineitem")
    flag = F.when(F.col("l_returnflag") == "A", F.lit(True)).when(F.col("l_returnflag") == "R", F.lit(False))
    return li.select("l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag", (F.col("l_discount") * 10).alias("pos"), F.col("l_quantity").alias("ang"), F.col("l_linenumber").alias("length"), flag.alias("flag"), "l_extendedprice", "l_tax", "l_discount", "l_quantity")


METRICS = """m AS (SELECT l_orderkey, l_linenumber, l_linestatus, l_returnflag, l_discount * 10 AS pos, l_quantity AS ang, l_linenumber AS length,
  CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END AS flag, l_extendedprice, l_tax, l_discount, l_quantity FROM lineitem)"""
