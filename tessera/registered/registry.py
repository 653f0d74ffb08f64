"""Where queries and their SQL are registered, and what they share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from ..spec import FeatureSpec
from ..staging import scratch_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Sums of doubles differ in their last digits from engine to engine."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), n) for c, n in digits.items()})


def written(df: DataFrame, name: str) -> str:
    """Path of a Parquet copy in the shared folder."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return path


# Raw rows with defects, the same expressions in both engines.
RAW = {
    "id": "CASE WHEN event_id % 37 = 0 THEN '  ' ELSE concat('EV-', cast(event_id AS string)) END",
    "age": "CASE WHEN event_id % 13 = 0 THEN '121' WHEN event_id % 11 = 0 THEN '-1' WHEN event_id % 7 = 0 THEN '12.5' ELSE cast(event_id % 121 AS string) END",
    "race": "CASE event_id % 6 WHEN 0 THEN ' White ' WHEN 1 THEN 'BLACK' WHEN 2 THEN 'hispanic' WHEN 3 THEN 'martian' WHEN 4 THEN concat(chr(9), 'Asian', chr(9)) ELSE '' END",
    "ethnicity": "upper(event_type)",
    "marital": "CASE WHEN user_id % 2 = 0 THEN ' M' ELSE 's' END",
    "income": "CASE WHEN event_id % 23 = 0 THEN 'n/a' ELSE cast(event_id * 10 AS string) END",
    "coverage": "CASE WHEN event_id % 8 = 0 THEN '' ELSE cast((event_id % 100) / 100.0e0 AS string) END",
    "healthcare_cost": "cast(value AS string)",
    "psa": "CASE WHEN event_id % 17 = 0 THEN '' WHEN event_id % 19 = 0 THEN 'null' WHEN event_id % 23 = 0 THEN 'NULL' WHEN event_id % 29 = 0 THEN 'abc' WHEN event_id % 31 = 0 THEN '1.5d' ELSE cast(value AS string) END",
    "num_encounters": "cast(user_id % 31 AS string)",
    "num_diagnoses": "CASE WHEN event_id % 5 = 0 THEN '3.0' ELSE '2' END",
    "has_died": "CASE event_id % 6 WHEN 0 THEN 'true' WHEN 1 THEN 'TRUE' WHEN 2 THEN '1' WHEN 3 THEN '0' WHEN 4 THEN 'yes' ELSE '' END",
    "survival_days": "CASE WHEN event_id % 41 = 0 THEN '99999999999' ELSE cast(event_id % 4000 AS string) END",
}
RAW_SQL = "raw AS (SELECT event_id, " + ", ".join(f"{e} AS {c}" for c, e in RAW.items()) + " FROM events)"


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", *(F.expr(e).alias(c) for c, e in RAW.items()))


def sql_trim(x: str) -> str:
    return f"trim(coalesce({x}, ''), concat(' ', chr(9), chr(10), chr(13)))"


def sql_long(x: str) -> str:
    return f"CASE WHEN regexp_full_match({sql_trim(x)}, '[+-]?[0-9]+') THEN try_cast({sql_trim(x)} AS BIGINT) END"


def sql_double(x: str) -> str:
    return f"CASE WHEN regexp_full_match({sql_trim(x)}, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast({sql_trim(x)} AS DOUBLE) END"


def sql_uniform(seed: int | str, name: str, key: str) -> str:
    return f"(('0x' || substr(md5(concat('{seed}|{name}|', {key}::VARCHAR)), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def sql_normal(seed: int | str, name: str, key: str) -> str:
    return f"(sqrt(-2 * ln(1 - {sql_uniform(seed, name + '.r', key)})) * cos(2 * pi() * {sql_uniform(seed, name + '.a', key)}))"


def sql_bround(x: str, digits: int = 0) -> str:
    """Half to even."""
    return f"round_even({x}, {digits})"


# The model table: order lines with their order and part.
LINES = FeatureSpec(
    id="id",
    continuous=("l_quantity", "l_extendedprice", "l_discount", "l_tax", "p_size", "p_retailprice"),
    category="o_orderpriority",
    categories=("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"),
    fallback="5-LOW",
    binary_target="returned",
    continuous_targets=("ship_days", "o_totalprice"),
)
LINES_SQL = """lines AS (
  SELECT concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_quantity, l_extendedprice, l_discount, l_tax,
         p_size::DOUBLE AS p_size, p_retailprice, o_orderpriority, (l_returnflag = 'R')::INT::DOUBLE AS returned,
         date_diff('day', o_orderdate::DATE, l_shipdate::DATE)::DOUBLE AS ship_days, o_totalprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
HOT_SQL = ", ".join(
    f"(o_orderpriority {'= ' + repr(c) if c != LINES.fallback else 'NOT IN (' + ', '.join(repr(k) for k in LINES.categories if k != LINES.fallback) + ')'})::INT::DOUBLE AS o_orderpriority_{i}"
    for i, c in enumerate(LINES.categories)
)
DATA_SQL = f"{LINES_SQL},\ndata AS (SELECT id, {', '.join(LINES.continuous)}, {HOT_SQL}, returned, ship_days, o_totalprice FROM lines)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns are pruned before the joins; joins choose their strategy by size."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", F.col("p_size").cast("double").alias("p_size"), "p_retailprice", "o_orderpriority",
        (F.col("l_returnflag") == "R").cast("double").alias("returned"),
        F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")).cast("double").alias("ship_days"),
        "o_totalprice",
    )


def as_columns(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]
