"""Profiles, histograms, metrics, ranks, splits and resizing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import aggregates as ag
from ..operators import metrics, sampling
from ..operators.ranks import PART_ROWS, placed
from .registry import query, rounded, table

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _profile_sql(rel: str = "lineitem") -> str:
    parts = []
    for c in [*MEASURES, "l_gap"]:
        parts.append(
            f"SELECT '{c}' AS col, count({c}) AS n, count(*) - count({c}) AS nulls, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 6) AS null_pct, round(avg({c}), 7) AS mean, round(var_samp({c}), 4) AS variance, "
            f"round(stddev_samp({c}), 6) AS std, min({c}) AS min, max({c}) AS max FROM x"
        )
    return f"WITH x AS (SELECT *, nullif(l_tax, 0) AS l_gap FROM {rel}) " + " UNION ALL ".join(parts)


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(*MEASURES, "l_linenumber")
    return items.withColumn("l_gap", F.nullif(F.col("l_tax"), F.lit(0.0)))


@query(_profile_sql())
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ag.column_profile(_measured(spark, sf_dir), [*MEASURES, "l_gap"]), null_pct=6, mean=7, variance=4, std=6)


@query(_profile_sql())
def profile_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of three batches, merged and finished."""
    items = _measured(spark, sf_dir)
    states = [ag.profile_state(items.filter(F.col("l_linenumber") % 3 == b), [*MEASURES, "l_gap"]) for b in range(3)]
    merged = ag.merge_states(states[0].unionByName(states[1]).unionByName(states[2]))
    return rounded(ag.finish_profile(merged), null_pct=6, mean=7, variance=4, std=6)


OFFSET = 1e9


@query("SELECT 'far' AS col, count(*) AS n, 0::BIGINT AS nulls, 0.0::DOUBLE AS null_pct, round(1e9::DOUBLE + avg(l_quantity), 4) AS mean, round(var_samp(l_quantity), 5) AS variance, round(stddev_samp(l_quantity), 6) AS std, 1e9::DOUBLE + min(l_quantity) AS min, 1e9::DOUBLE + max(l_quantity) AS max FROM lineitem")
def profile_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of batches of very different sizes, of values far from zero; states of states are merged again."""
    far = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") + OFFSET).alias("far"), "l_linenumber")
    states = [ag.profile_state(far.filter(F.col("l_linenumber") == b), ["far"]) for b in range(1, 8)]
    first = ag.merge_states(states[0].unionByName(states[1]))
    rest = states[2]
    for state in states[3:]:
        rest = rest.unionByName(state)
    merged = ag.merge_states(first.unionByName(ag.merge_states(rest)))
    return rounded(ag.finish_profile(merged), null_pct=6, mean=4, variance=5, std=6)


@query("SELECT CASE WHEN l_quantity < 5 THEN 0 WHEN l_quantity >= 45 THEN 9 ELSE floor((l_quantity - 5) / 5)::BIGINT + 1 END::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", 5, 45, 8)


@query("SELECT o_orderpriority AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 9) AS share FROM orders GROUP BY 1")
def category_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ag.category_frequencies(table(spark, sf_dir, "orders"), "o_orderpriority"), share=9)


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS corr FROM lineitem" for i, a in enumerate(MEASURES) for b in MEASURES[i + 1 :]))
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ag.correlation_matrix(table(spark, sf_dir, "lineitem"), MEASURES), corr=8)


def _gram_sql() -> str:
    names = ["1", *MEASURES]
    return " UNION ALL ".join(f"SELECT '{a}' AS row, '{b}' AS col, round(sum({a}::DOUBLE * {b}) / count(*), 3) AS value FROM lineitem" for i, a in enumerate(names) for b in names[i:])


@query(_gram_sql())
def gram_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Gram matrix over the number of rows."""
    rows = ag.gram_rows(table(spark, sf_dir, "lineitem"), MEASURES)
    n = rows.filter("row = '1' AND col = '1'").select(F.col("value").alias("n"))
    return rows.crossJoin(F.broadcast(n)).select("row", "col", F.round(F.col("value") / F.col("n"), 3).alias("value"))


SCORES_SQL = "s AS (SELECT l_discount * 10 AS score, (l_returnflag = 'R')::INT::DOUBLE AS y, l_extendedprice AS t, l_quantity * 1000 AS p FROM lineitem)"
RANKS_SQL = SCORES_SQL + ", g AS (SELECT score, count(*) AS n, sum(y) AS positives FROM s GROUP BY 1), r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0::DOUBLE AS rank FROM g)"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("score"), (F.col("l_returnflag") == "R").cast("double").alias("y"), F.col("l_extendedprice").alias("t"), (F.col("l_quantity") * 1000).alias("p"))


@query(f"WITH {RANKS_SQL} SELECT score, n, positives, rank FROM r")
def avg_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.average_ranks(_scores(spark, sf_dir), "score", "y")


@query(f"WITH {RANKS_SQL} SELECT round((sum(positives * rank) - sum(positives) * (sum(positives) + 1) / 2) / (sum(positives) * (sum(n) - sum(positives))), 9) AS auc FROM r")
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.auc(_scores(spark, sf_dir), "score", "y"), auc=9)


# one score for each row: a permutation of the ids
EACH_SQL = "e AS (SELECT event_id, event_id * 2654435761 % 4294967291 AS score, (event_type = 'error')::INT::DOUBLE AS y FROM events), r AS (SELECT *, row_number() OVER (ORDER BY score) AS rank FROM e)"
#: Ranges that a table is meant to have here, so that small ones have several.
RANGES = 20


def part_rows(rows: int) -> int:
    """Rows of a range: a share of a small table, as many as one task is meant to place of a large one."""
    return min(PART_ROWS, max(500, rows // RANGES))


def _each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 2654435761 % 4294967291).alias("score"), (F.col("event_type") == "error").cast("double").alias("y"))


@query(f"WITH {EACH_SQL} SELECT score, 1::BIGINT AS n, y AS positives, rank::DOUBLE AS rank FROM r")
def avg_rank_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _each(spark, sf_dir)
    return metrics.average_ranks(each, "score", "y", part_rows(each.count()))


@query(f"WITH {EACH_SQL} SELECT round((sum(y * rank) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 9) AS auc FROM r")
def auc_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _each(spark, sf_dir)
    return rounded(metrics.auc(each, "score", "y", part_rows(each.count())), auc=9)


@query("SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) - 1 AS place FROM events")
def score_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each event, from the highest value down, ties by id."""
    events = table(spark, sf_dir, "events")
    down = events.select("event_id", (-F.col("value")).alias("down"))
    return placed(down, ["down", "event_id"], part_rows=part_rows(events.count())).select("event_id", F.col("before").alias("place"))


@query(f"WITH {SCORES_SQL}, c AS (SELECT y, score, least(greatest(score, 1e-12), 1 - 1e-12) AS q FROM s) SELECT round(avg(((score >= 0.5) = (y = 1))::INT), 9) AS accuracy, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS log_loss FROM c")
def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.classification_metrics(_scores(spark, sf_dir), "score", "y"), accuracy=9, log_loss=6)


@query(f"WITH {SCORES_SQL} SELECT round(sqrt(avg((p - t) * (p - t))), 4) AS rmse, round(avg(abs(p - t)), 4) AS mae, round(1 - sum((p - t) * (p - t)) / (count(*) * var_pop(t)), 8) AS r2 FROM s")
def reg_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.regression_metrics(_scores(spark, sf_dir), "p", "t"), rmse=4, mae=4, r2=8)


@query("WITH t AS (SELECT o_orderstatus AS label, month(o_orderdate)::BIGINT AS workers, round(avg(o_totalprice), 4) AS time_s FROM orders GROUP BY 1, 2) SELECT label, workers, time_s, round(first_value(time_s) OVER (PARTITION BY label ORDER BY workers) / time_s, 8) AS speedup FROM t")
def speedup_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time of the row with the fewest workers over each row's time; rows are groups by then."""
    runs = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("label"), F.month("o_orderdate").cast("bigint").alias("workers")).agg(F.round(F.avg("o_totalprice"), 4).alias("time_s"))
    first = F.first_value("time_s").over(Window.partitionBy("label").orderBy("workers"))
    return runs.withColumn("speedup", F.round(first / F.col("time_s"), 8))


@query("SELECT concat('ORD-', lpad((o_orderkey + 1)::VARCHAR, 9, '0')) AS id FROM orders")
def regen_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New ids 1..n for all orders; which order gets which is not fixed, the set of ids is."""
    orders = table(spark, sf_dir, "orders")
    n = orders.count()
    indexed = sampling.dense_index(orders.select("o_orderkey"), "o_orderkey", rows=n)
    return indexed.select(sampling.id_format("ORD", F.col("index") + 1, n).alias("id"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def sample_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy("o_orderkey").limit(5).select("o_orderkey", "o_totalprice")


HASH_SQL = "substr(md5(concat('42|', {k}::VARCHAR)), 1, 8)"


@query(f"SELECT o_orderkey, (('0x' || {HASH_SQL.format(k='o_orderkey')})::BIGINT % 10000) < 2000 AS is_test FROM orders")
def split_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", sampling.in_test(42, F.col("o_orderkey"), 0.2).alias("is_test"))


@query(f"WITH h AS (SELECT o_orderkey, row_number() OVER (ORDER BY {HASH_SQL.format(k='o_orderkey')} || '|' || o_orderkey::VARCHAR) AS place, count(*) OVER () AS n FROM orders) SELECT o_orderkey, place <= floor(n * 0.25) AS is_test FROM h")
def split_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.split_exact(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.25, 42)


@query(f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {HASH_SQL.format(k='o_orderkey')} || '|' || o_orderkey::VARCHAR LIMIT 1000")
def resize_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.resize(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 1000)


def _bootstrap_sql(table: str, key: str, target: int) -> str:
    """Rows with k, how many of the draws take their place in the order of the hash of their key; those that any draw takes."""
    return f"""WITH placed AS (SELECT *, row_number() OVER (ORDER BY md5({key}::VARCHAR), {key}) - 1 AS place FROM {table}),
drawn AS (SELECT floor(('0x' || substr(md5(concat('42|draw|', i::VARCHAR)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * n)::BIGINT AS place, count(*) AS k
  FROM range({target}) r(i), (SELECT count(*) AS n FROM {table}) GROUP BY 1)
SELECT placed.*, drawn.k FROM placed JOIN drawn USING (place)"""


def _resized_sql(table: str, key: str, target: int) -> str:
    """Rows with k: those of a bootstrap where the table has fewer than ``target``, else once each those of the smallest hash."""
    return f"""SELECT * FROM ({_bootstrap_sql(table, key, target)}) WHERE (SELECT count(*) FROM {table}) < {target}
UNION ALL BY NAME SELECT * EXCLUDE (nth), 1 AS k FROM (SELECT *, row_number() OVER (ORDER BY {HASH_SQL.format(k=key)} || '|' || {key}::VARCHAR) AS nth FROM {table})
WHERE nth <= {target} AND (SELECT count(*) FROM {table}) >= {target}"""


@query(f"SELECT c_custkey, c_name FROM ({_resized_sql('customer', 'c_custkey', 4000)}), LATERAL (SELECT unnest(range(k)))")
def resize_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly 4,000 rows: a bootstrap of fewer, a sample without replacement of as many or more."""
    return sampling.resize(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 4000)


@query(f"SELECT p_partkey, k AS times FROM ({_bootstrap_sql('part', 'p_partkey', 5000)}) WHERE k > 0")
def bootstrap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each part is drawn in 5,000 draws with replacement."""
    parts = table(spark, sf_dir, "part").select("p_partkey")
    return sampling.bootstrap_counts(parts, "p_partkey", 5000, 42).withColumnRenamed("_times", "times")


JOBS = [
    sampling.ScaleJob("customer", "c_custkey", "C_NAME", "PAT"),
    sampling.ScaleJob("orders", "o_orderkey", "o_orderpriority", "ENC"),
    sampling.ScaleJob("supplier", "s_suppkey", None, ""),
    sampling.ScaleJob("part", "p_partkey", "p_name", "CLM"),
    sampling.ScaleJob("nation", "n_nationkey", "n_name", "CTX"),
]
SCALE_TO = 2000


@query(" UNION ALL ".join(f"SELECT '{j.table}' AS name, {SCALE_TO}::BIGINT AS n, {SCALE_TO if j.id_column else 1}::BIGINT AS ids, {repr(j.prefix + '-' + str(SCALE_TO).rjust(9, '0')) if j.id_column else 'NULL'} AS last_id" for j in JOBS))
def scale_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five tables resized to the same number of rows, up or down, with new ids; their counts."""
    out = None
    for job in JOBS:
        made = sampling.scaled(table(spark, sf_dir, job.table), job, SCALE_TO)
        names = {c.lower(): c for c in made.columns}
        id = F.col(names[job.id_column.lower()]) if job.id_column else F.lit("")
        row = made.agg(F.count("*").alias("n"), F.countDistinct(id).alias("ids"), F.max(F.nullif(id, F.lit(""))).alias("last_id")).select(F.lit(job.table).alias("name"), "n", "ids", "last_id")
        out = row if out is None else out.unionByName(row)
    return out


def _scaled_sql(job: sampling.ScaleJob, target: int) -> str:
    """Resized rows numbered by copy, then all of them by the hash of key and copy."""
    boot = _resized_sql(job.table, job.key, target)
    copies = f"copies AS (SELECT {job.key}, concat_ws('|', {job.key}::VARCHAR, each::VARCHAR) AS row FROM ({boot}), LATERAL (SELECT unnest(range(1, k + 1)) AS each))"
    return f"WITH {copies} SELECT {job.key}, concat('{job.prefix}-', lpad((row_number() OVER (ORDER BY md5(row), row))::VARCHAR, 9, '0')) AS id FROM copies"


@query(_scaled_sql(JOBS[0], 4000))
def scale_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table resized to 4,000 rows, row by row: which rows it has how often, and the new id of each."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return sampling.scaled(customers, JOBS[0], 4000).select("c_custkey", F.col("c_name").alias("id"))
