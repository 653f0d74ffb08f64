"""Scans, cleaning, derivation and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as fc
from ..operators import aggregates as ag
from ..operators import joins, quality
from ..plans import cohort
from ..sources import files, synthetic
from ..staging import scratch_folder, staged
from .registry import RAW, RAW_SQL, query, raw_rows, sql_bround, sql_double, sql_long, sql_normal, sql_trim, sql_uniform, table

REASON_SQL = f"""CASE WHEN {sql_trim('id')} = '' THEN 'id'
  WHEN ({sql_long('age')}) IS NULL OR ({sql_long('age')}) NOT BETWEEN 0 AND 120 THEN 'age'
  WHEN ({sql_double('psa')}) IS NULL OR ({sql_double('psa')}) NOT BETWEEN 0 AND 200 THEN 'psa' END"""


def _typed_sql(source: str = "raw") -> str:
    numbers = ", ".join(f"coalesce({sql_double(c)}, 0.0::DOUBLE) AS {c}" for c in ("income", "coverage", "healthcare_cost", "psa"))
    wholes = ", ".join(f"coalesce({sql_long(c)}, 0) AS {c}" for c in ("num_encounters", "num_diagnoses", "survival_days"))
    words = ", ".join(f"lower({sql_trim(c)}) AS {c}" for c in ("race", "ethnicity", "marital"))
    flag = f"(lower({sql_trim('has_died')}) = 'true' OR {sql_trim('has_died')} = '1') AS has_died"
    return f"SELECT {sql_trim('id')} AS id, {sql_long('age')} AS age, {words}, {numbers}, {wholes}, {flag} FROM {source} WHERE ({REASON_SQL}) IS NULL"


def _raw_csv(spark: SparkSession, sf_dir: str, shuffled_header: bool = True) -> str:
    """Raw rows as CSV; the header has other cases, blanks and another order than the cohort's columns."""
    path = scratch_folder(spark, "raw-csv")
    order = sorted(RAW) if shuffled_header else list(RAW)
    rows = raw_rows(spark, sf_dir)
    rows.select(*(F.col(c).alias(f" {c.upper()}") for c in order), F.col("event_id").alias("extra")).write.option("quoteAll", True).option("escape", '"').csv(path, header=True)
    return path


@query(f"WITH {RAW_SQL} {_typed_sql()}")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.typed_rows(files.csv_scan(spark, _raw_csv(spark, sf_dir), list(RAW)))


@query("SELECT CASE WHEN event_id % 10 IN (3, 5, 7) THEN 'malformed' ELSE 'kept' END AS kind, count(*) AS n FROM events GROUP BY 1")
def csv_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of ten rows one lacks a field, one has one too many and one has a quote inside a field that is not quoted."""
    e = F.col("event_id")
    bad = F.when(e % 10 == 7, F.concat_ws(",", "event_type", F.lit("one"))).when(e % 10 == 5, F.concat("event_type", F.lit('"x"'))).otherwise(F.col("event_type"))
    line = F.when(e % 10 == 3, F.concat_ws(",", "event_id", bad)).otherwise(F.concat_ws(",", "event_id", bad, "value"))
    rows = files.csv_rows(spark, _lines_as_csv(table(spark, sf_dir, "events").select(line), "id,type,value", "malformed"))
    kind = F.when(F.col(files.CORRUPT).isNull(), "kept").otherwise("malformed")
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def _lines_as_csv(lines: DataFrame, header: str, name: str) -> str:
    """Lines as they are in files that each begin with ``header``."""
    path = scratch_folder(lines.sparkSession, name)
    # a header that is the column's name is written as it is, like the lines
    as_is = {"quote": "", "sep": "\x01", "escapeQuotes": False, "header": True, "emptyValue": ""}
    lines.toDF(header).write.options(**as_is).csv(path)
    return path


@query("""SELECT event_id, event_type, CASE WHEN event_id % 2 = 0 THEN '' ELSE coalesce(props, '') END AS props, CASE WHEN event_id % 2 = 0 THEN '' ELSE value::VARCHAR END AS value
FROM events""")
def csv_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one folder whose headers differ in order, case and blanks, half of them without two of the columns."""
    path = scratch_folder(spark, "headers")
    events = table(spark, sf_dir, "events").withColumn("value", F.col("value").cast("string"))
    odd = events.filter("event_id % 2 = 1").select(F.col("props").alias(" Props"), F.col("event_id").alias("EVENT_ID "), "value", F.col("event_type").alias("Event_Type"))
    even = events.filter("event_id % 2 = 0").select("event_type", F.lit("x").alias("more"), "event_id")
    for part in (odd, even):
        part.write.mode("append").option("escape", '"').csv(path, header=True)
    rows = files.csv_scan(spark, path, ["event_id", "event_type", "props", "value"])
    return rows.withColumn("event_id", fc.to_long(F.col("event_id")))


@query("""SELECT o_custkey AS patient, count(*) AS num_diagnoses FROM orders GROUP BY 1""")
def diag_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conditions.csv is absent, claims.csv is there: diagnoses are counted in its columns."""
    folder = scratch_folder(spark, "raw")
    claims = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("PATIENTID"), F.col("o_orderpriority").alias("DIAGNOSIS1"), F.lit(None).cast("string").alias("DIAGNOSIS2"))
    claims.write.csv(f"{folder}/claims.csv", header=True)
    source = cohort.diagnosis_source(spark, folder)
    rows = spark.read.csv(source, header=True, schema="PATIENTID bigint, DIAGNOSIS1 string, DIAGNOSIS2 string")
    conditions, claimed = (rows, None) if source.endswith("conditions.csv") else (None, rows)
    return cohort.diagnosis_counts(conditions, claimed, spark)


@query("SELECT concat('C', c_custkey::VARCHAR) AS id, c_nationkey::BIGINT AS age, c_acctbal AS income, CASE WHEN c_custkey % 3 = 0 THEN 0.0::DOUBLE ELSE c_custkey / 2.0::DOUBLE END AS psa, coalesce(nullif(lower(c_mktsegment), 'machinery'), '') AS race FROM customer")
def json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one array and of single objects; absent fields take defaults."""
    path = scratch_folder(spark, "json")
    rows = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_nationkey").cast("bigint").alias("age"), F.col("c_acctbal").alias("income"),
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") / 2).alias("psa"), F.nullif(F.lower("c_mktsegment"), F.lit("machinery")).alias("race"), "c_custkey",
    )
    objects = F.to_json(F.struct("id", "age", "income", "psa", "race"))
    arrays = rows.filter("c_custkey > 0").groupBy((F.col("c_custkey") % 8).alias("g")).agg(F.concat(F.lit("["), F.concat_ws(",", F.collect_list(objects)), F.lit("]")).alias("value"))
    single = rows.filter("c_custkey = 0").select(objects.alias("value"))
    arrays.select("value").union(single).repartition(9).write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)
    schema = files.T.StructType().add("id", "string").add("age", "long").add("income", "double").add("psa", "double").add("race", "string")
    return files.json_scan(spark, path, schema, {"id": "", "age": 0, "income": 0.0, "psa": 0.0, "race": ""})


def _synth_sql(key: str) -> str:
    def u(name: str) -> str:
        return sql_uniform(42, name, key)

    return f"""WITH base AS (
  SELECT {key} AS k, concat('PAT-', lpad({key}::VARCHAR, 7, '0')) AS id, (45 + floor(40 * {u('age')}))::BIGINT AS age,
         ['white', 'black', 'hispanic', 'asian', 'other'][(floor(5 * {u('race')}) + 1)::INT] AS race, 20000 + 80000 * {u('income')} AS income,
         0.4::DOUBLE + 0.6::DOUBLE * {u('coverage')} AS coverage, 20 * {u('psa')} AS psa,
         (1 + floor(30 * {u('encounters')}))::BIGINT AS num_encounters, (1 + floor(8 * {u('diagnoses')}))::BIGINT AS num_diagnoses FROM customer)
SELECT id, age, race, round(income, 4) AS income, round(coverage, 8) AS coverage, round(psa, 6) AS psa, num_encounters, num_diagnoses,
       {sql_uniform(42, 'died', 'k')} < 1 / (1 + exp(-(-6 + 0.05::DOUBLE * age + 0.12::DOUBLE * psa + 0.2::DOUBLE * num_diagnoses - 2e-5 * income))) AS has_died,
       trunc(greatest(90.0::DOUBLE, 4200 - 18 * age - 90 * psa + 1500 * coverage + 200 * {sql_normal(42, 'survival', 'k')}))::BIGINT AS survival_days,
       round(greatest(0.0::DOUBLE, 6000 + 1500 * psa + 600 * num_encounters + 2200 * num_diagnoses + 0.05::DOUBLE * income + 1500 * {sql_normal(42, 'cost', 'k')}), 3) AS healthcare_cost
FROM base"""


@query(_synth_sql("c_custkey"))
def synth_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One synthetic patient for each customer."""
    made = synthetic.synthetic_cohort(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    return made.withColumns({"income": F.round("income", 4), "coverage": F.round("coverage", 8), "psa": F.round("psa", 6), "healthcare_cost": F.round("healthcare_cost", 3)})


@query("SELECT event_id, event_type, value, coalesce(props, '') AS props FROM events")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes and commas in a column survive."""
    path = scratch_folder(spark, "csv")
    files.write_csv(table(spark, sf_dir, "events").select("event_id", "event_type", "value", "props"), path)
    rows = files.csv_scan(spark, path, ["event_id", "event_type", "value", "props"])
    return rows.select(fc.to_long(F.col("event_id")).alias("event_id"), "event_type", fc.to_double(F.col("value")).alias("value"), "props")


@query(f"WITH {RAW_SQL}, typed AS ({_typed_sql()}) SELECT id, age, psa, psa / 200 AS risk, income AS survival, healthcare_cost AS cost FROM typed")
def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches, one of which is written twice."""
    path = scratch_folder(spark, "log")
    typed = quality.typed_rows(raw_rows(spark, sf_dir))
    scores = typed.select("*", (F.col("psa") / 200).alias("risk"), F.col("income").alias("survival"), F.col("healthcare_cost").alias("cost"))
    younger, older = scores.filter(F.col("age") < 60), scores.filter(F.col("age") >= 60)
    for batch, part in (("younger", younger), ("older", older), ("younger", younger)):
        files.append_predictions(part, typed.columns, path, batch)
    return spark.read.parquet(path).select("id", F.col("input.age").alias("age"), F.col("input.psa").alias("psa"), "risk", "survival", "cost")


@query(f"WITH {RAW_SQL} {_typed_sql()}")
def validate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.typed_rows(raw_rows(spark, sf_dir))


@query(f"WITH {RAW_SQL} SELECT coalesce({REASON_SQL}, 'valid') AS reason, count(*) AS n FROM raw GROUP BY 1")
def reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.reject_counts(raw_rows(spark, sf_dir))


@query(f"WITH {RAW_SQL} SELECT coalesce({REASON_SQL}, 'valid') AS reason, count(*) AS n FROM raw GROUP BY 1")
def load_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts as they fall out of writing the valid rows, without a scan of their own."""
    valid, counted = quality.typed_rows_counted(raw_rows(spark, sf_dir))
    valid.write.parquet(scratch_folder(spark, "valid"))
    return quality.observed_counts(spark, counted)


@query(f"WITH {RAW_SQL} SELECT event_id, coalesce({sql_double('income')}, 0.0::DOUBLE) AS income, coalesce({sql_long('num_diagnoses')}, 0) AS num_diagnoses FROM raw")
def default_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_rows(spark, sf_dir).select("event_id", F.coalesce(fc.to_double(F.col("income")), F.lit(0.0)).alias("income"), F.coalesce(fc.to_long(F.col("num_diagnoses")), F.lit(0).cast("bigint")).alias("num_diagnoses"))


@query(f"WITH {RAW_SQL} SELECT event_id, lower({sql_trim('race')}) AS race, lower({sql_trim('marital')}) AS marital FROM raw")
def string_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_rows(spark, sf_dir).select("event_id", fc.normalized(F.col("race")).alias("race"), fc.normalized(F.col("marital")).alias("marital"))


@query(f"WITH {RAW_SQL} SELECT event_id, (lower(has_died) = 'true' OR has_died = '1') AS flag FROM raw")
def flag_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_rows(spark, sf_dir).select("event_id", fc.to_flag(F.col("has_died")).alias("flag"))


@query(f"WITH {RAW_SQL} SELECT event_id, CASE WHEN lower({sql_trim('psa')}) IN ('', 'null') THEN NULL ELSE {sql_double('psa')} END AS psa FROM raw")
def null_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_rows(spark, sf_dir).select("event_id", fc.null_aware_double(F.col("psa")).alias("psa"))


@query("""WITH r AS (SELECT event_id, (event_id % 140)::BIGINT AS age, value - 10 AS income, value - 5 AS psa, event_id % 130 / 100.0::DOUBLE AS coverage FROM events)
SELECT event_id, concat_ws(',', CASE WHEN NOT (age BETWEEN 0 AND 120) THEN 'age' END, CASE WHEN NOT income >= 0 THEN 'income' END, CASE WHEN NOT psa >= 0 THEN 'psa' END, CASE WHEN NOT (coverage BETWEEN 0 AND 1) THEN 'coverage' END) AS broken FROM r""")
def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 140).alias("age"), (F.col("value") - 10).alias("income"), (F.col("value") - 5).alias("psa"), (F.col("event_id") % 130 / 100).alias("coverage"))
    return requests.select("event_id", F.concat_ws(",", quality.violations(quality.request_rules())).alias("broken"))


LIVES_SQL = """lives AS (SELECT c_custkey, min(o_orderdate)::DATE AS birth, max(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END)::DATE AS death
  FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)"""


def _lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").cast("date").alias("birth"), F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).cast("date").alias("death"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(dates, "c_custkey", "left")


AGE_SQL = sql_bround("least(greatest(coalesce(date_diff('day', birth, DATE '2002-01-01') / 365.25::DOUBLE, 68), 0), 120)")
SURVIVAL_SQL = "greatest(coalesce(date_diff('day', birth, coalesce(death, DATE '2002-01-01')), 0), 0)::BIGINT"


@query(f"WITH {LIVES_SQL} SELECT c_custkey, {AGE_SQL}::BIGINT AS age, death IS NOT NULL AS has_died, {SURVIVAL_SQL} AS survival_days FROM lives")
def derive_age_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.lit("2002-01-01").cast("date")
    return _lives(spark, sf_dir).select("c_custkey", cohort.age_years(F.col("birth"), as_of).alias("age"), F.col("death").isNotNull().alias("has_died"), cohort.survival_days(F.col("birth"), F.col("death"), as_of).alias("survival_days"))


CLAIMS_SQL = "claims AS (SELECT l_suppkey, nullif(l_discount, 0) AS DIAGNOSIS1, nullif(l_tax, 0) AS DIAGNOSIS2, nullif(l_returnflag, 'N') AS DIAGNOSIS3, l_orderkey, l_linenumber, l_partkey FROM lineitem)"
FOUND_SQL = "((DIAGNOSIS1 IS NOT NULL)::INT + (DIAGNOSIS2 IS NOT NULL)::INT + (DIAGNOSIS3 IS NOT NULL)::INT)::BIGINT"


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_suppkey", F.nullif(F.col("l_discount"), F.lit(0.0)).alias("DIAGNOSIS1"), F.nullif(F.col("l_tax"), F.lit(0.0)).alias("DIAGNOSIS2"), F.nullif(F.col("l_returnflag"), F.lit("N")).alias("DIAGNOSIS3"), "l_orderkey", "l_linenumber", "l_partkey")


@query(f"WITH {CLAIMS_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {FOUND_SQL} AS n FROM claims")
def row_nonnull_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _claims(spark, sf_dir)
    return claims.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", fc.count_non_null([F.col(c) for c in cohort.diagnosis_columns(claims)]).alias("n"))


@query(f"WITH {CLAIMS_SQL} SELECT l_suppkey, sum({FOUND_SQL})::BIGINT AS num_diagnoses FROM claims GROUP BY 1")
def diag_count_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _claims(spark, sf_dir)
    return ag.sum_per_key(claims, "l_suppkey", fc.count_non_null([F.col(c) for c in cohort.diagnosis_columns(claims)]), "num_diagnoses")


@query("SELECT event_id, coalesce(contains(lower(nullif(event_type, 'view')), 'err'), false) AS hit FROM events")
def contains_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", fc.contains_ci(F.nullif(F.col("event_type"), F.lit("view")), "ERR").alias("hit"))


@query("SELECT o_orderkey, least(greatest(o_totalprice / 1000, 10.0::DOUBLE), 400.0::DOUBLE) AS clipped, round_even(o_totalprice / 8, 1) AS half_even FROM orders")
def clip_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", fc.clip(price / 1000, 10.0, 400.0).alias("clipped"), F.bround(price / 8, 1).alias("half_even"))


# a shift keeps means off the ties of rounding, where the engines' last digits would decide
LEVELS_SQL = "levels AS (SELECT user_id, avg(value + 0.00123::DOUBLE) AS level FROM events WHERE contains(event_type, 'err') GROUP BY 1)"
LEVEL_SQL = f"round_even(least(greatest(coalesce(level, exp(1.5::DOUBLE + 0.6::DOUBLE * {sql_normal(42, 'level', 'c_custkey')})), 0.1::DOUBLE), 200), 2)"


@query(f"WITH {LEVELS_SQL} SELECT c_custkey, {LEVEL_SQL} AS psa FROM customer LEFT JOIN levels ON c_custkey = user_id")
def impute_lognormal(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = ag.mean_per_key(table(spark, sf_dir, "events"), "user_id", fc.contains_ci(F.col("event_type"), "err"), F.col("value") + 0.00123, "level")
    joined = joins.left_join_lookups(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", [levels], {})
    return joined.select("c_custkey", cohort.imputed_level(F.col("level"), F.col("c_custkey")).alias("psa"))


@query("SELECT user_id, round(avg(value), 6) AS level FROM events WHERE contains(event_type, 'err') GROUP BY 1")
def filtered_mean_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ag.mean_per_key(table(spark, sf_dir, "events"), "user_id", fc.contains_ci(F.col("event_type"), "err"), fc.to_double(F.col("value").cast("string")), "level")
    return found.withColumn("level", F.round("level", 6))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def count_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.count_per_key(table(spark, sf_dir, "orders"), "o_custkey", "n")


@query(f"""WITH {LEVELS_SQL}, visits AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), errors AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
SELECT c_custkey, coalesce(v.n, 0) AS num_encounters, coalesce(e.n, 0) AS num_events, round(level, 6) AS level
FROM customer LEFT JOIN visits v ON c_custkey = o_custkey LEFT JOIN errors e ON c_custkey = e.user_id LEFT JOIN levels l ON c_custkey = l.user_id""")
def left_join_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    lookups = [ag.count_per_key(table(spark, sf_dir, "orders"), "o_custkey", "num_encounters"), ag.count_per_key(events, "user_id", "num_events"), ag.mean_per_key(events, "user_id", fc.contains_ci(F.col("event_type"), "err"), F.col("value") + 0.00123, "level")]
    joined = joins.left_join_lookups(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", lookups, {"num_encounters": 0, "num_events": 0})
    return joined.withColumn("level", F.round("level", 6))


@query(f"""WITH {LIVES_SQL}, {LEVELS_SQL}, visits AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), errors AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
SELECT c.c_custkey::VARCHAR AS id, {AGE_SQL}::BIGINT AS age, lower(c_mktsegment) AS race, 'unknown' AS ethnicity, CASE WHEN c_nationkey % 2 = 0 THEN 'm' ELSE 's' END AS marital,
  round_even(c_acctbal, 2) AS income, round_even(coalesce(nullif(c_nationkey, 3) / 25.0::DOUBLE, 0), 4) AS coverage, round_even(c_acctbal * 2, 2) AS healthcare_cost, {LEVEL_SQL.replace('c_custkey', 'c.c_custkey')} AS psa,
  coalesce(v.n, 0) AS num_encounters, coalesce(e.n, 0) AS num_diagnoses, death IS NOT NULL AS has_died, {SURVIVAL_SQL} AS survival_days
FROM customer c JOIN lives ON c.c_custkey = lives.c_custkey LEFT JOIN visits v ON c.c_custkey = o_custkey LEFT JOIN errors e ON c.c_custkey = e.user_id LEFT JOIN levels l ON c.c_custkey = l.user_id""")
def cohort_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as patients, orders as encounters, events as conditions and observations."""
    customer, events = table(spark, sf_dir, "customer"), table(spark, sf_dir, "events")
    patients = customer.join(_lives(spark, sf_dir), "c_custkey").select(
        F.col("c_custkey").cast("string").alias("Id"), F.col("birth").alias("BIRTHDATE"), F.col("death").alias("DEATHDATE"), F.col("c_mktsegment").alias("RACE"), F.lit(None).cast("string").alias("ETHNICITY"),
        F.when(F.col("c_nationkey") % 2 == 0, "M").alias("MARITAL"), F.col("c_acctbal").alias("INCOME"), (F.nullif(F.col("c_nationkey"), F.lit(3)) / 25).alias("HEALTHCARE_COVERAGE"), (F.col("c_acctbal") * 2).alias("HEALTHCARE_EXPENSES"),
    )
    encounters = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("PATIENT"))
    happened = events.select(F.col("user_id").cast("string").alias("PATIENT"))
    observed = events.select(F.col("user_id").cast("string").alias("PATIENT"), F.when(F.col("event_type") == "error", "Prostate specific Ag").otherwise("other").alias("DESCRIPTION"), (F.col("value") + 0.00123).cast("string").alias("VALUE"))
    return cohort.cohort_table(patients, encounters, observed, cohort.diagnosis_counts(happened, None, spark), F.lit("2002-01-01").cast("date"))


@query("""WITH s AS (SELECT event_id, event_type, round(value, 0) AS value, user_id % 2 AS coverage FROM events)
SELECT event_id, event_type, value, coverage, length(event_type) * 1000 + value + coverage / 10.0::DOUBLE AS score, value < 20 AS hit FROM s""")
def memo_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of values below 20 are known; the key holds all features, coverage too."""
    requests = table(spark, sf_dir, "events").select("event_id", "event_type", F.round("value", 0).alias("value"), (F.col("user_id") % 2).alias("coverage"))
    features = ["event_type", "value", "coverage"]

    def score(df: DataFrame) -> DataFrame:
        return df.withColumn("score", F.length("event_type") * 1000 + F.col("value") + F.col("coverage") / 10)

    nothing = spark.createDataFrame([], "key string, score double")
    _, known = joins.memoised_scores(requests.filter("value < 20"), features, nothing, score)
    return joins.memoised_scores(requests, features, known, score)[0]


#: Times of three batches of requests and how long a score is good: what the first batch writes has expired by the third.
BATCH_TIMES, SCORE_TTL = (0, 50, 120), 100


def _store_sql() -> str:
    """Keys that are written by each batch are those it asks for that no live batch before it wrote."""
    t0, t1, t2 = BATCH_TIMES
    assert t0 + SCORE_TTL > t1 and t0 + SCORE_TTL <= t2 < t1 + SCORE_TTL
    keys = "event_type, value, coverage"
    return f"""WITH s AS (SELECT event_id, event_type, round(value, 0) AS value, user_id % 2 AS coverage, event_id % 3 AS batch FROM events),
w0 AS (SELECT DISTINCT {keys} FROM s WHERE batch = 0), w1 AS (SELECT DISTINCT {keys} FROM s WHERE batch = 1 EXCEPT SELECT * FROM w0)
SELECT event_id, batch, {keys}, length(event_type) * 1000 + value + coverage / 10.0::DOUBLE AS score,
  CASE batch WHEN 0 THEN false WHEN 1 THEN ({keys}) IN (SELECT ({keys}) FROM w0) ELSE ({keys}) IN (SELECT ({keys}) FROM w1) END AS hit FROM s"""


@query(_store_sql())
def memo_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches of requests through a stored table of scores that expire; the last one opens the store again and runs twice."""
    features = ["event_type", "value", "coverage"]
    requests = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 3).alias("batch"), "event_type", F.round("value", 0).alias("value"), (F.col("user_id") % 2).alias("coverage"))

    def score(df: DataFrame) -> DataFrame:
        return df.withColumn("score", F.length("event_type") * 1000 + F.col("value") + F.col("coverage") / 10)

    path, found = scratch_folder(spark, "scores"), {}
    for batch, now in [*enumerate(BATCH_TIMES), (2, BATCH_TIMES[2])]:
        store = joins.ScoreStore(spark, path, SCORE_TTL, buckets=8)
        found[batch] = staged(store.score(requests.filter(F.col("batch") == batch), features, score, f"b{batch}", now), "scored")
    store.table.drop()
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("WITH k AS (SELECT count(*) AS n FROM events GROUP BY event_type, round(value, 0)) SELECT sum(n)::BIGINT AS requests, count(*) AS misses, (sum(n) - count(*))::BIGINT AS hits, round((sum(n) - count(*)) / sum(n), 9) AS hit_share FROM k")
def dup_key_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ag.duplicate_key_rate(table(spark, sf_dir, "events"), F.struct("event_type", F.round("value", 0)))
    return found.withColumn("hit_share", F.round("hit_share", 9))


@query(f"""WITH {RAW_SQL} SELECT event_id, {sql_long('age')} AS whole, {sql_double('psa')} AS number, least(greatest(event_id, 10), 500) AS clipped, round(sqrt(event_id), 9) AS root, round(ln(event_id + 1), 9) AS log,
  CASE WHEN event_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0 END AS even, concat('ID-', lpad(event_id::VARCHAR, 9, '0')) AS code, sha256(concat(race, '|', marital)) AS digest,
  coalesce(try_cast(CASE WHEN event_id % 3 = 0 THEN '2001-02-30' ELSE '2001-02-03' END AS DATE), DATE '1970-01-01') AS day, round(1 / (1 + exp(-(event_id % 40 - 20.0::DOUBLE))), 9) AS sigmoid,
  round(0.5::DOUBLE + 2 * (event_id % 7) - 0.25::DOUBLE * (event_id % 5), 9) AS dot, abs(event_id - 50) AS distance, date_diff('day', DATE '2000-01-01', DATE '2000-01-01' + (event_id % 400)::INT)::BIGINT AS days FROM raw""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    day = F.when(e % 3 == 0, "2001-02-30").otherwise("2001-02-03")
    start = F.lit("2000-01-01").cast("date")
    return raw_rows(spark, sf_dir).select(
        "event_id", fc.to_long(F.col("age")).alias("whole"), fc.to_double(F.col("psa")).alias("number"), F.least(F.greatest(e, F.lit(10)), F.lit(500)).alias("clipped"), F.round(F.sqrt(e), 9).alias("root"), F.round(F.ln(e + 1), 9).alias("log"),
        fc.one_hot((e % 2).cast("string"), ["0", "1"], "1")[0].alias("even"), F.format_string("ID-%09d", e).alias("code"), F.sha2(F.concat("race", F.lit("|"), "marital"), 256).alias("digest"),
        F.coalesce(F.try_to_date(day, "yyyy-MM-dd"), F.lit("1970-01-01").cast("date")).alias("day"), F.round(fc.sigmoid((e % 40 - 20).cast("double")), 9).alias("sigmoid"),
        F.round(fc.dot([0.5, 2.0, -0.25], [e % 7, e % 5]), 9).alias("dot"), F.abs(e - 50).alias("distance"), F.datediff(F.date_add(start, (e % 400).cast("int")), start).cast("bigint").alias("days"),
    )


@query("SELECT l_linenumber % 3 AS batch, l_orderkey, l_linenumber, l_quantity FROM lineitem")
def union_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of three batches put together, columns by name."""
    items = table(spark, sf_dir, "lineitem")
    parts = [items.filter(F.col("l_linenumber") % 3 == b).select(F.lit(b).alias("batch"), *cols) for b, cols in enumerate((("l_orderkey", "l_linenumber", "l_quantity"), ("l_quantity", "l_orderkey", "l_linenumber"), ("l_linenumber", "l_quantity", "l_orderkey")))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(None)
def partition_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.partition_load(table(spark, sf_dir, "lineitem").repartition(8, "l_orderkey"))


