"""CSV, JSON and Parquet scans and sinks."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


class MissingColumns(ValueError):
    """Required columns are absent from a table."""


def csv_files(spark: SparkSession, path: str | Sequence[str]) -> list[str]:
    """The files under a path (or paths), listed by Spark and not read."""
    return sorted(r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect())


def _first_line(spark: SparkSession, path: str) -> str:
    """The first line of a file that is not empty, or the empty string; compressed files are read as Hadoop reads them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(place)
    stream = place.getFileSystem(conf).open(place)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream if codec is None else codec.createInputStream(stream), "UTF-8"))
    try:
        while (line := reader.readLine()) == "":
            pass
        return line or ""
    finally:
        reader.close()


def csv_headers(spark: SparkSession, path: str | Sequence[str], at_once: int = 16) -> dict[tuple[str, ...], list[str]]:
    """Files by the names in their first line; files without a line are left out.

    One line of each file is read, ``at_once`` files at a time.
    """
    found = csv_files(spark, path)
    with ThreadPoolExecutor(at_once) as pool:
        firsts = list(pool.map(lambda file: _first_line(spark, file), found))
    out: dict[tuple[str, ...], list[str]] = {}
    for file, first in zip(found, firsts, strict=True):
        if first:
            out.setdefault(tuple(next(csv.reader([first]))), []).append(file)
    return out


def quoted_rightly(line: Column) -> Column:
    """Whether the quotes of a line of CSV stand where they may: around whole fields, and doubled inside them.

    Cut at its quotes, a line is inside a field in every second part; the parts between are empty (a doubled quote) or go
    from one comma to another.
    """
    parts = F.split(line, '"', -1)
    last = F.size(parts) - 1

    def fits(part: Column, i: Column) -> Column:
        opens = (i == 0) & ((part == "") | part.endswith(","))
        closes = (i == last) & ((part == "") | part.startswith(","))
        return (i % 2 == 1) | (i == 0) & opens | (i == last) & closes | (i > 0) & (i < last) & ((part == "") | part.startswith(",") & part.endswith(","))

    checked = F.transform(parts, fits)
    return ~line.contains('"') | (last % 2 == 0) & F.forall(checked, lambda ok: ok)


def _csv_group(spark: SparkSession, header: tuple[str, ...], paths: list[str]) -> DataFrame:
    """Rows of files with one header, as strings by its names (lower-cased and trimmed, the last of equal ones), and the mark."""
    # one field a line: the reader leaves out each file's first line, and the line stays as it is
    whole = {"header": True, "sep": "\x01\x1f\x01", "quote": "", "maxCharsPerColumn": -1}
    lines = spark.read.options(**whole).schema("line string").csv(paths)
    schema = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(header))] + [T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_csv("line", schema.simpleString()[7:-1].replace(":", " "), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "escape": '"'})
    rows = lines.select("line", parsed.alias("row"))
    names = {name.strip().lower(): f"row._{i}" for i, name in enumerate(header)}
    bad = F.when(F.col(f"row.{CORRUPT}").isNotNull() | ~quoted_rightly(F.col("line")), F.col("line"))
    return rows.select(*(F.col(at).alias(name) for name, at in names.items()), bad.alias(CORRUPT))


def csv_rows(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """All rows of CSV files with headers, as strings by name, plus ``_corrupt_record``.

    Files may have different headers: columns are bound by name in each file, in any order, and are null where a file
    has no such column.  Files of one header are one scan; scans are united by name.  A row with more or fewer fields than its
    header, or with quotes where none may be, has its line in ``_corrupt_record``.  Records end with their line.
    """
    groups = csv_headers(spark, path)
    if not groups:
        return spark.createDataFrame([], f"{CORRUPT} string")
    rows = [_csv_group(spark, header, paths) for header, paths in groups.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)


def csv_scan(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The named columns of well-formed rows; absent columns read as the empty string.

    Rows with more or fewer fields than the header of their file, or with misplaced quotes, are left out.
    """
    rows = csv_rows(spark, path)
    well_formed, have = rows.filter(F.col(CORRUPT).isNull()), set(rows.columns)
    return well_formed.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) if c in have else F.lit("").alias(c) for c in columns))


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumns(f"missing columns: {', '.join(missing)}")
    return df


def json_scan(spark: SparkSession, path: str, schema: T.StructType, defaults: Mapping[str, object]) -> DataFrame:
    """Files that each hold one object or an array of objects; absent fields take their default."""
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return rows.select(*(F.coalesce(F.col(f.name), F.lit(defaults[f.name]).cast(f.dataType)).alias(f.name) if f.name in defaults else F.col(f.name) for f in schema.fields))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header in each part; quotes are doubled."""
    df.write.mode("overwrite").option("escape", '"').csv(path, header=True)


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str | None:
    """The first of the paths that exists, in whatever store they name."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(conf).exists(place):
            return path
    return None


def read_raw(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """A raw extract ``folder/name.csv`` with its explicit schema."""
    path = f"{folder}/{name}.csv"
    if first_existing(spark, [path]) is None:
        raise FileNotFoundError(f"raw extract {name} is missing: {path}")
    return spark.read.csv(path, header=True, schema=schema, escape='"')


def append_predictions(scores: DataFrame, rows: Sequence[str], path: str, batch: str, at: Column | None = None) -> None:
    """Add the scored rows of a batch to a Parquet log: id, the input as one nested column, scores, time.

    A batch is a folder of the log; one that is written again replaces itself, so each row is there once however often a
    job is run.  Readers see the batch as a column.
    """
    at = F.current_timestamp() if at is None else at
    nested = F.struct(*(F.col(c) for c in rows)).alias("input")
    scores.select("id", nested, "risk", "survival", "cost", at.alias("logged_at")).write.mode("overwrite").parquet(f"{path}/batch={batch}")
