"""Reading posts from files and streams."""

from __future__ import annotations

import csv
import io
import sys
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelcorr.operators.rows import POST_SCHEMA

REFUSED_ROW = "_refused_row"

# Executors need not have the package installed: what tasks call travels with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Cell texts that count as missing.
NA_STRINGS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]


def read_posts(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: T.StructType | str = POST_SCHEMA,
    multi_line: bool = True,
    partitions: int | None = None,
    refused: str = "raise",
) -> DataFrame:
    """Read CSV files by the names in their headers, plus a ``file_name`` column.

    Every file is read by its own header; files with equal headers are read
    together. Only the columns of ``schema`` are returned; files may hold more,
    in any order, and one that lacks a column of ``schema`` is an error. Quoted
    cells may hold line breaks, so by default a file is one task: large inputs
    are many part files. ``multi_line=False`` splits files whose cells have no
    line breaks. ``partitions`` spreads the rows of few files for the work that
    follows.

    A row with more or fewer cells than its header is refused: its cells may
    stand under the wrong names. ``refused`` says what becomes of it: ``raise``
    fails the job that meets it, ``keep`` keeps it without cells, with its raw
    text in a column ``refused`` that is NULL for good rows (see
    ``quarantine_posts`` and ``refusal_counts``).
    """
    if refused not in ("raise", "keep"):
        raise ValueError(f"refused is raise or keep, not {refused}")
    schema = _struct(schema)
    by_header: dict[tuple[str, ...], list[str]] = {}
    for path, header in read_headers(spark, paths).items():
        absent = [f.name for f in schema.fields if f.name not in header]
        if absent:
            raise ValueError(f"{path} has no column {', '.join(absent)}")
        by_header.setdefault(header, []).append(path)
    parts = []
    for header, files in sorted(by_header.items()):
        reader = _csv_reader(spark).option("multiLine", multi_line).option("enforceSchema", False)
        # The header decides the order of the cells; all are text until typed below.
        names = [*header, REFUSED_ROW]
        cells_as_text = T.StructType([T.StructField(c, T.StringType(), True) for c in names])
        raw = reader.schema(cells_as_text).csv(files)
        # Spark reads the raw text only together with a cell: name one that adds nothing.
        row = F.concat(F.col(REFUSED_ROW), F.left(F.coalesce(raw[f"`{header[0]}`"], F.lit("")), F.lit(0)))
        file_name = F.col("_metadata.file_name")
        cells = [_typed(raw[f"`{f.name}`"], f) for f in schema.fields]
        if refused == "raise":
            message = F.concat_ws(" ", F.lit("refused row of"), file_name, F.lit(":"), row)
            good = F.when(row.isNull(), True).otherwise(F.raise_error(message).cast("boolean"))
            parts.append(raw.filter(good).select(*cells, file_name.alias("file_name")))
            continue
        cells = [F.when(row.isNull(), c).alias(f.name) for c, f in zip(cells, schema.fields)]
        parts.append(raw.select(*cells, file_name.alias("file_name"), row.alias("refused")))
    if not parts:
        whole = T.StructType(schema.fields).add("file_name", "string")
        return spark.createDataFrame([], whole.add("refused", "string") if refused == "keep" else whole)
    posts = reduce(DataFrame.unionByName, parts)
    return posts.repartition(partitions) if partitions else posts


def quarantine_posts(posts: DataFrame, path: str) -> DataFrame:
    """The good rows of ``read_posts(..., refused="keep")``; the refused ones are written as
    Parquet ``(file_name, refused)`` to ``path``, replacing what is there."""
    bad = posts.filter(F.col("refused").isNotNull()).select("file_name", "refused")
    bad.write.mode("overwrite").parquet(path)
    return posts.filter(F.col("refused").isNull()).drop("refused")


def refusal_counts(posts: DataFrame) -> DataFrame:
    """``(file_name, good, refused)``: rows of each file, of posts read with ``refused="keep"``."""
    return posts.groupBy("file_name").agg(
        F.count_if(F.col("refused").isNull()).alias("good"),
        F.count_if(F.col("refused").isNotNull()).alias("refused"),
    )


def read_headers(spark: SparkSession, paths: str | Sequence[str]) -> dict[str, tuple[str, ...]]:
    """The header of each file with any rows, by path, found by one job for all files.

    Tasks open their share of the files and read up to the end of the first record.
    Files in a store that only Spark reads are scanned instead, in one job too.
    """
    files = sorted(spark.read.text(_listed(paths)).inputFiles())
    if not files:
        return {}
    if all(map(_opens, {f.split(":")[0]: f for f in files}.values())):
        # Dealt to tasks without a shuffle, which would be a job of its own.
        tasks = min(len(files), 4 * spark.sparkContext.defaultParallelism)
        listed = spark.sparkContext.parallelize([(f,) for f in files], tasks)
        firsts = spark.createDataFrame(listed, "path string").mapInArrow(
            _first_records, "path string, names array<string>"
        )
        found = {r["path"]: r["names"] for r in firsts.collect()}
    else:
        found = {path: _record([line]) for path, line in _first_lines(spark, files).items()}
    return {path: _header_names(names) for path, names in sorted(found.items()) if names}


def _opens(uri: str) -> bool:
    """Can tasks open files like this one without Spark?"""
    try:
        pyarrow.fs.FileSystem.from_uri(uri)
    except (OSError, ValueError, pa.ArrowException):
        return False
    return True


def _first_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = []
        for uri in batch.column(0).to_pylist():
            store, path = pyarrow.fs.FileSystem.from_uri(uri)
            with store.open_input_stream(path) as stream:
                names.append(_record(io.TextIOWrapper(stream, encoding="utf-8-sig", newline="")))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(names, pa.list_(pa.string()))], ["path", "names"]
        )


def _first_lines(spark: SparkSession, files: list[str]) -> dict[str, str]:
    lines = spark.read.text(files).filter(F.trim("value") != "").select(
        F.col("_metadata.file_path").alias("path"),
        F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("place"),
        "value",
    )
    rows = lines.groupBy("path").agg(F.min_by("value", "place").alias("value")).collect()
    return {r["path"]: r["value"].removeprefix("﻿") for r in rows}


def _record(lines: Iterable[str]) -> list[str]:
    """The cells of the first record that is not an empty line; none if there is no such record."""
    return next((row for row in csv.reader(lines) if row), [])


def _header_names(names: Sequence[str]) -> tuple[str, ...]:
    """Header cells as column names: empty ones by number, repeated ones with their number."""
    seen = Counter(n.lower() for n in names)
    return tuple(
        f"_c{i}" if not n else f"{n}{i}" if seen[n.lower()] > 1 else n for i, n in enumerate(names)
    )


def _csv_reader(spark: SparkSession):
    reader = spark.read.option("header", True).option("escape", '"')
    reader = reader.option("columnNameOfCorruptRecord", REFUSED_ROW)
    # All cells have to be cut apart to be counted, whichever of them are wanted.
    return reader.option("columnPruning", False)


def _listed(paths: str | Sequence[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def _struct(schema: T.StructType | str) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _typed(cell: Column, field: T.StructField) -> Column:
    kept = F.when(~cell.isin(NA_STRINGS), cell)
    if not isinstance(field.dataType, T.StringType):
        kept = kept.try_cast(field.dataType)
    return kept.alias(field.name)


def posts_to_parquet(posts: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """Write posts once as Parquet, which later jobs can split and prune."""
    posts.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def read_post_stream(
    spark: SparkSession, source: str = "text", path: str | None = None, **options
) -> DataFrame:
    """A stream of lines in a ``value`` column, from any line source Spark has.

    ``text`` follows a folder; ``kafka`` and ``socket`` take their usual options.
    """
    reader = spark.readStream.format(source).options(**options)
    lines = reader.load(path) if path else reader.load()
    return lines.select(F.col("value").cast("string").alias("value"))


def write_replay(
    posts: DataFrame, path: str, rows_per_file: int = 10_000, columns: Sequence[str] = ()
) -> None:
    """Write posts as JSON lines for ``replay_stream``, ``rows_per_file`` at most each."""
    fields = list(columns) or POST_SCHEMA.fieldNames()
    lines = posts.select(F.to_json(F.struct(*fields)).alias("value"))
    lines.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).text(path)


def replay_stream(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    """Stream stored JSON lines, at most ``max_files`` files per micro-batch."""
    return read_post_stream(spark, "text", path, maxFilesPerTrigger=max_files)
