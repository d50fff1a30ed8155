"""Replaying stored posts at a pace: a streaming source with exact offsets.

A replay table is Parquet with an index of its files. The source numbers the rows
in the order of file names and row positions; an offset is a number of rows, so
a query that is started again from its checkpoint goes on with the next row.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from labelcorr.operators.rows import POST_SCHEMA

# Executors need not have the package installed: the source travels with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "labelcorr_replay"
INDEX = "_index"  # Parquet readers pass over names that begin with an underscore
ROWS_PER_TASK = 10_000


def write_replay_table(
    posts: DataFrame, path: str, rows_per_file: int = 100_000, columns: Sequence[str] = ()
) -> None:
    """Write posts as JSON lines in a ``value`` column, for ``replay_at_pace``."""
    spark, path = posts.sparkSession, path.rstrip("/")
    fields = list(columns) or POST_SCHEMA.fieldNames()
    lines = posts.select(F.to_json(F.struct(*fields)).alias("value"))
    lines.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)
    written = spark.read.parquet(path)
    # Footers hold the counts; one row per file.
    files = written.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))
    files.coalesce(1).write.mode("overwrite").json(f"{path}/{INDEX}")


def replay_at_pace(
    spark: SparkSession, path: str, rows_per_trigger: int = 1000, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """A stream of the lines of a replay table, ``rows_per_trigger`` more per micro-batch.

    The trigger sets the time between batches, so both give the pace. A batch
    is read by tasks of up to ``rows_per_task`` rows. Tasks and the driver open
    the files themselves, in any store that pyarrow knows.
    """
    if rows_per_trigger < 1 or rows_per_task < 1:
        raise ValueError("a trigger and a task take one row at least")
    spark.dataSource.register(ReplaySource)
    files = spark.read.schema("file string, n bigint").json(f"{path.rstrip('/')}/{INDEX}")
    index = [(r["file"], r["n"]) for r in files.orderBy("file").collect()]
    options = {"rows": rows_per_trigger, "task": rows_per_task, "index": json.dumps(index)}
    return spark.readStream.format(FORMAT).options(**options).load()


class ReplaySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ReplayReader(self.options)


class Rows(InputPartition):
    """Rows ``start`` to ``end`` (exclusive) of a file."""

    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


class ReplayReader(DataSourceStreamReader):
    """Offsets are numbers of rows. The engine plans the last batch of its log again when a
    query restarts, which tells the reader where it is."""

    def __init__(self, options):
        self.rows, self.task = int(options["rows"]), int(options["task"])
        self.index = [(file, int(n)) for file, n in json.loads(options["index"])]
        self.at = 0

    def initialOffset(self) -> dict:
        return {"row": 0}

    def latestOffset(self) -> dict:
        return {"row": min(self.at + self.rows, sum(n for _, n in self.index))}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.at = max(self.at, end["row"])
        found, before = [], 0
        for file, n in self.index:
            low, high = max(start["row"] - before, 0), min(end["row"] - before, n)
            found += [Rows(file, i, min(i + self.task, high)) for i in range(low, high, self.task)]
            before += n
        return found

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        store, path = pyarrow.fs.FileSystem.from_uri(partition.file)
        with store.open_input_file(path) as stream:
            table, before = pq.ParquetFile(stream), 0
            for group in range(table.num_row_groups):
                n = table.metadata.row_group(group).num_rows
                low, high = max(partition.start - before, 0), min(partition.end - before, n)
                if low < high:
                    rows = table.read_row_group(group, columns=["value"]).slice(low, high - low)
                    yield from rows.to_batches()
                before += n

    def commit(self, end: dict) -> None:
        pass
