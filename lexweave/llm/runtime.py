"""Scratch space and materialisation shared by the corpus operators.

Intermediate tables go to the shared folder that the cluster names in
``spark.checkpoint.dir``; a folder of the local machine is chosen only where
that setting is absent (unit tests).

Tables are written by the tasks' Python workers with Arrow, one file a task.
Spark's own writer starts three ``chmod`` processes for each file of a local
file system without Hadoop's native library, and until such a child runs its
program, the system counts the executor's memory once more.  Results of tasks
that keep all cores busy are therefore written like intermediate tables, and
what reads them writes few files in little time.
"""

from __future__ import annotations

import ctypes
import json
import tempfile
import uuid
from dataclasses import dataclass
from functools import wraps

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_LISTED = "spark.sql.sources.parallelPartitionDiscovery.threshold"
#: Rows and bytes of a row group.
_GROUP_ROWS, _GROUP_BYTES = 1 << 16, 16 << 20


def _explicit(spark: SparkSession, key: str) -> bool:
    """Whether the session sets the key itself."""
    return spark._jsparkSession.sessionState().conf().contains(key)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; sets a checkpoint folder only where none is set."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not configured and context._jsc.sc().getCheckpointDir().isDefined():
        configured = context._jsc.sc().getCheckpointDir().get()
    if not configured:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="lexweave-")
        context.setCheckpointDir(configured)
    path = spark._jvm.org.apache.hadoop.fs.Path(configured)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if whole.startswith("file:/") and not whole.startswith("file://"):
        whole = "file://" + whole.removeprefix("file:")
    return whole.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, in the application's own folder."""
    return f"{shared_dir(spark)}/lexweave/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Deletes what this application has written to the shared folder.

    Results that are not materialised yet read from there: call it after them.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lexweave/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@dataclass
class Stored:
    """A written table and its number of rows."""

    frame: DataFrame
    rows: int
    folder: str

    def drop(self) -> None:
        """Deletes the files; frames that read them must be materialised."""
        spark = self.frame.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _nullable(schema: T.StructType) -> T.StructType:
    text = schema.json()
    for name in ("nullable", "containsNull", "valueContainsNull"):
        text = text.replace(f'"{name}":false', f'"{name}":true')
    return T.StructType.fromJson(json.loads(text))


class PartFile:
    """A Parquet file that a task writes; nothing is opened without rows."""

    def __init__(self, folder: str, arrow: pa.Schema):
        self.uri, self.rows = f"{folder}/part-{uuid.uuid4().hex}.parquet", 0
        self._folder, self._arrow, self._writer = folder, arrow, None
        self._held, self._count, self._bytes = [], 0, 0

    def add(self, batch: pa.RecordBatch) -> None:
        if batch.num_rows:
            self._held.append(batch)
            self.rows += batch.num_rows
            self._count, self._bytes = self._count + batch.num_rows, self._bytes + batch.nbytes
            if self._count >= _GROUP_ROWS or self._bytes >= _GROUP_BYTES:
                self._flush()

    def _flush(self) -> None:
        if self._writer is None:
            system, root = pafs.FileSystem.from_uri(self._folder)
            system.create_dir(root, recursive=True)
            self._sink = system.open_output_stream(f"{root}/{self.uri.rpartition('/')[2]}")
            words = [field.name for field in self._arrow if pa.types.is_string(field.type)]
            self._writer = pq.ParquetWriter(self._sink, self._arrow, compression="zstd", compression_level=1, use_dictionary=words, store_schema=False)
        self._writer.write_table(pa.Table.from_batches(self._held).select(self._arrow.names).cast(self._arrow))
        self._held, self._count, self._bytes = [], 0, 0

    def close(self) -> int:
        """The number of rows; 0 if there is no file."""
        if self._held:
            self._flush()
        if self._writer is not None:
            self._writer.close()
            self._sink.close()
        return self.rows


def _to_files(function, folder: str, arrow: pa.Schema):
    """Writes what ``function`` makes of a task's batches to one file."""

    def run(batches):
        file = PartFile(folder, arrow)
        for batch in function(batches):
            file.add(batch)
        if file.close():
            yield pa.record_batch([pa.array([file.uri]), pa.array([file.rows], pa.int64())], names=["file", "rows"])

    return run


def read_files(spark: SparkSession, files: list[str], schema: T.StructType) -> DataFrame:
    """The named Parquet files; their list is checked by the driver alone."""
    if not files:
        return spark.createDataFrame([], schema)
    explicit, before = _explicit(spark, _LISTED), spark.conf.get(_LISTED)
    spark.conf.set(_LISTED, str(max(int(before), len(files) + 1)))
    try:
        return spark.read.schema(schema).parquet(*files)
    finally:
        if explicit:
            spark.conf.set(_LISTED, before)
        else:
            spark.conf.unset(_LISTED)


def stored_map(frame: DataFrame, function, schema: T.StructType | str, label: str) -> Stored:
    """Writes ``mapInArrow(function, schema)`` of the frame in the same workers.

    Each attempt of a task writes a file of its own; only files of tasks that
    ended well are reported, and only these are read.  A folder that Arrow
    doesn't reach is written by Spark.
    """
    spark = frame.sparkSession
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    folder = scratch(spark, label)
    try:
        pafs.FileSystem.from_uri(folder)
    except (pa.ArrowException, NotImplementedError, OSError):
        arrow_map(frame, function, schema).write.parquet(folder)
        out = spark.read.schema(schema).parquet(folder)
        return Stored(out, out.count(), folder)
    files = arrow_map(frame, _to_files(function, folder, to_arrow_schema(_nullable(schema))), "file string, rows long").collect()
    return Stored(read_files(spark, sorted(x.file for x in files), schema), sum(x.rows for x in files), folder)


def _as_it_is(batches):
    yield from batches


def stored(frame: DataFrame, label: str) -> Stored:
    """Cuts the lineage: writes the table to the shared folder and rereads it."""
    return stored_map(frame, _as_it_is, frame.schema, label)


def written(frame: DataFrame, label: str) -> DataFrame:
    """``stored`` without its number of rows."""
    return stored(frame, label).frame


def written_by_spark(frame: DataFrame, label: str) -> DataFrame:
    """The same without Python: for native operators and whole documents."""
    spark = frame.sparkSession
    path = scratch(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


#: Narrow rows that are broadcast: about 20 MB.
BROADCAST_ROWS = 1 << 18


def small(frame: DataFrame, rows: int) -> DataFrame:
    """The side of a join, to be broadcast if its counted rows are few enough;
    more are shuffled."""
    return F.broadcast(frame) if rows <= BROADCAST_ROWS else frame


def text_of(column: str):
    """The text column with null as the empty string."""
    return F.coalesce(F.col(column), F.lit(""))


def release_memory() -> None:
    """Gives freed memory back to the system, where the allocators can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def _releasing(function):
    """Workers are reused by later stages, so none may keep what it freed."""

    @wraps(function)
    def run(batches):
        try:
            yield from function(batches)
        finally:
            release_memory()

    return run


def arrow_map(frame: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with the package shipped to the workers."""
    from lexweave.session import attach

    spark = attach(frame.sparkSession)
    # Texts can be long: unless the session sets a number of its own, a batch
    # has fewer rows than Spark's default, which bounds both sides' buffers.
    if not _explicit(spark, _BATCH_ROWS):
        spark.conf.set(_BATCH_ROWS, "1000")
    return frame.mapInArrow(_releasing(function), schema)
