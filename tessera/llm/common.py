"""What the operators on text and vectors share: reading, cutting lineage, slicing batches, components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a folder of our own on a local master, as in tests.
    A cluster without the setting is an error: its machines share no local folder."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        folder = context.getCheckpointDir()
    return folder


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write a table to the shared folder and read it again: later work starts from these files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: The column that numbered() adds.
KEY = "__row_key"
#: Nodes of a plan that only reads a table's rows, each once.
_READS = re.compile(r"^[\s:+\-|]*(?:Relation|Project|SubqueryAlias|Filter)\b")


def numbered(docs: DataFrame, name: str = KEY) -> DataFrame:
    """Adds a key of its own for each row, the same however often the table is read: file and row number where
    ``docs`` is read from Parquet as it lies; any other table is numbered and written first."""
    lines = docs._jdf.queryExecution().analyzed().toString().strip().splitlines()
    if all(map(_READS.match, lines)) and lines[-1].rstrip().endswith("parquet"):
        return docs.withColumn(name, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))
    return cut(docs.withColumn(name, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row"))), "numbered")


def bounded(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` to be broadcast if it has at most ``rows`` rows (they are counted), else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def slices(batches: Iterator[pa.RecordBatch], column: str, budget: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of the batches with about ``budget`` bytes of ``column``, and its values (null: empty)."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
        values = values.fill_null(b"")
        start, size = 0, 0
        lengths = pa.compute.binary_length(values).to_pylist()
        for i, n in enumerate(lengths):
            size += n
            if size >= budget or i + 1 == len(lengths):
                yield batch.slice(start, i + 1 - start), values.slice(start, i + 1 - start).to_pylist()
                start, size = i + 1, 0


_tables: dict[tuple, Any] = {}


def worker_table(*key: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, which a worker keeps for its later tasks: one thing at a time, that asked for last."""
    if key not in _tables:
        _tables.clear()
        _tables[key] = make()
    return _tables[key]


@cache
def _trim() -> Callable[[int], int] | None:
    """The C library's call that gives free memory back to the machine, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(run: Run, keep: bool = False) -> Run:
    """``run`` for mapInArrow, in a worker that serves many stages and lies idle between them: at its beginning the
    table of another operator goes (unless ``keep``), and at its end the memory that it no longer holds."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep:
            _drop()
        yield from run(batches)
        _free()

    return whole


def _drop() -> None:
    if _tables:
        _tables.clear()
        _free()


def _free() -> None:
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 1 << 16) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from rows that are sorted by ``keys``, with the group's number of each row. Held at
    once: the rows of one group, or about ``least``."""

    def marks(table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table), dtype=bool)
        for k in keys:
            c = table.column(k).to_numpy()
            new[1:] |= c[1:] != c[:-1]
        return new

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= least:
            table = pa.Table.from_batches(held).combine_chunks()
            new = marks(table)
            end = int(np.flatnonzero(new)[-1]) if new.any() else 0
            if end:
                yield table.slice(0, end).combine_chunks(), np.cumsum(new[:end])
            held, size = table.slice(end).combine_chunks().to_batches(), len(table) - end
            least = max(least, 2 * size)
    if size:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.cumsum(marks(table))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of edges (u, v), both long: rows (node, component) with the smallest node
    of each component, for every node that has an edge to another.

    Alternating large and small stars: every round is a few aggregations and joins over the edges, the
    number of rounds grows with the logarithm of the longest path, and each round is written to the
    shared folder. Loops, repeated edges and an empty table are allowed.
    """
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        state = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = e.union(e.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        e = cut(moved.union(low.select("u", "m")).distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    stars = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return stars.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
