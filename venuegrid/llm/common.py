"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import sys
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from venuegrid.runtime import ensure_checkpoint_dir

#: ASCII white space, the word separators of every operator here.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def run_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the cluster shares."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage is
    cut, and columns that are not needed later are not read later."""
    path = run_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """The intermediate tables of one run of an operator, in a folder of their own below the
    one that the cluster shares.

    Each is written as Parquet and read again, as by ``written``; the shuffle files of the
    job that wrote it go with the job. Once later tables are written, ``drop`` deletes those
    that only they came from, so that a run holds no more than what its result still reads.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder = spark, run_folder(spark, name)
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"
        with _shuffles_released(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete these tables; others that were derived from them have to be written."""
        for df in tables:
            delete_folder(self.spark, self.paths.pop(id(df))[1])

    def keep_only(self, *tables: DataFrame) -> None:
        """Delete all tables but these."""
        kept = set(map(id, tables))
        self.drop(*[df for df, _ in list(self.paths.values()) if id(df) not in kept])


@contextmanager
def _shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Jobs in here delete their shuffle files when they end."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote, in whatever file system it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Words of 64 bits in the map that clears rows before a join.
MAP_WORDS = 1 << 18


def row_key(*columns: str) -> Column:
    """A hash of the columns' values in which null is a value of its own."""
    return F.xxhash64(*(c for name in columns for c in (F.isnull(name), F.col(name))))


def without(docs: DataFrame, named: DataFrame, *hashed: str) -> DataFrame:
    """``docs`` without the rows that ``named`` (doc_id long, hash long) names: those of one
    doc_id and one ``row_key`` of the columns ``hashed``."""
    return _met(docs, named, hashed, "left_anti")


def only(docs: DataFrame, named: DataFrame, *hashed: str) -> DataFrame:
    """The rows of ``docs`` that ``named`` names; see ``without``."""
    return _met(docs, named, hashed, "left_semi")


def _met(docs: DataFrame, named: DataFrame, hashed: tuple[str, ...], how: str) -> DataFrame:
    """An anti or semi join that moves few of the long rows: a broadcast map of 2^24 bits, at
    most ``MAP_WORDS`` rows, clears those whose hash nobody has; the others meet ``named``
    in a join. Where the map would be too full to clear any, all rows do. Columns that the
    join needs get names that no table has."""
    mark = uuid.uuid4().hex
    doc_id, key, word, bits = (f"{name}_{mark}" for name in ("doc_id", "key", "word", "bits"))
    named = named.select(F.col("doc_id").alias(doc_id), F.col("hash").alias(key))
    place = F.shiftrightunsigned(key, 64 - (MAP_WORDS - 1).bit_length())
    bit = F.expr(f"shiftleft(1L, cast({key} & 63 AS int))")
    columns = [f"`{c}`" for c in docs.columns]
    held = docs.withColumn(key, row_key(*hashed))
    clear = None
    if named.count() < 16 * MAP_WORDS:
        filled = named.groupBy(place.alias(word)).agg(F.bit_or(bit).alias(bits))
        held = held.withColumn(word, place).join(F.broadcast(filled), word, "left")
        hit = F.coalesce(F.col(bits).bitwiseAND(bit), F.lit(0)) != 0
        clear, held = held.where(~hit).select(*columns), held.where(hit).select(*columns, key)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc_id)) & (held[key] == named[key])
    met = held.join(named, same, how).select(*columns)
    return met if clear is None or how == "left_semi" else clear.unionByName(met)


def words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    plain = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(plain, " "), "")


def id_crc(column: Column) -> Column:
    """CRC-32 of an id's decimal text; null for null."""
    return F.crc32(column.cast("string").cast("binary"))


def per_process(name: str, make: Callable[[], Any]) -> Any:
    """``make()``'s value, kept for the life of the Python worker, so that the tasks
    that a worker runs one after the other share loaded files and caches."""
    kept = sys.modules.setdefault("venuegrid_worker", types.ModuleType("venuegrid_worker"))
    if not hasattr(kept, name):
        setattr(kept, name, make())
    return getattr(kept, name)


def give_back() -> None:
    """Hand memory that this process has freed back to the system. Python workers outlive
    their tasks, and what their allocators keep adds to what the next stage takes."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` over a partition's batches, with the worker's freed memory handed back before
    it starts and after it ends."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from run(batches)
        give_back()

    return task


def lean_group(run: Callable):
    """``run`` over the rows of a group, with the worker's freed memory handed back after it."""

    def task(key, rows):
        out = run(key, rows)
        give_back()
        return out

    return task


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
        first, total = 0, 0
        for at, size in enumerate(sizes):
            if total and total + size > most or at - first >= 20_000:
                yield batch.slice(first, at - first)
                first, total = at, 0
            total += size
        yield batch.slice(first)
