"""Small helpers the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, ensure_checkpoint_dir

#: A word: a maximal run without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Spark's setting that deletes a query's shuffle files as soon as it has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder under the checkpoint folder, which driver and executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write once as a compressed table in the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffles behind the table are deleted with the end of the write, not when the driver next collects garbage.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession, purpose)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that do not clash with a column of `df` (names differ without regard to case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def utf8(text: Column) -> Column:
    """UTF-8 bytes of a text; a null is empty."""
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def word_count(text: Column) -> Column:
    """Number of words; a null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc32_of_id(key: Column) -> Column:
    """CRC-32 of the id as text (a null counts as the empty text): the fold of a row."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8"))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: T.StructType | str) -> DataFrame:
    """One Arrow batch in, one (or none) out."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := fn(b)) is not None:
                yield out
    return df.mapInArrow(each, schema)


def small_batches(spark: SparkSession, rows: int) -> None:
    """Rows in an Arrow batch for Python stages over whole texts, which may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def released(fn: Callable) -> Callable:
    """`fn` over Arrow batches; when a task ends, its Python worker, which is used again, gives free memory back to the system."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
            pool.release_unused()
    return run


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) with the smallest node reachable, for the nodes that have an edge.

    Rounds of "smallest label of my neighbours, then that label's label" over an
    edge table that is re-labelled each round; a round at least halves the
    unfinished labels, copies of edges fold, and minimums combine map-side.
    """
    from ..operators.components import connected_components

    return connected_components(nodes, edges)


__all__ = ["WORD", "components", "crc32_of_id", "cut_lineage", "map_arrow", "shared_folder", "small_batches", "spare", "stored", "table",
           "utf8", "word_count"]
