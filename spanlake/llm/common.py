"""What the operators of this subpackage share: inputs, the shared folder, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters that are neither blank, tab, nor a line or page break.
WORD = r"[^\x20\x09-\x0D]+"

#: A key with more than one in so many rows is joined by broadcast: there are at most so many of these.
HOT = 1000

_own_folder: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session without one (tests) gets a folder of this process; on
    a cluster its lack is an error, as executors don't share such a folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="spark-"))
    return f"file://{_own_folder[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/spanlake-{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str = "table", compression: str = "zstd") -> DataFrame:
    """Cut the lineage: write df to the shared folder once and read it from there."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet, whatever its letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def joined_by(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows joined to table, which has one row per key and, as `count`, how many of the `total` rows have it.

    Keys that hold more than one in HOT rows, HOT at most, are broadcast, so that no common key fills a task.
    """
    hot = F.col(count) * HOT > total
    many, few = table.filter(hot).drop(count), table.filter(~hot).drop(count)
    rest = rows.join(F.broadcast(many.select(key)), key, "left_anti")
    return rows.join(F.broadcast(many), key).unionByName(rest.join(few, key))


def word_count(text: Column) -> Column:
    """Words of a text as long; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 4 is 2: rows that no model learns from. Null ids count as ''."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4) == 2


def by_bytes(batch: pa.RecordBatch, column: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most about so many bytes in a text or binary column; a longer value makes a slice of its own: it is never cut."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def pieces(batches: Iterator[pa.RecordBatch], text: str, chars: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """`by_bytes` of Arrow batches, each slice with its texts (null: '')."""
    for batch in batches:
        for part in by_bytes(batch, text, chars):
            yield part, [x or "" for x in part.column(part.schema.get_field_index(text)).to_pylist()]


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
