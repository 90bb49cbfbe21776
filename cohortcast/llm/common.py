"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir


#: Python derives columns for about so many bytes of rows at a time.
SLICE_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read again: the lineage ends there, and a lost
    executor costs a re-read instead of a recomputation."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unnamed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with names that no operator adds, and these by the own names: whatever columns are called, none clashes, and
    none has to be carried twice."""
    names = {c: f"own_{k}" for k, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of :func:`unnamed` under their own names, and no others."""
    return df.select(*[F.col(n).alias(c) for c, n in names.items()])


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and all else as it is."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The UTF-8 bytes of a text column, null as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.string()).cast(pa.binary()).to_pylist()]


def with_arrow_columns(df: DataFrame, needs: list[str], adds: list[T.StructField],
                       columns: Callable[[Iterator[pa.RecordBatch]], Iterator[list[pa.Array]]],
                       keep: list[str] | None = None) -> DataFrame:
    """``df`` with columns that Python derives batch by batch.

    ``columns`` gets an iterator over the batches of one partition and yields, for each batch, the added columns.
    An input column with the name of an added one is replaced.  ``keep`` names the input columns to carry on (all
    by default); ``needs`` are read but carried on only if kept.
    """
    new = {f.name for f in adds}
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    source = df.select(*dict.fromkeys([*kept, *needs]))
    fields = {f.name: f for f in source.schema.fields}
    schema = T.StructType([fields[c] for c in kept] + adds)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[pa.RecordBatch] = []

        def note() -> Iterator[pa.RecordBatch]:
            for whole in batches:
                rows = max(1, whole.num_rows * SLICE_BYTES // max(1, whole.nbytes))
                for at in range(0, whole.num_rows, rows):
                    seen.append(whole.slice(at, rows))
                    yield seen[-1]

        for added in columns(note()):
            b = seen.pop(0)
            own = [b.column(b.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*own, *added], names=names)
        pa.default_memory_pool().release_unused()  # the worker stays for the next stage, its buffers needn't

    return source.mapInArrow(run, schema)
