"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word pattern ``[^\x20\x09-\x0D]+``.
WHITE = "\t\n\x0b\x0c\r "
#: Lower-cases A-Z in UTF-8 bytes and leaves every other byte alone.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares, from ``spark.checkpoint.dir``.

    Where the setting is absent a local session gets a temporary folder; a
    cluster without it is an error, since a machine-local folder would lose
    data there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not path:
        path = context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="plumbline-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(path)
    return path.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Removes a path that ``scratch`` gave."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release() -> None:
    """Gives freed memory back to the system; for the end of a task in a Python worker, which lives on.

    An executor's idle workers otherwise keep what their largest task once held.
    """
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


#: Rows and bytes of text that one Arrow batch carries to a Python worker at most (or one row).
TEXT_ROWS = 500
TEXT_BYTES = 4 << 20


def text_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of texts small, so that a worker holds a few megabytes at a time.

    Sets the session's ``spark.sql.execution.arrow.maxRecordsPerBatch`` and
    ``maxBytesPerBatch`` where they are larger.
    """
    for name, limit in (("Records", TEXT_ROWS), ("Bytes", TEXT_BYTES)):
        name = f"spark.sql.execution.arrow.max{name}PerBatch"
        if not 0 < _bytes(spark.conf.get(name)) <= limit:
            spark.conf.set(name, limit)


def _bytes(setting: str) -> int:
    """A number, also with the unit that Spark's size settings may carry."""
    units = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}
    digits = setting.strip().rstrip("bBkKmMgG")
    return int(digits) * units[setting.strip()[len(digits) :].lower()]


def shielded(docs: DataFrame, keep: tuple[str, ...] = ("text",)) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``docs`` with all columns but ``keep`` renamed by their place, and what gives the old names back, with further columns that are asked for.

    Names that an operator uses then never clash with the table's own.
    """
    names = [c if c in keep else f"own_{i}" for i, c in enumerate(docs.columns)]
    own = list(docs.columns)
    return docs.toDF(*names), lambda df, also=(): df.select(*[F.col(n).alias(c) for n, c in zip(names, own, strict=True)], *also)


#: Bits of the bitmap that ``sifted`` broadcasts: 8 MB in pieces of 4 KB.
SIFT_BITS = 1 << 26


def sifted(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``df`` with ``sifted``: false only where ``key``, a hash of 64 bits, is none of ``keys``; nothing is shuffled but ``keys``.

    The bitmap has a bit for each value of the lowest 26 bits and is the same
    size for any input.  k keys make a share of 1 - exp(-k / 2**26) of all other
    rows pass as well (4 % for 2.6 million), so an exact join has to follow.
    """
    slot = F.pmod(F.col(key), F.lit(SIFT_BITS))
    places = keys.select(F.bitmap_bucket_number(slot).alias("_bucket"), F.bitmap_bit_position(slot).alias("_place")).repartition("_bucket")
    bits = places.groupBy("_bucket").agg(F.bitmap_construct_agg("_place").alias("_bits"))
    place = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    hit = F.get(F.array(*(F.getbit(byte, F.lit(i)) for i in range(8))), (place % 8).cast("int")) == 1
    joined = df.withColumn("_bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(bits), "_bucket", "left")
    return joined.select(*df.columns, F.coalesce(hit, F.lit(False)).alias("sifted"))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def hold_out(doc_id: str = "doc_id") -> Column:
    """True for the rows whose labels no model may learn from."""
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def sampled_ids(labels: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` rows of ``labels``, the first in the order of a hash of doc_id.

    The order is fixed, so the sample is the same for every run and layout.
    """
    return labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
