"""Shared helpers of the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space and U+0009 to U+000D.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: A key is hot if it has more than one HOT_SHARE-th of all rows; so there are at most HOT_SHARE hot keys.
HOT_SHARE = 10_000
#: Text handled at once in a Python worker, in characters; a longer text is handled by itself.
BATCH_CHARS = 4_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor see.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset and Spark runs in this
    one process (tests, a laptop) a folder of this machine is taken, and set, so that all later calls agree on it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = os.path.join(tempfile.gettempdir(), "tsumugi-shared")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one."""
    return f"{shared_dir(spark)}/tsumugi/{spark.sparkContext.applicationId}"


#: Paths of the scratch tables that this process made, in order.
MADE: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    MADE.append(f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return MADE[-1]


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_scratch(spark: SparkSession) -> None:
    """Deletes this application's tables; results that have not been written elsewhere are gone with them."""
    drop_path(spark, scratch_dir(spark))


def drop_made(spark: SparkSession, first: int, end: int) -> None:
    """Deletes the scratch tables made from the first to before the end (places in MADE); nothing lazy may still read them."""
    for path in MADE[first:end]:
        drop_path(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and outlives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def nested(docs: DataFrame, name: str = "_row") -> Column:
    """All columns of docs as one struct, so that a caller's columns can't clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name)


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """names, each with as many underscores more as it takes until docs has no column of that name."""
    taken, out = {c.lower() for c in docs.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def spread_join(rows: DataFrame, side: DataFrame, key: str, n: str, total: int | None = None) -> DataFrame:
    """rows joined to side on the column `key` of both, unique in side; side's column n says how many rows have the key.

    Rows of hot keys would all meet in one task. Hot keys, at most HOT_SHARE by their definition, are
    broadcast; their rows then go to the shuffle under scattered keys that meet nothing. side must be a
    written table, as it is read three times. total: the sum of n, if it is known. Null keys meet nothing.
    """
    total = (side.agg(F.sum(n)).first()[0] or 0) if total is None else total
    values = [c for c in side.columns if c != key]
    is_hot = F.col(n) * HOT_SHARE > total
    hot = side.filter(is_hot).select(F.col(key).alias("_hot_key"), F.struct(*values).alias("_hot"))
    cold = side.filter(~is_hot).select(F.col(key).alias("_cold_key"), F.lit(0).alias("_cold_salt"), F.struct(*values).alias("_cold"))
    out = rows.join(F.broadcast(hot), rows[key] == F.col("_hot_key"), "left")
    salt = F.when(F.col("_hot_key").isNull(), 0).otherwise(1 + (F.rand(7) * 1_000_000_000).cast("int"))
    out = out.withColumn("_salt", salt).join(cold, (F.col(key) == F.col("_cold_key")) & (F.col("_salt") == F.col("_cold_salt")), "left")
    found = F.coalesce("_hot", "_cold")
    return out.filter(F.col("_hot_key").isNotNull() | F.col("_cold_key").isNotNull()).select(*rows.columns, *[found[c].alias(c) for c in values])


def bounded_batches(spark: SparkSession, rows: int = 512) -> None:
    """Hold Arrow batches to a few hundred documents and some ten megabytes, unless the session sets a count itself.

    Texts can be long, and a batch lies in memory on both sides of the Python pipe.
    """
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(value))


def by_size(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts of about BATCH_CHARS characters together."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= BATCH_CHARS):
            size += len(texts[end] or "")
            end += 1
        yield at, end
        at = end


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than space and U+0009 to U+000D; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus
