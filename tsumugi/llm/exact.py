"""Exact dedup by an extendible-hash index kept as Parquet files in the shared folder."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HOT_SHARE, free_names, nested, table, written

#: Keys a bucket may hold before it splits, and buckets at most; where these are not enough, a bucket may hold more.
CAPACITY, BUCKETS = 256, 50_000
#: Rows that share a key before it can count as hot.
HOT_ROWS = 1000


def hash_key(text: Column, bits: int = 64) -> Column:
    """xxHash64 of the text, its leading bits only (fewer than 64 make keys collide, for tests)."""
    key = F.xxhash64(text)
    return key if bits == 64 else F.shiftleft(F.shiftrightunsigned(key, 64 - bits), 64 - bits)


def prefix(key: str, depth: str | int) -> Column:
    """The first depth bits of a key (SQL expressions)."""
    return F.expr(f"case when {depth} = 0 then 0L else shiftrightunsigned({key}, cast(64 - {depth} as int)) end")


def build_directory(keys: DataFrame, capacity: int) -> DataFrame:
    """_depth and _prefix of each bucket; keys: a written table of distinct keys, _key.

    The directory starts as one bucket and doubles: an overfull bucket is split by one more bit. One pass
    over the keys counts them under prefixes some doublings deep; summed up over shorter prefixes that
    says of each cell at each depth whether it is overfull. A bucket is a cell that is not, in one that
    is. Keys under prefixes still overfull go on to the next pass. Nothing but their number and the number of
    keys reaches the driver. Buckets cut the key space: each key has exactly one.
    """
    left, base, closed = keys.select("_key"), 0, []
    while True:
        n = left.count()
        deep = min(64, base + max(0, math.ceil(math.log2(max(1, n) / capacity))) + 3)
        cells = written(left.groupBy(prefix("_key", deep).alias("_p")).agg(F.count("*").alias("_n")), "cells")
        depths = F.explode(F.sequence(F.lit(base), F.lit(deep))).alias("_depth")
        sums = cells.select("_p", "_n", depths).select("_depth", F.expr(f"case when _depth = 0 then 0L else shiftrightunsigned(_p, {deep} - _depth) end").alias("_prefix"), "_n")
        sums = sums.groupBy("_depth", "_prefix").agg(F.sum("_n").alias("_n"))
        above = sums.select((F.col("_depth") + 1).alias("_depth"), F.col("_prefix").alias("_up"), F.col("_n").alias("_above"))
        split = sums.withColumn("_up", F.expr("shiftrightunsigned(_prefix, 1)")).join(above, ["_depth", "_up"], "left")
        opened = written(split.filter((F.col("_depth") == base) | (F.col("_above") > capacity)), "directory")
        fits = (F.col("_n") <= capacity) | (F.col("_depth") == 64)
        closed.append(opened.filter(fits).select("_depth", "_prefix"))
        over = opened.filter(~fits & (F.col("_depth") == deep)).select("_prefix")
        if over.isEmpty():
            return reduce(DataFrame.unionByName, closed)
        left = written(left.withColumn("_prefix", prefix("_key", deep)).join(over, "_prefix", "left_semi").select("_key"), "open-keys")
        base = deep


def to_buckets(rows: DataFrame, directory: DataFrame) -> DataFrame:
    """rows with _bucket, the least key of the bucket that the directory gives _key (null: none).

    The directory has some BUCKETS rows at most, so it is broadcast; cells are met by the shortest depth in use.
    """
    directory = directory.withColumn("_bucket", F.expr("case when _depth = 0 then 0L else shiftleft(_prefix, cast(64 - _depth as int)) end"))
    least = directory.agg(F.min("_depth")).first()[0] or 0
    top = F.expr(f"case when _depth = 0 or {least} = 0 then 0L else shiftrightunsigned(_prefix, _depth - {least}) end")
    cells = directory.groupBy(top.alias("_top")).agg(F.collect_list(F.struct("_depth", "_prefix", "_bucket")).alias("_cells"))
    met = rows.join(F.broadcast(cells), prefix("_key", least) == F.col("_top"), "left")
    own = "filter(_cells, c -> c._prefix = case when c._depth = 0 then 0L else shiftrightunsigned(_key, cast(64 - c._depth as int)) end)"
    return met.withColumn("_bucket", F.expr(f"get({own}, 0)._bucket")).drop("_top", "_cells")


def hot_keys(rows: DataFrame, counts: DataFrame, total: int, text: str, hot_rows: int) -> DataFrame | None:
    """_hot, _keep_id, _n of the keys of more than hot_rows rows and one HOT_SHARE-th of all rows; None: there are none.

    At most HOT_SHARE keys, so they are broadcast. Their copies are compared byte by byte where they lie: each
    task sends one row for each of its different texts. Only keys of a single text, whose row with the
    largest id is there once, are given; any other goes to its owner task like the rest.
    """
    hot = counts.filter((F.col("_n") > hot_rows) & (F.col("_n") * HOT_SHARE > total)).select("_key")
    if hot.isEmpty():
        return None
    own = rows.join(F.broadcast(hot), "_key").select("_key", F.col(text).alias("_text"), "_id")
    chains = own.groupBy("_key", "_text").agg(F.max("_id").alias("_keep_id"), F.count("*").alias("_n"))
    one = chains.groupBy("_key").agg(F.count("*").alias("_texts"), F.first("_keep_id").alias("_keep_id"), F.first("_n").alias("_n"))
    one = written(one.filter("_texts = 1 and _keep_id is not null").select(F.col("_key").alias("_hot"), "_keep_id", "_n"), "hot-keys")
    best = own.join(F.broadcast(one), (F.col("_key") == F.col("_hot")) & (F.col("_id") == F.col("_keep_id")))
    once = best.groupBy(F.col("_hot").alias("_once")).agg(F.count("*").alias("_times")).filter("_times = 1")
    return written(one.join(F.broadcast(once), F.col("_hot") == F.col("_once"), "left_semi"), "hot-keys")


def mark_exact(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, key_bits: int = 64, hot_rows: int = HOT_ROWS) -> DataFrame:
    """docs with _sha, _keep_id, _n, _kept and _chain: of equal texts, the row with the largest id stays.

    1. Keys (64-bit hashes of the texts) are counted, and the directory of buckets built; both are
    files in the shared folder. 2. Each row finds its bucket in the directory and goes, once, with its text,
    to the bucket's owner task, which may own several buckets. 3. There the texts of a key are sorted and each is compared with
    the one before, byte by byte: equal ones are one chain entry, texts whose keys collide are
    further entries (_chain: 1, 2, ... along the key). Rows of hot keys, if their texts are all the
    same, don't move at all (see hot_keys()).

    Null and empty texts are one group. Null ids rank below all others. Of rows that repeat both text
    and the largest id, exactly one stays, by a hash of all columns. An empty table gives an
    empty table. Columns of docs pass through; where docs has a column named like an added one, the added
    one has an underscore more.
    """
    added = free_names(docs, "_sha", "_keep_id", "_n", "_kept", "_chain")
    t = F.coalesce(F.col(f"_row.`{text}`").cast("string"), F.lit(""))
    rows = docs.select(nested(docs)).withColumns({"_key": hash_key(t, key_bits), "_id": F.col(f"_row.`{doc_id}`")})
    counts = written(rows.groupBy("_key").agg(F.count("*").alias("_n")), "exact-keys")
    n, total = counts.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()
    directory = build_directory(counts, max(capacity, -(-n // BUCKETS)))
    hot = hot_keys(rows.withColumn("_text", t), counts, total, "_text", hot_rows)
    cold = rows if hot is None else rows.join(F.broadcast(hot.select("_hot")), F.col("_key") == F.col("_hot"), "left_anti")
    owned = to_buckets(cold, directory).repartition("_bucket").withColumn("_text", t)
    along = Window.partitionBy("_bucket", "_key").orderBy("_text")
    fresh = F.coalesce(F.lag("_text").over(along) != F.col("_text"), F.lit(True)).cast("int")
    owned = owned.withColumn("_fresh", fresh).withColumn("_chain", F.sum("_fresh").over(along))
    same = Window.partitionBy("_bucket", "_key", "_chain")
    first = F.row_number().over(same.orderBy(F.col("_id").desc_nulls_last(), F.xxhash64("_row")))
    marked = owned.select("_row", F.sha2("_text", 256).alias("_sha"), F.max("_id").over(same).alias("_keep_id"), F.count("*").over(same).alias("_n"), (first == 1).alias("_kept"), "_chain")
    if hot is not None:
        near = rows.join(F.broadcast(hot), F.col("_key") == F.col("_hot"))
        marked = marked.unionByName(near.select("_row", F.sha2(t, 256).alias("_sha"), "_keep_id", "_n", F.col("_id").eqNullSafe(F.col("_keep_id")).alias("_kept"), F.lit(1).cast("bigint").alias("_chain")))
    own = ("_sha", "_keep_id", "_n", "_kept", "_chain")
    return marked.select("_row.*", *[F.col(a).alias(b) for a, b in zip(own, added, strict=True)])


def drop_exact(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows that mark_exact keeps, one of each text, with the columns they came with; texts are shuffled once."""
    kept = free_names(docs, "_kept")[0]
    return mark_exact(docs, text, doc_id, **options).filter(F.col(kept)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's verdict by mark_exact(); nulls, empty texts, ties, repeated rows and empty tables as said there."""
    df = mark_exact(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", F.col("_keep_id").alias("keep_id"), F.col("_n").alias("group_size"), F.col("_kept").alias("kept"), F.col("_sha").alias("text_sha256"))


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
