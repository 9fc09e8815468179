"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_names, nested, table, written

#: Up to so many sources (some 300 bytes each) and distribution function entries, the rates are broadcast; beyond, they are joined by shuffle.
BROADCAST_SOURCES = 20_000
BROADCAST_ENTRIES = 2_000_000
#: Bits of the hash that make the uniform number; exact in a double.
UNIFORM_BITS = 52


def uniform(*parts: Column) -> Column:
    """In (0, 1), from the first 13 hex digits of the md5 of the parts joined by ':'."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, UNIFORM_BITS // 4)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << UNIFORM_BITS)


def source_rates(docs: DataFrame, source: str, weights: dict | None) -> DataFrame:
    """_source, _rate, _low and _cdf of each source.

    _rate is the mean number of copies that brings the source's documents to its share of the
    input's size. weights: share by source, normalised over the sources present; a source not
    named gets none, and so do all where none that is present has a weight. None: equal shares. Null is a source of its own.
    _cdf holds the Poisson distribution function at _low, _low + 1, ..., where a double can tell it from 0 and 1.
    Its terms are summed up as logarithms of their ratios and scaled by the largest, as exp(-_rate) is 0
    for rates of some hundreds.
    """
    counts = docs.groupBy(F.col(source).alias("_source")).agg(F.count("*").alias("_n"))
    weight = F.lit(1.0)
    if weights is not None:
        weight = F.lit(0.0)
        for k, v in weights.items():
            weight = F.when(F.col("_source").eqNullSafe(F.lit(k)), float(v)).otherwise(weight)
    total = counts.select(F.sum("_n").alias("_all"), F.sum(weight).alias("_weights"))
    rate = F.try_divide(F.col("_all") * F.try_divide(weight, F.col("_weights")), F.col("_n"))
    rated = counts.join(F.broadcast(total)).withColumn("_rate", F.coalesce(rate, F.lit(0.0)))  # total is one row
    spread = "(12 * sqrt(_rate) + 24)"
    rated = rated.withColumn("_low", F.expr(f"cast(greatest(0, floor(_rate - {spread})) as bigint)"))
    terms = rated.select("_source", "_rate", "_low", F.explode(F.expr(f"sequence(_low, cast(ceil(_rate + {spread}) as bigint))")).alias("_k"))
    own = Window.partitionBy("_source")
    up = own.orderBy("_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ratio = F.when(F.col("_k") == F.col("_low"), 0.0).when(F.col("_rate") > 0, F.log(F.col("_rate") / F.col("_k"))).otherwise(float("-inf"))
    terms = terms.withColumn("_log", F.sum(ratio).over(up))
    terms = terms.withColumn("_p", F.exp(F.col("_log") - F.max("_log").over(own)))
    terms = terms.withColumn("_c", F.sum("_p").over(up) / F.sum("_p").over(own))
    cdf = F.transform(F.array_sort(F.collect_list(F.struct("_k", "_c"))), lambda x: x["_c"])
    return terms.groupBy("_source", "_rate", "_low").agg(cdf.alias("_cdf"))


def mix(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", weights: dict | None = None, seed: int = 17) -> DataFrame:
    """docs with each row repeated as often as its hash-seeded Poisson number says, shuffled globally.

    Adds _rate, _copies (the row's number), _copy (0, 1, ...) and _order (the shuffle key); where docs has a column
    of such a name, the added one has an underscore more. The number depends on seed and id alone: a rerun or a
    lost executor gives the same copies. Rows that repeat an id draw the same number. A row without an id draws by
    a hash of all its columns, so such rows draw each for themselves unless they are equal. Null sources are one
    source. Sources without weight, and all sources if no source present has any, get no copies. Empty tables give empty tables.

    The rates (a row per source) are broadcast up to BROADCAST_SOURCES and BROADCAST_ENTRIES, so a hot source moves
    nowhere before the shuffle; more are joined by shuffle, where AQE splits hot keys. The copies go to
    equal ranges of _order, a hash of seed, id and copy number, and are sorted there; as the hash is
    uniform, the ranges are known without a look at the rows.
    """
    spark, added = docs.sparkSession, free_names(docs, "_rate", "_copies", "_copy", "_order")
    rates = written(source_rates(docs, source, weights), "rates")
    sources, entries = rates.agg(F.count("*"), F.coalesce(F.sum(F.size("_cdf")), F.lit(0))).first()
    if sources <= BROADCAST_SOURCES and entries <= BROADCAST_ENTRIES:
        rates = F.broadcast(rates)
    rows = docs.select(nested(docs)).join(rates, F.col(f"_row.`{source}`").eqNullSafe(F.col("_source")))
    rows = rows.withColumn("_key", F.coalesce(F.col(f"_row.`{doc_id}`").cast("string"), F.concat(F.lit("null:"), F.xxhash64("_row").cast("string"))))
    rows = rows.withColumn("_u", uniform(F.lit(str(seed)), F.col("_key")))
    rows = rows.withColumn("_copies", F.col("_low") + F.expr("size(filter(_cdf, c -> c <= _u))"))
    rows = rows.filter("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
    rows = rows.withColumn("_order", uniform(F.lit(str(seed)), F.col("_key"), F.col("_copy").cast("string")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("_row", "_rate", "_copies", "_copy", "_order").repartitionById(parts, F.floor(F.col("_order") * parts).cast("int"))
    return rows.sortWithinPartitions("_order").select("_row.*", *[F.col(a).alias(b) for a, b in zip(("_rate", "_copies", "_copy", "_order"), added, strict=True)])


def op3_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All copies of all documents by mix(), equal shares; nulls, ties, repeated rows and empty tables as said there."""
    df = mix(table(spark, sf_dir, "documents"))
    return df.select("doc_id", "text", "lang", "source", "n_chars", F.col("_copies").alias("copies"), F.col("_copy").alias("copy"), F.round("_rate", 9).alias("rate"), F.col("_order").alias("shuffle_key"))


OP3_SQL = """
WITH sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (
  SELECT source, n, (SELECT sum(n) FROM sizes) * (1.0::DOUBLE / (SELECT count(*) FROM sizes)) / n AS rate FROM sizes),
terms AS (
  SELECT source, rate, k, CASE WHEN rate = 0 THEN (k = 0)::INT::DOUBLE ELSE exp(k * ln(rate) - rate - lgamma(k + 1)) END AS p
  FROM rates, range(0, CAST(ceil(rate + 12 * sqrt(rate) + 24) AS BIGINT) + 1) AS t(k)),
cdf AS (SELECT source, rate, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
drawn AS (
  SELECT d.*, (('0x' || substr(md5('17:' || d.doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u FROM documents d),
counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, any_value(r.rate) AS rate, count(*) FILTER (c.c <= d.u) AS copies
  FROM drawn d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source JOIN cdf c ON c.source IS NOT DISTINCT FROM r.source
  GROUP BY d.doc_id, d.text, d.lang, d.source, d.n_chars)
SELECT doc_id, text, lang, source, n_chars, copies, copy, round(rate, 9) AS rate,
       (('0x' || substr(md5('17:' || doc_id || ':' || copy), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS shuffle_key
FROM counted, range(0, copies) AS t(copy)
"""
