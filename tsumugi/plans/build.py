"""Building the lookup tables from entries."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kana import romaji_key
from ..functions.text import tokens
from ..schema import FORMAT_VERSION, META, SCRIPTS
from ..sources.entries import read_source


def surface_forms(entries: DataFrame) -> DataFrame:
    """script and key of every kanji and kana form, and its romaji key, before any collapse."""
    written = [entries.select(F.lit(s).alias("script"), F.explode(F.col(s)["text"]).alias("key"), "seq_id") for s in ("kana", "kanji")]
    both = written[0].unionByName(written[1])
    spelled = both.select("key", "seq_id").distinct().select(F.lit("romaji").alias("script"), romaji_key(F.col("key")).alias("key"), "seq_id")
    return both.unionByName(spelled).filter(F.col("key").isNotNull())


def collapse_keys(forms: DataFrame, collapse: bool = True) -> DataFrame:
    """The key table: of the entries that share script and key, the one with the least seq_id.

    collapse=False keeps them all. Combined map-side, so a key shared by any number of entries
    arrives as one row per task.
    """
    rows = forms.groupBy("script", "key").agg(F.min("seq_id").alias("seq_id")) if collapse else forms.select("script", "key", "seq_id").distinct()
    rank = F.array_position(F.array(*map(F.lit, SCRIPTS)), F.col("script")).cast("int") - 1
    return rows.select(rank.alias("script_rank"), "script", "key", F.char_length("key").alias("key_len"), "seq_id")


def ids(entries: DataFrame) -> DataFrame:
    return entries.groupBy("id").agg(F.min("seq_id").alias("seq_id"))


def gloss_texts(entries: DataFrame, language: str = "eng") -> DataFrame:
    every = entries.select("seq_id", F.explode("sense").alias("s")).select("seq_id", F.explode("s.gloss").alias("g"))
    return every.filter(F.col("g.lang") == language).select("seq_id", F.col("g.text").alias("text"))


def postings(texts: DataFrame, seq_id: str = "seq_id", text: str = "text") -> DataFrame:
    """token and seq_id, each pair once."""
    return texts.select(F.explode(tokens(F.col(text))).alias("token"), F.col(seq_id).alias("seq_id")).distinct()


def token_df(posting_rows: DataFrame) -> DataFrame:
    return posting_rows.groupBy("token").agg(F.count("*").alias("df"))


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """In key ranges and sorted, so that row-group statistics prune equality and prefix scans."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def tables_of(entries: DataFrame, collapse: bool = True) -> dict[str, DataFrame]:
    """All lookup tables but meta, lazily."""
    posting_rows = postings(gloss_texts(entries))
    return {"entries": entries, "keys": collapse_keys(surface_forms(entries), collapse), "ids": ids(entries), "postings": posting_rows, "token_df": token_df(posting_rows)}


def meta_row(spark: SparkSession, source_version: str, generated_at: str | None = None) -> DataFrame:
    at = generated_at or datetime.now(UTC).isoformat(timespec="seconds")
    return spark.createDataFrame([(FORMAT_VERSION, source_version, at)], META)


SORT_KEYS: dict[str, tuple[str, ...]] = {"entries": ("seq_id",), "keys": ("key",), "ids": ("id",), "postings": ("token", "seq_id"), "token_df": ("token",)}


def write_tables(entries: DataFrame, out: str, source_version: str, collapse: bool = True) -> None:
    """Entries first; everything else is derived from the table so written. meta comes last: a folder with
    meta is whole."""
    spark = entries.sparkSession
    by_key(entries, "seq_id").write.mode("overwrite").parquet(f"{out}/entries")
    for name, df in tables_of(spark.read.parquet(f"{out}/entries"), collapse).items():
        if name == "token_df":
            df = token_df(spark.read.parquet(f"{out}/postings"))
        if name != "entries":
            by_key(df, *SORT_KEYS[name]).write.mode("overwrite").parquet(f"{out}/{name}")
    meta_row(spark, source_version).coalesce(1).write.mode("overwrite").parquet(f"{out}/meta")


def build_indexes(spark: SparkSession, source: str, out: str, source_version: str = "", collapse: bool = True) -> None:
    """The whole build: source JSON to a folder of tables."""
    write_tables(read_source(spark, source), out, source_version, collapse)
