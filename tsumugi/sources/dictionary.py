"""A dictionary: lookup tables opened from a folder, a build or DataFrames."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..errors import DataCorrupted, DataNotFound, DataVersionMismatch
from ..functions.text import tokens
from ..operators import candidates as C
from ..operators.filters import has_reading
from ..plans.build import build_indexes, meta_row, tables_of
from ..plans.query import BatchQuery, Query, entries_of, resolve, terms_frame
from ..schema import DEINFLECTION, FORMAT_VERSION, TABLES, DataVersion, MatchMode, MatchType, QueryOptions, Xref
from .entries import read_source

#: Names the folder of the default dictionary.
DATA_VARIABLE = "TSUMUGI_DATA"


class Dictionary:
    """entries, keys, ids, postings, token_df and meta as DataFrames, and the lookups over them."""

    def __init__(self, tables: dict[str, DataFrame]):
        if missing := sorted(set(TABLES) - set(tables)):
            raise DataNotFound(f"no table {', '.join(missing)}")
        self.entries, self.keys, self.ids = tables["entries"], tables["keys"], tables["ids"]
        self.postings, self.token_df, self.meta = tables["postings"], tables["token_df"], tables["meta"]
        self.spark = self.entries.sparkSession

    @classmethod
    def from_tables(cls, **tables: DataFrame) -> "Dictionary":
        return cls(tables)

    @classmethod
    def from_entries(cls, entries: DataFrame, source_version: str = "", collapse: bool = True) -> "Dictionary":
        """Tables derived lazily, nothing written. For small sources and tests."""
        return cls(tables_of(entries, collapse) | {"meta": meta_row(entries.sparkSession, source_version)})

    @classmethod
    def from_json(cls, spark: SparkSession, path: str, source_version: str = "") -> "Dictionary":
        return cls.from_entries(read_source(spark, path), source_version)

    @classmethod
    def build(cls, spark: SparkSession, source: str, out: str, source_version: str = "", collapse: bool = True) -> "Dictionary":
        build_indexes(spark, source, out, source_version, collapse)
        return cls.open(spark, out)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "Dictionary":
        """Tables of a folder, read lazily and by schema; only meta is looked at."""
        tables = {}
        for name, schema in TABLES.items():
            try:
                tables[name] = spark.read.schema(schema).parquet(f"{path}/{name}")
            except AnalysisException as e:
                if e.getCondition() == "PATH_NOT_FOUND":
                    raise DataNotFound(f"no table {name} in {path}") from e
                raise
        try:
            meta = tables["meta"].collect()
        except Exception as e:
            raise DataCorrupted(f"meta of {path} can't be read") from e
        if len(meta) != 1 or meta[0]["format_version"] is None:
            raise DataCorrupted(f"meta of {path} has {len(meta)} rows")
        if meta[0]["format_version"] != FORMAT_VERSION:
            raise DataVersionMismatch(FORMAT_VERSION, meta[0]["format_version"])
        return cls(tables)

    @classmethod
    def open_default(cls, spark: SparkSession) -> "Dictionary":
        """The packaged tables, else those in TSUMUGI_DATA, else ./dist."""
        packaged = os.path.join(os.path.dirname(os.path.dirname(__file__)), "data")
        for path in (packaged, os.environ.get(DATA_VARIABLE), "dist"):
            if path and (path == os.environ.get(DATA_VARIABLE) or os.path.isdir(path)):
                return cls.open(spark, path)
        raise DataNotFound(f"no packaged tables, no {DATA_VARIABLE}, no ./dist")

    def terms(self, terms: list[str]) -> DataFrame:
        return terms_frame(self.spark, terms)

    # Scans

    def count(self) -> int:
        return self.entries.count()

    def version(self) -> DataVersion:
        return DataVersion(*self.meta.first())

    def scan(self) -> DataFrame:
        return self.entries.orderBy("seq_id")

    def iterate(self) -> Iterator[Row]:
        return self.scan().toLocalIterator()

    def page(self, start: int, count: int) -> DataFrame:
        """Entries start to start + count - 1, as far as there are any, by a pushed-down range."""
        return self.entries.filter((F.col("seq_id") >= start) & (F.col("seq_id") < start + count)).orderBy("seq_id")

    def at(self, seq_id: int) -> DataFrame:
        return self.entries.filter(F.col("seq_id") == seq_id)

    def get(self, seq_id: int) -> Row | None:
        return self.at(seq_id).first()

    def by_ids(self, wanted: DataFrame, entries: DataFrame | None = None) -> DataFrame:
        """pos and id in; pos, seq_id and the entry as an exact match out."""
        return resolve(self._by_ids(wanted, self.ids), self, QueryOptions(), entries)

    def _by_ids(self, wanted: DataFrame, ids: DataFrame) -> DataFrame:
        none = F.lit(None).cast(DEINFLECTION).alias("deinflection")
        return wanted.join(ids, "id").select("pos", F.lit(0).cast("bigint").alias("ord"), "seq_id", F.lit(MatchType.EXACT.value).alias("match_type"), F.col("id").alias("match_key"), F.lit(1.0).alias("score"), none)

    def lookup_by_id(self, entry_id: str) -> Row | None:
        one = self.spark.createDataFrame([(0, entry_id)], "pos bigint, id string")
        found = self._by_ids(one, self.ids.filter(F.col("id") == entry_id))
        return resolve(found, self, QueryOptions(), entries_of(found, self)).first()

    # Lookups

    def lookup(self, term: str) -> Query:
        return Query(self, term)

    def lookup_batch(self, terms: list[str] | DataFrame) -> BatchQuery:
        return BatchQuery(self, terms)

    def lookup_with_options(self, term: str, options: QueryOptions) -> list[Row]:
        return Query(self, term, options).execute()

    def lookup_batch_with_options(self, terms: list[str] | DataFrame, options: QueryOptions) -> list[Row]:
        return BatchQuery(self, terms, options).execute()

    def lookup_exact(self, term: str) -> list[Row]:
        return self.lookup(term).execute()

    def lookup_exact_with_deinflection(self, term: str) -> list[Row]:
        return self.lookup(term).mode(MatchMode.DEINFLECT).execute()

    def lookup_partial(self, prefix: str) -> list[Row]:
        return self.lookup(prefix).mode(MatchMode.PREFIX).execute()

    def gloss_batch(self, queries: DataFrame) -> DataFrame:
        return resolve(C.gloss(queries, self.postings, self.token_df), self, QueryOptions())

    def lookup_gloss(self, query: str) -> list[Row]:
        """Only the lists of the query's tokens are read, and only the entries found."""
        named = F.col("token").isin(self.gloss_tokens(query))
        found = C.gloss(self.terms([query]), self.postings.filter(named), self.token_df.filter(named))
        return resolve(found, self, QueryOptions(), entries_of(found, self)).orderBy("ord").drop("pos").collect()

    def xref_batch(self, xrefs: DataFrame) -> DataFrame:
        """pos, term, reading in. Exact matches of the term among whose kana the reading is, if one is given."""
        return self._with_reading(resolve(C.exact(xrefs.select("pos", "term"), self.keys), self, QueryOptions()), xrefs)

    @staticmethod
    def _with_reading(found: DataFrame, xrefs: DataFrame) -> DataFrame:
        rows = found.join(xrefs.select("pos", "reading"), "pos")
        return rows.withColumn("kana", F.col("entry.kana")).filter(has_reading(F.col("reading"))).drop("kana", "reading")

    def resolve_xref(self, xref: Xref) -> list[Row]:
        one = self.spark.createDataFrame([(0, xref.term, xref.reading)], "pos bigint, term string, reading string")
        found = C.exact(one.select("pos", "term"), self.keys.filter(F.col("key") == xref.term))
        return self._with_reading(resolve(found, self, QueryOptions(), entries_of(found, self)), one).orderBy("ord").drop("pos").collect()

    def gloss_tokens(self, text: str) -> list[str]:
        return self.terms([text]).select(tokens(F.col("term"))).first()[0]
