"""Fluent queries over a dictionary. Nothing runs until a result is taken."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..errors import InvalidQuery
from ..functions.deinflect import deinflect_word
from ..operators import candidates as C
from ..operators.filters import entry_passes, limit_per_term
from ..schema import MAX_DISTANCE, TERMS, MatchMode, QueryOptions

if TYPE_CHECKING:
    from ..sources.dictionary import Dictionary

ENTRY = ("id", "kanji", "kana", "sense")


#: A single term's candidates up to this number are fetched by their ids; more are joined.
LOOKED_UP = 1000


def literal_keys(keys: DataFrame, term: str, options: QueryOptions) -> DataFrame:
    """The keys one term can meet, by filters that the scan takes: key ranges are sorted, so others are not read."""
    if options.mode == MatchMode.EXACT:
        return keys.filter(F.col("key") == term)
    if options.mode == MatchMode.PREFIX:
        return keys.filter(F.col("key").startswith(term)) if term else keys
    if options.mode == MatchMode.FUZZY:
        return keys.filter(F.col("key_len").between(len(term) - options.max_distance, len(term) + options.max_distance))
    return keys.filter(F.col("key").isin(sorted({term} | {c.word for c in deinflect_word(term)})))


def find(terms: DataFrame, dictionary: "Dictionary", options: QueryOptions, term: str | None = None) -> DataFrame:
    """Candidates of the terms under the mode, before entries are looked at. term: the only one, if it is known."""
    keys = dictionary.keys if term is None else literal_keys(dictionary.keys, term, options)
    if options.mode == MatchMode.EXACT:
        return C.exact(terms, keys)
    if options.mode == MatchMode.PREFIX:
        return C.prefix(terms, keys) if term is None else C.prefix_of(term, keys)
    if options.mode == MatchMode.FUZZY:
        return C.fuzzy(terms, keys, options.max_distance)
    return C.deinflected(terms, keys)


def resolve(found: DataFrame, dictionary: "Dictionary", options: QueryOptions, entries: DataFrame | None = None) -> DataFrame:
    """Candidates joined to their entries, filtered, then limited for each term."""
    rows = found.join(dictionary.entries if entries is None else entries, "seq_id").filter(entry_passes(options))
    entry = F.struct(*ENTRY).alias("entry")
    rows = rows.select("pos", "ord", "seq_id", "match_type", "match_key", "score", "deinflection", entry)
    return limit_per_term(rows, options.limit)


def entries_of(found: DataFrame, dictionary: "Dictionary") -> DataFrame:
    """The entries of a few candidates, by ids that the scan takes; of many, all entries."""
    ids = [r[0] for r in found.select("seq_id").distinct().limit(LOOKED_UP + 1).collect()]
    return dictionary.entries.filter(F.col("seq_id").isin(ids)) if len(ids) <= LOOKED_UP else dictionary.entries


def search(terms: DataFrame, dictionary: "Dictionary", options: QueryOptions) -> DataFrame:
    return resolve(find(terms, dictionary, options), dictionary, options)


class _Builder:
    def __init__(self, dictionary: "Dictionary", options: QueryOptions | None = None):
        self.dictionary, self.options = dictionary, options or QueryOptions()

    def _with(self, **changes):
        self.options = replace(self.options, **changes)
        return self

    def mode(self, mode: MatchMode):
        return self._with(mode=MatchMode(mode))

    def common_only(self, yes: bool = True):
        return self._with(common_only=yes)

    def pos(self, *values: str):
        return self._with(pos=values)

    def misc(self, *values: str):
        return self._with(misc=values)

    def field(self, *values: str):
        return self._with(field=values)

    def dialect(self, *values: str):
        return self._with(dialect=values)

    def max_distance(self, distance: int):
        return self._with(max_distance=max(0, min(distance, MAX_DISTANCE)))

    def limit(self, n: int):
        """At most n rows of each term after the filters; 0: none."""
        if n < 0:
            raise InvalidQuery("a limit can't be negative")
        return self._with(limit=n)


class Query(_Builder):
    """One term. dataframe() is in result order and lazy; execute() collects; iterate() fetches by partition.

    All read only the key ranges that the term can meet; execute() and iterate() first fetch the candidates' ids, if they
    are few, and then only these entries.
    """

    def __init__(self, dictionary: "Dictionary", term: str, options: QueryOptions | None = None):
        super().__init__(dictionary, options)
        self.term = term

    def _found(self) -> DataFrame:
        return find(self.dictionary.terms([self.term]), self.dictionary, self.options, self.term)

    def _ordered(self, found: DataFrame, entries: DataFrame | None = None) -> DataFrame:
        return resolve(found, self.dictionary, self.options, entries).orderBy("ord").drop("pos")

    def dataframe(self) -> DataFrame:
        return self._ordered(self._found())

    def _pruned(self) -> DataFrame:
        found = self._found()
        return self._ordered(found, entries_of(found, self.dictionary))

    def execute(self) -> list[Row]:
        return self._pruned().collect()

    def iterate(self) -> Iterator[Row]:
        return self._pruned().toLocalIterator()


class BatchQuery(_Builder):
    """Many terms, a list or a DataFrame (pos, term). Equal terms keep their own rows."""

    def __init__(self, dictionary: "Dictionary", terms: list[str] | DataFrame, options: QueryOptions | None = None):
        super().__init__(dictionary, options)
        self.terms = terms if isinstance(terms, DataFrame) else dictionary.terms(terms)

    def dataframe(self) -> DataFrame:
        """A row for each result; terms without one have none."""
        return search(self.terms, self.dictionary, self.options)

    def grouped(self) -> DataFrame:
        """A row for each term, in no order: pos, term, results (array in result order; empty if nothing is found)."""
        rows = self.dataframe().select("pos", F.struct("ord", "seq_id", "match_type", "match_key", "score", "deinflection", "entry").alias("r"))
        lists = rows.groupBy("pos").agg(F.array_sort(F.collect_list("r"), lambda a, b: (a["ord"] - b["ord"]).cast("int")).alias("results"))
        kind = dict(lists.dtypes)["results"]
        return self.terms.select("pos", "term").join(lists, "pos", "left").withColumn("results", F.coalesce("results", F.array().cast(kind)))

    def execute(self) -> list[Row]:
        return self.grouped().orderBy("pos").collect()


def terms_frame(spark, terms: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(terms)), TERMS)
