"""Entry predicates and the per-term limit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.entries import is_common
from ..schema import QueryOptions


def any_contains(values: Column, wanted: tuple[str, ...]) -> Column:
    """Some value contains some wanted text, by case; nothing wanted passes."""
    if not wanted:
        return F.lit(True)
    one = lambda v: reduce(Column.__or__, [v.contains(w) for w in wanted])
    return F.coalesce(F.exists(values, one), F.lit(False))


def sense_matches(options: QueryOptions, sense: str = "sense") -> Column:
    """One and the same sense passes every filter that is set."""
    lists = {"partOfSpeech": options.pos, "misc": options.misc, "field": options.field, "dialect": options.dialect}
    active = {k: v for k, v in lists.items() if v}
    if not active:
        return F.lit(True)
    return F.coalesce(F.exists(sense, lambda s: reduce(Column.__and__, [any_contains(s[k], v) for k, v in active.items()])), F.lit(False))


def entry_passes(options: QueryOptions) -> Column:
    return (is_common() if options.common_only else F.lit(True)) & sense_matches(options)


def has_reading(reading: Column, kana: str = "kana") -> Column:
    """A null reading asks for nothing."""
    return reading.isNull() | F.coalesce(F.exists(kana, lambda k: k["text"] == reading), F.lit(False))


def limit_per_term(rows: DataFrame, limit: int | None, term: str = "pos", order: str = "ord") -> DataFrame:
    """The first rows of each term in its order; Spark stops a group at the limit before the shuffle too."""
    if limit is None:
        return rows
    rank = F.row_number().over(Window.partitionBy(term).orderBy(order))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= limit).drop("_rank")
