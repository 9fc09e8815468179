"""A stream of terms against a dictionary's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.query import search
from ..schema import MatchMode, QueryOptions
from ..sources.dictionary import Dictionary


def exact_stream(terms: DataFrame, dictionary: Dictionary) -> DataFrame:
    """term and seq_id of a stream's terms that are keys: a stateless stream-static join."""
    keys = dictionary.keys.select("key", "seq_id").distinct()
    return terms.join(keys, F.col("term") == F.col("key")).select(*terms.columns, "seq_id")


def lookup_stream(terms: DataFrame, dictionary: Dictionary, sink: Callable[[DataFrame, int], None], options: QueryOptions | None = None, checkpoint: str | None = None) -> StreamingQuery:
    """Any mode, batch by batch: sink gets the results of each micro-batch of (pos, term) and its number."""
    chosen = options or QueryOptions(mode=MatchMode.EXACT)
    writer = terms.writeStream.foreachBatch(lambda batch, n: sink(search(batch, dictionary, chosen), n))
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.start()
