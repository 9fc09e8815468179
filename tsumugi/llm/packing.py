"""Best-fit packing by patterns of document lengths, fitted by non-negative least squares."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HOT_SHARE, bounded_batches, table, written
from .tokens import encoded

#: Rows of one length ranked by one task; more lengths or rows only make more tasks.
RANKED = 5_000
#: Tasks that number the copies of a piece that has very many.
DEALS = 64


def piece_table(docs: DataFrame, tokenizer: str, text: str, doc_id: str, limit: int, with_ids: bool) -> DataFrame:
    """_id, _piece, _start, _length, _crc (and _ids): each document's ids and a closing 0, cut at limit."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, data in enumerate(encoded(b.column(1).to_pylist(), tokenizer)):
                data += b"\0\0\0\0"
                for k, at in enumerate(range(0, len(data), 4 * limit)):
                    part = data[at : at + 4 * limit]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, np.uint32).astype(np.int32))
            columns = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["_id", "_piece", "_start", "_length", "_crc"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("_ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, f"_id {kind}, _piece int, _start bigint, _length bigint, _crc bigint" + ", _ids array<int>" * with_ids)


def few_document_patterns(lengths: np.ndarray, limit: int, coarse: int = 24) -> list[tuple[int, ...]]:
    """Ascending lengths that fill a sequence exactly: all pairs, and all triples that start in coarse.

    Triples start at one of `coarse` of the lengths up to a third of the limit, evenly spread, and go
    on with any length; so there are at most limit/2 + coarse * limit/2 patterns, whatever the input.
    """
    have = set(lengths.tolist())
    ordered = sorted(have)
    out = [(a, limit - a) for a in ordered if 2 * a <= limit and limit - a in have]
    small = [a for a in ordered if 3 * a <= limit]
    for a in [small[i] for i in sorted({round(k * (len(small) - 1) / max(1, coarse - 1)) for k in range(coarse)})] if small else []:
        rest = limit - a
        out += [(a, b, rest - b) for b in ordered if a <= b and 2 * b <= rest and rest - b in have]
    return out


def fit_repeats(patterns: list[tuple[int, ...]], histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares: x >= 0 that makes the patterns' lengths add up to the histogram.

    Accelerated projected gradient on the sparse pattern matrix. Errors count by length, as longer
    documents are harder to place.
    """
    if not patterns:
        return np.zeros(0)
    cols = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    rows = np.array([a for p in patterns for a in p])
    weight = np.sqrt(np.arange(len(histogram)) / (len(histogram) - 1) + 0.1)
    into = lambda x: np.bincount(rows, weights=x[cols], minlength=len(histogram)) * weight
    back = lambda r: np.bincount(cols, weights=(r * weight)[rows], minlength=len(patterns))
    v = np.ones(len(patterns))
    for _ in range(20):
        v = back(into(v))
        v /= np.linalg.norm(v)
    step = 1 / max(1e-12, np.linalg.norm(back(into(v))) * 1.05)
    target = histogram * weight
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * back(into(y) - target))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def pack_histogram(histogram: dict[int, int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) that use up the histogram exactly.

    Full pieces stand alone. Fitted pattern counts are rounded down, then raised where documents are
    left. The residual is packed best-fit decreasing on counts: the longest open length meets the
    space it fits best, for as many sequences at once as both sides allow, so the work depends on the
    number of lengths, not on the number of documents.
    """
    left = np.zeros(limit + 1, np.int64)
    for a, n in histogram.items():
        left[a] = n
    plans: list[tuple[tuple[int, ...], int]] = []
    if left[limit]:
        plans.append(((limit,), int(left[limit])))
        left[limit] = 0
    patterns = few_document_patterns(np.nonzero(left)[0], limit)
    x = fit_repeats(patterns, left.astype(float))
    order = np.argsort(-x, kind="stable")
    for up in (0.0, 0.5):
        for k in order.tolist():
            need = Counter(patterns[k])
            most = min(int(left[a]) // n for a, n in need.items())
            n = min(most, int(x[k] + up) if up == 0.0 else max(0, round(x[k]) - int(x[k])))
            if n > 0:
                plans.append((patterns[k], n))
                for a, m in need.items():
                    left[a] -= m * n
    spaces: dict[int, Counter] = {}  # space left: contents -> sequences
    order_of: list[int] = []  # the keys of spaces, ascending

    def put(contents: tuple[int, ...], n: int) -> None:
        space = limit - sum(contents)
        if space not in spaces:
            spaces[space] = Counter()
            insort(order_of, space)
        spaces[space][contents] += n

    for a in np.nonzero(left)[0][::-1].tolist():
        n = int(left[a])
        while n:
            at = bisect_left(order_of, a)
            if at == len(order_of):
                each = limit // a  # none fits: open new ones, filled with this length alone
                if n // each:
                    put((a,) * each, n // each)
                if n % each:
                    put((a,) * (n % each), 1)
                break
            space = order_of[at]
            contents, count = next(iter(spaces[space].items()))
            fits = min(space // a, n)
            take = min(count, n // fits)
            spaces[space][contents] -= take
            if not spaces[space][contents]:
                del spaces[space][contents]
            if not spaces[space]:
                del spaces[space]
                order_of.pop(at)
            put(contents + (a,) * fits, take)
            n -= take * fits
    plans += [(contents, n) for of in spaces.values() for contents, n in of.items()]
    return plans


def slots(plans: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, ranks a sequence, first sequence, offset of the first) of each length in each plan."""
    used: Counter = Counter()
    out, base = [], 0
    for contents, n in plans:
        offset = 0
        for a, k in Counter(contents).items():
            out.append((a, used[a], k * n, k, base, offset))
            used[a] += k * n
            offset += k * a
        base += n
    return out


def ranked(pieces: DataFrame) -> DataFrame:
    """pieces with _rank: 0, 1, ... within each length; pieces must be a written table, with a unique _serial.

    Neighbouring ranks share a sequence where a pattern has a length more than once, so copies (equal
    _id, _piece, _crc) must not be neighbours: all first copies are ranked, then all second ones, each time in the
    order of a hash. A length, or the copies of one piece, may be a third of all rows: rows are dealt
    by hash into groups of about RANKED, and the copies of hot pieces (at most HOT_SHARE) into DEALS, each numbered by itself.
    """
    total = pieces.count()
    deal = max(1, -(-total // RANKED))
    counts = pieces.groupBy("_id", "_piece", "_crc").agg(F.count("*").alias("_n"))
    hot = written(counts.filter((F.col("_n") > RANKED) & (F.col("_n") * HOT_SHARE > total)).select(F.col("_id").alias("_i"), F.col("_piece").alias("_p"), F.col("_crc").alias("_c")), "pieces")
    met = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_piece") == F.col("_p")) & (F.col("_crc") == F.col("_c"))
    salt = F.when(F.col("_c").isNull(), 0).otherwise(F.pmod(F.xxhash64("_serial"), F.lit(DEALS)))
    rows = pieces.join(F.broadcast(hot), met, "left").withColumn("_salt", salt)
    twin = F.row_number().over(Window.partitionBy("_id", "_piece", "_crc", "_salt").orderBy("_serial"))
    rows = rows.withColumn("_level", (twin - 1) * DEALS + F.col("_salt")).withColumn("_h", F.xxhash64("_id", "_piece", "_crc", F.lit(9))).withColumn("_group", F.pmod("_h", F.lit(deal)))
    sizes = rows.groupBy("_length", "_level", "_group").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("_length").orderBy("_level", "_group")) - F.col("_n")).drop("_n")
    own = F.row_number().over(Window.partitionBy("_length", "_level", "_group").orderBy("_h", "_serial"))
    out = rows.withColumn("_own", own).join(before, ["_length", "_level", "_group"]).withColumn("_rank", F.col("_before") + F.col("_own") - 1)
    return out.select(*pieces.columns, "_rank")


def pack(docs: DataFrame, tokenizer: str, limit: int = 2048, text: str = "text", doc_id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """_id, _piece, _start, _length, _crc, _sequence, _offset (and _ids): where each piece goes.

    Documents are encoded, closed by id 0 and cut where longer than limit; the table of pieces is
    written. Only the histogram of lengths (limit rows at most) goes to the driver, where
    pack_histogram() plans sequences as (pattern, repeats). A piece finds its place by its rank among
    the pieces of its length, in a broadcast table of the plans' slots; that table has a few rows for
    each pattern, at most some ten thousand for 2048 tokens. Copies of a document are ranked apart, so that they
    meet in a sequence only where a length has too few other documents.

    Null and empty texts are the single id 0. Null ids are packed like others; rows that repeat an id
    are packed one by one. An empty table gives an empty table; other columns are not read. A long text is encoded
    whole and by itself.
    """
    spark = docs.sparkSession
    pieces = written(piece_table(docs, tokenizer, text, doc_id, limit, with_ids).withColumn("_serial", F.monotonically_increasing_id()), "pieces")
    histogram = {r["_length"]: r["count"] for r in pieces.groupBy("_length").count().collect()}
    rows = [(a, lo, lo + n, k, base, offset) for a, lo, n, k, base, offset in slots(pack_histogram(histogram, limit))]
    places = spark.createDataFrame(rows, "_l bigint, _lo bigint, _hi bigint, _k bigint, _base bigint, _at bigint")
    # A length's slots in order: a piece finds its own among them, one row in and one row out.
    by_length = places.groupBy("_l").agg(F.sort_array(F.collect_list(F.struct("_lo", "_hi", "_k", "_base", "_at"))).alias("_slots"))
    out = ranked(pieces).join(F.broadcast(by_length), F.col("_length") == F.col("_l"))
    out = out.withColumn("_slot", F.element_at(F.filter("_slots", lambda s: (s["_lo"] <= F.col("_rank")) & (F.col("_rank") < s["_hi"])), 1))
    q = F.col("_rank") - F.col("_slot._lo")
    out = out.withColumn("_sequence", F.col("_slot._base") + F.floor(q / F.col("_slot._k")))
    out = out.withColumn("_offset", F.col("_slot._at") + (q % F.col("_slot._k")) * F.col("_length"))
    return out.drop("_serial").select(*[c for c in pieces.columns if c != "_serial"], "_sequence", "_offset")


def packed_columns(df: DataFrame) -> DataFrame:
    return df.select(F.col("_id").alias("doc_id"), F.col("_piece").alias("piece"), F.col("_start").alias("start"), F.col("_length").alias("length"), F.col("_crc").alias("ids_crc32"), F.col("_sequence").cast("long").alias("sequence_id"), F.col("_offset").cast("long").alias("offset"))


def op9_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces by pack(); nulls, empty and long texts, ties, repeated rows and empty tables as said there."""
    import public_tokenizers

    return packed_columns(pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
