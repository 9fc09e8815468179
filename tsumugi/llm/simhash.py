"""SimHash near-dedup by a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, spread_join, table, written
from .components import component_labels

BYTES = 8
#: Fingerprints under one key that are joined pair by pair; denser keys go to linked_blocks().
DENSE = 24
#: Fingerprints of a dense key compared at once.
BLOCK = 4096


def covering_triples() -> list[tuple[int, ...]]:
    """Twenty of the 56 triples of byte positions; any four positions hold at least one of them.

    Turan's construction: three classes; triples within a class, or two of a class and one of the next.
    """
    classes = ((0, 1, 2), (3, 4, 5), (6, 7))
    out = [t for c in classes for t in combinations(c, 3)]
    for own, following in zip(classes, classes[1:] + classes[:1], strict=True):
        out += [tuple(sorted((*two, one))) for two in combinations(own, 2) for one in following]
    return out


def shingle_hashes(text: str | None, shingle: int = 4, seed: int = 42) -> list[int]:
    """XXH64 of all word shingles, repeats included; of the whole sequence if it is shorter; none without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not words:
        return []
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    if n < 1:
        return [xxhash.xxh64_intdigest(joined, seed)]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip((ends - lengths)[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)]


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """64 majority bits over the hashes of all word shingles, repeats included; no words: 0."""
    hashes = shingle_hashes(text, shingle, seed)
    counts, given = np.zeros(64, np.int64), np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(hashes), 255):  # as many as a byte can count
        counts += np.add.reduce(np.unpackbits(given[at : at + 255], axis=1), axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str, doc_id: str, shingle: int) -> DataFrame:
    """_id and _fp (as a signed long) of each row, written to the shared folder."""
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text"))
    schema = rows.schema["_id"].dataType.simpleString()
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["_id", "_fp"])

    return written(rows.mapInArrow(run, f"_id {schema}, _fp bigint"), "fingerprints")


def byte_at(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255))


def shared_bytes(a: Column, b: Column) -> Column:
    """How many of the eight positions hold the same byte."""
    return sum((((byte_at(a, p) == byte_at(b, p)).cast("int")) for p in range(BYTES)), F.lit(0))


def postings(fps: DataFrame) -> DataFrame:
    """_key and _fp: the inverted index. A key is three positions of covering_triples() with their bytes."""
    keys = []
    for k, triple in enumerate(covering_triples()):
        key = F.lit(k).cast("long")
        for p in triple:
            key = F.shiftleft(key, 8).bitwiseOR(byte_at(F.col("_fp"), p))
        keys.append(key)
    return fps.select("_fp", F.explode(F.array(*keys)).alias("_key"))


def forest(fps: np.ndarray, others: np.ndarray | None, distance: int) -> list[tuple[int, int]]:
    """Links that connect whatever is connected within distance, at most one fewer than the fingerprints.

    Compares all of a block (or of two blocks) in numpy and keeps the links that join two trees.
    """
    both = fps if others is None else np.concatenate([fps, others])
    parent = np.arange(len(both))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i in range(len(fps)):
        rest = both[i + 1 :] if others is None else others
        base = i + 1 if others is None else len(fps)
        for j in np.nonzero(np.bitwise_count(rest ^ fps[i]) <= distance)[0].tolist():
            if (a := root(i)) != (b := root(base + j)):
                parent[a] = b
                out.append((int(fps[i]), int(both[base + j])))
    return out


def linked_blocks(dense: DataFrame, distance: int) -> DataFrame:
    """_a and _b: links that connect the fingerprints of each dense key as all its links would.

    A key's fingerprints are dealt by hash into blocks of about BLOCK, and each pair of blocks is a
    group of its own, so no task holds more than two blocks, however many share the key.
    """
    sizes = dense.groupBy("_key").agg(F.count("*").alias("_n")).withColumn("_blocks", F.ceil(F.col("_n") / BLOCK))
    rows = dense.join(sizes, "_key").withColumn("_own", F.pmod(F.xxhash64("_fp"), F.col("_blocks")))
    rows = rows.withColumn("_with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    rows = rows.select("_key", "_fp", F.least("_own", "_with").alias("_i"), F.greatest("_own", "_with").alias("_j"), "_own")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        fps, own = t["_fp"].to_numpy().view(np.uint64), t["_own"].to_numpy()
        _, _, i, j = *([None] * 2), key[1].as_py(), key[2].as_py()
        links = forest(np.sort(fps), None, distance) if i == j else forest(np.sort(fps[own == i]), np.sort(fps[own == j]), distance)
        signed = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"_a": signed[:, 0], "_b": signed[:, 1]})

    return rows.groupBy("_key", "_i", "_j").applyInArrow(run, "_a bigint, _b bigint")


def tallied(sparse: DataFrame, distance: int) -> DataFrame:
    """_a < _b that meet under a key and share at least 8 - distance positional bytes: the count filter.

    Three shared bytes bring a pair under a key; distance differing bits leave at least 8 - distance bytes alone, so
    pairs that share fewer are retained no further.
    """
    a, b = sparse.select("_key", F.col("_fp").alias("_a")), sparse.select(F.col("_key").alias("_key2"), F.col("_fp").alias("_b"))
    met = a.join(b, (F.col("_key") == F.col("_key2")) & (F.col("_a") < F.col("_b")))
    return met.withColumn("_shared", shared_bytes(F.col("_a"), F.col("_b"))).filter(F.col("_shared") >= BYTES - distance).select("_a", "_b")


def near_links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """_a < _b or a spanning subset of them: distinct fingerprints at distance or fewer bits.

    distance bits touch at most distance of the eight bytes, so a pair shares at least 8 - distance
    positional bytes; four guaranteed matches meet under one of the twenty triple keys. Pairs under a
    key are tallied, and those retained by the count filter are verified by their bits. Keys with more
    than DENSE fingerprints never make pairs in Spark; linked_blocks()
    compares them and keeps the links of a spanning forest, which connects the same fingerprints.
    """
    if not 0 <= distance <= 4:
        raise ValueError("the index guarantees distances from 0 to 4")
    index = postings(fps)
    sizes = index.groupBy("_key").agg(F.count("*").alias("_n")).filter("_n > 1")
    shared = written(index.join(sizes, "_key"), "shared-keys")
    close = F.bit_count(F.col("_a").bitwiseXOR(F.col("_b"))) <= distance
    pairs = tallied(shared.filter(F.col("_n") <= DENSE), distance).filter(close)
    dense = shared.filter(F.col("_n") > DENSE).select("_key", "_fp")
    return pairs.unionByName(linked_blocks(dense, distance)).distinct()


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 4, distance: int = 4) -> DataFrame:
    """_id, _fp and _component of each row: the smallest id reachable over links of the fingerprints.

    Equal fingerprints are linked like any other; texts without words have fingerprint 0 and link
    with it. Null texts count as empty. Null ids rank last: a component of only null ids has a null
    _component. Repeated rows share one result. Empty tables give empty tables; other columns are
    not read. Copies collapse to one fingerprint before anything is compared.
    """
    rows = fingerprints(docs, text, doc_id, shingle)
    nodes = written(rows.groupBy("_fp").agg(F.min("_id").alias("_first"), F.count("*").alias("_rows")), "nodes")
    labels = component_labels(near_links(nodes.select("_fp"), distance))
    joined = written(nodes.join(labels, nodes["_fp"] == labels["_node"], "left").withColumn("_root", F.coalesce("_label", "_fp")), "roots")
    firsts = written(joined.groupBy("_root").agg(F.min("_first").alias("_component"), F.count("*").alias("_fps")), "components")
    member = written(spread_join(joined.select("_fp", "_rows", "_root"), firsts, "_root", "_fps").select("_fp", "_rows", "_component"), "members")
    return spread_join(rows, member, "_fp", "_rows").select("_id", "_fp", "_component")


def op5_simhash_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's fingerprint and component by near_groups(); nulls, empty texts, ties, repeated rows and empty tables as said there."""
    df = near_groups(table(spark, sf_dir, "documents"))
    return df.select(F.col("_id").alias("doc_id"), F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), F.col("_component").alias("component_id"))
