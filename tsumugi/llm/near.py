"""SimHash near-dedup at a Jaccard similarity: wide fingerprints, the byte-position index, counts, exact verification.

The 64-bit form of simhash.py links fingerprints within four bits, which near copies at a similarity of 0.8 seldom are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, nested, written
from .components import component_labels

#: Longs of a fingerprint; each has eight byte positions.
LANES = 4
WORDS = [f"_w{i}" for i in range(LANES)]
#: Count filter: of the 32 positional bytes, so many must be shared; then at most so many bits may differ.
#: At similarity 0.8 a byte is shared with probability 0.27 or more and some 36 bits differ, give or take 6.
SHARED, BITS = 4, 50
#: Fingerprints under one key that are compared pair by pair at once; denser keys give the links of a spanning forest.
DENSE = 24
#: Rows that one group of the index should have, and the most of them that are one block (some 40 bytes each); pairs compared at once.
TOGETHER, BLOCK, AT_ONCE = 8_000, 100_000, 200_000
#: Shingle hashes (8 bytes each) of the texts that are one block where sets are compared.
HASHES = 2_000_000
#: Dropped rows, or nodes whose texts are wanted, up to this number (some 20 bytes each) are broadcast to the filter.
BROADCAST_ROWS = 500_000


#: Added to a shingle's hash before it is mixed, one for each lane.
STEPS = np.array([(0x9E3779B97F4A7C15 * (lane + 1)) % 2**64 for lane in range(LANES)], np.uint64)


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """LANES longs: majority bits over distinct shingle hashes, mixed anew for each lane; no hashes: 0."""
    counts = np.zeros(64 * LANES, np.int64)
    for at in range(0, len(hashes), 255):  # as many as a byte can count
        z = hashes[at : at + 255, None] + STEPS
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
        counts += np.add.reduce(np.unpackbits(z.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(hashes)).view(np.int64)


class _WordHashes(dict):
    """XXH64 of words, remembered; starts anew beyond a million of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 42)
        return h


_HASHES = _WordHashes()


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Distinct hashes of the word shingles, A-Z in lower case: polynomials of the words' hashes modulo 2 ** 64. A shorter
    text is one shingle; without words there is none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    size = min(shingle, len(words))
    if not size:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = out * np.uint64(0x9FB21C651E98DF25) + each[i : n + i]
    return np.unique(out)


def fingerprints(docs: DataFrame, text: str, doc_id: str, shingle: int) -> DataFrame:
    """_id, _node (the text's hash) and WORDS of each row, written to the shared folder."""
    bounded_batches(docs.sparkSession)
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(t).alias("_node"), t.alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [wide_fingerprint(shingle_set(x.as_py(), shingle)) for x in b.column(2)]
            lanes = np.array(fps, np.int64).reshape(-1, LANES)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(lanes[:, i]) for i in range(LANES))], names=["_id", "_node", *WORDS])

    schema = rows.select("_id", "_node").schema
    for w in WORDS:
        schema = schema.add(w, "long")
    return written(rows.mapInArrow(run, schema), "wide-fingerprints")


def index_groups(nodes: DataFrame, total: int) -> DataFrame:
    """nodes, a row for each group of the inverted index that they belong to: _g, and _i <= _j, the blocks compared there.

    A key of the index is three byte positions of one lane with their bytes. Keys are dealt by lane, first position and
    a range of its byte, so a node goes with its whole fingerprint to LANES * 6 groups, not to as many places as it has keys
    (LANES * 56), and whatever keys a group holds are met within it. Groups of more than BLOCK rows are
    dealt by hash into blocks, and each pair of blocks is met by itself.
    """
    ranges = min(256, max(1, -(-total // TOGETHER)))
    byte = lambda w, p: F.shiftrightunsigned(w, 8 * p).bitwiseAND(F.lit(255))
    groups = [F.lit((8 * i + p) << 8) + F.floor(byte(w, p) * ranges / 256) for i, w in enumerate(WORDS) for p in range(6)]
    rows = nodes.withColumn("_g", F.explode(F.array(*[g.cast("int") for g in groups])))
    large = rows.groupBy("_g").agg(F.count("*").alias("_rows")).filter(F.col("_rows") > BLOCK)
    return in_blocks(rows, large.select("_g", F.ceil(F.col("_rows") / BLOCK).cast("int").alias("_blocks")))


def in_blocks(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """rows (_g, _node and more), a row for each pair of blocks, _i <= _j, that a row's block is in; blocks: _g and _blocks, two at
    least, of the groups that have so many, at most LANES * 6 * 256 of them."""
    rows = rows.join(F.broadcast(blocks), "_g", "left")
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("_node"), F.coalesce("_blocks", F.lit(1))).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.coalesce("_blocks", F.lit(1)) - 1), lambda i: F.col("_blocks").isNull() | (i != F.col("_own")))
    rows = rows.withColumn("_with", F.explode(others))
    return rows.withColumns({"_i": F.least("_own", "_with"), "_j": F.greatest("_own", "_with")}).drop("_blocks", "_own", "_with")


def differing_bits(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))) for w in WORDS), F.lit(0))


def shared_bytes(a: str, b: str) -> Column:
    """How many positions hold the same byte: each differing byte is folded into its lowest bit, and those are counted."""
    out = F.lit(8 * LANES)
    for w in WORDS:
        x = F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))
        for step in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
        out = out - F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return out


def compared(lanes: np.ndarray, at: int) -> np.ndarray:
    """Differing bits of each fingerprint to the one at a place; BITS + 1 where a filter fails, and at the place itself."""
    x = lanes ^ lanes[at]
    bits = np.bitwise_count(x).sum(1).astype(np.int64)
    near = np.nonzero(bits <= BITS)[0]
    shared = (x[near].view(np.uint8).reshape(len(near), -1) == 0).sum(1)
    out = np.full(len(lanes), BITS + 1)
    out[near[shared >= SHARED]] = bits[near[shared >= SHARED]]
    out[at] = BITS + 1
    return out


def least_links(lanes: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, place, bits) of the links of a minimum spanning forest over pairs that pass both filters, by Prim's steps."""
    left = np.ones(len(lanes), bool)
    best, via = np.full(len(lanes), BITS + 1), np.zeros(len(lanes), np.int64)
    out, at = [], 0
    for _ in range(len(lanes) - 1):
        left[at] = False
        bits = compared(lanes, at)
        nearer = left & (bits < best)
        best[nearer], via[nearer] = bits[nearer], at
        at = int(np.where(left, best, BITS + 2).argmin())
        if best[at] <= BITS:
            out.append((int(via[at]), at, int(best[at])))
    return out


def close(lanes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows (place, place, bits) of those pairs of places that pass both filters."""
    x = lanes[a] ^ lanes[b]
    bits = np.bitwise_count(x).sum(1, dtype=np.int64)
    ok = np.nonzero(bits <= BITS)[0]
    ok = ok[(x[ok].view(np.uint8).reshape(len(ok), 8 * LANES) == 0).sum(1) >= SHARED]
    return np.stack([a[ok], b[ok], bits[ok]], 1)


def keys(lanes: np.ndarray, group: int) -> Iterator[tuple[tuple[int, int, int, int], np.ndarray, np.ndarray, np.ndarray]]:
    """(lane and three positions, places by key, each key's first among them, each key's size) of the group's triples of positions."""
    lane, p = divmod(group >> 8, 8)
    own = lanes.view(np.uint8).reshape(len(lanes), 8 * LANES)[:, 8 * lane : 8 * lane + 8].astype(np.int32)
    for q, r in combinations(range(p + 1, 8), 2):
        key = own[:, p] << 16 | own[:, q] << 8 | own[:, r]
        order = np.argsort(key, kind="stable")
        first = np.nonzero(np.diff(key[order], prepend=-1))[0]
        yield (lane, p, q, r), order, first, np.diff(first, append=len(order))


def few_together(order: np.ndarray, first: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places under each key of up to DENSE, at most AT_ONCE at a time."""
    after = np.repeat(first + np.where(size <= DENSE, size, 0), size) - np.arange(len(order)) - 1  # rows that follow under the key
    at, step = np.nonzero(after >= 1)[0], 1
    while len(at):
        for some in np.split(at, range(AT_ONCE, len(at), AT_ONCE)):
            yield order[some], order[some + step]
        step += 1
        at = at[after[at] >= step]


def met(lanes: np.ndarray, group: int) -> np.ndarray:
    """Rows (place, place, bits), each pair once, of pairs that meet under a key of the group and pass both filters.

    Keys of up to DENSE fingerprints give all such pairs, denser ones the links of a minimum spanning forest.
    """
    found = [np.zeros((0, 3), np.int64)]
    for _, order, first, size in keys(lanes, group):
        found += [close(lanes, a, b) for a, b in few_together(order, first, size)]
        for k in np.nonzero(size > DENSE)[0].tolist():
            run = order[first[k] : first[k] + size[k]]
            links = np.array(least_links(np.ascontiguousarray(lanes[run])), np.int64).reshape(-1, 3)
            found.append(np.stack([run[links[:, 0]], run[links[:, 1]], links[:, 2]], 1))
        found = [np.concatenate(found)]
        found[0][:, :2].sort(1)
        found = [found[0][np.unique(found[0][:, 0] * len(lanes) + found[0][:, 1], return_index=True)[1]]]
    return found[0]


def across(lanes: np.ndarray, group: int, of: np.ndarray) -> Iterator[np.ndarray]:
    """Rows (place, place, bits) of all pairs of different components (of) that pass both filters and meet in this group first.

    A pair meets first under the first three bytes that it shares in the first lane where it shares three, so it comes once,
    whatever keys and groups it has in common. A piece holds pairs of few places or of one with many: all are never held at once.
    Under a dense key all but the most frequent component's members are compared with every other fingerprint.
    """
    for (lane, _, _, r), order, first, size in keys(lanes, group):

        def here(found: np.ndarray, lane: int = lane, r: int = r) -> np.ndarray:
            x = lanes[found[:, 0]] ^ lanes[found[:, 1]]
            same = x.view(np.uint8).reshape(len(x), LANES, 8) == 0
            return found[(same[:, lane, : r + 1].sum(1) == 3) & (same[:, :lane].sum(2).max(1, initial=0) < 3)]

        for a, b in few_together(order, first, size):
            some = of[a] != of[b]
            yield here(close(lanes, a[some], b[some]))
        for k in np.nonzero(size > DENSE)[0].tolist():
            run = order[first[k] : first[k] + size[k]]
            own, (names, counts) = np.ascontiguousarray(lanes[run]), np.unique(of[run], return_counts=True)
            most = names[counts.argmax()]
            for at in np.nonzero(of[run] != most)[0].tolist() if len(names) > 1 else []:
                bits = compared(own, at)
                j = np.nonzero(bits <= BITS)[0]
                j = j[(of[run[j]] == most) | (of[run[j]] != of[run[at]]) & (j > at)]
                yield here(np.stack([np.full(len(j), run[at]), run[j], bits[j]], 1))


def spanning(links: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The links (place, place, bits) of a minimum spanning forest, and the tree of each of n places, by Boruvka's rounds."""
    links = links[np.argsort(links[:, 2], kind="stable")]  # a link's place breaks ties
    tree, kept = np.arange(n), np.zeros(len(links), bool)
    left = np.arange(len(links))
    while len(left):
        best = np.full(n, len(links))
        for end in (0, 1):
            np.minimum.at(best, tree[links[left, end]], left)
        has = np.nonzero(best < len(links))[0]
        kept[best[has]] = True
        a, b = tree[links[best[has], 0]], tree[links[best[has], 1]]
        parent = np.arange(n)
        parent[has] = np.where(a == has, b, a)
        twins = (parent[parent[has]] == has) & (has < parent[has])  # two that chose the same link: one is the root
        parent[has[twins]] = has[twins]
        while not np.array_equal(parent, up := parent[parent]):
            parent = up
        tree = parent[tree]
        left = left[tree[links[left, 0]] != tree[links[left, 1]]]
    return links[kept], tree


def lanes_of(t: pa.Table) -> np.ndarray:
    return np.stack([t[w].to_numpy() for w in WORDS], 1).view(np.uint64)  # bit counts of signed numbers go by size


def in_groups(nodes: DataFrame, total: int) -> DataFrame:
    """_a < _b, _bits and _alone of links between nodes that meet in the index and pass both filters.

    nodes: _node and WORDS, and perhaps _of. Without _of: the links of each group's minimum spanning forest; _alone says that
    no other pair of the group touches the two. With _of, their components: all pairs across these, whose number
    grows with the square of a large group's size; crossing_links() needs no rows of them.
    """
    by_component = "_of" in nodes.columns
    schema = "_a bigint, _b bigint, _bits int, _alone boolean"

    def run(t: pa.Table) -> pa.Table:
        node, links, alone = t["_node"].to_numpy(), np.zeros((0, 3), np.int64), np.zeros(0, bool)
        if by_component:
            links = np.concatenate([links, *across(lanes_of(t), t["_g"][0].as_py(), t["_of"].to_numpy())])
            alone = np.zeros(len(links), bool)
        elif len(node) > 1:
            links, tree = spanning(met(lanes_of(t), t["_g"][0].as_py()), len(node))
            alone = np.bincount(tree, minlength=len(node))[tree[links[:, 0]]] == 2
        a, b = node[links[:, 0]], node[links[:, 1]]
        return pa.table({"_a": np.minimum(a, b), "_b": np.maximum(a, b), "_bits": pa.array(links[:, 2].astype(np.int32)), "_alone": alone})

    found = index_groups(nodes, total).groupBy("_g", "_i", "_j").applyInArrow(run, schema)
    return found.groupBy("_a", "_b").agg(F.first("_bits").alias("_bits"), F.bool_and("_alone").alias("_alone"))


def crossing_nodes(nodes: DataFrame, total: int) -> DataFrame:
    """_g and _node: the groups of the index where a node first meets one of another component (_of) and both filters pass."""

    def run(t: pa.Table) -> pa.Table:
        group, of, meets = t["_g"][0].as_py(), t["_of"].to_numpy(), np.zeros(len(t), bool)
        if (of != of[0]).any():
            for found in across(lanes_of(t), group, of):
                meets[found[:, :2]] = True
        return pa.table({"_g": pa.array(np.full(meets.sum(), group, np.int32)), "_node": t["_node"].to_numpy()[meets]})

    return index_groups(nodes, total).groupBy("_g", "_i", "_j").applyInArrow(run, "_g int, _node bigint").distinct()


def alike(codes: np.ndarray, starts: np.ndarray, a: int, others: np.ndarray, mark: np.ndarray, similarity: float) -> np.ndarray:
    """Of other places those whose sets have at least this Jaccard similarity to a's, exactly. codes[starts[i] : starts[i + 1]] is
    place i's set; mark: False for every code."""
    sizes, own = np.diff(starts)[others], codes[starts[a] : starts[a + 1]]
    may = np.minimum(sizes, len(own)) >= similarity * np.maximum(sizes, len(own))
    others, sizes = others[may], sizes[may]
    mark[own] = True
    hits = np.concatenate([own[:0], *(codes[starts[i] : starts[i + 1]] for i in others.tolist())])
    upto = np.concatenate([[0], np.cumsum(mark[hits])])
    mark[own] = False
    ends = np.cumsum(sizes)
    both = upto[ends] - upto[ends - sizes]
    every = sizes + len(own) - both
    return others[(every == 0) | (both >= similarity * every)]


def linked(pieces: Iterator[np.ndarray], of: np.ndarray, codes: np.ndarray, starts: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Of pairs of places, in pieces, those that are similar and join two components: at most one fewer than there are
    components. Each pair is verified unless its ends are joined by then."""
    names, of = np.unique(of, return_inverse=True)
    parent, mark, out = np.arange(len(names)), np.zeros(codes.max(initial=-1) + 1, bool), []

    def root(x: np.ndarray) -> np.ndarray:
        top = x
        while not np.array_equal(up := parent[top], top):
            top = up
        parent[x] = top
        return top

    for found in pieces:
        found = found[np.argsort(found[:, 0], kind="stable")]
        for one in np.split(found, np.nonzero(np.diff(found[:, 0]))[0] + 1) if len(found) else []:
            a, others = int(one[0, 0]), one[:, 1]
            others = others[root(of[others]) != root(of[[a]])]
            for b in alike(codes, starts, a, others, mark, similarity).tolist() if len(others) else []:
                x, y = root(of[[a, b]]).tolist()
                if x != y:
                    parent[x] = y
                    out.append((a, b))
    return out


def crossing_links(nodes: DataFrame, total: int, sets: DataFrame, similarity: float) -> DataFrame:
    """_a and _b: similar pairs that join the components (_of) of nodes as all similar pairs in the index would.

    Candidates stay within the group where they first meet and are verified there, next to their sets, so the rows made
    are nodes, at most one for each of a node's groups, and links, fewer than a group's nodes. Groups whose sets
    have more than HASHES hashes are dealt into blocks, which are met in pairs.
    """
    found = written(crossing_nodes(nodes, total), "crossing")
    weights = found.join(sets.select("_node", F.size("_set").alias("_size")), "_node").groupBy("_g").agg(F.ceil(F.sum("_size") / HASHES).cast("int").alias("_blocks"))

    def run(t: pa.Table) -> pa.Table:
        node, of, t = t["_node"].to_numpy(), t["_of"].to_numpy(), t.combine_chunks()
        column = t["_set"].chunk(0)
        starts = column.offsets.to_numpy().astype(np.int64)
        codes = np.unique(column.values.to_numpy()[starts[0] : starts[-1]], return_inverse=True)[1]
        links = linked(across(lanes_of(t), t["_g"][0].as_py(), of), of, codes, starts - starts[0], similarity)
        ends = node[np.array(links, np.int64).reshape(-1, 2)]
        return pa.table({"_a": ends[:, 0], "_b": ends[:, 1]})

    rows = in_blocks(found.join(nodes, "_node").join(sets, "_node"), weights.filter("_blocks > 1"))
    return written(rows.groupBy("_g", "_i", "_j").applyInArrow(run, "_a bigint, _b bigint").distinct(), "links")


def shingle_sets(docs: DataFrame, text: str, shingle: int, pairs: DataFrame) -> DataFrame:
    """_node and _set (its distinct shingle hashes) of the nodes in pairs, written to the shared folder.

    Up to BROADCAST_ROWS nodes are broadcast, so that only their texts are shuffled, not all that there are.
    """
    wanted = written(pairs.select(F.explode(F.array("_a", "_b")).alias("_node")).distinct(), "wanted")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = docs.select(F.xxhash64(t).alias("_node"), t.alias("_text")).join(wanted, "_node", "left_semi").groupBy("_node").agg(F.first("_text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(x.as_py(), shingle).view(np.int64) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["_node", "_set"])

    return written(texts.mapInArrow(run, "_node bigint, _set array<bigint>"), "shingle-sets")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (_a, _b) whose shingle sets have at least this Jaccard similarity, exactly; written to the shared folder."""
    a, b = sets.select(F.col("_node").alias("_a"), F.col("_set").alias("_x")), sets.select(F.col("_node").alias("_b"), F.col("_set").alias("_y"))
    rows = pairs.select("_a", "_b").join(a, "_a").join(b, "_b")
    rows = rows.withColumn("_both", F.size(F.array_intersect("_x", "_y"))).withColumn("_all", F.size("_x") + F.size("_y") - F.col("_both"))
    return written(rows.filter((F.col("_all") == 0) | (F.col("_both") >= F.lit(similarity) * F.col("_all"))).select("_a", "_b"), "links")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (_node, _label) after links (_a, _b) between nodes of different components: only components are linked anew."""
    of = lambda x: labels.select(F.col("_node").alias(x), F.col("_label").alias(f"_of{x}"))
    ends = written(links.join(of("_a"), "_a", "left").join(of("_b"), "_b", "left").select("_a", "_b", F.coalesce("_of_a", "_a").alias("_x"), F.coalesce("_of_b", "_b").alias("_y")), "ends")
    new = written(component_labels(ends.select(F.col("_x").alias("_a"), F.col("_y").alias("_b"))).select(F.col("_node").alias("_old"), F.col("_label").alias("_new")), "merged")
    own = ends.select(F.explode(F.array(F.struct(F.col("_a").alias("_node"), F.col("_x").alias("_label")), F.struct(F.col("_b").alias("_node"), F.col("_y").alias("_label")))).alias("e")).select("e.*")
    every = labels.unionByName(own).distinct()
    return every.join(new, F.col("_label") == F.col("_old"), "left").select("_node", F.coalesce("_new", "_label").alias("_label"))


def similar_groups(docs: DataFrame, text: str, doc_id: str, shingle: int, similarity: float) -> DataFrame:
    """_id, _node and _component (a node's hash) of each row; a written table.

    Candidates are the links of minimum spanning forests, one in each group of the index. 1. Each node's nearest candidate is verified.
    2. Of the others those are that would join different components. 3. Nodes that are in a tree of three or more, where pairs
    were left out, are met again: all pairs across components are verified too, where they meet. So every pair that passes the
    filters is verified or lies within a component, and a large group makes a few rows a node.
    """
    rows = fingerprints(docs, text, doc_id, shingle)
    nodes = written(rows.groupBy("_node").agg(*[F.min(w).alias(w) for w in WORDS]), "nodes")
    total = nodes.count()
    pairs = written(in_groups(nodes, total), "candidates")
    again = pairs.filter("not _alone").select(F.explode(F.array("_a", "_b")).alias("_node")).distinct()
    sets = shingle_sets(docs, text, shingle, pairs.select("_a", "_b"))
    ends = pairs.select("_a", "_b", "_bits", F.explode(F.array("_a", "_b")).alias("_end"))
    nearest = ends.groupBy("_end").agg(F.min(F.struct("_bits", "_a", "_b")).alias("_m")).select("_m._a", "_m._b").distinct()
    nearest = written(nearest, "nearest")
    labels = written(component_labels(verified(nearest, sets, similarity)), "labels")
    name = lambda x: labels.select(F.col("_node").alias(x), F.col("_label").alias(f"_of{x}"))
    rest = pairs.select("_a", "_b").join(nearest, ["_a", "_b"], "left_anti").join(name("_a"), "_a", "left").join(name("_b"), "_b", "left")
    rest = written(rest.filter(F.coalesce("_of_a", "_a") != F.coalesce("_of_b", "_b")).select("_a", "_b"), "rest")
    links = verified(rest, sets, similarity)
    if not links.isEmpty():
        labels = written(merged(labels, links), "labels")
    of = nodes.join(again, "_node", "left_semi").join(name("_node"), "_node", "left")
    of = written(of.select("_node", *WORDS, F.coalesce("_of_node", "_node").alias("_of")), "again")
    if total := of.count():
        links = crossing_links(of, total, sets, similarity)
        if not links.isEmpty():
            labels = written(merged(labels, links), "labels")
    return written(rows.select("_id", "_node").join(labels, "_node", "left").select("_id", "_node", F.coalesce("_label", "_node").alias("_component")), "groups")


def drop_similar(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without near copies: of each group of texts linked at this Jaccard similarity of word shingles, one row stays.

    It is the row with the smallest id (null ids come last), among equal ids that with the smallest text hash; of rows that
    repeat both, any one. Texts of fewer words than a shingle are one shingle; all texts without words, null and
    empty ones among them, are one group. Texts are told apart by a 64-bit hash. Long texts are taken whole. An empty table
    gives an empty table; columns are as they came.

    What is found: pairs at the similarity or above that share a key (three bytes in one lane) and pass the count filter and
    the bits; near 0.8 about nine in ten do, from 0.85 on nearly all. None below the similarity links.
    """
    groups = similar_groups(docs, text, doc_id, shingle, similarity)
    best = groups.groupBy("_component").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_node")).alias("_m"), F.count("*").alias("_n"))
    best = best.filter("_n > 1").select(F.col("_component").alias("_group"), F.col("_m._id").alias("_keep"), F.col("_m._node").alias("_keep_node"))
    met = groups.join(best, F.col("_component") == F.col("_group"))
    stays = F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_node") == F.col("_keep_node"))
    met = written(met.select("_id", "_node", stays.alias("_stays")).groupBy("_id", "_node", "_stays").agg(F.count("*").alias("_times")), "verdicts")
    gone, twice = met.filter("not _stays").select("_id", "_node"), met.filter("_stays and _times > 1").select("_id", "_node")
    t = F.coalesce(F.col(f"_row.`{text}`").cast("string"), F.lit(""))
    rows = docs.select(nested(docs)).withColumns({"_key": F.xxhash64(t), "_own": F.col(f"_row.`{doc_id}`")})
    on = lambda x: (F.col("_key") == F.col("_node")) & F.col("_own").eqNullSafe(F.col("_id"))
    small = lambda x: F.broadcast(x) if met.count() <= BROADCAST_ROWS else x
    out = rows.join(small(gone), on(gone), "left_anti")
    if not twice.isEmpty():
        out = out.join(small(twice), on(twice), "left_anti").unionByName(out.join(small(twice), on(twice), "left_semi").dropDuplicates(["_key", "_own"]))
    return out.select("_row.*")
