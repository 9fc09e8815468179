"""Candidates of a batch of terms: index probes as equi-joins.

terms has pos (bigint, unique) and term; keys is the key table. Every function returns CANDIDATE
columns: pos, ord (order within pos), seq_id, match_type, match_key, score, deinflection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.deinflect import deinflect
from ..functions.text import tokens
from ..schema import DEFAULT_DISTANCE, DEINFLECTION, MAX_DISTANCE, MatchType


def _none() -> Column:
    return F.lit(None).cast(DEINFLECTION).alias("deinflection")


def _shape(df: DataFrame, order: list[Column], match_type: Column | str, match_key: Column, score: Column, deinflection: Column | None = None) -> DataFrame:
    kind = F.lit(match_type) if isinstance(match_type, str) else match_type
    rows = df.select("pos", "seq_id", kind.alias("match_type"), match_key.alias("match_key"), score.alias("score"), _none() if deinflection is None else deinflection.alias("deinflection"), *[o.alias(f"_o{k}") for k, o in enumerate(order)])
    ord_ = F.row_number().over(Window.partitionBy("pos").orderBy(*[f"_o{k}" for k in range(len(order))])).cast("bigint") - 1
    return rows.select("pos", ord_.alias("ord"), "seq_id", "match_type", "match_key", "score", "deinflection")


def exact_pairs(terms: DataFrame, keys: DataFrame) -> DataFrame:
    """pos, term and seq_id of every key equal to the term, an entry once per term."""
    return terms.join(keys.select("key", "seq_id"), F.col("term") == F.col("key")).select("pos", "term", "seq_id").distinct()


def exact(terms: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys equal to the term in any script, as written; by seq_id, score 1."""
    return _shape(exact_pairs(terms, keys), [F.col("seq_id")], MatchType.EXACT.value, F.col("term"), F.lit(1.0))


def best_per_entry(pairs: DataFrame) -> DataFrame:
    """Of an entry's keys the one with the highest score; ties: kana, kanji, romaji, then the least key.

    One aggregate without a window: the greatest score is the least negated one.
    """
    first = F.min(F.struct((-F.col("score")).alias("s"), "script_rank", "key", "kind")).alias("m")
    return pairs.groupBy("pos", "seq_id").agg(first).select("pos", "seq_id", "m.key", "m.kind", (-F.col("m.s")).alias("score"))


def prefix_pairs(terms: DataFrame, keys: DataFrame) -> DataFrame:
    """Every key with every term it starts with, by equality of the key's own prefixes with the terms.

    A key is cut at the lengths that terms have (the driver learns these lengths alone), so the join's
    output is the result; no theta join. The empty term matches every key.
    """
    lengths = sorted(r[0] for r in terms.select(F.char_length("term")).distinct().collect() if r[0] is not None)
    cuts = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.col("key_len"))
    cut = keys.withColumn("_cut", F.explode(cuts)).withColumn("_prefix", F.substring("key", F.lit(1), F.col("_cut")))
    return terms.join(cut, F.col("term") == F.col("_prefix")).select("pos", "term", "key", "script_rank", "seq_id")


def _prefixed(pairs: DataFrame) -> DataFrame:
    same = F.col("key") == F.col("term")
    kind = F.when(same, MatchType.EXACT.value).otherwise(MatchType.PREFIX.value)
    pairs = pairs.withColumns({"kind": kind, "score": F.when(same, 1.0).otherwise(0.5)})
    return _shape(best_per_entry(pairs), [-F.col("score"), F.col("seq_id")], F.col("kind"), F.col("key"), F.col("score"))


def prefix(terms: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys that start with the term: the term itself Exact, 1.0, others Prefix, 0.5; an entry once."""
    return _prefixed(prefix_pairs(terms, keys))


def prefix_of(term: str, keys: DataFrame) -> DataFrame:
    """The same for one term, as pos 0, and the keys that start with it: no join and no job beforehand."""
    return _prefixed(keys.select(F.lit(0).cast("bigint").alias("pos"), F.lit(term).alias("term"), "key", "script_rank", "seq_id"))


def _segments(length: Column, parts: int) -> list[tuple[Column, Column]]:
    """(start from 0, length) of the even parts of a text; the later parts are the longer ones."""
    short, long_ones = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    return [((short * k + F.greatest(F.lit(0), F.lit(k - parts) + long_ones)).cast("int"), F.when(k >= F.lit(parts) - long_ones, short + 1).otherwise(short).cast("int")) for k in range(parts)]


def _pieces(part: int, at: Column, size: Column, distance: int) -> Column:
    """(want_part, want_piece) of the term's substrings that segment `part` of a key could be."""
    low = F.greatest(F.lit(0), at - distance)
    starts = F.sequence(low, F.greatest(low, F.least(at + distance, F.col("term_len") - size)))
    cut = F.transform(starts, lambda s: F.substring(F.col("term"), s + 1, size))
    fit = F.array_distinct(F.filter(cut, lambda p: F.char_length(p) == size))
    return F.transform(fit, lambda p: F.struct(F.lit(part).alias("want_part"), p.alias("want_piece")))


def fuzzy_pairs(terms: DataFrame, keys: DataFrame, distance: int) -> DataFrame:
    """Every key within the Levenshtein distance of a term, each pair once.

    A key is cut into distance + 1 even segments. Edits can't touch them all: one segment stands
    unchanged in the term, shifted by at most distance. So keys list (length, segment number,
    segment), terms list all that could match, and the two meet by equality; the distance is then
    computed for these few pairs, with its threshold. A segment may be empty for keys no longer
    than distance; every term of such a length is then a candidate, and nearly all are results.

    Each distinct term is looked up once. Both joins sort and merge: Spark's estimate of the probes leaves out that a
    term makes some dozen of them, so it would send millions of them through the driver as a broadcast.
    """
    parts = distance + 1
    own = F.array(*[F.struct(F.lit(k).alias("part"), F.substring(F.col("key"), at + 1, n).alias("piece")) for k, (at, n) in enumerate(_segments(F.col("key_len"), parts))])
    index = keys.select("key", "key_len", "script_rank", "seq_id", F.inline(own))
    sized = terms.select("term").distinct().withColumn("term_len", F.char_length("term"))
    around = F.sequence(F.greatest(F.lit(0), F.col("term_len") - distance), F.col("term_len") + distance)
    sized = sized.withColumn("want_len", F.explode(around))
    probes = [_pieces(k, at, n, distance) for k, (at, n) in enumerate(_segments(F.col("want_len"), parts))]
    asked = sized.select("term", "want_len", F.inline(F.concat(*probes))).hint("merge")
    meet = (F.col("key_len") == F.col("want_len")) & (F.col("part") == F.col("want_part")) & (F.col("piece") == F.col("want_piece"))
    near = F.levenshtein("key", "term", distance) >= 0
    found = asked.join(index, meet & near).select("term", "key", "key_len", "script_rank", "seq_id").distinct()
    return terms.select("pos", "term").hint("merge").join(found, "term").select("pos", "term", "key", "key_len", "script_rank", "seq_id")


def fuzzy(terms: DataFrame, keys: DataFrame, distance: int = DEFAULT_DISTANCE) -> DataFrame:
    """Keys within the distance (at most MAX_DISTANCE): the term itself Exact, 1.0; others Fuzzy.

    A fuzzy score falls with the difference of lengths alone.
    """
    distance = max(0, min(distance, MAX_DISTANCE))
    same = F.col("key") == F.col("term")
    a, b = F.greatest(F.col("key_len"), F.lit(1)).cast("double"), F.greatest(F.char_length("term"), F.lit(1)).cast("double")
    score = F.greatest(F.lit(0.5) - F.abs(a - b) / (a + b) * F.lit(0.2), F.lit(0.1))
    kind = F.when(same, MatchType.EXACT.value).otherwise(MatchType.FUZZY.value)
    pairs = fuzzy_pairs(terms, keys, distance).withColumns({"kind": kind, "score": F.when(same, 1.0).otherwise(score)})
    return _shape(best_per_entry(pairs), [-F.col("score"), F.col("seq_id")], F.col("kind"), F.col("key"), F.col("score"))


def deinflected(terms: DataFrame, keys: DataFrame) -> DataFrame:
    """Exact matches; for terms without any, matches of their candidate dictionary forms.

    An entry counts at its first form in order of discovery. Each distinct term is undone once.
    """
    found = exact_pairs(terms, keys)
    direct = _shape(found, [F.col("seq_id")], MatchType.EXACT.value, F.col("term"), F.lit(1.0))
    missing = terms.join(found.select("pos").distinct(), "pos", "left_anti")
    forms = missing.select("term").distinct().select("term", F.posexplode(deinflect(F.col("term"))).alias("step", "c"))
    forms = forms.select("term", "step", F.col("c.word").alias("form"), F.flatten("c.reason_chains").alias("rules"))
    hits = forms.join(keys.select("key", "seq_id"), F.col("form") == F.col("key"))
    first = hits.groupBy("term", "seq_id").agg(F.min(F.struct("step", "form", "rules")).alias("f"))
    rows = missing.join(first, "term")
    info = F.struct(F.col("term").alias("original_form"), F.col("f.form").alias("base_form"), F.col("f.rules").alias("rules"))
    undone = _shape(rows, [F.col("f.step"), F.col("seq_id")], MatchType.DEINFLECTED.value, F.col("f.form"), F.lit(0.75), info)
    return direct.unionByName(undone)


def gloss(queries: DataFrame, postings: DataFrame, token_df: DataFrame) -> DataFrame:
    """Entries whose glosses hold every token of a query (terms are the queries here).

    The list of the query's rarest token gives the candidates; its other tokens are then looked up for these entries
    alone, so a frequent token's list is never emitted. A query with a token that no entry has finds nothing. The score rises
    with rare tokens, 0.6 at most; it counts the postings of all the query's tokens.
    """
    asked = queries.select("pos", tokens(F.col("term")).alias("_ts")).filter(F.size("_ts") > 0)
    wanted = asked.select("pos", "_ts", F.explode("_ts").alias("token"))
    named = wanted.select("token").distinct()
    counted = wanted.join(token_df.join(named, "token", "left_semi"), "token")
    per = counted.groupBy("pos").agg(F.sum("df").alias("_df"), F.count("*").alias("_known"), F.min(F.struct("df", "token")).alias("_m"), F.first("_ts").alias("_ts"))
    per = per.filter(F.col("_known") == F.size("_ts")).select("pos", "_ts", "_df", F.col("_m.token").alias("_rarest"))
    lists = postings.join(named, "token", "left_semi")
    first = per.join(lists, F.col("_rarest") == F.col("token")).select("pos", "_ts", "_df", "_rarest", "seq_id")
    alone = first.filter(F.size("_ts") == 1).select("pos", "_ts", "_df", "seq_id")
    probes = first.filter(F.size("_ts") > 1).select("pos", "_ts", "_df", "seq_id", F.explode(F.array_remove("_ts", F.col("_rarest"))).alias("token"))
    hits = probes.join(lists, ["token", "seq_id"]).groupBy("pos", "seq_id").agg(F.count("*").alias("_n"), F.first("_ts").alias("_ts"), F.first("_df").alias("_df"))
    rows = alone.unionByName(hits.filter(F.col("_n") == F.size("_ts") - 1).drop("_n"))
    score = F.least(F.lit(0.6), F.lit(0.3) + F.size("_ts").cast("double") / F.greatest(F.col("_df"), F.lit(1)).cast("double"))
    return _shape(rows, [F.col("seq_id")], MatchType.GLOSS.value, F.array_join("_ts", " "), score)
