"""Clashing column names, hot keys, zero weights, rows without ids."""

import hashlib
import math
from collections import Counter

import helpers as H
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tsumugi.llm import common, crf, exact, mixing, quality, tokens, toxicity

OWN = ["_row", "_key", "_id", "_text", "_sha", "_keep_id", "_n", "_kept", "_chain", "_bucket", "_rate", "_copies", "_copy", "_order", "_u", "_source", "_q_t", "_q_votes", "_q_kept", "_digest", "_tokens", "_bytes", "_score", "_lang", "_hot"]


def clashing(spark, data=None):
    df = H.frame(spark, data)
    return df.select("*", *[F.concat(F.lit(f"own {c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in OWN])


def unchanged(out, columns=OWN):
    rows = out.select("doc_id", *columns).collect()
    assert rows
    for r in rows:
        for c in columns:
            assert r[c] == f"own {c} {'-' if r['doc_id'] is None else r['doc_id']}", c


def test_clashing_names(spark, tmp_path):
    df = clashing(spark)
    n, model = df.count(), toxicity.Lexicon({" idiot": 2.0}, ())
    for out in (exact.mark_exact(df), tokens.count_tokens(df, public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "c")), toxicity.score_toxicity(df, model), crf.label_languages(df, crf.train([]))):
        unchanged(out)
        assert out.count() == n
    for out in (exact.drop_exact(df), mixing.mix(df), quality.score_quality(df), quality.keep_good(df)):
        unchanged(out)
    for out in (exact.drop_exact(df), quality.keep_good(df)):
        assert out.columns == df.columns
    marked = exact.mark_exact(df)
    assert marked.filter("_kept_").count() == exact.drop_exact(df).count()


def expected(data):
    groups = Counter((t or "") for _, t, *_ in data)
    best = {}
    for d, t, *_ in data:
        if d is not None:
            best[t or ""] = max(d, best.get(t or "", d))
    return groups, best


@pytest.mark.parametrize("hot_rows", [0, 3, 10_000])
@pytest.mark.parametrize("key_bits", [64, 3])
def test_exact_hot_and_colliding_keys(spark, hot_rows, key_bits):
    """Hot keys don't move, keys of three bits collide: the verdicts are the same."""
    data = H.rows()
    groups, best = expected(data)
    out = exact.mark_exact(H.frame(spark), capacity=4, hot_rows=hot_rows, key_bits=key_bits).collect()
    assert len(out) == len(data)
    for r in out:
        t = r["text"] or ""
        assert (r["_n"], r["_keep_id"], r["_sha"]) == (groups[t], best.get(t), hashlib.sha256(t.encode()).hexdigest())
    assert Counter(r["text"] or "" for r in out if r["_kept"]) == Counter(dict.fromkeys(groups, 1))
    if key_bits == 3 and hot_rows:
        assert max(r["_chain"] for r in out) > 1


def test_exact_needs_its_directory(spark, monkeypatch):
    """Rows sent to other buckets than the directory's are not found to be copies."""
    right = exact.to_buckets
    astray = lambda rows, directory: right(rows, directory).withColumn("_bucket", F.col("_bucket") + F.col("_id"))
    monkeypatch.setattr(exact, "to_buckets", astray)
    df = H.frame(spark)
    assert exact.drop_exact(df).count() > len({r["text"] or "" for r in df.collect()})


def test_repeated_rows_stay_once(spark):
    data = [(7, "same text", "en", "a", 1, True, "", "", "")] * 5 + [(None, "no id", "en", "a", 1, True, "", "", "")] * 3
    for hot in (0, 1000):
        left = exact.drop_exact(H.frame(spark, data), hot_rows=hot).collect()
        assert sorted(r["text"] for r in left) == ["no id", "same text"]


def test_spread_join(spark):
    rows = spark.createDataFrame([(k % 7 if k % 3 else 1, k) for k in range(300)] + [(None, 300), (99, 301)], "k int, v int")
    side = common.written(rows.filter("k is not null and k <> 99").groupBy("k").agg(F.count("*").alias("n")).withColumn("w", F.col("k") * 2), "side")
    for share in (1, 3, 10_000):
        common.HOT_SHARE, kept = share, common.HOT_SHARE
        try:
            got = common.spread_join(rows, side, "k", "n")
            assert got.columns == ["k", "v", "n", "w"]
            assert sorted((r["k"], r["v"], r["w"]) for r in got.collect()) == sorted((r["k"], r["v"], 2 * r["k"]) for r in rows.collect() if r["k"] is not None and r["k"] != 99)
        finally:
            common.HOT_SHARE = kept


def test_mixing_without_weights(spark):
    df = H.frame(spark)
    assert mixing.mix(df, weights={"absent": 1.0}).count() == 0
    assert mixing.mix(df, weights={"a": 0.0, "hot": 0.0}).count() == 0
    assert set(mixing.mix(df, weights={"a": 2.0, "hot": 0.0}).select("source").distinct().toPandas()["source"]) == {"a"}


def test_mixing_a_rate_of_a_million(spark):
    """One row of a rare source among two million: its rate is one million."""
    rate = 1_000_000
    rows = spark.range(2 * rate).selectExpr("id as doc_id", "if(id = 0, 'rare', 'hot') as source")
    u = (int(hashlib.md5(b"17:0").hexdigest()[:13], 16) + 0.5) / 2**52
    s, low = 0.0, rate - 12_000
    for k in range(low, rate + 12_000):
        s += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        if s > u:
            break
    assert abs(mixing.mix(rows).filter("source = 'rare'").count() - k) <= 1  # log-gamma is good to some 1e-9 at this size


def test_rows_without_ids_draw_for_themselves(spark):
    data = [(None, f"text {k}", "en", "a", k, True, "", "", "") for k in range(200)]
    copies = Counter(r["text"] for r in mixing.mix(H.frame(spark, data)).collect())
    assert len(set(copies.values())) > 2 and 140 < sum(copies.values()) < 260
    order = {r["_order"] for r in mixing.mix(H.frame(spark, data)).collect()}
    assert len(order) == sum(copies.values())


def test_a_mix_after_a_union_with_a_constant(spark):
    a = H.frame(spark).withColumn("source", F.lit("x"))
    both = a.unionByName(H.frame(spark).withColumn("source", F.lit("y")))
    assert mixing.mix(both).filter("source = 'x'").count() > 0
