import pytest
from dictionary_words import WORDS

from tsumugi import errors
from tsumugi.schema import FORMAT_VERSION, MatchMode, QueryOptions, Xref
from tsumugi.sources.dictionary import Dictionary

IDS = [w["id"] for w in WORDS]


def found(rows):
    return [r["entry"]["id"] for r in rows]


def test_scans(dictionary):
    assert dictionary.count() == len(WORDS)
    assert [r["id"] for r in dictionary.scan().collect()] == IDS == [r["id"] for r in dictionary.iterate()]
    assert [r["seq_id"] for r in dictionary.page(17, 50).collect()] == [17, 18]
    assert dictionary.page(99, 5).count() == 0
    assert dictionary.get(3)["id"] == IDS[3]
    assert dictionary.get(999) is None and dictionary.get(-1) is None
    assert dictionary.version().format_version == FORMAT_VERSION and dictionary.version().source_version == "1.0"


def test_by_id(dictionary):
    hit = dictionary.lookup_by_id("1060")
    assert (hit["match_type"], hit["match_key"], hit["score"]) == ("Exact", "1060", 1.0)
    assert hit["entry"]["kanji"][0]["text"] == "犬"
    assert dictionary.lookup_by_id("nothing") is None


def test_exact_shape(dictionary):
    (hit,) = dictionary.lookup_exact("猫")
    assert (hit["match_type"], hit["match_key"], hit["score"], hit["deinflection"]) == ("Exact", "猫", 1.0, None)
    assert found(dictionary.lookup_exact("neko")) == ["1000"]
    assert dictionary.lookup_exact("Neko") == []  # keys are in lower case, terms are taken as written
    assert dictionary.lookup_exact("食べた") == [] == dictionary.lookup_exact("")


def test_homographs_collapse_to_the_first(spark, dictionary, source):
    assert found(dictionary.lookup_exact("生")) == ["1110"]
    every = Dictionary.from_entries(dictionary.entries, collapse=False)
    assert found(every.lookup_exact("生")) == ["1110", "1120"]


def test_deinflection(dictionary):
    (hit,) = dictionary.lookup_exact_with_deinflection("食べました")
    assert (hit["match_type"], hit["score"], hit["match_key"]) == ("Deinflected", 0.75, "食べる")
    assert hit["deinflection"].asDict() == {"original_form": "食べました", "base_form": "食べる", "rules": ["PolitePast"]}
    (exact,) = dictionary.lookup_exact_with_deinflection("美しい")
    assert exact["match_type"] == "Exact"
    assert dictionary.lookup_exact_with_deinflection("美しいです") == []


def test_fallback_is_decided_before_filters(dictionary):
    q = dictionary.lookup("食べ物").mode(MatchMode.DEINFLECT).pos("v1")
    assert q.execute() == []


def test_prefix(dictionary):
    hits = dictionary.lookup_partial("たべる")
    assert [(h["match_type"], h["score"]) for h in hits] == [("Exact", 1.0)]
    hits = dictionary.lookup_partial("たべ")
    assert found(hits) == ["1010", "1020", "1030", "1040", "1050"]
    assert {h["match_type"] for h in hits} == {"Prefix"} and {h["score"] for h in hits} == {0.5}
    assert len(dictionary.lookup("").mode("Prefix").execute()) == len(WORDS)
    assert len(dictionary.lookup("たべ").mode("Prefix").limit(2).execute()) == 2
    assert dictionary.lookup("たべ").mode("Prefix").limit(0).execute() == []
    assert found(dictionary.lookup("たべ").mode("Prefix").common_only().limit(2).execute()) == ["1010", "1020"]


def test_filters(dictionary):
    prefix = lambda: dictionary.lookup("").mode("Prefix")
    assert found(prefix().field("med").execute()) == ["1150"]
    assert found(prefix().dialect("ksb").execute()) == ["1160"]
    assert found(prefix().misc("uk").common_only().execute()) == ["1130", "1140", "1170"]
    # する has a verb sense and an uk sense, but no sense that is both; adv holds a v.
    assert found(prefix().pos("v").misc("uk").execute()) == ["1170"]
    assert found(prefix().pos("v1", "v5").execute()) == ["1010", "1180"]
    assert found(prefix().pos("V1").execute()) == []


def test_fuzzy(dictionary):
    assert "1000" in found(dictionary.lookup("nko").mode("Fuzzy").max_distance(1).execute())
    exact = dictionary.lookup("neko").mode("Fuzzy").max_distance(0).execute()
    assert [(h["match_type"], h["score"]) for h in exact] == [("Exact", 1.0)]
    sets = [set(found(dictionary.lookup("たべる").mode("Fuzzy").max_distance(d).execute())) for d in range(5)]
    assert all(a <= b for a, b in zip(sets, sets[1:], strict=False))
    assert dictionary.lookup("x").max_distance(9).options.max_distance == 4
    hits = dictionary.lookup("たべる").mode("Fuzzy").execute()
    assert hits[0]["score"] == 1.0 and [h["score"] for h in hits] == sorted((h["score"] for h in hits), reverse=True)
    assert len({h["seq_id"] for h in hits}) == len(hits)


@pytest.mark.parametrize("mode", list(MatchMode))
def test_batch_equals_single(dictionary, mode):
    terms = ["猫", "zzz", "たべ", "犬", "猫", "走ります", ""]
    groups = dictionary.lookup_batch(terms).mode(mode).limit(3).execute()
    assert [g["term"] for g in groups] == terms
    for g in groups:
        single = dictionary.lookup(g["term"]).mode(mode).limit(3).execute()
        assert [(r["entry"]["id"], r["match_type"], r["match_key"], r["score"], r["deinflection"]) for r in g["results"]] == [(r["entry"]["id"], r["match_type"], r["match_key"], r["score"], r["deinflection"]) for r in single]


def test_lazy_equals_eager(dictionary):
    q = dictionary.lookup("たべ").mode("Prefix")
    assert list(q.iterate()) == q.execute()


def test_options_form(dictionary):
    options = QueryOptions(mode=MatchMode.PREFIX, common_only=True, limit=1)
    assert found(dictionary.lookup_with_options("たべ", options)) == ["1010"]
    assert [len(g["results"]) for g in dictionary.lookup_batch_with_options(["たべ", "犬", "zzz"], options)] == [1, 1, 0]
    with pytest.raises(errors.InvalidQuery):
        dictionary.lookup("a").limit(-1)


def test_gloss(dictionary):
    hits = dictionary.lookup_gloss("To EAT")
    assert found(hits) == ["1010", "1030"]
    assert {h["match_key"] for h in hits} == {"eat to"} and hits[0]["deinflection"] is None
    df = {r["token"]: r["df"] for r in dictionary.token_df.collect()}
    assert hits[0]["score"] == min(0.6, 0.3 + 2 / (df["eat"] + df["to"])) <= 0.6
    assert found(dictionary.lookup_gloss("live eat")) == ["1010"]  # tokens of different glosses
    assert dictionary.lookup_gloss("eat zebra") == [] == dictionary.lookup_gloss("") == dictionary.lookup_gloss("éé")
    assert dictionary.lookup_gloss("Katze") == []  # only English glosses are indexed
    assert dictionary.lookup_gloss("cat cat") == dictionary.lookup_gloss("CAT")


def test_xrefs(dictionary):
    related = dictionary.get(1)["sense"][0]["related"]
    assert [tuple(x) for x in related] == [("食う", None, 2), ("生", "なま", None), ("無い", "ない", 1), ("", None, None), ("", None, None)]
    assert found(dictionary.resolve_xref(Xref("生"))) == ["1110"]
    assert found(dictionary.resolve_xref(Xref("生", "なま"))) == ["1110"]
    assert dictionary.resolve_xref(Xref("生", "せい")) == [] == dictionary.resolve_xref(Xref("無い"))


def test_opening(spark, tmp_path, folder, dictionary, monkeypatch):
    with pytest.raises(errors.DataNotFound):
        Dictionary.open(spark, str(tmp_path / "none"))
    with pytest.raises(errors.DataNotFound):
        Dictionary.from_tables(entries=dictionary.entries)
    import shutil

    old = tmp_path / "old"
    shutil.copytree(folder, old)
    shutil.rmtree(old / "meta")
    spark.createDataFrame([(3, "0.9", "then")], dictionary.meta.schema).write.parquet(str(old / "meta"))
    with pytest.raises(errors.DataVersionMismatch) as e:
        Dictionary.open(spark, str(old))
    assert (e.value.expected, e.value.found, e.value.code) == (FORMAT_VERSION, 3, 2)
    spark.createDataFrame([], dictionary.meta.schema).write.mode("overwrite").parquet(str(old / "meta"))
    with pytest.raises(errors.DataCorrupted):
        Dictionary.open(spark, str(old))
    monkeypatch.setenv("TSUMUGI_DATA", folder)
    assert Dictionary.open_default(spark).count() == len(WORDS)
    monkeypatch.delenv("TSUMUGI_DATA")
    monkeypatch.chdir(tmp_path)
    with pytest.raises(errors.DataNotFound):
        Dictionary.open_default(spark)


def test_source_forms(spark, source, tmp_path):
    import json

    from tsumugi.sources.entries import read_entry_lines, read_source

    path = tmp_path / "lines.json"
    path.write_text("\n".join(json.dumps({"seq_id": k} | w, ensure_ascii=False) for k, w in enumerate(WORDS)), encoding="utf-8")
    assert read_entry_lines(spark, str(path)).orderBy("seq_id").collect() == read_source(spark, source).orderBy("seq_id").collect()


def test_accessors(dictionary):
    from pyspark.sql import functions as F

    from tsumugi.functions import entries as E

    rows = dictionary.entries.select("id", E.primary_kanji(), E.primary_kana(), E.headword(), E.is_common(), E.glosses("eng"), E.glosses("ger"), E.parts_of_speech(), E.first_gloss()).collect()
    by = {r[0]: tuple(r)[1:] for r in rows}
    assert by["1000"] == ("猫", "ねこ", "猫", True, ["cat (esp. the domestic cat)"], ["Katze"], ["n"], "cat (esp. the domestic cat)")
    assert by["1040"][:4] == (None, "たべすぎ", "たべすぎ", False)
    assert by["1140"][6] == ["vs-i", "n"]
    empty = dictionary.spark.createDataFrame([], dictionary.entries.schema).select(F.count(E.headword()))
    assert empty.first()[0] == 0


def test_stream(spark, dictionary, tmp_path):
    from tsumugi.streaming.lookup import lookup_stream

    src = str(tmp_path / "terms")
    dictionary.terms(["猫", "たべ", "zzz"]).write.parquet(src)
    got = []
    stream = spark.readStream.schema("pos bigint, term string").parquet(src)
    q = lookup_stream(stream, dictionary, lambda df, n: got.extend(df.collect()), QueryOptions(mode=MatchMode.PREFIX), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert sorted((r["pos"], r["entry"]["id"]) for r in got) == [(0, "1000")] + [(1, i) for i in ("1010", "1020", "1030", "1040", "1050")]


def pushed(df):
    """The filters that the scans of a plan take."""
    import re

    return re.findall(r"PushedFilters: \[(.*?)\], ReadSchema", df._jdf.queryExecution().executedPlan().toString())


def test_single_lookups_read_only_their_keys(dictionary):
    """Key filters reach the scan, and so do the few candidates' ids."""
    from tsumugi.plans.query import entries_of, find

    plans = {mode: pushed(dictionary.lookup("たべ").mode(mode).dataframe()) for mode in MatchMode}
    assert any("EqualTo(key,たべ)" in p for p in plans[MatchMode.EXACT])
    assert any("StringStartsWith(key,たべ)" in p for p in plans[MatchMode.PREFIX])
    assert any("GreaterThanOrEqual(key_len,0)" in p for p in plans[MatchMode.FUZZY])
    assert all("In(key, [" in p or "EqualTo(key" in p for p in plans[MatchMode.DEINFLECT] if "key" in p)
    options = QueryOptions(mode=MatchMode.PREFIX)
    found = find(dictionary.terms(["たべ"]), dictionary, options, "たべ")
    assert any("In(seq_id, [1,2,3,4,5])" in p.replace(", ", ",").replace("In(seq_id,[", "In(seq_id, [") for p in pushed(entries_of(found, dictionary)))
    none = find(dictionary.terms(["zzz"]), dictionary, QueryOptions(), "zzz")
    assert entries_of(none, dictionary).count() == 0


def test_many_candidates_are_joined(dictionary, monkeypatch):
    from tsumugi.plans import query

    monkeypatch.setattr(query, "LOOKED_UP", 2)
    assert found(dictionary.lookup_partial("たべ")) == ["1010", "1020", "1030", "1040", "1050"]


def test_gloss_starts_from_the_rarest_token(spark, dictionary):
    """Postings of a frequent token are looked up for the rare token's entries alone."""
    from tsumugi.operators import candidates as C

    rows = [("the", k) for k in range(500)] + [("cat", 7), ("cat", 999), ("dog", 7)]
    postings = spark.createDataFrame(rows, "token string, seq_id bigint")
    df = postings.groupBy("token").count().withColumnRenamed("count", "df")
    asked = spark.createDataFrame([(0, "the cat"), (1, "cat"), (2, "cat dog the"), (3, "the absent"), (4, "dog dog")], "pos bigint, term string")
    got = {(r["pos"], r["seq_id"]): r["score"] for r in C.gloss(asked, postings, df).collect()}
    assert set(got) == {(0, 7), (1, 7), (1, 999), (2, 7), (4, 7)}
    assert got[(0, 7)] == 0.3 + 2 / 502 and got[(4, 7)] == 0.6
