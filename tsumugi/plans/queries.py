"""The registered queries: each operator over dictionary-shaped views of the driver's tables.

parts serve as entries with three scripts (name, brand, type) and as whole dictionary entries, documents as glosses, orders
with their lines as entries with senses. Every query runs over whole tables. ORACLES has the same in DuckDB SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import entries as E
from ..functions import kana, text
from ..functions.deinflect import deinflect
from ..operators import candidates as C
from ..operators.filters import any_contains, has_reading, limit_per_term, sense_matches
from ..schema import QueryOptions
from ..sources.dictionary import Dictionary
from ..sources.entries import parse_entry_lines
from ..streaming.lookup import exact_stream
from . import build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Views


def part_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    scripts = F.array(*[F.struct(F.lit(s).alias("script"), F.col(c).alias("key")) for s, c in (("kana", "p_name"), ("kanji", "p_brand"), ("romaji", "p_type"))])
    return table(spark, sf_dir, "part").select(F.inline(scripts), F.col("p_partkey").alias("seq_id"))


def part_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.collapse_keys(part_forms(spark, sf_dir))


def part_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name of every part, asked for under its key."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("term"))


def cut_terms(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """The first characters of names and types, each once, under the least part that has them."""
    p = table(spark, sf_dir, "part")
    cuts = F.array(F.struct(F.lit(0).alias("n"), F.substring("p_name", 1, size).alias("term")), F.struct(F.lit(1).alias("n"), F.substring("p_type", 1, size).alias("term")))
    both = p.select("p_partkey", F.inline(cuts))
    return both.groupBy("term").agg(F.min(2 * F.col("p_partkey") + F.col("n")).alias("pos")).select("pos", "term")


def document_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.postings(table(spark, sf_dir, "documents"), "doc_id", "text")


def order_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey and sense: a sense for each line, with its flags as tags."""
    lines = table(spark, sf_dir, "lineitem")
    one = lambda c: F.array(F.col(c))
    empty = F.array().cast("array<string>")
    sense = F.struct(one("l_returnflag").alias("partOfSpeech"), one("l_linestatus").alias("misc"), F.when(F.col("l_quantity") > 45, F.array(F.lit("bulk"))).otherwise(empty).alias("field"), empty.alias("dialect"))
    return lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(sense).alias("sense"))


# Queries


GLOSS_QUERIES = ["the and", "And the THE", "to-of", "für die", "the", "loser idiot", "zzzz the", "", "é"]


def _literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def gloss_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings = document_postings(spark, sf_dir)
    asked = _literal(spark, list(enumerate(GLOSS_QUERIES)), "pos bigint, term string")
    return C.gloss(asked, postings, build.token_df(postings)).select("pos", "ord", F.col("seq_id").alias("doc_id"), "match_type", "match_key", "score")


def gloss_postings_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.token_df(document_postings(spark, sf_dir))


def gloss_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.tokens(F.col("text")), " ").alias("tokens"))


def keys_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_keys(spark, sf_dir)


def _flat(df: DataFrame) -> DataFrame:
    return df.select("pos", "ord", "seq_id", "match_type", "match_key", "score")


def exact_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(C.exact(part_terms(spark, sf_dir), part_keys(spark, sf_dir)))


def prefix_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(C.prefix(cut_terms(spark, sf_dir, 6), part_keys(spark, sf_dir)))


def limit_per_term_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limit_per_term(prefix_batch(spark, sf_dir), 3)


def document_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of the documents as a key of its first document; the collapse alone combines them."""
    docs = table(spark, sf_dir, "documents")
    return build.collapse_keys(docs.select(F.lit("kana").alias("script"), F.explode(text.tokens(F.col("text"))).alias("key"), F.col("doc_id").alias("seq_id")))


FUZZY_TERMS = ["the", "idiot", "thand", "ofthe", "licence", "einlich", "verber", "a", "12345", ""]


def fuzzy_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = _literal(spark, list(enumerate(FUZZY_TERMS)), "pos bigint, term string")
    return _flat(C.fuzzy(terms, document_keys(spark, sf_dir), 2))


def fuzzy_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's name less its second character, at distance 1."""
    p = table(spark, sf_dir, "part")
    terms = p.select(F.col("p_partkey").alias("pos"), F.concat(F.substring("p_name", 1, 1), F.expr("substring(p_name, 3)")).alias("term"))
    return _flat(C.fuzzy(terms, part_keys(spark, sf_dir), 1))


def filter_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = QueryOptions(pos=("R", "N"), misc=("F",), field=("ul",))
    return order_entries(spark, sf_dir).filter(sense_matches(options)).select("o_orderkey")


def filter_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each filter by itself, as numbers of entries that pass."""
    e = order_entries(spark, sf_dir)
    one = {"pos": QueryOptions(pos=("A",)), "misc": QueryOptions(misc=("O",)), "field": QueryOptions(field=("bulk",)), "dialect": QueryOptions(dialect=("x",)), "none": QueryOptions()}
    stack = F.array(*[F.struct(F.lit(k).alias("filter"), sense_matches(o).alias("passes")) for k, o in one.items()])
    return e.select(F.inline(stack)).groupBy("filter").agg(F.count_if("passes").alias("n"))


def region_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as entries: their nations by key as kanji, in reverse as kana; common from nation 20 on."""
    n = table(spark, sf_dir, "nation")
    form = F.struct("n_nationkey", (F.col("n_nationkey") >= 20).alias("common"), F.col("n_name").alias("text"))
    lists = n.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(form)).alias("kanji"))
    r = table(spark, sf_dir, "region").join(lists, F.col("r_regionkey") == F.col("n_regionkey"))
    return r.select(F.col("r_regionkey").cast("bigint").alias("seq_id"), F.col("r_name").alias("id"), "kanji", F.reverse("kanji").alias("kana"))


def accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = region_entries(spark, sf_dir)
    return e.select("seq_id", E.primary_kanji().alias("primary_kanji"), E.primary_kana().alias("primary_kana"), E.headword().alias("headword"), E.is_common().alias("is_common"))


def glosses_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entries, a sense with one gloss for each line: the return flag is its language."""
    gloss = F.struct(F.col("l_returnflag").alias("lang"), F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("text"))
    sense = F.struct("l_linenumber", "l_linestatus", "l_returnflag", F.array(gloss).alias("gloss"))
    e = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(sense)).alias("sense"))
    return e.select("l_orderkey", F.array_join(E.glosses("N"), "/").alias("glosses"), E.first_gloss().alias("first_gloss"))


def first_seen_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The return flags of an order's lines as parts of speech."""
    line = F.struct("l_linenumber", F.array("l_returnflag").alias("partOfSpeech"))
    e = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("sense"))
    return e.select("l_orderkey", F.array_join(E.parts_of_speech(), ",").alias("flags"))


def xref_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation's name as the reading of every region's name, and each region without a reading."""
    e = region_entries(spark, sf_dir)
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    readings = n.select("n_name").union(spark.createDataFrame([(None,)], "n_name string"))
    x = r.select("r_regionkey", F.col("r_name").alias("term")).join(F.broadcast(readings.groupBy().agg(F.collect_list(F.struct("n_name")).alias("all"))))  # 26 readings, a fixed list
    x = x.select("term", F.explode("all").alias("a")).select("term", F.col("a.n_name").alias("reading")).withColumn("pos", F.xxhash64("term", "reading"))
    keys = e.select(F.lit(0).alias("script_rank"), F.lit("kana").alias("script"), F.col("id").alias("key"), F.length("id").alias("key_len"), "seq_id")
    found = C.exact(x.select("pos", "term"), keys).join(x.select("pos", "term", "reading"), "pos").join(e.select("seq_id", "kana"), "seq_id")
    return found.filter(has_reading(F.col("reading"))).select("term", "reading", "seq_id", "score")


def part_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as source JSON, an entry each: brand as kanji, name as kana, type as part of speech, size as misc. The cross
    references have all forms: a term, with a reading, with a sense number, with both, and none."""
    p = table(spark, sf_dir, "part")
    form = F.struct((F.col("p_size") > 25).alias("common"), F.col("p_brand").alias("text"), F.array().cast("array<string>").alias("tags"))
    plain = F.to_json(F.struct(F.col("p_partkey").alias("seq_id"), F.col("p_partkey").cast("string").alias("id"), F.array(form).alias("kanji")))
    kana = F.format_string('"kana":[{"common":false,"text":"%s","tags":[],"appliesToKanji":["*"]}]', "p_name")
    related = F.format_string('[["%s"],["%s","%s"],["%s",%d],["%s","%s",2],[]]', "p_brand", "p_brand", "p_name", "p_name", F.col("p_size").cast("int"), "p_brand", "p_name")
    sense = F.format_string('"sense":[{"partOfSpeech":["%s"],"appliesToKanji":["*"],"appliesToKana":["*"],"related":%s,"antonym":[],"field":[],"dialect":[],"misc":["size %d"],"info":[],"languageSource":[],"gloss":[{"lang":"eng","gender":null,"type":null,"text":"%s, %s"},{"lang":"ger","gender":null,"type":null,"text":"Teil"}]}]', "p_type", related, F.col("p_size").cast("int"), "p_name", "p_type")
    return p.select(F.concat(F.regexp_replace(plain, "}$", ""), F.lit(","), kana, F.lit(","), sense, F.lit("}")).alias("value"))


def part_dictionary(spark: SparkSession, sf_dir: str) -> Dictionary:
    return Dictionary.from_entries(parse_entry_lines(part_lines(spark, sf_dir)), "parts")


def source_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source's entries after cleaning, with their cross references as text."""
    e = parse_entry_lines(part_lines(spark, sf_dir))
    ref = lambda x: F.concat_ws("/", x["term"], F.coalesce(x["reading"], F.lit("-")), F.coalesce(x["sense_index"].cast("string"), F.lit("-")))
    return e.select("seq_id", "id", E.headword().alias("headword"), E.primary_kana().alias("kana"), E.is_common().alias("is_common"), F.array_join(F.transform(F.col("sense")[0]["related"], ref), ";").alias("related"), E.first_gloss().alias("gloss"))


def surface_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.surface_forms(part_dictionary(spark, sf_dir).entries)


def full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_dictionary(spark, sf_dir).scan().select("seq_id", "id", E.headword().alias("headword"), E.primary_kana().alias("kana"))


def page_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_dictionary(spark, sf_dir).page(50, 25).select("seq_id", "id", E.primary_kana().alias("kana"))


def point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_dictionary(spark, sf_dir).at(42).select("seq_id", E.primary_kana().alias("kana"))


def scan_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(part_dictionary(spark, sf_dir).count(),)], "n bigint")


def by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts that lines name, by their ids as text; a row for each line."""
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_partkey").cast("string").alias("id"))
    found = part_dictionary(spark, sf_dir).by_ids(lines)
    return found.select("pos", "ord", "seq_id", "match_type", "match_key", "score", F.col("entry.id").alias("id"), E.primary_kana("entry.kana").alias("kana"))


def lookup_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes of names looked up: common entries of two types, at most two of a term, counted after the filters."""
    query = part_dictionary(spark, sf_dir).lookup_batch(cut_terms(spark, sf_dir, 6)).mode("Prefix").common_only().pos("ECON", "SMALL").limit(2)
    return query.dataframe().select("pos", "ord", "seq_id", "match_type", "match_key", "score", F.col("entry.id").alias("id"))


def lookup_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation and every part's name as a term: a row each, found or not."""
    nations = table(spark, sf_dir, "nation").select((-1 - F.col("n_nationkey").cast("bigint")).alias("pos"), F.col("n_name").alias("term"))
    rows = part_dictionary(spark, sf_dir).lookup_batch(part_terms(spark, sf_dir).unionByName(nations)).grouped()
    return rows.select("pos", "term", F.size("results").alias("n"), F.array_join(F.transform("results", lambda r: r["entry"]["id"]), ",").alias("ids"))


def lookup_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One term by the fluent query."""
    return part_dictionary(spark, sf_dir).lookup("red w").mode("Prefix").limit(5).dataframe().select("ord", "seq_id", "match_type", "match_key", "score", F.col("entry.id").alias("id"))


def xref_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's brand with its name as the reading, and without one."""
    p = table(spark, sf_dir, "part")
    asked = F.array(F.struct((2 * F.col("p_partkey")).alias("pos"), F.col("p_brand").alias("term"), F.col("p_name").alias("reading")), F.struct((2 * F.col("p_partkey") + 1).alias("pos"), F.col("p_brand").alias("term"), F.lit(None).cast("string").alias("reading")))
    return part_dictionary(spark, sf_dir).xref_batch(p.select(F.inline(asked))).select("pos", "ord", "seq_id", "match_type", "score", F.col("entry.id").alias("id"))


def gloss_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name with its type as a gloss query."""
    asked = table(spark, sf_dir, "part").select("p_name", "p_type").distinct().select(F.xxhash64("p_name", "p_type").alias("pos"), F.concat_ws(" ", F.lower("p_type"), "p_name").alias("term"))
    found = part_dictionary(spark, sf_dir).gloss_batch(asked).join(asked, "pos")
    return found.select("term", "ord", "seq_id", "match_type", "match_key", "score", F.col("entry.id").alias("id"))


def value_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The substring test on part types: case counts."""
    p = table(spark, sf_dir, "part").withColumn("tags", F.split("p_type", " "))
    return p.filter(any_contains(F.col("tags"), ("ECO", "MALL", "small"))).select("p_partkey")


# Words of the transliteration rows, and their spellings in the SQL below.
KANA_ROWS = ["neko", "ネコ", "ねこ", "kyou", "gakkou", "itte", "ittte", "itt", "durai", "shinbun", "きょう", "いって", "しゅみ", "たべる", "にほん", "がっこう", "xtsu", "ltsu", "mixtsuka", ""]


def _kana(spark: SparkSession, *columns) -> DataFrame:
    return _literal(spark, [(w,) for w in KANA_ROWS], "word string").select("word", *columns)


def kana_to_hiragana(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kana(spark, kana.to_hiragana(F.col("word")).alias("hiragana"))


def kana_to_katakana(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kana(spark, kana.to_katakana(F.col("word")).alias("katakana"))


def kana_to_romaji(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kana(spark, kana.to_romaji(F.col("word")).alias("romaji"))


SCRIPT_ROWS = ["あ", "ア", "ー", "漢", "a", "", "ねこ", "ネコ", "漢字", "ネコa", "ｱ", "ゟ", "々"]


def script_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("word")
    tests = {"hiragana": text.is_hiragana(w), "katakana": text.is_katakana(w), "kanji": text.is_kanji(w), "kana_word": text.is_kana_word(w), "katakana_word": text.is_katakana_word(w), "kanji_word": text.is_kanji_word(w)}
    return _literal(spark, [(x,) for x in SCRIPT_ROWS], "word string").select("word", *[v.alias(k) for k, v in tests.items()])


# Inflected form, dictionary form, type, reason chains (reasons joined by +, chains by /).
DEINFLECTIONS = [
    ("走ります", "走る", 2, "Polite"), ("走リマス", "走る", 2, "Polite"), ("走ッタ", "走る", 2, "Past"), ("踊りたくなかった", "踊る", 2, "Tai+Negative+Past"),
    ("食べ", "食べる", 9, "MasuStem"), ("思わぬ", "思う", 2, "Negative"), ("見ぬ", "見る", 9, "Negative"), ("こぬ", "くる", 8, "Negative"), ("食べられぬ", "食べる", 9, "PotentialOrPassive+Negative"),
    ("き", "くる", 8, "MasuStem"), ("美しき", "美しい", 4, "Ki"), ("した", "する", 16, "Past"), ("しよう", "する", 16, "Volitional"), ("できる", "する", 16, "Potential"), ("すれば", "する", 27, "Ba"),
    ("発せさせる", "発する", 32, "Irregular+Causative"), ("信ぜず", "信ずる", 32, "Irregular+Zu"), ("愛せば", "愛する", 32, "Irregular+Ba"), ("発さないで", "発する", 32, "Irregular+NegativeTe"),
    ("行った", "行く", 2, "Past"), ("いって", "いく", 2, "Te"), ("逝った", "逝く", 2, "Past"), ("往った", "往く", 2, "Past"),
]


def deinflect_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _literal(spark, [r[:3] for r in DEINFLECTIONS], "inflected string, plain string, kind int")
    forms = rows.withColumn("c", F.explode(deinflect(F.col("inflected")))).filter((F.col("c.word") == F.col("plain")) & (F.col("c.word_type") == F.col("kind")))
    chains = F.array_join(F.transform("c.reason_chains", lambda c: F.array_join(c, "+")), "/")
    return forms.select("inflected", F.col("c.word").alias("base"), F.col("c.word_type").alias("word_type"), chains.alias("reasons"))


def deinflect_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inflected forms looked up among their dictionary forms."""
    bases = list(dict.fromkeys(r[1] for r in DEINFLECTIONS))
    keys = _literal(spark, [(0, "kana", b, len(b), k) for k, b in enumerate(bases)], "script_rank int, script string, key string, key_len int, seq_id bigint")
    terms = _literal(spark, [(k, r[0]) for k, r in enumerate(DEINFLECTIONS)] + [(100, "走る"), (101, "美しいです")], "pos bigint, term string")
    return C.deinflected(terms, keys).select("pos", "ord", "match_type", "match_key", "score", F.col("deinflection.original_form").alias("original_form"))


def deinflect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every inflected form, in order of discovery."""
    forms = _literal(spark, [(r[0],) for r in DEINFLECTIONS], "inflected string").select("inflected", F.posexplode(deinflect(F.col("inflected"))).alias("step", "c"))
    return forms.select("inflected", "step", F.col("c.word").alias("base"), F.col("c.word_type").alias("word_type"), F.array_join(F.transform("c.reason_chains", lambda c: F.array_join(c, "+")), "/").alias("reasons"))


def stream_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as a stream of terms against the static keys."""
    schema = table(spark, sf_dir, "part").schema
    names = spark.readStream.schema(schema).parquet(f"{sf_dir}/par[t].parquet").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("term"))
    keys = part_keys(spark, sf_dir)

    class Static:
        pass

    static = Static()
    static.keys = keys
    name = f"stream_{uuid.uuid4().hex}"
    run = exact_stream(names, static).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


QUERIES = {f.__name__: f for f in (
    gloss_and, gloss_postings_df, gloss_tokens, keys_collapse, exact_batch, prefix_batch, limit_per_term_batch, fuzzy_batch, fuzzy_parts, filter_conjunction, filter_each, accessors,
    glosses_by_language, first_seen_distinct, xref_resolve, source_entries, surface_forms, full_scan, page_range, point_get, scan_count, by_id, lookup_filtered, lookup_grouped, lookup_single, xref_lookup,
    gloss_lookup, value_contains, kana_to_hiragana, kana_to_katakana, kana_to_romaji, script_tests, deinflect_forms, deinflect_all, deinflect_batch, stream_exact,
)}

_PARTS = "SELECT 0 AS script_rank, 'kana' AS script, p_name AS key, p_partkey AS seq_id FROM part UNION ALL SELECT 1, 'kanji', p_brand, p_partkey FROM part UNION ALL SELECT 2, 'romaji', p_type, p_partkey FROM part"
_KEYS = f"keys AS (SELECT script_rank, script, key, length(key)::INT AS key_len, min(seq_id) AS seq_id FROM ({_PARTS}) GROUP BY ALL)"
_POSTINGS = "postings AS (SELECT DISTINCT doc_id, lower(t) AS token FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[^A-Za-z0-9]+')) AS t FROM documents) WHERE t <> '')"
_CUT = "terms AS (SELECT min(pos) AS pos, term FROM (SELECT 2 * p_partkey AS pos, substr(p_name, 1, 6) AS term FROM part UNION ALL SELECT 2 * p_partkey + 1, substr(p_type, 1, 6) FROM part) GROUP BY term)"


def _values(rows, columns: str) -> str:
    quote = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) AS v({columns})"


def _ranked(pairs: str, score: str, kind: str) -> str:
    """Best key of an entry, then the order within a term."""
    return f"""scored AS (SELECT *, {score} AS score, {kind} AS match_type FROM {pairs}),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pos, seq_id ORDER BY score DESC, script_rank, key) AS r FROM scored) WHERE r = 1)
SELECT pos, row_number() OVER (PARTITION BY pos ORDER BY score DESC, seq_id) - 1 AS ord, seq_id, match_type, key AS match_key, score FROM best"""


_PREFIX = f"WITH {_KEYS}, {_CUT}, pairs AS (SELECT * FROM terms JOIN keys ON starts_with(key, term)), " + _ranked("pairs", "CASE WHEN key = term THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END", "CASE WHEN key = term THEN 'Exact' ELSE 'Prefix' END")
_FUZZY_SCORE = "CASE WHEN key = term THEN 1.0::DOUBLE ELSE greatest(0.5::DOUBLE - abs(greatest(length(key), 1)::DOUBLE - greatest(length(term), 1)::DOUBLE) / (greatest(length(key), 1)::DOUBLE + greatest(length(term), 1)::DOUBLE) * 0.2::DOUBLE, 0.1::DOUBLE) END"
_FUZZY_KIND = "CASE WHEN key = term THEN 'Exact' ELSE 'Fuzzy' END"

_FORMS = """SELECT 'kana' AS script, p_name AS key, p_partkey AS seq_id FROM part UNION ALL SELECT 'kanji', p_brand, p_partkey FROM part
    UNION ALL (SELECT DISTINCT 'romaji', lower(k), p_partkey FROM (SELECT p_name AS k, p_partkey FROM part UNION ALL SELECT p_brand, p_partkey FROM part))"""
_ENTRY_KEYS = f"keys AS (SELECT CASE script WHEN 'kana' THEN 0 WHEN 'kanji' THEN 1 ELSE 2 END AS script_rank, script, key, min(seq_id) AS seq_id FROM ({_FORMS}) GROUP BY ALL)"
_ENTRY_PREFIX = "WITH pairs AS (SELECT * FROM terms JOIN keys ON starts_with(key, term)), " + _ranked("pairs", "CASE WHEN key = term THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END", "CASE WHEN key = term THEN 'Exact' ELSE 'Prefix' END")

ORACLES = {
    "gloss_and": f"""WITH {_POSTINGS}, df AS (SELECT token, count(*) AS df FROM postings GROUP BY token),
        asked AS (SELECT pos, list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(term, '[^A-Za-z0-9]+'), lambda x: lower(x)), lambda x: x <> ''))) AS ts FROM {_values(list(enumerate(GLOSS_QUERIES)), 'pos, term')}),
        wanted AS (SELECT pos, len(ts) AS n, array_to_string(ts, ' ') AS match_key, unnest(ts) AS token FROM asked),
        sums AS (SELECT pos, sum(df) AS s FROM wanted JOIN df USING (token) GROUP BY pos),
        hits AS (SELECT pos, n, match_key, doc_id, count(*) AS c FROM wanted JOIN postings USING (token) GROUP BY ALL)
        SELECT pos::BIGINT AS pos, row_number() OVER (PARTITION BY pos ORDER BY doc_id) - 1 AS ord, doc_id, 'Gloss' AS match_type, match_key, least(0.6::DOUBLE, 0.3::DOUBLE + n::DOUBLE / greatest(s, 1)::DOUBLE) AS score FROM hits JOIN sums USING (pos) WHERE c = n""",
    "gloss_postings_df": f"WITH {_POSTINGS} SELECT token, count(*) AS df FROM postings GROUP BY token",
    "gloss_tokens": f"WITH {_POSTINGS} SELECT d.doc_id, coalesce(string_agg(token, ' ' ORDER BY token), '') AS tokens FROM documents d LEFT JOIN postings p USING (doc_id) GROUP BY d.doc_id",
    "keys_collapse": f"WITH {_KEYS} SELECT * FROM keys",
    "exact_batch": f"WITH {_KEYS}, pairs AS (SELECT DISTINCT p_partkey AS pos, p_name AS term, seq_id FROM part JOIN keys ON key = p_name) SELECT pos, row_number() OVER (PARTITION BY pos ORDER BY seq_id) - 1 AS ord, seq_id, 'Exact' AS match_type, term AS match_key, 1.0::DOUBLE AS score FROM pairs",
    "prefix_batch": _PREFIX,
    "limit_per_term_batch": f"SELECT * FROM ({_PREFIX}) WHERE ord < 3",
    "fuzzy_batch": f"WITH {_POSTINGS}, keys AS (SELECT 0 AS script_rank, token AS key, min(doc_id) AS seq_id FROM postings GROUP BY token), pairs AS (SELECT * REPLACE (pos::BIGINT AS pos) FROM {_values(list(enumerate(FUZZY_TERMS)), 'pos, term')} JOIN keys ON abs(length(key) - length(term)) <= 2 AND levenshtein(key, term) <= 2), " + _ranked("pairs", _FUZZY_SCORE, _FUZZY_KIND),
    "fuzzy_parts": f"WITH {_KEYS}, pairs AS (SELECT t.pos, t.term, k.* FROM (SELECT p_partkey AS pos, substr(p_name, 1, 1) || substr(p_name, 3) AS term FROM part) t JOIN keys k ON levenshtein(key, term) <= 1), " + _ranked("pairs", _FUZZY_SCORE, _FUZZY_KIND),
    "filter_conjunction": "SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE (contains(l_returnflag, 'R') OR contains(l_returnflag, 'N')) AND contains(l_linestatus, 'F') AND l_quantity > 45",
    "filter_each": """SELECT 'pos' AS filter, count(DISTINCT l_orderkey) AS n FROM lineitem WHERE contains(l_returnflag, 'A') UNION ALL SELECT 'misc', count(DISTINCT l_orderkey) FROM lineitem WHERE contains(l_linestatus, 'O')
        UNION ALL SELECT 'field', count(DISTINCT l_orderkey) FROM lineitem WHERE l_quantity > 45 UNION ALL SELECT 'dialect', 0 UNION ALL SELECT 'none', count(DISTINCT l_orderkey) FROM lineitem""",
    "accessors": "SELECT r_regionkey::BIGINT AS seq_id, arg_min(n_name, n_nationkey) AS primary_kanji, arg_max(n_name, n_nationkey) AS primary_kana, arg_min(n_name, n_nationkey) AS headword, bool_or(n_nationkey >= 20) AS is_common FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey",
    "glosses_by_language": "SELECT l_orderkey, coalesce(string_agg(l_linestatus || l_linenumber, '/' ORDER BY l_linenumber, l_linestatus) FILTER (l_returnflag = 'N'), '') AS glosses, first(l_linestatus || l_linenumber ORDER BY l_linenumber, l_linestatus) AS first_gloss FROM lineitem GROUP BY l_orderkey",
    "first_seen_distinct": "SELECT l_orderkey, string_agg(l_returnflag, ',' ORDER BY n, l_returnflag) AS flags FROM (SELECT l_orderkey, l_returnflag, min(l_linenumber) AS n FROM lineitem GROUP BY ALL) GROUP BY l_orderkey",
    "xref_resolve": "SELECT r_name AS term, n_name AS reading, r_regionkey::BIGINT AS seq_id, 1.0::DOUBLE AS score FROM region JOIN nation ON r_regionkey = n_regionkey UNION ALL SELECT r_name, NULL, r_regionkey, 1.0 FROM region",
    "source_entries": """SELECT p_partkey AS seq_id, p_partkey::VARCHAR AS id, p_brand AS headword, p_name AS kana, p_size > 25 AS is_common,
        p_brand || '/-/-;' || p_brand || '/' || p_name || '/-;' || p_name || '/-/' || p_size || ';' || p_brand || '/' || p_name || '/2;/-/-' AS related, p_name || ', ' || p_type AS gloss FROM part""",
    "surface_forms": f"SELECT script, key, seq_id FROM ({_FORMS})",
    "full_scan": "SELECT p_partkey AS seq_id, p_partkey::VARCHAR AS id, p_brand AS headword, p_name AS kana FROM part",
    "page_range": "SELECT p_partkey AS seq_id, p_partkey::VARCHAR AS id, p_name AS kana FROM part WHERE p_partkey BETWEEN 50 AND 74",
    "point_get": "SELECT p_partkey AS seq_id, p_name AS kana FROM part WHERE p_partkey = 42",
    "scan_count": "SELECT count(*) AS n FROM part",
    "by_id": "SELECT l_orderkey * 10 + l_linenumber AS pos, 0::BIGINT AS ord, p_partkey AS seq_id, 'Exact' AS match_type, p_partkey::VARCHAR AS match_key, 1.0::DOUBLE AS score, p_partkey::VARCHAR AS id, p_name AS kana FROM lineitem JOIN part ON l_partkey = p_partkey",
    "lookup_filtered": f"WITH {_ENTRY_KEYS}, {_CUT}, found AS ({_ENTRY_PREFIX}) SELECT pos, ord, seq_id, match_type, match_key, score, seq_id::VARCHAR AS id FROM found JOIN part ON p_partkey = seq_id WHERE p_size > 25 AND (contains(p_type, 'ECON') OR contains(p_type, 'SMALL')) QUALIFY row_number() OVER (PARTITION BY pos ORDER BY ord) <= 2",
    "lookup_grouped": f"""WITH {_ENTRY_KEYS}, terms AS (SELECT p_partkey::BIGINT AS pos, p_name AS term FROM part UNION ALL SELECT -1 - n_nationkey, n_name FROM nation),
        hits AS (SELECT DISTINCT pos, seq_id FROM terms JOIN keys ON key = term)
        SELECT pos, term, count(seq_id)::INT AS n, coalesce(string_agg(seq_id::VARCHAR, ',' ORDER BY seq_id), '') AS ids FROM terms LEFT JOIN hits USING (pos) GROUP BY pos, term""",
    "lookup_single": f"WITH {_ENTRY_KEYS}, terms AS (SELECT 0 AS pos, 'red w' AS term), found AS ({_ENTRY_PREFIX}) SELECT ord, seq_id, match_type, match_key, score, seq_id::VARCHAR AS id FROM found WHERE ord < 5",
    "xref_lookup": f"""WITH {_ENTRY_KEYS}, asked AS (SELECT 2 * p_partkey AS pos, p_brand AS term, p_name AS reading FROM part UNION ALL SELECT 2 * p_partkey + 1, p_brand, NULL FROM part),
        hits AS (SELECT DISTINCT pos, reading, seq_id FROM asked JOIN keys ON key = term), ranked AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY seq_id) - 1 AS ord FROM hits)
        SELECT pos, ord, seq_id, 'Exact' AS match_type, 1.0::DOUBLE AS score, seq_id::VARCHAR AS id FROM ranked JOIN part ON p_partkey = seq_id WHERE reading IS NULL OR reading = p_name""",
    "gloss_lookup": """WITH postings AS (SELECT DISTINCT p_partkey AS seq_id, lower(t) AS token FROM (SELECT p_partkey, unnest(regexp_split_to_array(p_name || ', ' || p_type, '[^A-Za-z0-9]+')) AS t FROM part) WHERE t <> ''),
        df AS (SELECT token, count(*) AS df FROM postings GROUP BY token),
        asked AS (SELECT DISTINCT lower(p_type) || ' ' || p_name AS term FROM part),
        wanted AS (SELECT DISTINCT term, lower(t) AS token FROM (SELECT term, unnest(regexp_split_to_array(term, '[^A-Za-z0-9]+')) AS t FROM asked) WHERE t <> ''),
        per AS (SELECT term, count(*) AS n, sum(df) AS s, string_agg(token, ' ' ORDER BY token) AS match_key FROM wanted JOIN df USING (token) GROUP BY term),
        hits AS (SELECT term, seq_id, count(*) AS c FROM wanted JOIN postings USING (token) GROUP BY ALL)
        SELECT term, row_number() OVER (PARTITION BY term ORDER BY seq_id) - 1 AS ord, seq_id, 'Gloss' AS match_type, match_key, least(0.6::DOUBLE, 0.3::DOUBLE + n::DOUBLE / s::DOUBLE) AS score, seq_id::VARCHAR AS id FROM hits JOIN per USING (term) WHERE c = n""",
    "value_contains": "SELECT p_partkey FROM part WHERE contains(p_type, 'ECO') OR contains(p_type, 'MALL') OR contains(p_type, 'small')",
    "kana_to_hiragana": f"SELECT * FROM {_values([('neko', 'ねこ'), ('ネコ', 'ねこ'), ('ねこ', 'ねこ'), ('kyou', 'きょう'), ('gakkou', 'がっこう'), ('itte', 'いって'), ('ittte', 'いっって'), ('itt', 'いっt'), ('durai', 'づらい'), ('shinbun', 'しんぶん'), ('きょう', 'きょう'), ('いって', 'いって'), ('しゅみ', 'しゅみ'), ('たべる', 'たべる'), ('にほん', 'にほん'), ('がっこう', 'がっこう'), ('xtsu', 'っ'), ('ltsu', 'っ'), ('mixtsuka', 'みっか'), ('', '')], 'word, hiragana')}",
    "kana_to_katakana": f"SELECT * FROM {_values([('neko', 'ネコ'), ('ネコ', 'ネコ'), ('ねこ', 'ネコ'), ('kyou', 'キョウ'), ('gakkou', 'ガッコウ'), ('itte', 'イッテ'), ('ittte', 'イッッテ'), ('itt', 'イッt'), ('durai', 'ヅライ'), ('shinbun', 'シンブン'), ('きょう', 'キョウ'), ('いって', 'イッテ'), ('しゅみ', 'シュミ'), ('たべる', 'タベル'), ('にほん', 'ニホン'), ('がっこう', 'ガッコウ'), ('xtsu', 'ッ'), ('ltsu', 'ッ'), ('mixtsuka', 'ミッカ'), ('', '')], 'word, katakana')}",
    "kana_to_romaji": f"SELECT * FROM {_values([('neko', 'neko'), ('ネコ', 'neko'), ('ねこ', 'neko'), ('kyou', 'kyou'), ('gakkou', 'gakkou'), ('itte', 'itte'), ('ittte', 'iっtte'), ('itt', 'iっt'), ('durai', 'zurai'), ('shinbun', 'shinbun'), ('きょう', 'kyou'), ('いって', 'itte'), ('しゅみ', 'shumi'), ('たべる', 'taberu'), ('にほん', 'nihon'), ('がっこう', 'gakkou'), ('xtsu', 'っ'), ('ltsu', 'っ'), ('mixtsuka', 'mikka'), ('', '')], 'word, romaji')}",
    "script_tests": f"""SELECT word, regexp_full_match(word, '[\\x{{3040}}-\\x{{309F}}]') AS hiragana, regexp_full_match(word, '[\\x{{30A0}}-\\x{{30FF}}]') AS katakana, regexp_full_match(word, '[\\x{{4E00}}-\\x{{9FFF}}]') AS kanji,
        regexp_full_match(word, '[\\x{{3040}}-\\x{{309F}}]*') AS kana_word, regexp_full_match(word, '[\\x{{30A0}}-\\x{{30FF}}]+') AS katakana_word, regexp_full_match(word, '[\\x{{4E00}}-\\x{{9FFF}}]*') AS kanji_word FROM {_values([(w,) for w in SCRIPT_ROWS], 'word')}""",
    "deinflect_forms": f"SELECT inflected, base, word_type::INT AS word_type, reasons FROM {_values(DEINFLECTIONS, 'inflected, base, word_type, reasons')}",
    "deinflect_batch": f"SELECT pos::BIGINT AS pos, 0::BIGINT AS ord, 'Deinflected' AS match_type, base AS match_key, 0.75::DOUBLE AS score, term AS original_form FROM {_values([(k, r[0], r[1]) for k, r in enumerate(DEINFLECTIONS)], 'pos, term, base')} UNION ALL SELECT 100, 0, 'Exact', '走る', 1.0, NULL",
    "stream_exact": f"WITH {_KEYS} SELECT DISTINCT p_partkey AS pos, p_name AS term, seq_id FROM part JOIN keys ON key = p_name",
}
