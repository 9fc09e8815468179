"""Reading source documents into the clean entry shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SOURCE


def _xref(raw: Column) -> Column:
    """[term], [term, n], [term, reading] or [term, reading, n]; whatever is not text is no term or reading."""
    part = lambda k: F.get(raw, F.lit(k))
    text = lambda k: F.when(F.schema_of_variant(part(k)) == "STRING", F.variant_get(part(k), "$", "string"))
    number = lambda k: F.when(F.schema_of_variant(part(k)) == "BIGINT", F.variant_get(part(k), "$", "bigint"))
    index = F.coalesce(*(F.when(number(k) >= 0, number(k)) for k in (1, 2))).cast("int")
    return F.struct(F.coalesce(text(0), F.lit("")).alias("term"), text(1).alias("reading"), index.alias("sense_index"))


def _sense(s: Column) -> Column:
    plain = ("partOfSpeech", "appliesToKanji", "appliesToKana", "field", "dialect", "misc", "info", "gloss")
    columns = {c: s[c].alias(c) for c in plain}
    columns |= {c: F.transform(s[c], _xref).alias(c) for c in ("related", "antonym")}
    columns["language_source"] = s["languageSource"].alias("language_source")
    order = ("partOfSpeech", "appliesToKanji", "appliesToKana", "related", "antonym", "field", "dialect", "misc", "info", "language_source", "gloss")
    return F.struct(*(columns[c] for c in order))


def read_source(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON document {"words": [...]}; seq_id is an entry's place in the array."""
    raw = spark.read.schema(SOURCE).option("multiLine", True).json(path)
    rows = raw.select(F.posexplode("words").alias("seq_id", "w"))
    return rows.select(F.col("seq_id").cast("bigint"), "w.id", "w.kanji", "w.kana", F.transform("w.sense", _sense).alias("sense"))


def _line_type(spark: SparkSession):
    entry = SOURCE.removeprefix("words array<struct<").removesuffix(">>").replace("id:string", "seq_id:bigint,id:string", 1)
    return spark.createDataFrame([], f"w struct<{entry}>").schema["w"].dataType


def _clean(raw: DataFrame) -> DataFrame:
    return raw.select("seq_id", "id", "kanji", "kana", F.transform("sense", _sense).alias("sense"))


def read_entry_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same from JSON lines, one entry each with its seq_id; splits over many tasks, for large sources."""
    return _clean(spark.read.schema(_line_type(spark)).json(path))


def parse_entry_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """The same from a column of such JSON texts."""
    return _clean(lines.select(F.from_json(column, _line_type(lines.sparkSession)).alias("w")).select("w.*"))
