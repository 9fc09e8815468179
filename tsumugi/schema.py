"""Entry and result types, match modes and the option record."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

FORMAT_VERSION = 4

_FORM = "common:boolean,text:string,tags:array<string>"
_XREF = "struct<term:string,reading:string,sense_index:int>"
_GLOSS = "array<struct<lang:string,gender:string,type:string,text:string>>"
_SOURCE = "array<struct<lang:string,full:boolean,wasei:boolean,text:string>>"
_LISTS = "partOfSpeech:array<string>,appliesToKanji:array<string>,appliesToKana:array<string>"
_TAGS = "field:array<string>,dialect:array<string>,misc:array<string>,info:array<string>"

KANJI = f"array<struct<{_FORM}>>"
KANA = f"array<struct<{_FORM},appliesToKanji:array<string>>>"
SENSE = f"array<struct<{_LISTS},related:array<{_XREF}>,antonym:array<{_XREF}>,{_TAGS},language_source:{_SOURCE},gloss:{_GLOSS}>>"
#: The source document; cross references are arrays of strings and numbers.
SOURCE = f"words array<struct<id:string,kanji:{KANJI},kana:{KANA},sense:array<struct<{_LISTS},related:array<array<variant>>,antonym:array<array<variant>>,{_TAGS},languageSource:{_SOURCE},gloss:{_GLOSS}>>>>"

ENTRIES = f"seq_id bigint, id string, kanji {KANJI}, kana {KANA}, sense {SENSE}"
KEYS = "script_rank int, script string, key string, key_len int, seq_id bigint"
IDS = "id string, seq_id bigint"
POSTINGS = "token string, seq_id bigint"
TOKEN_DF = "token string, df bigint"
META = "format_version int, source_version string, generated_at string"
TABLES = {"entries": ENTRIES, "keys": KEYS, "ids": IDS, "postings": POSTINGS, "token_df": TOKEN_DF, "meta": META}
TERMS = "pos bigint, term string"
DEINFLECTION = "struct<original_form:string,base_form:string,rules:array<string>>"

SCRIPTS = ("kana", "kanji", "romaji")
MAX_DISTANCE, DEFAULT_DISTANCE = 4, 2


class MatchMode(str, Enum):
    EXACT = "Exact"
    PREFIX = "Prefix"
    DEINFLECT = "Deinflect"
    FUZZY = "Fuzzy"


class MatchType(str, Enum):
    EXACT = "Exact"
    PREFIX = "Prefix"
    DEINFLECTED = "Deinflected"
    FUZZY = "Fuzzy"
    GLOSS = "Gloss"


@dataclass(frozen=True)
class QueryOptions:
    """What a query asks for, besides its terms. limit counts rows of a term after the filters; None: all."""

    mode: MatchMode = MatchMode.EXACT
    common_only: bool = False
    pos: tuple[str, ...] = ()
    misc: tuple[str, ...] = ()
    field: tuple[str, ...] = ()
    dialect: tuple[str, ...] = ()
    limit: int | None = None
    max_distance: int = DEFAULT_DISTANCE
    language: str | None = None


@dataclass(frozen=True)
class Xref:
    term: str
    reading: str | None = None
    sense_index: int | None = None


@dataclass(frozen=True)
class DataVersion:
    format_version: int
    source_version: str
    generated_at: str
