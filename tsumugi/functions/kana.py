"""Transliteration between romaji, hiragana and katakana. Only the romaji scanners need Python."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import has_katakana, hiragana_to_katakana, katakana_to_hiragana

# The syllables by row; a dash where the row has none.
_ROWS = {
    "": "あいうえお", "k": "かきくけこ", "s": "さ-すせそ", "t": "た--てと", "n": "なにぬねの", "h": "はひ-へほ", "m": "まみむめも",
    "y": "や-ゆ-よ", "r": "らりるれろ", "w": "わ---を", "g": "がぎぐげご", "z": "ざ-ずぜぞ", "d": "だぢづでど", "b": "ばびぶべぼ", "p": "ぱぴぷぺぽ",
}
_IRREGULAR = {"shi": "し", "chi": "ち", "tsu": "つ", "fu": "ふ", "ji": "じ", "n": "ん", "vu": "ゔ"}
_GLIDES = {"ky": "き", "sh": "し", "ch": "ち", "ny": "に", "hy": "ひ", "my": "み", "ry": "り", "gy": "ぎ", "j": "じ", "by": "び", "py": "ぴ"}
_SMALL = {"a": "ゃ", "u": "ゅ", "o": "ょ"}

TO_KANA = {c + v: k for c, row in _ROWS.items() for v, k in zip("aiueo", row, strict=True) if k != "-"} | _IRREGULAR
TO_KANA |= {c + v: k + small for c, k in _GLIDES.items() for v, small in _SMALL.items()}
#: The Hepburn spelling of each syllable: ぢ and づ read as じ and ず.
TO_ROMAJI = {k: r for r, k in TO_KANA.items()} | {"ぢ": "ji", "づ": "zu"}
# The small tsu by itself. It has no syllable to be read back as.
TO_KANA |= {"xtsu": "っ", "ltsu": "っ"}


def _any(keys) -> str:
    return "|".join(sorted(map(re.escape, keys), key=len, reverse=True))


_ROMAJI = re.compile(f"{_any(TO_KANA)}|([bcdfghjklmpqrstvwxz])(?=\\1)")
_KANA = re.compile(f"(っ)?({_any(TO_ROMAJI)})")
_KATAKANA = re.compile("[ァ-ヶ]")
_TO_HIRAGANA = {c: c - 0x60 for c in range(0x30A1, 0x30F7)}
_TO_KATAKANA = {c: c + 0x60 for c in range(0x3040, 0x30A0)}


def to_hiragana_text(text: str) -> str:
    """Katakana shifted, and nothing else, if the text has any; else lower-cased romaji scanned from the left,
    longest syllable first, a doubled consonant but n as っ."""
    if _KATAKANA.search(text):
        return text.translate(_TO_HIRAGANA)
    return _ROMAJI.sub(lambda m: "っ" if m[1] else TO_KANA[m[0]], text.lower())


def to_katakana_text(text: str) -> str:
    return to_hiragana_text(text).translate(_TO_KATAKANA)


def to_romaji_text(text: str) -> str:
    """Hepburn of the text's hiragana form; っ doubles the consonant after it; other characters pass."""
    return _KANA.sub(lambda m: TO_ROMAJI[m[2]][0] * bool(m[1]) + TO_ROMAJI[m[2]], to_hiragana_text(text))


def romaji_key_text(text: str) -> str:
    """The romaji key of a surface form: Hepburn, without accents, in lower case. Kanji stay as they are."""
    spelled = _KANA.sub(lambda m: TO_ROMAJI[m[2]][0] * bool(m[1]) + TO_ROMAJI[m[2]], text.translate(_TO_HIRAGANA))
    return "".join(c for c in unicodedata.normalize("NFD", spelled) if not unicodedata.combining(c)).lower()


def _scanner(f):
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return run


_scan_hiragana, _scan_romaji, _scan_key = map(_scanner, (to_hiragana_text, to_romaji_text, romaji_key_text))


def to_hiragana(text: Column) -> Column:
    return F.when(has_katakana(text), katakana_to_hiragana(text)).otherwise(_scan_hiragana(text))


def to_katakana(text: Column) -> Column:
    return hiragana_to_katakana(to_hiragana(text))


def to_romaji(text: Column) -> Column:
    return _scan_romaji(text)


def romaji_key(text: Column) -> Column:
    return _scan_key(text)
