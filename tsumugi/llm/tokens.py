"""Token counts through a digest cache, and the piecewise encoder that the packer shares."""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, free_names, new_path, spread_join, table, written

#: Pieces whose ids a Python worker remembers; it starts anew beyond. Speed only.
REMEMBERED = 700_000
#: A space or line break with white space beside it or at an end of the text: there a cut could change tokens.
_UNEVEN = re.compile(r"(?:^|\s)[ \n]|[ \n](?:\s|$)")
#: Signs that may follow a word without a merge reaching across.
_TAIL = ".,;:!?$%&*#"
_WORKERS: dict[str, "PieceEncoder"] = {}


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level models write each byte: its Latin-1 one if that can be seen, else one from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_BYTES = byte_letters()


class PieceEncoder(dict):
    """Token ids of a text, encoded piece by piece, a piece's ids remembered as little-endian uint32.

    The concatenation is what the library gives for the whole text, by the kind of pre-tokenizer:

    - Word BPE drops white space and lowers case. Texts are cut at spaces and line breaks; A to Z are lowered
      first. Special strings count by case, so texts with "<|" go to the library whole.
    - Byte level: a single space or line break between other characters opens a pre-token, and no
      merge reaches across. Texts are cut before it; texts with other spaces go to the library whole.
    - Any other tokenizer: all texts go to the library whole.

    A piece that ends in a letter and signs of _TAIL is its word and the signs, as both pre-tokenizers
    part letters and signs.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.tokenize = self.library.model.tokenize
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        normalizers = [n["type"] for n in (told.get("normalizer") or {}).get("normalizers", ())]
        splits = (told.get("pre_tokenizer") or {}).get("pretokenizers") or [told.get("pre_tokenizer") or {}]
        self.words = normalizers[-1:] == ["Lowercase"] and splits[0].get("behavior") == "Removed" and splits[0].get("invert") is True
        self.bytes = told.get("normalizer") is None and splits[0].get("type") == "ByteLevel" and not splits[0].get("add_prefix_space") and splits[0].get("use_regex", True)
        self.tails: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def cut(self, text: str) -> list[str] | None:
        """The pieces of a text, the first one empty or without a space before it; None: to be encoded whole."""
        if self.words and "<|" not in text:
            lowered = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes: A to Z only
            return ["", *lowered.replace("\n", " ").split(" ")]
        if self.bytes and not _UNEVEN.search(text):
            return text.replace("\n", " \n").split(" ")
        return None

    def __missing__(self, piece: str) -> bytes:
        word = piece.rstrip(_TAIL)
        if len(word) < len(piece) and word and word[-1].isalpha():
            ids = self[word] + self.tail(piece[len(word) :])
        elif (letters := self.plain(piece)) is not None:
            ids = array("I", [t.id for t in self.tokenize(letters)]).tobytes()
        else:  # after a space, unless after a line break
            ids = self.whole(piece if piece[:1] == "\n" else " " + piece)
        self[piece] = ids
        return ids

    def tail(self, signs: str) -> bytes:
        ids = self.tails.get(signs)
        if ids is None:
            if len(self.tails) > 10_000:
                self.tails.clear()
            ids = self.tails[signs] = self.whole(signs)
        return ids

    def plain(self, word: str) -> str | None:
        """A word of Latin letters as the library's model takes it; None: any other piece.

        The normalizer leaves such a word as it is and the pre-tokenizer takes it whole (at the byte level with the
        space before it), so only the bytes' spelling and the merges are left to do.
        """
        if not word.isalpha() or not (self.bytes or word == word.lower()):
            return None
        if not word.isascii():
            if max(word) >= "\u0250":
                return None
            word = word.encode().decode("latin-1").translate(_BYTES)
        return _BYTES[32] + word if self.bytes else word

    def encode(self, text: str) -> bytes:
        pieces = self.cut(text)
        if pieces is None:
            return self.whole(text)
        if len(self) > REMEMBERED:
            self.clear()
        return (self.whole(pieces[0]) if pieces[0] else b"") + b"".join(map(self.__getitem__, pieces[1:]))


def worker_encoder(path: str) -> PieceEncoder:
    """One encoder for each Python worker and vocabulary."""
    if path not in _WORKERS:
        _WORKERS[path] = PieceEncoder(path)
    return _WORKERS[path]


def encoded(texts: list[str], path: str) -> Iterator[bytes]:
    """Ids of each text as uint32 bytes, in order, one text at a time."""
    return map(worker_encoder(path).encode, texts)


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens bigint"
#: Misses up to this number (32 bytes each) are broadcast, so that no other text moves.
BROADCAST_MISSES = 200_000


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The cache's entries; none yet: an empty table. Racing runs may both store an entry; one counts."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).option("recursiveFileLookup", True).parquet(cache)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, text: str = "text") -> DataFrame:
    """docs' rows with _digest, _bytes and _tokens, by the tokenizers file named; the text is dropped.

    1. Each text is digested (sha256 of its UTF-8; nothing is normalised away, since any change
       could change the count; null counts as empty) and the digests are counted. 2. Those without an entry
       under this tokenizer file's own digest are the misses. 3. One row for each miss carries its
       text to the encoder, and the counts are appended to the cache, a folder of Parquet tables, one of each run,
       so that runs at the same time don't touch each other's files. 4. The documents' digests are joined to the cache.

    Copies, however many, are one digest before anything is joined, and one encoding; a hot digest's rows are spread
    (spread_join()). Repeated rows count alike; null ids and other columns pass through, and where one has the name of an added
    column, the added one has an underscore more; an empty table gives an empty table. A long text is encoded by itself.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    version = file_digest(tokenizer)
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text]
    added = free_names(docs.select(*kept), "_digest", "_bytes", "_tokens")
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select((F.struct(*kept) if kept else F.lit(None)).alias("_row"), t.alias("_text"), F.unhex(F.sha2(t, 256)).alias("_digest"))
    counted = written(rows.groupBy("_digest").agg(F.count("*").alias("_rows")), "digests")
    stored = read_cache(spark, cache).filter(F.col("tokenizer") == version).select("digest")
    misses = written(counted.join(stored, F.col("_digest") == F.col("digest"), "left_anti").select("_digest"), "misses")
    known, new = counted.count(), misses.count()
    # Rows of one digest have one text, so distinct() leaves one row a digest; it combines before the shuffle.
    if new == known:
        distinct = rows.select("_digest", "_text").distinct()
    elif new <= BROADCAST_MISSES:
        distinct = rows.select("_digest", "_text").join(F.broadcast(misses), "_digest", "left_semi").distinct()
    else:
        distinct = rows.groupBy("_digest").agg(F.first("_text").alias("_text")).join(misses, "_digest", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(x) // 4 for x in encoded(b.column(1).to_pylist(), tokenizer)]
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(n), pa.string()), b.column(0), pa.array(n, pa.int64())], names=["tokenizer", "digest", "n_tokens"])

    distinct.select("_digest", "_text").mapInArrow(run, CACHE_SCHEMA).write.parquet(f"{cache}/{uuid.uuid4().hex}")
    counts = read_cache(spark, cache).filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("_tokens"))
    side = written(counted.join(counts, F.col("_digest") == F.col("digest")).drop("digest"), "token-counts")
    sized = rows.select("_row", F.octet_length("_text").cast("long").alias("_bytes"), "_digest")
    out = spread_join(sized, side, "_digest", "_rows")
    values = zip(("_digest", "_bytes", "_tokens"), added, strict=True)
    return out.select(*(["_row.*"] if kept else []), *[F.lower(F.hex(a)).alias(b) if a == "_digest" else F.col(a).alias(b) for a, b in values])


def op7_token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache of its own, so that it encodes every distinct text."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    df = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), new_path(spark, "token-cache"))
    return df.select("doc_id", F.col("_bytes").alias("n_bytes"), F.col("_tokens").alias("n_tokens"), (F.col("_tokens") > 1024).alias("over_limit"))
