"""Brute-force versions and a small, awkward table."""

import random
import re
import zlib

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, n_words string, score string, label string, digest string"
GAP = r"[\x20\x09-\x0D]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return [w for w in re.split(GAP, text or "") if w]


def remainder(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


VOCABULARY = {
    "en": "the of and to in is that for it was on are with as his they be at one have this from or had by hot word but what some we can out other were all there when up use your how said".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou être son aux fait comme mais nous cette tout lui même sous bien où".split(),
}


def prose(rng, lang, n, insult=0):
    out = [rng.choice(VOCABULARY[lang]) + rng.choice(["", "", "", ",", "."]) for _ in range(n)]
    for _ in range(insult):
        out[rng.randrange(n)] = rng.choice(["idiot", "moron", "scum"])
    return " ".join(out) + "."


def rows(seed=3):
    """Prose in three languages, exact and near copies, junk, empty, null and long texts, null ids, repeated rows."""
    rng = random.Random(seed)
    out = []

    def add(text, lang="en", source="a", doc_id="next"):
        out.append((len(out) if doc_id == "next" else doc_id, text, lang, source, None if text is None else len(text), True, "x", "y", "z"))

    for k in range(60):
        lang = ("en", "de", "fr")[k % 3]
        add(prose(rng, lang, rng.randint(40, 160)), lang, "hot" if k % 3 else f"s{k % 4}")
    base = out[0][1]
    for k in range(6):
        add(base, "en", "hot")
    for k in range(6):
        w = base.split(" ")
        w[10 + k] = "changed"
        add(" ".join(w), "en", "hot")
    add(None)
    add("", lang=None)
    add("  \t\n", source=None)
    add("12 34 !!", "de")
    add("é" * 300, "fr")
    add("word " * 6000, "en")
    add("x" * 30000, "en")
    add("line one two three\nline one two three\n" * 20, "en")
    add("a | b | c $ d % e " * 20, "en")
    add("Released under the MIT License. mit license", "en")
    add("This work is licensed under the GNU General Public License, version 3.", "en")
    add("Licensed under CC BY-NC 4.0.", "fr")
    add("<|endoftext|> some  text <|endoftext|>x\n\n", "en")
    add("no id here the of and", "en", doc_id=None)
    add("no id here the of and", "en", doc_id=None)
    out.append(out[5])
    out.append(out[5])
    return out


def frame(spark, data=None, parts=5):
    data = [(*r, "d") for r in (rows() if data is None else data)]
    return spark.createDataFrame(data, SCHEMA).repartition(parts)


def write_tables(spark, folder, data=None, labels=None):
    """documents and labels as the queries read them."""
    frame(spark, data).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels or [], "doc_id bigint, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    return str(folder)
