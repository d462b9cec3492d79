"""Texts that were decoded with the wrong character encoding.

1. Multibyte damage. Every character is mapped back to the byte it stands for in a legacy encoding; an automaton over
   byte classes finds the maximal spans that are well-formed UTF-8 multibyte sequences, and only those spans are
   decoded. A span counts if all it decodes to are letters or signs of European text. Text damaged twice or more is decoded
   again until nothing changes; every decoding shortens the text, so this ends.
2. Damage between single-byte encodings has no byte structure to find, so the method can't show it. There each word
   with a character such a mix-up yields is mapped back through the pair of encodings, and the result is accepted if
   the corpus itself knows that word: it stands in at least KNOWN texts and RATIO times as many as the damaged form.
   The corpus counts are over all texts and joined, not broadcast by hand; copies of a damaged text count once, so that
   they can't outvote the right word. A sign between letters that no clean word has there (PROOF) shows the damage of a
   word that the corpus doesn't confirm; it is put right if the word it was is known or only one is possible.
3. A replacement sign beside a letter shows damage that can't be undone.

Nulls and empty texts are no cases. A key loaded twice with the same text gives one row.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pliego.llm.common import cut_lineage

#: Encodings that UTF-8 bytes are taken for.
LEGACY = ["cp1252", "cp850", "cp437", "mac_roman", "cp1251", "cp1250", "iso8859-15"]
#: Pairs of single-byte encodings: what the text was in, what it was read as.
MIX_UPS = [("cp850", "cp1252"), ("cp1252", "cp850"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp437", "cp1252"), ("cp1252", "cp437"), ("cp1252", "cp1251")]
KNOWN = 5
RATIO = 5
LOST = "�"
#: Letters and signs that the corpus' languages use beyond ASCII; what a span decodes to must be among them.
EXPECTED = set("áéíóúüñÁÉÍÓÚÜÑàâãäåçèêëìîïòôõöøùûÿýæœßÀÂÃÄÅÇÈÊËÌÎÏÒÔÕÖØÙÛÝÆŒŸ¿¡«»“”‘’„‚–—…€£§ºª°·•™©®\xa0")
#: Letters of clean words; a word made of these alone needs no look.
CLEAN = "áéíóúüñÁÉÍÓÚÜÑàâãçêôõÀÂÃÇÊÔÕèëîïûùœ"


@functools.cache
def decoder(encoding: str) -> list[str]:
    """The character of every byte; bytes that an encoding leaves open stand for the control sign of that number."""
    return [bytes([b]).decode(encoding, "replace").replace(LOST, chr(b)) for b in range(256)]


@functools.cache
def byte_of(encoding: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for b, c in enumerate(decoder(encoding)):
        out.setdefault(c, b)
    if encoding == "cp1252":  # control signs also stand for themselves (Latin-1)
        out |= {chr(b): b for b in range(0x80, 0xA0)}
    return out


#: States of the automaton: from the lead byte's range to the ranges that must follow.
SEQUENCES = [
    [(0xC2, 0xDF), (0x80, 0xBF)],
    [(0xE0, 0xE0), (0xA0, 0xBF), (0x80, 0xBF)],
    [(0xE1, 0xEC), (0x80, 0xBF), (0x80, 0xBF)],
    [(0xED, 0xED), (0x80, 0x9F), (0x80, 0xBF)],
    [(0xEE, 0xEF), (0x80, 0xBF), (0x80, 0xBF)],
    [(0xF0, 0xF0), (0x90, 0xBF), (0x80, 0xBF), (0x80, 0xBF)],
    [(0xF1, 0xF3), (0x80, 0xBF), (0x80, 0xBF), (0x80, 0xBF)],
    [(0xF4, 0xF4), (0x80, 0x8F), (0x80, 0xBF), (0x80, 0xBF)],
]


@functools.cache
def automaton(encoding: str) -> re.Pattern:
    """The byte automaton over the characters of an encoding; it matches maximal runs of sequences."""
    by_byte: dict[int, list[str]] = {}
    for c, b in byte_of(encoding).items():
        by_byte.setdefault(b, []).append(c)

    def one(low: int, high: int) -> str:
        return "[" + "".join(re.escape(c) for b in range(low, high + 1) for c in by_byte.get(b, ())) + "]"

    paths = ["".join(one(*r) for r in s) for s in SEQUENCES if all(any(b in by_byte for b in range(r[0], r[1] + 1)) for r in s)]
    return re.compile(f"(?:{'|'.join(paths)})+")


PAIR = re.compile(r"[^\x00-\x7f][^\x00-\x7f]")


@functools.cache
def leads(encoding: str) -> frozenset[str]:
    return frozenset(c for c, b in byte_of(encoding).items() if 0xC2 <= b <= 0xF4)


def _decode(span: str, encoding: str) -> str:
    bytes_of = byte_of(encoding)
    try:
        out = bytes(bytes_of[c] for c in span).decode("utf-8")
    except UnicodeDecodeError:
        return span
    good = all(c in EXPECTED for c in out) or (len(out) == 1 and 0x80 <= ord(out) < 0xA0) or _damaged_again(out)
    return out if good else span


def _damaged_again(text: str) -> bool:
    """Whether what came out is itself the damaged form of expected signs (text damaged twice)."""
    for encoding in ("cp1252", "mac_roman", "cp850"):
        m = automaton(encoding).match(text)
        if not m or len(text) - m.end() > 2 or text[m.end() : m.end() + 1] not in leads(encoding) | {""}:
            continue  # the rest may begin a sequence that goes on behind the span
        try:
            again = bytes(byte_of(encoding)[c] for c in m.group()).decode("utf-8")
        except UnicodeDecodeError:
            continue
        if all(c in EXPECTED for c in again) or _damaged_again(again):
            return True
    return False


def decode_spans(text: str) -> tuple[str, int]:
    """The text with its damaged multibyte spans decoded, and how many there were."""
    total = 0
    before = -1
    while total > before and PAIR.search(text):  # a sequence has at least two signs beyond ASCII
        before = total
        signs = set(text)
        for encoding in LEGACY:
            if signs.isdisjoint(leads(encoding)):
                continue
            n = 0

            def put(m: re.Match, encoding: str = encoding) -> str:
                nonlocal n
                out = _decode(m.group(), encoding)
                n += out != m.group()
                return out

            text = automaton(encoding).sub(put, text)
            total += n
    return text, total


@functools.cache
def mixed(pair: tuple[str, str]) -> dict[str, str]:
    """What a character was before a mix-up of single-byte encodings, for letters of the corpus' languages."""
    was, read = pair
    letters = set("áéíóúüñÁÉÍÓÚÜÑçãõâêôàÇÃÕÂÊÔÀ")
    return {r: w for w, r in zip(decoder(was), decoder(read)) if w in letters and w != r}


#: Characters that only a mix-up is likely to put into a word.
@functools.cache
def suspects() -> set[str]:
    return {c for p in MIX_UPS for c in mixed(p)} | {LOST}


def back_through(word: str) -> set[str]:
    """Words that a damaged word may have been."""
    out = set()
    for pair in MIX_UPS:
        back = mixed(pair)
        if any(c in back for c in word):
            was = "".join(back.get(c, c) for c in word)
            if was != word and all(c.isascii() and c.isalpha() or c in CLEAN for c in was):
                out.add(was)
    return out


#: A word with a currency, fraction, frame or control sign between letters of one case. Blanks, dashes, quotes, dots,
#: opening marks and the signs of units may stand between words that lack a blank, so they prove nothing.
PROOF = "^(?=(?:[^A-Za-z]*[A-Za-z]){3}).*(?:[a-záéíóúüñ]SIGN[a-záéíóúüñ]|[A-ZÁÉÍÓÚÜÑ]SIGN[A-ZÁÉÍÓÚÜÑ])".replace("SIGN", "[\x81\x8d\x90¢£¤¥§±¶¾†‡‰√≤⌠⌡┌└├┬┴═╒╔╘╙╟╤╩▄]")


@functools.cache
def _tokens() -> re.Pattern:
    inside = "".join(re.escape(c) for c in sorted(suspects()))
    return re.compile(f"[^\\W\\d_{inside}]*[{inside}][^\\W\\d_]*(?:[{inside}][^\\W\\d_]*)*")


@functools.cache
def _odd_sign() -> re.Pattern:
    """A suspect sign that clean words don't have, or a letter whose case doesn't fit the one before it."""
    odd = "".join(re.escape(c) for c in sorted(suspects() - set(CLEAN)))
    upper, lower = "".join(c for c in CLEAN if c.isupper()), "".join(c for c in CLEAN if c.islower())
    return re.compile(f"[A-Za-z{CLEAN}][{odd}]|[{odd}][A-Za-z{CLEAN}]|[a-z{lower}][{upper}]|[A-Z{upper}]{{2}}[{lower}]")


def odd_words(text: str) -> set[str]:
    """Words with a suspect character beside letters."""
    found: set[str] = set()
    if not _odd_sign().search(text):
        return found
    for w in _tokens().findall(text):
        if not any(c in suspects() and c != "\xa0" for c in w) and not w.endswith("\xa0"):
            w = w.strip("\xa0")
        if len(w) >= 3 and any(c.isascii() and c.isalpha() for c in w):
            found.add(w)
    return found


def needs_look(column: Column) -> Column:
    """Whether a text has any character that damage leaves; checked in the JVM.

    Every alternative ends at a sign beyond ASCII, which texts seldom have, so the pattern begins with that.
    """
    upper, lower = "".join(c for c in CLEAN if c.isupper()), "".join(c for c in CLEAN if c.islower())
    return column.rlike(f"[^\\x00-\\x7F](?:(?<=[^\\x00-\\x7F{CLEAN}¿«»ºª“”…€])|[^\\x00-\\x7F]|(?<=[a-z{lower}][{upper}])|(?<=[A-Z{upper}]{{2}}[{lower}]))")


def examine(df: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, decoded, spans, lost and words (damaged word, what it may have been) of every text that needs a look."""
    rows = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where(needs_look(F.col("text")))
    shape = pa.list_(pa.struct([("word", pa.string()), ("was", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lost_beside = re.compile(rf"[^\W\d_]{LOST}|{LOST}[^\W\d_]")
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for t in batch.column(1).to_pylist():
                out, spans = decode_spans(t)
                cols[0].append(out)
                cols[1].append(spans)
                cols[2].append(bool(lost_beside.search(t)))
                cols[3].append([{"word": w, "was": was} for w in sorted(odd_words(out)) for was in sorted(back_through(w))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.bool_()), pa.array(cols[3], shape)], ["doc_id", "text", "decoded", "spans", "lost", "words"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, text string, decoded string, spans int, lost boolean, words array<struct<word string, was string>>")


def known_words(df: DataFrame, text: str) -> DataFrame:
    """In how many texts each word with a letter beyond ASCII stands; over all texts."""
    word = f"(?<![A-Za-z{CLEAN}])([A-Za-z]*+[{CLEAN}][A-Za-z{CLEAN}]*)"
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(word), F.lit(1))))
    return df.where(F.col(text).isNotNull()).select(words.alias("was")).groupBy("was").agg(F.count("*").alias("known"))


def damaged_words(df: DataFrame, text: str, examined: DataFrame) -> DataFrame:
    """word, was: the single-byte damage that the corpus' own words confirm or a sign proves; was is null if unsure."""
    each = examined.select("digest", F.explode("words").alias("w")).select("digest", "w.word", "w.was").distinct()
    candidates = each.groupBy("word", "was").agg(F.count("*").alias("seen"))
    known = F.coalesce("known", F.lit(0))
    judged = candidates.join(known_words(df, text), "was", "left").withColumn("known", known).withColumn("confirmed", (known >= KNOWN) & (known >= RATIO * F.col("seen")))
    likeliest = F.max_by("was", F.struct("confirmed", "known", "was"))
    sure = F.bool_or("confirmed") | (F.max("known") > 0) | (F.count("*") == 1)
    return judged.where(F.col("confirmed") | F.col("word").rlike(PROOF)).groupBy("word").agg(F.when(sure, likeliest).alias("was"))


def find_damaged(df: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id of every text with at least one wrongly decoded word."""
    examined = cut_lineage(examine(df, key, text).where("spans > 0 or lost or size(words) > 0").select("doc_id", "spans", "lost", "words", F.md5("text").alias("digest")))
    sure = examined.where("spans > 0 or lost").select("doc_id")
    doubtful = examined.where("spans = 0 and not lost and size(words) > 0")
    words = damaged_words(df, text, examined.where("size(words) > 0")).select("word")
    more = doubtful.select("doc_id", F.explode("words.word").alias("word")).join(words, "word", "left_semi").select("doc_id")
    return sure.unionByName(more).distinct()


def restore(df: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, text as stored and restored, for every text that changes."""
    examined = cut_lineage(examine(df, key, text).where("spans > 0 or size(words) > 0").dropDuplicates(["doc_id", "text"]).withColumn("digest", F.md5("text")))
    words = damaged_words(df, text, examined.where("size(words) > 0")).where("was is not null")
    by_doc = examined.select("doc_id", "digest", F.explode("words.word").alias("word")).join(words, "word").groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set(F.struct("word", "was"))).alias("fixes"))

    @F.pandas_udf("string")
    def mend(texts, fixes):
        out = []
        for t, found in zip(texts, fixes):
            by = {f["word"]: f["was"] for f in found} if found is not None else {}
            out.append(re.sub("|".join(map(re.escape, sorted(by, key=len, reverse=True))), lambda m: by[m.group()], t) if by else t)
        import pandas as pd

        return pd.Series(out)

    rows = examined.select("doc_id", "text", "decoded", "digest").join(by_doc, ["doc_id", "digest"], "left")
    return rows.select("doc_id", "text", mend("decoded", "fixes").alias("restored")).where("text <> restored")
