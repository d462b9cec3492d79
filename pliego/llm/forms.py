"""One consistent form for texts that look alike.

A longest-match transducer over grapheme clusters, compiled into one alternation, rewrites a text in a single pass:

* full-width and half-width forms become their plain counterparts, joined letters (ﬁ) come apart;
* a letter with separate accents becomes the composed letter, also when invisible signs stand between them;
* invisible signs go, and every kind of single blank becomes the plain blank (their number stays);
* letters of other scripts that look like Latin ones become those, alone or under an accent.

The mapping is computed from rules and the list of look-alikes below and checked for conflicts: no source has two
targets and no target is itself a source, so that a second pass changes nothing. Case, presence of accents, digits,
quotes and dashes stay as they are. Nulls stay null, empty texts empty.
"""

from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pliego.llm.common import cut_lineage

#: Letters of Greek and Cyrillic (and a few Latin signs) that look like the Latin letter beside them.
LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ѕ": "S", "Ј": "J",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ӏ": "l", "Ԛ": "Q", "ԛ": "q", "Ԝ": "W", "ԝ": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    "ɑ": "a", "ɡ": "g", "ı": "i", "ǀ": "l", "ℓ": "l",
}
#: Signs without a shape, first and last code point of each range.
INVISIBLE = [(0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF)]
MARKS = r"\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f"


def _hex(c: int) -> str:
    return f"\\u{c:04x}" if c < 0x10000 else f"\\U{c:08x}"


@functools.cache
def mapping() -> dict[str, str]:
    """Every single character that is rewritten, with its target."""
    invisible = {chr(c) for a, b in INVISIBLE for c in range(a, min(b, 0xFFFF) + 1)}
    table: dict[str, str] = {c: "" for c in invisible}

    def put(source: str, target: str) -> None:
        if table.setdefault(source, target) != target:
            raise ValueError(f"two targets for {source!r}")

    for c in map(chr, range(0x80, 0x10000)):
        if c in table or 0xD800 <= ord(c) < 0xE000:
            continue
        wide = unicodedata.decomposition(c).split(" ")[0] in ("<wide>", "<narrow>") or 0xFB00 <= ord(c) <= 0xFB06
        joined = unicodedata.category(c)[0] == "L" and unicodedata.decomposition(c).startswith("<compat>") and (plain := unicodedata.normalize("NFKC", c)).isascii() and plain.isalpha() and len(plain) > 1
        wide = wide or joined
        if unicodedata.category(c) == "Zs":
            put(c, " ")
        elif wide:
            put(c, unicodedata.normalize("NFKC", c))
        elif unicodedata.normalize("NFC", c) != c:
            put(c, unicodedata.normalize("NFC", c))
    for source, target in LOOK_ALIKES.items():
        put(source, target)
    # a composed letter over a look-alike, as in Greek with tonos
    for c in map(chr, range(0x80, 0x2000)):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and parts[0] in LOOK_ALIKES and c not in table:
            put(c, unicodedata.normalize("NFC", LOOK_ALIKES[parts[0]] + parts[1:]))
    for _ in range(3):
        table = {s: "".join(table.get(c, c) for c in t) for s, t in table.items()}
    if any(c in table for t in table.values() for c in t):
        raise ValueError("a target is itself rewritten")
    return table


def _class(chars: set[str]) -> str:
    """A character class in ranges, the same for Python and Java."""
    out, codes = [], sorted(map(ord, chars))
    start = prev = codes[0]
    for c in [*codes[1:], -1]:
        if c != prev + 1:
            out.append(_hex(start) + (f"-{_hex(prev)}" if prev > start else ""))
            start = c
        prev = c
    return "".join(out)


@functools.cache
def transducer() -> tuple[re.Pattern, re.Pattern]:
    table = mapping()
    invisible = _class({s for s, t in table.items() if not t})
    return re.compile(f"[^{MARKS}{invisible}](?:[{invisible}]*[{MARKS}])+|[{_class(set(table))}]|[\U000e0000-\U000e0fff]+"), re.compile(f"[{invisible}]+")


@functools.lru_cache(maxsize=65536)
def _cluster(cluster: str) -> str:
    table = mapping()
    out = "".join(table.get(c, "" if 0xE0000 <= ord(c) <= 0xE0FFF else c) for c in cluster)
    return unicodedata.normalize("NFC", out) if len(cluster) > 1 else out


def same_form(text: str) -> str:
    """The consistent form of one text."""
    pattern, _ = transducer()
    return pattern.sub(lambda m: _cluster(m.group()), text)


#: Ranges without any sign that the transducer rewrites; nearly all text of European languages lies within them.
PLAIN = [(0x00, 0x7F), (0xA1, 0xAC), (0xAE, 0xFF), (0x2010, 0x2027), (0x20AC, 0x20AC)]


def may_change(text: Column) -> Column:
    """Whether a text has any sign outside PLAIN; checked in the JVM, without Python. Others keep their form."""
    assert not any(a <= ord(c) <= b for c in mapping() for a, b in PLAIN)
    return text.rlike("[^" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in PLAIN) + "]")


def with_form(df: DataFrame, text: str, out: str = "form") -> DataFrame:
    """df with the consistent form of a column. Only texts with a sign to rewrite go through Python."""

    @F.pandas_udf("string")
    def rewrite(texts):
        return texts.map(lambda t: same_form(t), na_action="ignore")

    return df.withColumn(out, F.when(may_change(F.col(text)), rewrite(F.when(may_change(F.col(text)), F.col(text)))).otherwise(F.col(text)))


def form_digests(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, the digest of the stored text (raw) and of its consistent form (form), once for each key and text.

    The table is read once: texts without a sign to rewrite pass by Python as nulls. Texts that nothing is left of are
    left out, as null and empty ones.
    """

    @F.pandas_udf("string")
    def digest(texts):
        import hashlib

        def one(t: str | None) -> str | None:
            if t is None:
                return None
            form = same_form(t)
            return hashlib.md5(form.encode("utf-8", "surrogatepass")).hexdigest() if form else ""

        return texts.map(one)

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("key").isNotNull() & (F.length("text") > 0))
    seen = rows.select("key", F.md5("text").alias("raw"), digest(F.when(may_change(F.col("text")), F.col("text"))).alias("changed"))
    return seen.where("changed is null or changed <> ''").select("key", "raw", F.coalesce("changed", "raw").alias("form")).distinct()


def look_alike_classes(seen: DataFrame) -> DataFrame:
    """key, form (the class), raw and n_links of all keys whose text has another one of the same form beside it.

    seen: distinct key, raw and form (form_digests). n_links is how many keys of the class have a different text; keys
    of equal texts aren't linked, so copies cost a row each. Counts are aggregated by text before they meet by form.
    """
    by_text = seen.groupBy("form", "raw").agg(F.count("*").alias("n"))
    by_form = by_text.groupBy("form").agg(F.sum("n").alias("total"), F.count("*").alias("n_texts")).where("n_texts > 1").select("form", "total")
    links = by_text.join(by_form, "form").select("form", "raw", (F.col("total") - F.col("n")).alias("n_links"))
    return seen.join(links, ["form", "raw"]).select("key", "form", "raw", "n_links")


def pairs_of(classes: DataFrame) -> DataFrame:
    """key_a < key_b (by code point) of all keys of a class whose texts differ as stored."""
    pairs = classes.alias("a").join(classes.alias("b"), F.col("a.form") == F.col("b.form")).where("a.raw <> b.raw and a.key < b.key")
    return pairs.select(F.col("a.key").alias("key_a"), F.col("b.key").alias("key_b")).distinct()


def look_alike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """key_a < key_b of all rows whose texts differ as stored but not in their consistent form; texts are read once.

    Only digests are shuffled, and only classes with more than one text are joined: a boilerplate text that many keys
    share costs nothing by itself. AQE splits a form that holds a large share of the rows.
    """
    return pairs_of(cut_lineage(look_alike_classes(cut_lineage(form_digests(df, key, text)))))
