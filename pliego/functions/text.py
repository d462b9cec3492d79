"""Text functions as column expressions: cleaning, tokens, language, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that search leaves out.
STOP_WORDS = "el la de que y a en un por con para es se del al los las una su".split()
#: Frequent words of the two languages that are told apart.
SPANISH_WORDS = "el la de que y a en un por con para los las una su al del se es son como más pero sus le ya este cuando todo esta entre nos durante también fue había hasta".split()
ENGLISH_WORDS = "the be to of and a in that have for it with as you do at this but his by from they we say her she or an will my one all would there their".split()
#: Damaged sequences and what they stand for, in the order in which they are replaced.
REPAIRS = [("Ã¡", "á"), ("Ã©", "é"), ("Ã\xad", "í"), ("Ã³", "ó"), ("Ãº", "ú"), ("Ã±", "ñ"), ("Ã\x81", "Á"), ("Ã‰", "É"), ("Ã\x8d", "Í"), ("Ãš", "Ú"), ("Ã\x91", "Ñ"), ("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'"), ("…", "..."), ("Â°", "°"), ("Â´", "´"), ("Â¨", "¨"), ("Ã‚Â", ""), ("Ã‚", ""), ("Â ", " ")]
#: Marks that are stamped over a document's text.
WATERMARKS = r"CONFIDENCIAL\s*-?\s*NO\s+DISTRIBUIR|BORRADOR\s*-?\s*DRAFT|COPIA\s+NO\s+CONTROLADA|Página\s+\d+\s+de\s+\d+|\[WATERMARK\]"


def clean_spaces(text: Column) -> Column:
    """Control characters go; every run of white space becomes one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), r"[\s]+", " "))


def repair_encoding(text: Column) -> Column:
    """Literal repairs in order, then control characters go."""
    fixed = reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), REPAIRS, text)
    return F.regexp_replace(fixed, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def plain_quotes(text: Column) -> Column:
    """Angular and low quotes become ASCII, runs of double quotes become one."""
    return F.regexp_replace(F.translate(text, "„«»‚‛", "\"\"\"''"), '"{2,}', '"')


def without_watermarks(text: Column) -> Column:
    return F.regexp_replace(text, f"(?iu){WATERMARKS}", "")


def clean_ocr(text: Column) -> Column:
    """Long runs of a sign become two, blanks between digits go, signs outside text become blanks."""
    shorter = F.regexp_replace(F.regexp_replace(text, r"([\p{L}\p{N}_])\1{4,}", "$1$1"), r"(\d)\s+(?=\d)", "$1")
    return F.regexp_replace(shorter, r"""[^\p{L}\p{N}_\s\-.,:;¡!¿?()\[\]{}«»"'€$%@#&*+=/<>|\\]""", " ")


def tokens(text: Column, keep_stop_words: bool = False) -> Column:
    """Lower-case words without stop words."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "), " "), lambda t: t != "")
    return words if keep_stop_words else F.filter(words, lambda t: ~t.isin(STOP_WORDS))


def sentences(text: Column, longer_than: int = 10) -> Column:
    return F.filter(F.transform(F.split(text, r"[.!?]+"), lambda s: F.trim(s)), lambda s: F.length(s) > longer_than)


def language(text: Column) -> Column:
    """es or en by frequent words among the first 200; then by legal words; es if undecided."""
    words = F.slice(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), 1, 200)
    es = F.size(F.filter(words, lambda w: w.isin(SPANISH_WORDS)))
    en = F.size(F.filter(words, lambda w: w.isin(ENGLISH_WORDS)))
    low = F.lower(text)
    return F.when(es > en * 1.2, "es").when(en > es * 1.2, "en").when(low.rlike(r"(?:^|[^\p{L}])(?:artículo|cláusula|contrato|acuerdo|partes)(?:[^\p{L}]|$)"), "es").when(low.rlike(r"(?:^|[^\p{L}])(?:article|clause|agreement|contract|parties)(?:[^\p{L}]|$)"), "en").otherwise("es")
