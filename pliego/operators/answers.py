"""Checks of answers against their queries and sources, and extraction of what they claim."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pliego.functions import text as tx

#: Words that hedge a statement.
HEDGES = r"posiblemente|probablemente|quizás?|tal vez|podría|parece|aparentemente|possibly|probably|perhaps|maybe|might|could"
#: A figure with its unit, or a date.
FIGURES = r"(\d[\d.,]*\s*(?:euros?|€|%|años?|meses|días?|years?|months?|days?)|\d{1,2} de [\p{L}]+ de \d{4})"
#: Two or more capitalised words in a row.
ENTITIES = r"([A-ZÁÉÍÓÚÑ][a-záéíóúñü]+(?: [A-ZÁÉÍÓÚÑ][a-záéíóúñü]+)+)"
#: Month names in order.
MONTHS = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()
KEPT_MARKS = "áéíóúñÁÉÍÓÚÑ¡¿"


def overlap(a: Column, b: Column) -> Column:
    """The share of a's distinct words that b has; null if a has none."""
    left = F.array_distinct(a)
    return F.round(F.try_divide(F.size(F.array_intersect(left, b)), F.size(left)), 6)


def unsupported(answer: Column, sources: Column) -> Column:
    """Figures of an answer that no source holds."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(answer), F.lit(FIGURES), F.lit(1)))
    return F.filter(found, lambda x: ~F.exists(sources, lambda s: F.contains(s, x)))


def missing_share(missing: Column, answer: Column) -> Column:
    """Unsupported figures for each 100 words, at most 1."""
    words = F.size(tx.tokens(answer, keep_stop_words=True))
    return F.least(F.lit(1.0), F.size(missing) / F.greatest(words / 100.0, F.lit(1.0)))


def long_date(text: Column) -> Column:
    """The date of a text such as 3 de mayo de 2021; null if it isn't one."""
    part = lambda i: F.regexp_extract(text, r"(\d{1,2})\s+de\s+([\p{L}]+)\s+de\s+(\d{4})", i)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(part(2)))
    return F.when(month > 0, F.try_to_date(F.concat_ws("-", part(3), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(1), 2, "0")), "yyyy-MM-dd"))


@F.pandas_udf(StringType())
def plain_unicode(texts: pd.Series) -> pd.Series:
    """Composed form; signs beyond ASCII and Spanish letters lose their marks, or stay if nothing is left."""

    def one(t: str | None) -> str | None:
        if t is None or t.isascii():
            return t
        t = unicodedata.normalize("NFC", t)
        return "".join(c if c.isascii() or c in KEPT_MARKS else "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn") or c for c in t)

    return texts.map(one, na_action="ignore")
