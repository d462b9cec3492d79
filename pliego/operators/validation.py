"""Answers held against their sources: coverage, unsupported statements, citations, logic, and one score of it all.

All are column expressions over an answer and the array of its sources' texts (lower case), so an answer is checked
where it lies, without a join. Where a test by matching blocks would be needed, the share of a sentence's long words
that one source holds stands for it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pliego.functions import text as tx

#: What a sentence must find literally in a source.
KEY_INFO = r"\d+\s*años?|\d{1,2}[^\n]*?202\d|enero|diciembre"
#: Phrases that attribute a statement to a source.
ATTRIBUTED = r"(?:según|de acuerdo con|como indica)\s+(?:el documento|la fuente)|(?:establece|menciona|señala)\s+que|(?:específicamente|claramente|expresamente)\s+(?:dice|indica)"
#: Speculative language.
SPECULATIVE = r"posiblemente|probablemente|quizás|tal vez|podría|debería|sería|parece que|aparentemente|supuestamente|en general|normalmente|típicamente"
#: Figures with a unit, numeric dates and capitalised runs.
SPECIFIC = r"\d+(?:\.\d+)?\s*(?:%|euros?|€|\$|días?|meses?|años?)|\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|[A-ZÁÉÍÓÚÑ]\p{L}{3,}(?:\s+[A-ZÁÉÍÓÚÑ]\p{L}+)*"
#: Pairs of patterns of which one sentence has the first and a later one the second.
OPPOSITES = [(r"no\s+[\p{L}\p{N}_]+", r"sí\s+[\p{L}\p{N}_]+"), ("nunca", "siempre"), ("ninguno", "todos"), ("prohibido", "permitido"), ("debe", "no debe")]
#: The ways to cite a numbered source, and a source by name.
CITED = r"\[(\d+)\]|\((?:doc|documento)\s*(\d+)\)|según\s+(?:el\s+)?documento\s+(\d+)|<cite[^>]*>([^<]+)</cite>"
#: Attributions that may name a numbered source.
ATTRIBUTIONS = r"según (?:el documento|la fuente)(?:\s+\d+)?|como (?:indica|señala|menciona) (?:el documento|la fuente)(?:\s+\d+)?|\[\d+\]|\((?:doc|documento)\s*\d+\)"
#: Statements of fact by their verb.
FACTS = r"(?:es|son|fue|fueron|tiene|tienen|tuvo|tuvieron|costa|cuesta|mide|miden|dura|duran)\s+[^,.]+"
#: Causes, and quantities with and without figures.
CAUSES = r"debido a|por causa de|como resultado de|por |causa|provoca|resulta en|lleva a|por lo tanto|en consecuencia|así que"
QUANTITIES = r"\d+(?:\.\d+)?\s*(?:%|por ciento|euros?|€|\$|días?|meses?|años?)|(?:todos|ninguno|la mayoría|algunos|muchos|pocos)\s+(?:de\s+)?(?:los|las)\s+\p{L}+|(?:más de|menos de|aproximadamente|cerca de)\s+\d+"
VAGUE = "algunos|muchos|pocos|la mayoría"
NAMES = r"[A-ZÁÉÍÓÚÑ]\p{L}+(?:\s+[A-ZÁÉÍÓÚÑ]\p{L}+)+|[12]\d{3}|\d+(?:\.\d+)?%"
TOTAL = r"(?:total|suma)\s*:?\s*\d+(?:\.\d+)?"
NUMBER = r"\d+(?:\.\d+)?"
WEIGHTS = [0.3, 0.25, 0.2, 0.15, 0.1]


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def located(text: Column, pattern: str) -> Column:
    """Matches in order with their place (0-based): array of struct<m, at>, from the pieces between them."""
    m, pieces = found(text, pattern), F.split(text, pattern, -1)
    length = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + F.length(x))
    return F.transform(m, lambda x, i: F.struct(x.alias("m"), (length(F.slice(pieces, 1, i + 1)) + length(F.slice(m, 1, i))).alias("at")))


def long_words(text: Column, more_than: int) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.length(w) > more_than)


def in_one(words: Column, sources: Column, share: float) -> Column:
    """Whether one source holds more than a share of the words (all of none)."""
    return F.exists(sources, lambda s: F.size(F.filter(words, lambda w: F.contains(s, w))) >= F.size(words) * share)


def in_any(item: Column, sources: Column) -> Column:
    return F.exists(sources, lambda s: F.contains(s, F.lower(item)))


def coverage(answer: Column, sources: Column) -> Column:
    """The share of sentences that a source covers: all key information, or else more than half of the long words."""

    def covered(sentence: Column) -> Column:
        info = found(sentence, KEY_INFO)
        words = long_words(sentence, 3)
        return F.when(F.size(info) > 0, F.exists(sources, lambda s: F.forall(info, lambda x: F.contains(s, x)))).otherwise((F.size(words) > 0) & in_one(words, sources, 0.5))

    sentences = tx.sentences(F.lower(answer))
    return F.coalesce(F.try_divide(F.size(F.filter(sentences, covered)), F.size(sentences)), F.lit(0.0))


def unsupported_claims(answer: Column, sources: Column) -> Column:
    """How many attributed statements no source holds (60 % of their long words)."""
    claims = F.filter(F.split(F.lower(answer), r"\."), lambda c: c.rlike(ATTRIBUTED) & (F.size(long_words(c, 3)) >= 2))
    return F.aggregate(F.filter(claims, lambda c: ~in_one(long_words(c, 3), sources, 0.6)), F.lit(0), lambda n, c: n + F.regexp_count(c, F.lit(ATTRIBUTED)))


def hallucination(answer: Column, sources: Column) -> Column:
    """Unsupported statements, specific information in no source and much speculation, for each 100 words (not capped)."""
    missing = F.size(F.filter(found(answer, SPECIFIC), lambda x: ~in_any(x, sources)))
    speculative = (F.regexp_count(F.lower(answer), F.lit(SPECULATIVE)) > 2).cast("int")
    words = F.size(F.filter(F.split(answer, r"\s+"), lambda w: w != ""))
    return (unsupported_claims(answer, sources) + missing + speculative) / F.greatest(words / F.lit(100.0), F.lit(1.0))


def contradictions(answer: Column) -> Column:
    """How many ordered pairs of sentences match a pair of opposites."""
    ss = tx.sentences(F.lower(answer))
    total = F.lit(0)
    for first, second in OPPOSITES:
        total = total + F.aggregate(F.transform(ss, lambda a, i: F.when(a.rlike(first), F.size(F.filter(F.slice(ss, i + 2, F.size(ss)), lambda b: b.rlike(second)))).otherwise(0)), F.lit(0), lambda n, x: n + x)
    return total


def wrong_totals(answer: Column) -> Column:
    """Stated totals that the last five numbers before them (within 200 signs) don't add up to."""

    def wrong(t: Column) -> Column:
        before = F.substring(F.lower(answer), F.greatest(t["at"] - 199, F.lit(1)), F.least(t["at"], F.lit(200)))
        numbers = F.transform(F.slice(F.reverse(found(before, NUMBER)), 1, 5), lambda x: x.cast("double"))
        added = F.aggregate(numbers, F.lit(0.0), lambda s, x: s + x)
        stated = F.regexp_extract(t["m"], f"({NUMBER})$", 1).cast("double")
        return (F.size(found(before, NUMBER)) >= 2) & (F.abs(added - stated) > 0.01) & (added < stated * 2)

    return F.size(F.filter(located(F.lower(answer), TOTAL), wrong))


def citation_counts(answer: Column, sources: Column) -> tuple[Column, Column]:
    """How many citations name a source that is there, and how many don't."""
    cited = found(F.lower(answer), CITED)
    good = F.size(F.filter(cited, lambda c: F.coalesce(F.regexp_extract(c, r"^[^<]*?(\d+)", 1).try_cast("int").between(1, F.size(sources)), F.lit(False))))
    return good, F.size(cited) - good


def attribution_quality(answer: Column, sources: Column) -> Column:
    every = found(F.lower(answer), ATTRIBUTIONS)
    bad = F.size(F.filter(every, lambda a: ~F.coalesce(F.regexp_extract(a, r"(\d+)", 1).try_cast("int").between(1, F.size(sources)), F.lit(True))))
    return F.coalesce(1 - F.try_divide(bad, F.size(every)), F.lit(1.0))


def factual_accuracy(answer: Column, sources: Column) -> Column:
    """The share of statements of fact of which one source holds 70 % of the long words; 1 if there are none."""
    facts = F.filter(found(F.lower(answer), FACTS), lambda f: F.length(F.trim(f)) > 15)
    good = F.size(F.filter(facts, lambda f: (F.size(long_words(f, 4)) >= 2) & in_one(long_words(f, 4), sources, 0.7)))
    return F.coalesce(F.try_divide(good, F.size(facts)), F.lit(1.0))
