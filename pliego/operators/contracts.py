"""Contract analytics as column expressions: types, dates, amounts, clauses, risk, complexity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Contract types and their words, in the order in which they are tried.
LOADER_TYPES = {
    "franquicia": ["franquicia", "franquiciador", "franquiciado", "royalty", "fee de marketing"],
    "mantenimiento": ["mantenimiento", "servicios de mantenimiento", "preventivo", "correctivo"],
    "gestión": ["gestión hotelera", "management", "operación hotelera", "gestor"],
    "arrendamiento": ["arrendamiento", "alquiler", "renta", "inquilino", "arrendador", "local de negocio"],
    "préstamo": ["préstamo", "crédito", "financiación", "prestamista", "deudor"],
    "compraventa": ["compraventa", "compra", "venta", "vendedor", "comprador"],
    "servicios": ["servicios", "prestación", "proveedor", "contratista"],
}
#: The analyser's own types.
ANALYSER_TYPES = {
    "arrendamiento": ["arrendamiento", "alquiler", "renta", "inquilino"],
    "compraventa": ["compraventa", "compra", "venta", "adquisición"],
    "servicios": ["servicios", "prestación", "consultoría", "asesoría"],
    "gestión": ["gestión", "administración", "management", "operación"],
    "préstamo": ["préstamo", "crédito", "financiación", "hipoteca"],
    "laboral": ["laboral", "empleo", "trabajo", "contratación"],
    "confidencialidad": ["confidencialidad", "nda", "secreto", "no divulgación"],
}
#: Phrases that raise or lower the risk, with their weight.
RISKS = {3: ["responsabilidad ilimitada", "sin límite de responsabilidad", "penalización automática", "rescisión unilateral", "jurisdicción extranjera", "renuncia a derechos"], 2: ["penalización", "incumplimiento", "retraso", "modificación unilateral", "cláusula penal"], -1: ["buena fe", "mutuo acuerdo", "notificación previa", "periodo de gracia"]}
#: Special clauses and what shows them.
SPECIAL = {"arbitraje": ["arbitraje", "árbitro", "mediación"], "exclusividad": ["exclusividad", "exclusivo", "no competencia"], "rescisión": ["rescisión", "terminación anticipada", "resolución"], "renovación": ["renovación automática", "prórroga", "extensión"], "ajuste_precio": ["revisión de precio", "actualización", "ipc"], "fuerza_mayor": ["fuerza mayor", "caso fortuito", "circunstancias excepcionales"]}
#: What the complexity counts, with its weight.
COMPLEXITY = {"clauses": (r"cláusula", 0.2), "technical_terms": (r"jurisdicción|arbitraje|indemnización|incumplimiento", 0.3), "refs": (r"(?:artículo|sección|anexo)\s+\d+", 0.2), "conditions": (r"si|cuando|en caso de|siempre que", 0.2)}
DATES = r"\d{1,2}\s+de\s+[\p{L}]+\s+de\s+\d{4}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}-\d{1,2}-\d{4}|\d{4}-\d{1,2}-\d{1,2}"
AMOUNTS = r"(\d{1,3}(?:\.\d{3})+(?:,\d+)?|\d+(?:,\d+)?)\s*(?:euros?|€)"
MAX_DATES = 10


def _hits(low: Column, words: list[str]) -> Column:
    return sum(F.contains(low, F.lit(w)).cast("int") for w in words)


def _first_best(scores: dict[str, Column], default: str) -> Column:
    top = F.greatest(*scores.values())
    return F.when(top > 0, F.coalesce(*[F.when(s == top, F.lit(t)) for t, s in scores.items()])).otherwise(default)


def loader_type(text: Column) -> Column:
    """The first type with a word among the first 1000 signs; else the one with most words (long ones twice)."""
    head, low = F.lower(F.substring(text, 1, 1000)), F.lower(text)
    early = F.coalesce(*[F.when(_hits(head, ws) > 0, F.lit(t)) for t, ws in LOADER_TYPES.items()])
    scores = {t: _hits(low, ws) + _hits(low, [w for w in ws if len(w) > 10] or ["\0"]) for t, ws in LOADER_TYPES.items()}
    return F.coalesce(early, _first_best(scores, "otros"))


def analyser_type(text: Column) -> Column:
    low = F.lower(text)
    return _first_best({t: _hits(low, ws) for t, ws in ANALYSER_TYPES.items()}, "genérico")


def risk_score(text: Column) -> Column:
    low = F.lower(text)
    return sum(w * _hits(low, phrases) for w, phrases in RISKS.items())


def risk_level(score: Column) -> Column:
    return F.when(score >= 10, "alto").when(score >= 5, "medio").otherwise("bajo")


def raw_complexity(text: Column) -> Column:
    low = F.lower(text)
    counted = sum(F.regexp_count(low, F.lit(p)) * F.lit(w) for p, w in COMPLEXITY.values())
    return F.least(F.lit(10.0), (F.length(text) / 1000 * 0.1 + counted) / 10)


def complexity(text: Column) -> Column:
    return F.round(raw_complexity(text), 2)


def complexity_level(text: Column) -> Column:
    """By the score before it is rounded."""
    score = raw_complexity(text)
    return F.when(score > 7, "alto").when(score > 4, "medio").otherwise("bajo")


def special_clauses(text: Column) -> Column:
    """The kinds of special clauses present, in the order of SPECIAL."""
    low = F.lower(text)
    return F.filter(F.array(*[F.when(_hits(low, ws) > 0, F.lit(t)) for t, ws in SPECIAL.items()]), lambda x: x.isNotNull())


def dates(text: Column, most: int | None = MAX_DATES) -> Column:
    """Distinct date strings in text order, at most so many (None: all)."""
    every = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({DATES})"), F.lit(1)))
    return every if most is None else F.slice(every, 1, most)


def amounts(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(AMOUNTS), F.lit(1))
    return F.transform(found, lambda a: F.replace(F.replace(a, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).cast("decimal(18,2)"))


def clauses(text: Column) -> Column:
    """Title, length and flags of each clause, cut before every clause heading."""
    parts = F.filter(F.split(text, r"(?=CLÁUSULA [\p{L}\p{N}]+)"), lambda p: p.startswith("CLÁUSULA "))
    return F.transform(parts, lambda p: F.struct(F.trim(F.regexp_extract(p, r"^CLÁUSULA [\p{L}\p{N}]+ *[-–—]? *([^\n]+)", 1)).alias("title"), F.length(F.trim(p)).alias("length"), F.lower(p).rlike("deberá|debe|obligado").alias("has_obligations"), F.lower(p).rlike("penalización|sanción|multa").alias("has_penalties")))
