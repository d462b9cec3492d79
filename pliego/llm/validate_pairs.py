"""Validates the cutoffs of pairs.py on pairs damaged on purpose.

    python -m pliego.llm.validate_pairs RESPONSES.parquet

A bounded sample (PAIRS, drawn by hash from all rows) of answers that the labels at a cutoff of a half find whole is damaged
in one of five ways; refusals, placeholders and answers in other languages are phrased here, beside the word lists. All are
labelled together. For each defect the one of CUTOFFS with the best F1 is kept in models/pairs.json, with
its precision and recall on half of the pairs that the choice didn't see.
"""

from __future__ import annotations

import json
import random
import sys

from pliego.llm.common import model_path

PAIRS = 20_000
CUTOFFS = [0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95]
EMPTY = ["", " ", "...", "-", "()", "N/A", "null", "\u200b", "¿?", "[ ]", "(sin respuesta)", "TBD", "—", "***"]
REFUSED = ["Me es imposible atender su petición.", "Eso queda fuera de lo que puedo tratar.", "No me está permitido opinar sobre este asunto.", "Lo siento, pero no voy a responder a eso.", "Prefiero abstenerme de contestar.", "Lamento no poder ayudarle con esta cuestión.", "Unfortunately I am unable to assist with that.", "I would rather not answer this question.", "Sorry, that is not something I can discuss.", "I must decline to comment.", "Não posso responder a essa pergunta.", "Je ne peux pas répondre à cette demande.", "No debo pronunciarme al respecto.", "Declino hacer comentarios."]
ELSEWHERE = {
    "es": ["The tenancy lasts five years and renews unless someone gives notice.", "The landlord keeps the deposit until the keys are returned.", "Le bail dure cinq ans et se renouvelle chaque année.", "O inquilino paga a renda no início de cada mês.", "Der Mieter zahlt die Miete am Anfang des Monats."],
    "en": ["El inquilino paga la renta al principio de cada mes.", "El contrato se prorroga cada año salvo aviso de una de las partes.", "Le bail dure cinq ans et se renouvelle chaque année.", "O inquilino paga a renda no início de cada mês."],
    "pt": ["The landlord keeps the deposit until the keys are returned.", "Le bail dure cinq ans et se renouvelle chaque année."],
    "fr": ["The landlord keeps the deposit until the keys are returned.", "El contrato se prorroga cada año salvo aviso de una de las partes."],
}
DRESS = ["{q}", "«{q}»", "Pregunta: {q}", "{q}\n{q}", "Usted pregunta: {q}", "Q: {q}", "  {q}  "]


def damaged(query: str, answer: str, language: str, rng: random.Random) -> tuple[str, str]:
    """A broken answer and its defect."""
    defect = rng.choice(["empty", "copied", "refusal", "truncated", "wrong_language"])
    if defect == "truncated":
        words = answer.split(" ")
        keep = " ".join(words[: max(3, int(len(words) * rng.uniform(0.4, 0.85)))])
        return (keep[: -rng.randint(1, 3)] if rng.random() < 0.5 else keep).rstrip(" .,;:"), defect
    if defect == "copied":
        q = rng.choice([query, query.upper(), query.lower()])
        return rng.choice(DRESS).format(q=q), defect
    return rng.choice({"empty": EMPTY, "refusal": REFUSED, "wrong_language": ELSEWHERE[language]}[defect]), defect


def best_cutoff(scored: list[tuple[float, bool]]) -> float:
    """The lowest of CUTOFFS with the best F1: beyond them a defect would need more certainty than the model can give."""
    total = sum(y for _, y in scored)

    def f1(cutoff: float) -> float:
        found = [y for p, y in scored if p > cutoff]
        return round(2 * sum(found) / max(len(found) + total, 1), 3)

    return max(CUTOFFS, key=lambda c: (f1(c), -c))


def main(path: str) -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from pliego.llm import pairs

    rng = random.Random(7)
    spark = SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").getOrCreate()
    labelled = pairs.label_pairs(spark.read.parquet(path))
    whole = labelled.where("size(labels) = 0").select("response_id").distinct()
    rows = spark.read.parquet(path).join(whole, "response_id").where("query is not null and length(answer) > 40").dropDuplicates(["query", "answer"]).orderBy(F.xxhash64("response_id")).limit(PAIRS)
    made = []
    for i, r in enumerate(rows.select("query", "answer", "confidence", "warnings").collect()):  # PAIRS rows
        language, _ = pairs.look_at_query(r.query)
        answer, defect = damaged(r.query, r.answer, language, rng) if i % 5 == 0 and language in ELSEWHERE else (r.answer, None)
        made.append((i, r.query, answer, r.confidence, r.warnings, defect))
    df = spark.createDataFrame(made, "response_id long, query string, answer string, confidence double, warnings array<string>, defect string")
    got = {r.response_id: {p.defect: p.posterior for p in r.posteriors} for r in pairs.label_pairs(df.drop("defect")).collect()}
    out = {}
    for d in pairs.DEFECTS:
        seen = [(got[i][d], defect == d) for i, *_, defect in made if i % 2 == 0]
        held = [(got[i][d], defect == d) for i, *_, defect in made if i % 2]
        at = best_cutoff(seen)
        found = [y for p, y in held if p > at]
        out[d] = {"cutoff": round(at, 4), "precision": round(sum(found) / max(len(found), 1), 4), "recall": round(sum(found) / max(sum(y for _, y in held), 1), 4)}
    with open(model_path("pairs.json"), "w", encoding="utf-8") as f:
        json.dump(out, f, indent=1)
    print(out)


if __name__ == "__main__":
    main(sys.argv[1])
