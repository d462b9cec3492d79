import random

from pliego.llm import pairs

ANSWERS = {
    "es": ["La renta mensual es de {n} euros y se paga por adelantado.", "El contrato dura {n} años, con prórroga anual salvo preaviso.", "El inquilino debe conservar el local y pagar los suministros de la vivienda."],
    "en": ["The monthly rent is {n} euros and it is paid in advance.", "The contract runs for {n} years and then renews every year.", "The tenant must keep the premises in good repair and pay the utilities."],
}
QUERIES = {"es": ["¿Cuál es la renta mensual del contrato ARR/2020/{c}?", "¿Qué duración tiene el contrato ARR/2020/{c}?"], "en": ["What is the monthly rent under contract ARR/2020/{c}?", "How long does contract ARR/2020/{c} run?"]}


def corpus(n=1500, seed=1):
    """Pairs of which some are damaged on purpose, with the defect."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        lang = rng.choice(["es", "es", "en"])
        q = rng.choice(QUERIES[lang]).format(c=f"{rng.randrange(10**8):08}")
        a, defect, r = rng.choice(ANSWERS[lang]).format(n=rng.randint(2, 90)), None, rng.random()
        if r < 0.03:
            a, defect = rng.choice([None, " ", "...", "N/A", "\u200b", "(sin respuesta)"]), "empty"
        elif r < 0.06:
            a, defect = a[: rng.randint(12, len(a) - 4)], "truncated"
        elif r < 0.09:
            a, defect = rng.choice(["Lo siento, no puedo ayudar con esa consulta.", "Prefiero no pronunciarme; consulte con un profesional.", "I'm sorry, but I can't help with that request."]), "refusal"
        elif r < 0.12:
            a, defect = rng.choice([q, q.upper(), f"Pregunta: {q}", f"{q}\n{q}"]), "copied"
        elif r < 0.15:
            a, defect = rng.choice(ANSWERS["en" if lang == "es" else "es"]).format(n=7), "wrong_language"
        elif r < 0.2:
            a = f"Sobre su pregunta («{q}»): {rng.randint(2, 9)} años" if lang == "es" else "Yes."
        rows.append((i, q, a, None if rng.random() < 0.1 else round(rng.uniform(0.2, 0.6) if defect else rng.uniform(0.5, 1), 3), [], defect))
    return rows


def test_cutoffs_on_pairs_damaged_on_purpose(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "response_id long, query string, answer string, confidence double, warnings array<string>, defect string")
    got = {r.response_id: r.primary for r in pairs.label_pairs(df.drop("defect")).collect()}
    for d in pairs.DEFECTS:
        want, have = {r[0] for r in rows if r[5] == d}, {k for k, v in got.items() if v == d}
        assert len(want & have) / len(want) >= 0.9, d
        assert len(want & have) / max(len(have), 1) >= 0.85, d


def test_label_model_finds_the_lead_functions_class():
    patterns = {"1,1,1,0,1": 40, "1,0,1,0,0": 20, "-1,-1,-1,0,0": 900, "-1,-1,0,0,1": 60, "0,0,0,0,1": 30}
    p = pairs.label_model(patterns)
    assert p["1,1,1,0,1"] > 0.9 and p["1,0,1,0,0"] > 0.9 and p["-1,-1,-1,0,0"] < 0.1 and p["0,0,0,0,1"] == 0
    assert pairs.label_model({}) == {}


def test_nulls_and_empty_table(spark):
    schema = "response_id long, query string, answer string, confidence double, warnings array<string>, labels int"
    df = spark.createDataFrame([(1, None, None, None, None, 1), (2, "q", "", 0.1, [], 1), (2, "q", "", 0.1, [], 1)], schema)
    got = sorted((r.response_id, r.primary) for r in pairs.label_pairs(df).collect())
    assert got == [(1, "empty"), (2, "empty"), (2, "empty")]
    assert pairs.label_pairs(df.limit(0)).count() == 0
