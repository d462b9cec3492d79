import random

from pliego.llm import cuts


def corpus(n=3000, seed=1):
    rng, rows = random.Random(seed), []
    subjects = ["La empresa contratista", "El perito designado", "La parte arrendadora", "El comité de seguimiento"]
    verbs = ["conserva archivada la póliza", "deberá revisar el presupuesto", "ha remitido el borrador", "puso en duda el inventario"]
    tails = ["a la espera de la firma del notario", "por falta de documentación acreditativa", "para evitar nuevas penalizaciones"]
    for i in range(n):
        text = " ".join(f"{rng.choice(subjects)} {rng.choice(verbs)} {rng.choice(tails)}." for _ in range(rng.randint(3, 8)))
        text += rng.choice(["", "", f"\nRef.: {rng.randint(2015, 2025)}/{rng.randint(10000, 99999)}", "\nOficina de Valmera", "\n- Cerrar parte"])
        cut = rng.random() < 0.06
        if cut:
            body = text.split("\n")[0]
            text = body[: rng.randint(60, len(body) - 12)].rstrip(".") + rng.choice(["", "", "…", "..."])
        rows.append((i, text, "es", rng.choice(["a", "b", None]), cut))
    return rows


def test_held_against_texts_cut_on_purpose(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, was_cut boolean").withColumnRenamed("was_cut", "cut")
    got = {r.doc_id for r in cuts.find_cuts(df).where("cut").collect()}
    want = {r[0] for r in rows if r[4]}
    # a cut that leaves a whole sentence can't be told
    assert len(got & want) / len(want) > 0.9 and len(got & want) / len(got) > 0.95


def test_trailing_blanks_and_many_languages(spark):
    """Fields padded with blanks are judged as without them, and dirty language values hide no one's threshold."""
    rows = [(i, t + " " * 60 + "\n", f"x{i}" if i % 3 == 0 else "es", s, c) for i, t, _, s, c in corpus()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, was_cut boolean")
    got = {r.doc_id for r in cuts.find_cuts(df).where("cut").collect()}
    want = {r[0] for r in rows if r[4]}
    assert len(got & want) / len(want) > 0.9 and len(got & want) / len(got) > 0.95


def test_odds_against_plain_counts(spark):
    texts = [t for _, t, *_ in corpus(200)]
    model = cuts.EndModel.train(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    odds = {r.tail: r.log_odds for r in model.odds.collect()}
    tails, folded = [cuts.tail(t) for t in dict.fromkeys(texts)], [cuts.folded(t.rstrip()) for t in texts]
    import math

    for want in list(odds)[:40]:
        p = len(tails) / sum(map(len, folded))
        for order in cuts.ORDERS:
            if order <= len(want):
                context = want[-order:]
                ended = sum(t.endswith(context) for t in tails) - 1
                goes_on = sum(f.startswith(context, i) and i + order < len(f) for f in folded for i in range(len(f)))
                p = (ended + cuts.PRIOR * p) / (ended + goes_on + cuts.PRIOR)
        assert abs(odds[want] - (math.log(p) - math.log1p(-p))) < 1e-6


def test_blank_and_empty(spark):
    df = spark.createDataFrame([(1, None, None, None), (2, "", "es", "a"), (3, " \n", "es", "a"), (4, "x" * 50_000 + ".", "es", "a")], "doc_id long, text string, lang string, source string")
    assert not any(r.cut for r in cuts.find_cuts(df).collect() if r.doc_id < 4)
    assert cuts.find_cuts(df.limit(0)).count() == 0
