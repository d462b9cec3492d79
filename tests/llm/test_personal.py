import numpy as np

from pliego.llm import personal, queries, tagger, train_personal


def test_gradient_is_right():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in tagger.new_params(6, 3, 4, seed=2).items()}
    sym, lens = rng.integers(0, 6, (3, 5)).astype(np.uint8), np.array([5, 3, 4])
    gold = rng.integers(0, 4, (3, 5)).astype(np.int8)
    _, grads = tagger.gradients(p, sym, lens, gold)
    for k, at in (("U", (0, 1, 2)), ("U", (1, 2, 7)), ("W", (1, 2)), ("A", (0, 3)), ("b", (1,)), ("s", (2,))):
        def loss(by, k=k, at=at):
            q = {x: y.copy() for x, y in p.items()}
            q[k][at] += by
            return tagger.gradients(q, sym, lens, gold)[0]

        step = 1e-2
        assert abs((loss(step) - loss(-step)) / (2 * step) - grads[k][at]) < 5e-3


def test_decode_takes_the_best_path():
    import itertools

    rng = np.random.default_rng(1)
    p = tagger.new_params(6, 3, 3, seed=5)
    p = {k: v + rng.normal(0, 0.7, v.shape).astype(np.float32) for k, v in p.items()}
    sym, lens = rng.integers(0, 6, (8, 5)).astype(np.uint8), np.array([5, 4, 3, 2, 1, 5, 5, 5])
    states, _ = tagger.hidden_states(p, sym, lens)
    e = states @ p["W"] + p["b"]
    got = tagger.decode(p, sym, lens)
    for i, n in enumerate(lens):
        score = lambda y: p["s"][y[0]] + sum(e[t, i, y[t]] for t in range(n)) + sum(p["A"][y[t - 1], y[t]] for t in range(1, n))
        best = max(score(y) for y in itertools.product(range(3), repeat=int(n)))
        assert abs(score(got[i, :n]) - best) < 1e-4


def test_finds_kinds_with_other_names():
    text = "De una parte, Dña. Marisa Colmenar Trujeda, mayor de edad, con DNI 91.234.567-K y domicilio en Calle del Olivo Seco, 12, 3.º B, de Lirma, y Talleres Ondavera S.L., con CIF B-25449672. Contacto del contrato ARR/2020/00000017: Marisa Colmenar, tfno. +34 572 500 262, correo marisa.colmenar@tresmar.test, dirección Plaza Mayor 4, Lirma."
    found = [(k, text[a:b]) for k, a, b in personal.Finder.load().find_all([text])[0]]
    assert ("name", "Marisa Colmenar Trujeda") in found and ("id_number", "91.234.567-K") in found
    assert ("phone", "+34 572 500 262") in found and ("email", "marisa.colmenar@tresmar.test") in found
    assert ("address", "Calle del Olivo Seco, 12, 3.º B") in found
    assert not any("Talleres" in t or "B-25449672" in t for _, t in found)


def test_unseen_phrasings_and_names():
    for kind, (found, right, n) in train_personal.held_out_recall(personal.Finder.load(), 1200, seed=5).items():
        assert n > 50 and found >= 0.9 and right >= 0.9, kind


def test_skipped_windows_could_hold_nothing():
    """Every form that a kind can have lies in a window that is labelled."""
    rng = train_personal.random.Random(4)
    for _ in range(2000):
        text, spans = train_personal.sentence(rng, False)
        signs, where = personal.signs_of(text)
        for kind in ("email", "phone", "id_number", "address"):
            for m in personal.FORMS[kind].finditer(signs):
                assert personal.POSSIBLE.search(signs), (kind, m.group())
    assert not personal.POSSIBLE.search("La renta se paga por meses y por adelantado, salvo pacto")


def test_long_texts_are_reconciled_over_windows():
    filler = "y así sucesivamente con los mismos términos que constan en la escritura que las partes conocen, " * 40
    text = filler + "representada por don Teodoro Robledanca Valdrojo, con DNI 91667834T, " + filler
    found = [(k, text[a:b]) for k, a, b in personal.Finder.load().find_all([text])[0]]
    assert ("name", "Teodoro Robledanca Valdrojo") in found and ("id_number", "91667834T") in found


def test_tables(spark):
    rows = [("a", "Fdo.: Lucía Heredizo Cantolla", ["don Lucía Heredizo Cantolla", None, ""]), ("a", "Fdo.: Lucía Heredizo Cantolla", None), ("b", None, []), ("c", "", None)]
    df = spark.createDataFrame(rows, "doc_id string, content string, parties array<string>").withColumnRenamed("doc_id", "kind")
    got = sorted(tuple(r) for r in personal.find_personal(df, "kind", {"content": "content", "parties": "parties"}).collect())
    assert got == [("a", "content", "name", "Lucía Heredizo Cantolla"), ("a", "parties", "name", "Lucía Heredizo Cantolla")]
    assert personal.find_personal(df.limit(0), "kind", {"content": "content"}).count() == 0
    red = {r.kind: r.redacted for r in personal.redact(df, "content").collect()}
    assert red["a"] == "Fdo.: [NAME]" and red["b"] is None


def test_redacted_parties(spark, tmp_path):
    rows = [("a", "Fdo.: Lucía Heredizo Cantolla", (["don Lucía Heredizo Cantolla", None, "", "Talleres Ondavera S.L."],)), ("b", None, (None,)), ("c", "", ([],))]
    df = spark.createDataFrame(rows + rows[:1], "doc_id string, content string, metadata struct<parties: array<string>>")
    df.write.parquet(str(tmp_path / "contracts.parquet"))
    got = sorted(tuple(r) for r in queries.p2_redacted(spark, str(tmp_path)).collect())
    assert got == [("a", "Fdo.: [NAME]", ["don [NAME]", None, "", "Talleres Ondavera S.L."]), ("b", None, None), ("c", "", [])]
