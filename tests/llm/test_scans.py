from pliego.llm import scans

BODY = ["El contrato tendrá una duración de cinco años, con prórrogas", "anuales salvo aviso en contra con cuatro meses de antelación,", "y el arrendatario deberá conservar las instalaciones y pagar", "los suministros de agua y luz que procedan en cada momento", "según la factura que presente la compañía distribuidora y con", "cargo a la cuenta que se designe en el anexo del contrato."]


def pages(lines):
    return "\n".join(x for n in range(1, 5) for x in [*lines, "", "ARCHIVO SALCEDO S.L.  |  Archivo general", f"Página {n}", ""])


def test_furniture_and_plain_repeats():
    r = scans.Repairer.load()
    assert r.candidates(pages(BODY))[0] == {"H", "N"}
    assert r.candidates("\n".join(["[Página 1]", *BODY, "[Página 2]", *BODY[:3]]))[0] == set()
    assert r.candidates("- uno\n- dos\n- tres\n\n1. OBJETO\ntexto normal.\n2. PRECIO\notro texto.")[0] == set()


def test_wide_headers_and_many_digits():
    r = scans.Repairer.load()
    for width in (60, 95, 120):
        head = "ARCHIVO GENERAL DE CONTRATOS Y ESCRITURAS DE LA SOCIEDAD SALCEDO HERMANOS S.L.  |  COPIA SIMPLE DEL EXPEDIENTE DE LA NOTARÍA"[:width].strip()
        text = pages(BODY).replace("ARCHIVO SALCEDO S.L.  |  Archivo general", head)
        assert "H" in r.candidates(text)[0], width
    assert list(scans.words_in("las 1ns1a1aciones y c0nd1c10nes de 12345678 y B1234567")) == ["las", "1ns1a1aciones", "c0nd1c10nes"]


def test_found_and_repaired(spark):
    clean = [(f"c{i}", " ".join(BODY) + " El contrato y su duración se rigen por la cláusula.") for i in range(20)]
    odd = [("h", "El arrendatario deberá conser-\nvar las instalaciones"), ("m", "El c0ntrato y su duraci6n"), ("n", None), ("e", ""), ("x", "conser-var")]
    df = spark.createDataFrame(clean + odd + odd, "doc_id string, text string").withColumnRenamed("text", "kind")
    got = sorted(tuple(r) for r in scans.find_noise(df, "doc_id", "kind").collect())
    assert got == [("h", "hyphenation"), ("m", "misread")]
    fixed = {r.doc_id: r.repaired for r in scans.repair(df, "doc_id", "kind").collect()}
    assert fixed == {"h": "El arrendatario deberá conservar las instalaciones", "m": "El contrato y su duración"}
    assert scans.find_noise(df.limit(0), "doc_id", "kind").count() == 0


def test_perceptron_learns():
    data = [([f"a{x}", f"b{y}"], "J" if x == y else "K") for x in range(2) for y in range(2)] * 5
    data = [(f + ["".join(f)], c) for f, c in data]
    model = scans.Perceptron.train(data, 10)
    assert all(model.predict(f) == c for f, c in data)


def test_copies_of_a_misread_text(spark):
    clean = [(f"c{i}", f"El contrato y su duración número {i}") for i in range(20)]
    copies = [(f"m{i}", "El c0ntrato y su duraci6n") for i in range(10)]
    df = spark.createDataFrame(clean + copies, "doc_id string, text string")
    assert sorted(tuple(r) for r in scans.find_noise(df, "doc_id", "text").collect()) == [(d, "misread") for d, _ in copies]
    assert {tuple(r) for r in scans.repair(df, "doc_id", "text").select("doc_id", "repaired").collect()} == {(d, "El contrato y su duración") for d, _ in copies}
