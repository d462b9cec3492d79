import pytest

from pliego.llm import encoding

TEXT = "La duración será de dos años según la cláusula TERCERA - RESOLUCIÓN, más 50 € de interés"


@pytest.mark.parametrize("read", ["cp1252", "cp850", "mac_roman", "cp1251"])
def test_round_trip(read):
    table = encoding.decoder(read)
    damaged = "".join(table[b] for b in TEXT.encode("utf-8"))
    out, n = encoding.decode_spans(damaged)
    assert n > 0 and out == TEXT


def test_damaged_twice():
    damaged = "duración según".encode().decode("cp1252").encode("utf-8").decode("cp1252")
    assert encoding.decode_spans(damaged)[0] == "duración según"


def test_damaged_many_times():
    for times in (3, 4):
        damaged = "duración según"
        for _ in range(times):
            damaged = damaged.encode().decode("cp1252", "strict") if all(b not in damaged.encode() for b in (0x81, 0x8D, 0x8F, 0x90, 0x9D)) else damaged.encode().decode("latin-1")
        assert encoding.decode_spans(damaged)[0] == "duración según", times


def test_correct_text_stays():
    for t in (TEXT, "São Paulo, NÃO CONCORRÊNCIA", "Größe garçon Âme d'Été", "«Ελλάδα Πλοία»", "21 °C ± 2, 3¾, 50 ¢ y 40 m²", "Еѕcorial", "", "Сіudad"):
        assert encoding.decode_spans(t) == (t, 0)


def test_found_and_restored(spark):
    clean = [(f"c{i}", "Tras la duración pactada, la resolución y el interés de la cláusula") for i in range(60)]
    odd = [("latin", "la duraci¾n y la resoluci¾n"), ("mac", "la duraci—n pactada"), ("utf", "la duraciÃ³n"), ("lost", "la duraci�n"), ("ok", "3¾ pulgadas — y más"), ("n", None), ("e", "")]
    df = spark.createDataFrame(clean + odd + odd, "doc_id string, content string").withColumnRenamed("content", "text")
    assert sorted(r.doc_id for r in encoding.find_damaged(df, "doc_id", "text").collect()) == ["latin", "lost", "mac", "utf"]
    got = {r.doc_id: r.restored for r in encoding.restore(df, "doc_id", "text").collect()}
    assert got == {"latin": "la duración y la resolución", "mac": "la duración pactada", "utf": "la duración"}
    assert encoding.find_damaged(df.limit(0), "doc_id", "text").count() == 0


def test_copies_and_rare_words(spark):
    clean = [(f"c{i}", f"Tras la duración pactada número {i}") for i in range(20)]
    copies = [(f"copy{i}", "la duraci—n del encargo") for i in range(10)]
    rare = [("rare", "en la finca Pe¤alba"), ("lone", "Ａ — b, 5 ¢ y US$ o 3¾ de l·l"), ("dash", "Madrid—Burgos")]
    df = spark.createDataFrame(clean + copies + rare, "doc_id string, text string")
    want = sorted([d for d, _ in copies] + ["rare"])
    assert sorted(r.doc_id for r in encoding.find_damaged(df, "doc_id", "text").collect()) == want
    got = {r.doc_id: r.restored for r in encoding.restore(df, "doc_id", "text").collect()}
    assert got == {d: "la duración del encargo" for d, _ in copies} | {"rare": "en la finca Peñalba"}
