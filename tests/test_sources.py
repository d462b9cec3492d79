import io
import json
import zipfile

from pyspark.sql import functions as F

from pliego.sources import loaders
from pliego.streaming import ingest


def test_load_directory(spark, tmp_path):
    sub = tmp_path / "in" / "sub"
    sub.mkdir(parents=True)
    (sub / "a.TXT").write_text("CLÁUSULA PRIMERA\n\nRenta   mensual", encoding="utf-8")
    (sub / "b.txt").write_bytes("año".encode("cp1252"))
    (sub / "c.html").write_text("<html><style>x</style><p>Hola</p><script>y</script><p>mundo</p></html>")
    (sub / "d.csv").write_text("a,b\n1,2\n")
    (sub / "e.docx").write_bytes(b"not a zip")
    (sub / "f.txt").write_text(" \n")
    (sub / "g.xyz").write_text("?")
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Uno</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    (sub / "h.docx").write_bytes(buf.getvalue())
    loaded = loaders.load_directory(spark, str(tmp_path / "in")).cache()
    by = {r.filename: r for r in loaded.collect()}
    assert by["a.TXT"].status == "ok" and by["b.txt"].content == "año"
    assert by["c.html"].content.replace("\n", "") == "Holamundo"
    assert by["h.docx"].content == "Uno\n\n[TABLAS]\n\nx | y"
    assert by["e.docx"].status == "BadZipFile" and by["f.txt"].status == "empty" and by["g.xyz"].status == "unsupported"
    docs = loaders.as_documents(loaded)
    assert docs.count() == 5
    assert docs.where("filename = 'a.TXT'").first().content == "CLÁUSULA PRIMERA\n\nRenta mensual"
    assert loaders.extraction_report(loaded).agg(F.sum("n_files")).first()[0] == 8


def test_append_new_and_stream(spark, tmp_path):
    table = str(tmp_path / "t")
    df = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "2")], "doc_id string, content string")
    loaders.append_new(df, table, "doc_id")
    loaders.append_new(df, table, "doc_id")
    assert spark.read.parquet(table).count() == 2
    spark.createDataFrame([("b", "2"), ("c", "3")], "doc_id string, content string").write.parquet(str(tmp_path / "in"))
    q = ingest.append_documents(ingest.documents_stream(spark, str(tmp_path / "in")), table, str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert sorted(r.doc_id for r in spark.read.parquet(table).collect()) == ["a", "b", "c"]


def test_read_log_skips_bad_lines(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"level": "INFO", "message": "a"}\nnot json\n{"level": "ERROR", "message": "b"}\n')
    assert loaders.read_log(spark, str(tmp_path)).count() == 2


def test_conversations(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c")], "s int, turn int, text string")
    got = {r.s: r.history for r in loaders.conversations(df, "s", "turn", "text").collect()}
    assert got[1] == '[{"turn":1,"text":"a"},{"turn":2,"text":"b"}]'


def test_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(loaders, "BLOCK_TURNS", 7)
    rows = [(1, i, f"«{i}»" if i % 5 else None) for i in range(100)] + [(2, 1, "c"), (None, 1, "d")]
    df = spark.createDataFrame(rows[::-1], "s int, turn int, text string").repartition(5)
    got = sorted((r for r in loaders.conversations(df, "s", "turn", "text").collect()), key=lambda r: (r.s or 0, r.first_turn))
    assert len([r for r in got if r.s == 1]) >= 15 and all(r.n_turns <= 7 and r.n_turns == len(json.loads(r.history)) for r in got)
    assert [(r.s, t["turn"], t.get("text")) for r in got for t in json.loads(r.history)] == sorted(rows, key=lambda r: (r[0] or 0, r[1]))
