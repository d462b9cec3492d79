import itertools
import unicodedata

from pliego.llm import forms


def test_examples():
    same = forms.same_form
    assert same("ｃｏｎｔｒａｔｏ １２") == "contrato 12"
    assert same("cо\u200bntra\u00adtо") == "contrato"
    assert same("a\u0301ño\u00a0x\u202fy") == "áño x y"
    assert same("а\u200d\u0301") == "á"
    assert same("ﬁanza") == "fianza"
    assert same("«Ελλάδα»") == same("«Ελλάδα»")
    assert same("Año 1—2 'x'  y") == "Año 1—2 'x'  y"


def test_mapping_is_closed_and_a_second_pass_changes_nothing():
    table = forms.mapping()
    assert not any(c in table for t in table.values() for c in t)
    for c in map(chr, range(0x20, 0x3000)):
        once = forms.same_form("x" + c + "y")
        assert forms.same_form(once) == once
        assert unicodedata.normalize("NFC", once) == once


def test_pairs_against_brute_force(spark):
    texts = ["renta mensual", "rеnta mensual", "renta\u00a0mensual", "Renta mensual", "renta  mensual", "ｒenta mensual", "á", "a\u0301", "a", "", None, "ren\u200bta mensual", "renta mensual"]
    rows = [(f"k{i:02}", t, i) for i, t in enumerate(texts)] + [("k00", texts[0], 0)]
    got = {tuple(r) for r in forms.look_alike_pairs(spark.createDataFrame(rows, "key string, text string, raw int"), "key", "text").collect()}
    want = {(a[0], b[0]) for a, b in itertools.combinations(sorted(set(rows), key=lambda r: r[0]), 2) if a[1] and b[1] and a[1] != b[1] and forms.same_form(a[1]) == forms.same_form(b[1])}
    assert got == want and ("k06", "k07") in got


def test_classes_count_links(spark):
    texts = ["renta", "rеnta", "renta", "ｒenta", "otra", "otra"]
    df = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(texts)], "key string, text string")
    got = {r.key: r.n_links for r in forms.look_alike_classes(forms.form_digests(df, "key", "text")).collect()}
    assert got == {"k0": 2, "k1": 3, "k2": 2, "k3": 3}


def test_empty_table_and_with_form(spark):
    df = spark.createDataFrame([("a", "ｘ"), ("b", None), ("c", "y" * 100_000)], "key string, text string")
    assert forms.look_alike_pairs(df.limit(0), "key", "text").count() == 0
    got = {r.key: r.form for r in forms.with_form(df, "text").collect()}
    assert got["a"] == "x" and got["b"] is None and len(got["c"]) == 100_000
