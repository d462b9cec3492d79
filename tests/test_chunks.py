"""Chunking against plain Python."""

import random
import re

from pliego.operators import chunks as ch


def packed(text, size, overlap):
    pieces = []
    for p in re.split(r"\n\s*\n", text):
        w = p.split()
        if len(w) > size:
            pieces += [w[i : i + size] for i in range(0, len(w) - overlap, size - overlap)]
        elif w:
            pieces.append(p.strip(" "))
    done, open_ = [], []
    count = lambda x: len(x) if isinstance(x, list) else len(x.split())
    for x in pieces:
        if open_ and sum(map(count, open_)) + count(x) > size:
            done.append(open_)
            open_ = [open_[-1]] if count(open_[-1]) + count(x) <= size else []
        open_ = [*open_, x]
    if open_:
        done.append(open_)
    return ["\n\n".join(" ".join(x) if isinstance(x, list) else x for x in c) for c in done]


def text_of(rng):
    return "\n\n".join(" ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice([1, 3, 5, 9, 40]))) for _ in range(rng.randint(0, 12)))


def test_packed_paragraphs(spark):
    rng = random.Random(1)
    texts = [text_of(rng) for _ in range(60)] + ["", "  \n\n "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in ch.packed_paragraphs(df, "doc_id", "text", 12, 4).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r.content)
    for i, t in enumerate(texts):
        assert got.get(i, []) == packed(t, 12, 4)
        assert all(len(c.split()) <= 12 for c in got.get(i, []))


def test_sections_and_ids(spark):
    text = "prólogo\n" + "".join(f"CLÁUSULA {n} - COSA\ntexto de {n}\n\n" + " ".join(["larga"] * 30) + "\n" for n in ("PRIMERA", "SEGUNDA", "TERCERA"))
    df = spark.createDataFrame([("a", text), ("b", "sin partes"), ("c", ""), ("d", None)], "doc_id string, text string")
    rows = ch.chunk_documents(df, "doc_id", "text", 16, 4).orderBy("doc_id", "chunk_index").collect()
    a = [r for r in rows if r.doc_id == "a"]
    assert [r.chunk_index for r in a] == list(range(len(a))) and all(r.n_tokens <= 16 for r in a)
    assert {r.title for r in a} == {f"CLÁUSULA {n} - COSA" for n in ("PRIMERA", "SEGUNDA", "TERCERA")}
    assert all(text[r.start_char :].startswith(r.title) for r in a) and not any("prólogo" in r.content for r in a)
    assert all(re.fullmatch(rf"a_chunk_{r.chunk_index}_[0-9a-f]{{6}}", r.chunk_id) for r in a)
    assert [(r.content, r.title) for r in rows if r.doc_id == "b"] == [("sin partes", None)]
    assert not [r for r in rows if r.doc_id in "cd"]
