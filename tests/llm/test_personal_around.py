"""The part of a window that the network sees."""

import types

from pliego.llm import personal


def test_no_search_beyond_the_end(monkeypatch):
    seen = []
    find = personal.POSSIBLE.finditer
    monkeypatch.setattr(personal, "POSSIBLE", types.SimpleNamespace(finditer=lambda w: (seen.append(m) or m for m in find(w))))
    assert personal.around("paga Ana Ruiz y Luis Gil y Eva Sanz") == (0, 35)
    assert len(seen) == 1  # the first place's context reaches the end


def test_around_first_and_last_place():
    for w in ("x" * 60 + " Ana Ruiz " + "y " * 60 + "000000000 " + "b " * 60, "at", "la arroba", "data", "el letrado R", "xorroba", "don X", "z0000000", "nada aqui", ""):
        places = [m.span() for m in personal.POSSIBLE.finditer(w)]
        low, high = personal.around(w)
        assert (low, high) == (0, 0) if not places else low <= places[0][0] and high >= places[-1][1]
    assert personal.around("data xorroba nada")[1] == 0 and personal.around("la arroba")[1] and personal.around("a at b")[1] and personal.around("el letrado R")[1]
