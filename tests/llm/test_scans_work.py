"""What the examination of scanned text looks at, and that shorter ways give the same."""

import random

from pliego.llm import scans


def test_words_of_lines_are_edited_once():
    r = scans.Repairer.load()
    text = "\n".join(f"la renta mensual del contrato queda pactada en la clausula {i}" for i in range(300)) + "\nel arrendatari0 debera pagar"
    calls, edit = [], r.editor.edit
    r.editor.edit = lambda w: calls.append(w) or edit(w)
    _, found = r.candidates(text)
    assert ("misread", "arrendatari0", "arrendatario") in found
    assert len(calls) < 100  # distinct words, not the words of all lines


def test_normal_line():
    rng = random.Random(1)
    signs = [chr(i) for i in range(1, 0x250)] + list("–—“”’‘€…‐σΣς�ǅ😀İ")
    for _ in range(20_000):
        line = "".join(rng.choices(signs, k=rng.randint(0, 12)))
        assert scans.normal_line(line) == line.lower().translate(scans.NORMAL)
