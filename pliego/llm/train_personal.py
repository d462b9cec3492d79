"""Trains the tagger of personal.py from labelled spans.

    python -m pliego.llm.train_personal CONTRACTS.parquet [second]

Spans are labelled by rules on a bounded sample (TEXTS rows, drawn by hash from all of them) of undamaged contracts, where
cues such as titles and labels make them certain, and the same windows are shown again with other names, in capitals,
with damaged accents and broken lines. Sentences of free phrasing (phrasings.py) stand beside them, so that the tagger
doesn't hang on the contracts' own phrases. Bounds of what is trained on: WITH_SPANS and WITHOUT_SPANS windows of
contracts, SENTENCES others; then the windows that came out wrong are shown again among AGAIN others (second: only
that, from the model as stored). A tenth of the texts, and phrasings and names of their own, are held out; the share of
spans found and of findings right on them is printed.
"""

from __future__ import annotations

import random
import re
import sys

import numpy as np

from pliego.llm import personal, tagger
from pliego.llm.common import model_path
from pliego.llm.personal import KINDS, numbers, signs_of, windows
from pliego.llm.phrasings import invented, sentence

TEXTS = 7000
WITH_SPANS, WITHOUT_SPANS, SENTENCES = 13_000, 7_000, 18_000
HIDDEN = 20
EPOCHS = 6
BATCH, RATE = 128, 0.016
#: Windows beside the hard ones in the second stage.
AGAIN = 16_000
U = "[A-ZÁÉÍÓÚÑ][A-Za-zÁÉÍÓÚÑáéíóúñü]+"
WHOLE = rf"(?:{U} {U}, {U}(?: {U})?|{U}(?: {U}){{1,3}}|{U}|[A-ZÁÉÍÓÚÑ]\. {U}(?: {U})?)"
TITLE = r"(?:\b[Dd]on|\b[Dd]oña|\bD\.|\bDña\.|\bDa\.|\bSr\.|\bSra\.|\b[Ll]a letrada|\b[Ee]l letrado)"
CUES = [
    rf"(?:{TITLE}) (?P<x>{WHOLE})",
    rf"represent(?:ed by|ada por) (?P<x>{U}(?: {U}){{1,3}})",
    rf"contrato [A-Z]{{3}}/\d+/\d+: (?P<x>{U}(?: {U}){{1,3}}), tfno",
    rf"Fdo\.:\s+(?P<x>{WHOLE})",
    rf"(?:, and|, e|, y) (?P<x>{U}(?: {U}){{1,3}}),? (?:holder of|con |mayor de|portador|titular)",
]
STREET = r"(?:\b[Cc]alle|\bC/|\bAvda\.|\b[Aa]venida|\b[Pp]laza|\bPza\.|\b[Pp]aseo|\b[Cc]amino|\b[Rr]onda|\b[Tt]ravesía|\b[Cc]uesta|\b[Cc]arretera|\bRua|\bCALLE|\bPLAZA|\bAVENIDA|\bPASEO|\bCAMINO|\bRONDA|\bTRAVESÍA|\bCUESTA)"
RULES = {
    1: r"[A-Za-z0-9_][\w.+-]*\s?(?:@|\(arroba\)|\[at\]|\(at\)|\[arroba\])\s?[A-Za-z0-9-]+(?:\s?(?:\.|\[punto\]|\(punto\)|\[dot\])\s?[A-Za-z0-9-]+)*\s?(?:\.|\[punto\]|\(punto\)|\[dot\])\s?[A-Za-z]{2,}",
    2: r"(?<![\w/.,-])(?:(?:\(0034\)|\+\d{2}|0034)[ -]?)?(?:\d{3}[ .-]\d{3}[ .-]\d{3}|\d{3} \d{2} \d{2} \d{2}|\d{2}-\d{3}\.\d{2}\.\d{2}|\d{4} \d{6}|\d{9})(?![\w/-]|[.,]\d)",
    3: r"(?<![\w/.-])(?:\d{8}[ -]?[A-Za-z]|\d{2}\.\d{3}\.\d{3}[ -]?[A-Za-z]|[XYZxyz][ -]?\d{7}[ -]?[A-Za-z]|[A-Z]{3}\d{6}|\d{2}[/ -]\d{8}[/ -]\d{2})(?![\w/-])",
    4: STREET + rf" (?:(?:de|del|la|las|los|el|DE|DEL|LA|LAS|LOS|{U}) ?){{1,5}}?,?(?: n\.º| núm\.| nº| N\.º| NÚM\.)? ?\d+(?:, (?:bajo|BAJO|piso \d+, puerta \d+|PISO \d+, PUERTA \d+|\d+\.º [A-Z]))?",
}
NOT_NAMES = re.compile(r"^(?:ARREND|COMPRAD|VENDED|CLIENTE|CONTRAT|PROVEED|GESTOR|PROPIET|PRESTA|FRANQUI|En |Firmad)")


def label(text: str) -> list[tuple[int, int, int]]:
    """Spans (begin, end, kind) that the rules are sure of."""
    flat = text.replace("\n", " ")
    spans = [(m.start(), m.end(), k) for k, r in RULES.items() for m in re.finditer(r, flat)]
    for cue in CUES:
        for m in re.finditer(cue, flat):
            a, b = m.span("x")
            while re.match(TITLE + " ", flat[a:b]):
                a += re.match(TITLE + " ", flat[a:b]).end()
            after = flat[b : b + 7]
            if NOT_NAMES.match(flat[a:b]) or re.match(r",? S\.", after) or re.search(r"(?:Galerías|Centro|Edificio|Residencia|Hijos de) (?:Doña |Don )?$", flat[max(0, a - 22) : a]):
                continue
            spans.append((a, b, 5))
    spans.sort(key=lambda s: (s[0], -s[1]))
    out: list[tuple[int, int, int]] = []
    for s in spans:
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def renamed(text: str, spans: list[tuple[int, int, int]], rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with invented words in its names and streets."""
    out, new, last = "", [], 0
    for a, b, k in spans:
        out += text[last:a]
        value = text[a:b]
        if k == 5:
            value = re.sub(r"[^\W\d_]{2,}", lambda m: (x := invented(rng)) and (x.upper() if m.group().isupper() else x), value)
        elif k == 4:
            value = re.sub(r"(?<=[a-z/.] )[A-ZÁÉÍÓÚ][a-záéíóúñü]{3,}", lambda m: invented(rng), value)
        new.append((len(out), len(out) + len(value), k))
        out += value
        last = b
    return out + text[last:], new


def damaged(signs: str, labels: np.ndarray, rng: random.Random) -> tuple[str, np.ndarray]:
    """Signs as damaged decoding and scanning leave them."""
    out, lab = [], []
    for c, k in zip(signs, labels):
        r = rng.random()
        if c.isalpha() and r < 0.03:
            out += [rng.choice("A~"), rng.choice("~A-'")] if rng.random() < 0.6 else ["~"]
        elif c in "oO" and r < 0.06:
            out.append("0")
        else:
            out.append(c)
        lab += [k] * (len(out) - len(lab))
    return "".join(out), np.array(lab, np.int8)


def examples(texts: list[str], rng: random.Random, again: bool) -> list[tuple[str, np.ndarray]]:
    seen: dict[str, np.ndarray] = {}
    for t in texts:
        spans = label(t)
        for version in range(3 if again else 1):
            text, sp = (t, spans) if version == 0 else renamed(t, spans, rng)
            if version == 2:
                text = text.upper()
            signs, where = signs_of(text)
            flat = np.zeros(len(text), np.int8)
            for a, b, k in sp:
                flat[a:b] = k
            labels = flat if where is None else flat[where]
            for a, b in windows(signs):
                w, l = signs[a:b].replace("\n", " "), labels[a:b]
                if version and not l.any():
                    continue
                if version == 2 and rng.random() < 0.6:
                    continue
                if again and rng.random() < 0.15 and l.any():
                    w, l = damaged(w, l, rng)
                seen.setdefault(w, l)
    return list(seen.items())


def free_examples(rng: random.Random, n: int) -> list[tuple[str, np.ndarray]]:
    """Windows of sentences in free phrasing, one or two together."""
    out = []
    for _ in range(n):
        text, spans = sentence(rng, False)
        if rng.random() < 0.3:
            more, others = sentence(rng, False)
            spans, text = spans + [(a + len(text) + 1, b + len(text) + 1, k) for a, b, k in others], f"{text} {more}"
        labels = np.zeros(len(text), np.int8)
        for a, b, k in spans:
            labels[a:b] = k
        signs, where = signs_of(text)
        labels = labels if where is None else labels[where]
        out += [(signs[a:b].replace("\n", " "), labels[a:b]) for a, b in windows(signs)]
    return out


def held_out_recall(finder: personal.Finder, n: int = 3000, seed: int = 99) -> dict[str, tuple[float, float, int]]:
    """Share found, share right and number of spans by kind, in phrasings and with names that weren't trained on."""
    rng = random.Random(seed)
    rows = [sentence(rng, True) for _ in range(n)]
    want = {(i, KINDS[k], a, b) for i, (_, spans) in enumerate(rows) for a, b, k in spans}
    got = {(i, *f) for i, found in enumerate(finder.find_all([t for t, _ in rows])) for f in found}
    return {k: (len(w & got) / max(len(w), 1), len(w & got) / max(len(g), 1), len(w)) for k in KINDS[1:] if (w := {x for x in want if x[1] == k}) is not None and (g := {x for x in got if x[1] == k}) is not None}


def bare_parties(parties: list[str]) -> list[tuple[str, np.ndarray]]:
    """A bare name in a list of parties, and what may follow it."""
    out = []
    for p in dict.fromkeys(parties):
        signs, where = signs_of(p)
        m = re.match(rf"(?:{TITLE} )?(?P<x>{WHOLE})(?=$|,| -| \(| tel| representad)", p)
        if not m or re.search(r"S\. ?[AL]\.|S\. ?Coop|Hijos de", p[: m.end() + 10]) or where is not None:
            continue
        flat = np.zeros(len(p), np.int8)
        flat[m.start("x") : m.end("x")] = 5
        for a, b, k in label(p):
            flat[a:b] = np.where(flat[a:b] == 0, k, flat[a:b])
        out.append((signs, flat))
    return out


def wrong(params: tagger.Params, data: list[tuple[str, np.ndarray]]) -> list[tuple[str, np.ndarray]]:
    """The windows that a model labels otherwise."""
    data, out = sorted(data, key=lambda x: len(x[0])), []
    for i in range(0, len(data), 256):
        part = data[i : i + 256]
        sym, lens = tagger.padded([numbers(w) for w, _ in part])
        out += [(w, l) for (w, l), row in zip(part, tagger.decode(params, sym, lens)) if not np.array_equal(row[: len(l)], l)]
    return out


def main(path: str, stage: str = "both") -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    rng = random.Random(11)
    spark = SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").getOrCreate()
    rows = spark.read.parquet(path).select("content", F.col("metadata.parties").alias("parties")).orderBy(F.xxhash64("doc_id", "content")).limit(TEXTS).collect()  # TEXTS rows
    spark.stop()
    good = lambda t: t and not re.search(r"[^\x00-\xffŒœ€“”’–—…]|Ã(?!O)|\xad|\xa0", t)
    texts = list(dict.fromkeys(r["content"] for r in rows if good(r["content"])))
    parties = [p for r in rows for p in (r["parties"] or []) if good(p)]
    cut = len(texts) // 10
    bare = bare_parties(parties)
    if stage == "both":
        train = examples(texts[cut:] + parties, rng, True)
        with_spans = [(w, l) for w, l in train if l.any()]
        without = [(w, l) for w, l in train if not l.any()]
        rng.shuffle(with_spans)
        rng.shuffle(without)
        data = with_spans[:WITH_SPANS] + without[:WITHOUT_SPANS] + free_examples(rng, SENTENCES) + bare * 3
        save(tagger.fit(tagger.new_params(len(personal.SIGNS), HIDDEN, len(KINDS)), coded(data), EPOCHS, BATCH, RATE))
    # again with the windows that came out wrong, among others
    rng = random.Random(12)
    params = personal.Finder.load().params
    every = examples(texts[cut:], rng, True) + bare * 2 + free_examples(rng, SENTENCES)
    hard = wrong(params, every)
    print(len(every), "windows,", len(hard), "wrong")
    rng.shuffle(every)
    save(tagger.fit(params, coded(hard * 3 + every[:AGAIN]), 2, BATCH, RATE / 4))
    finder = personal.Finder.load()
    hit = found = gold = 0
    for t, got in zip(texts[:cut], finder.find_all(texts[:cut])):
        want = {(KINDS[k], a, b) for a, b, k in label(t)}
        hit += len(want & set(got))
        found += len(got)
        gold += len(want)
    print(f"held out contracts: {gold} spans, found {hit / max(gold, 1):.4f}, right {hit / max(found, 1):.4f}")
    print("held out phrasings:", {k: tuple(round(x, 4) for x in v) for k, v in held_out_recall(finder).items()})


def coded(data: list[tuple[str, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(numbers(w), l) for w, l in data]


def save(params: tagger.Params) -> None:
    np.savez_compressed(model_path("personal.npz"), **{k: v.astype(np.float16) for k, v in params.items()})


if __name__ == "__main__":
    main(*sys.argv[1:])
