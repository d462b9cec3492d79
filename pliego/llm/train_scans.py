"""Trains the models of scans.py on clean text that is damaged on purpose.

    python -m pliego.llm.train_scans CONTRACTS.parquet

A bounded sample of texts (TEXTS, drawn by hash from all rows) gives the words; everything else at run time covers all texts.
"""

from __future__ import annotations

import json
import random
import re
import sys
from collections import Counter, defaultdict

from pliego.llm.common import model_path
from pliego.llm.scans import CONFUSIONS, EDGE, HYPHENS, NUMBER_LINE, Perceptron, join_features, line_features, normal_line, replacements, sign_features

TEXTS = 8000
#: Of these, so many are set in pages for the line model.
LINE_TEXTS = 4000
COMMON = 15


def damage(word: str, rng: random.Random, times: int = 1) -> tuple[str, list[tuple[str, str]]] | None:
    """A damaged word, and the sign-wise operations that undo it."""
    at = [(m.start(), right, read) for right, read in CONFUSIONS for m in re.finditer(re.escape(right), word)]
    rng.shuffle(at)
    chosen: list[tuple[int, str, str]] = []
    for i, right, read in at:
        if len(chosen) < times and all(i + len(right) <= j or i >= j + len(r) for j, r, _ in chosen):
            chosen.append((i, right, read))
    if not chosen:
        return None
    ops: list[tuple[str, str]] = []
    i, by = 0, {c[0]: c for c in chosen}
    while i < len(word):
        if i in by:
            _, right, read = by[i]
            ops += [(read[0], f"R:{right}"), *((c, "D") for c in read[1:])]
            i += len(right)
        else:
            ops.append((word[i], "K"))
            i += 1
    return "".join(c for c, _ in ops), ops


def editor_data(words: Counter, rng: random.Random) -> list[tuple[list[str], str]]:
    data, may = [], replacements()
    known = set(words)

    def put(word: str, ops: list[str]) -> None:
        data.extend((sign_features(word, i), op) for i, (c, op) in enumerate(zip(word, ops)) if c in may)

    for w, n in words.items():
        for _ in range(3 if n > 100 else 2):
            put(w, ["K"] * len(w))
        for _ in range(10):
            d = damage(w, rng, 1 if rng.random() < 0.8 else 2)
            if d and d[0] not in known:
                put(d[0], [op for _, op in d[1]])
    return data


def join_data(words: Counter, rng: random.Random) -> list[tuple[list[str], str]]:
    data = []
    plain = [w for w in words if len(w) >= 6 and w.isalpha()]
    for w in plain:
        for _ in range(4):
            i = rng.randint(2, len(w) - 2)
            data.append((join_features(w[:i], rng.choice(HYPHENS), w[i:], rng.random() < 0.2), "J"))
    compounds = [w for w in words if "-" in w and all(len(p) > 1 for p in w.split("-"))]
    for w in compounds * 4:
        a, b = w.split("-")[:2]
        data.append((join_features(a, "-", b, False), "K"))
    for _ in range(len(plain)):
        a, b = rng.choice(plain), rng.choice(plain)
        data.append((join_features(a, "-", b.capitalize() if rng.random() < 0.5 else b.upper(), False), "K"))
    return data


def page(text: str, rng: random.Random) -> tuple[list[str], list[str]]:
    """A clean text set in pages, with the class of each line."""
    width, lines = rng.randint(55, 80), []
    for para in text.split("\n"):
        line = ""
        for w in para.split(" "):
            if line and len(line) + len(w) + 1 > width:
                lines.append(line)
                line = w
            else:
                line = f"{line} {w}".strip() if line else w
        lines.append(line)
    company = rng.choice(["Talleres Ortega S.A.  |  Archivo general", "Registro de la Torre de Arriba del Monte · Protocolo 8123", "PROMOCIONES DEL SUR S.L.U.", "Contrato ARR/2021/00007777 - Archivo Sierra", "ARCHIVO SIERRA", "Notaría de Alta Sierra · Protocolo 911", "COPIA SIMPLE    GES/2016/00000888", "COPIA SIMPLE    COM/2022/00001234", "ARCHIVO GENERAL", "Notaría de Ribera · Protocolo 4411", "Bufete Salcedo S.L. | Archivo", "COPIA    FRA/2021/00000574", "Contrato SER/2020/00004421 - Talleres Ortega S.A.", "TALLERES ORTEGA S. COOP.", "Registro Mercantil, tomo 12", "Inmobiliaria Norte S.L.U.  |  Archivo general", "COPIA SIMPLE    ARR/2019/00000011"])
    style, header, number, lower = rng.randrange(6), rng.random() < 0.7, rng.random() < 0.7, rng.random() < 0.5
    roman = "i ii iii iv v vi vii viii ix x xi xii xiii xiv xv xvi".split()
    out, kinds, n, size, used = [], [], rng.randint(1, 14), rng.randint(9, 26), 0
    pages = rng.random() < 0.75

    def furnish() -> None:
        nonlocal n
        blank = rng.random() < 0.3
        first = rng.random() < 0.5
        if header and first:
            out.append(company if rng.random() < 0.8 else company.replace(" ", "  ", 1))
            kinds.append("H")
        if number:
            s = [f"Página {n}", f"Pág. {n} de {n + 3}", f"- {n} -", f"{n}/{n + 2}", str(n), roman[n % 16]][style] if rng.random() < 0.9 else f"Folio {n} vto."
            out.append(s)
            kinds.append("N")
        if header and not first:
            out.append(company if rng.random() < 0.8 else re.sub(" +", " ", company))
            kinds.append("H")
        if blank:
            out.append("")
            kinds.append("K")
        n += 1

    if pages and header and rng.random() < 0.3:
        furnish()
    for line in lines:
        if pages and used >= size and line:
            furnish()
            used = 0
        out.append(line)
        kinds.append("K")
        used += 1
    if pages and used and lower:
        furnish()
    return out, kinds


def line_data(texts: list[str], rng: random.Random) -> list[tuple[list[str], str]]:
    data = []
    for t in texts:
        if rng.random() < 0.3:  # text that repeats its own lines
            ls = [x for x in t.split("\n") if x.strip()[-1:] in ".:;," or x.strip()[:1] in "-[" or re.match(r"\d", x)]
            if ls:
                t = t + "\n" + "\n".join(rng.choices(ls, k=4))
            t = re.sub(r"\n(?=\S)", lambda m: "\nSER/2020/00004421.\n" if rng.random() < 0.15 else m.group(), t)
        lines, kinds = page(t, rng)
        seen = defaultdict(list)
        for i, x in enumerate(lines):
            if len(key := normal_line(x)) >= 4:
                seen[key].append(i)
        for i, (x, kind) in enumerate(zip(lines, kinds)):
            s = x.strip()
            if s and (NUMBER_LINE.fullmatch(s) or len(seen.get(normal_line(s), ())) >= 2):
                data.append((line_features(lines, i, seen), kind))
    return data


def main(path: str) -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    rng = random.Random(20)
    spark = SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").getOrCreate()
    rows = spark.read.parquet(path).where("content <> ''").select("content").distinct().orderBy(F.xxhash64("content")).limit(TEXTS).collect()  # TEXTS rows
    spark.stop()
    texts = [r.content for r in rows]
    counts: Counter = Counter()
    for t in texts:
        counts.update({w.strip(EDGE) for w in t.split()})
    clean = re.compile("[a-zA-ZáéíóúüñÁÉÍÓÚÜÑàâãçêôõÀÂÃÇÊÔÕ]{3,}(?:-[a-zA-ZáéíóúüñÁÉÍÓÚÜÑàâãçêôõÀÂÃÇÊÔÕ]+)?")
    words = Counter({w: n for w, n in counts.items() if n >= COMMON and clean.fullmatch(w)})
    editor = Perceptron.train(editor_data(Counter({w: n for w, n in words.items() if w.isalpha()}), rng), 4)
    joins = Perceptron.train(join_data(words, rng), 5)
    def repeats(t: str) -> bool:
        seen = Counter(normal_line(x) for x in t.split("\n") if x.strip()[-1:] not in (".", ":", ";", ",") or x.strip().isupper())
        return any(n > 1 and len(k) >= 4 for k, n in seen.items())

    plain = [t for t in texts if not repeats(t) and not re.search("[�Ã├√]", t) and not re.search(f"[{HYPHENS}]\\s*\n", t) and not any(NUMBER_LINE.fullmatch(x.strip()) for x in t.split("\n") if x.strip())]
    lines = Perceptron.train(line_data(plain[:LINE_TEXTS], rng), 8)
    with open(model_path("scans.json"), "w", encoding="utf-8") as f:
        json.dump({"editor": editor.weights, "joins": joins.weights, "lines": lines.weights}, f, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    print(len(words), {k: len(m.weights) for k, m in (("editor", editor), ("joins", joins), ("lines", lines))})


if __name__ == "__main__":
    main(sys.argv[1])
