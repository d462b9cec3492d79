"""Noise in text that came from scanned pages: repair into continuous paragraphs.

Two averaged perceptrons, trained by train_scans on clean text that is damaged on purpose, do the work:

* the line model tells running headers and page numbers from text by page-position features: how often a line comes
  back in its text and at what distance, whether it interrupts a sentence, blank lines and other furniture around it;
* the character editor goes through a word sign by sign and predicts to keep, delete or replace it (a replacement may
  insert signs), and at a hyphen before a line end whether to join the lines.

An exact check follows: an edited or joined word must be known to the corpus, in at least KNOWN texts and RATIO times
as many as the form found. Word counts cover all texts; each task counts its own and Spark sums them. Copies of a text
are looked at once, and the form found counts once for all of them, so that they can't outvote the right word.
Repeated words are edited once a task. Texts are read whole.

Null and empty texts have no noise. The loader's own page marks, plain line ends, lists and hyphenated words stay.
"""

from __future__ import annotations

import functools
import json
import random
import re
import string
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pliego.llm.common import cut_lineage, model_path

KNOWN = 4
RATIO = 3
MEMO_WORDS = 300_000
COUNT_WORDS = 400_000
#: What scanning makes of letters (right, read).
CONFUSIONS = [("o", "0"), ("O", "0"), ("l", "1"), ("l", "|"), ("i", "1"), ("S", "5"), ("B", "8"), ("ó", "6"), ("a", "@"), ("e", "c"), ("m", "rn"), ("n", "ri"), ("rn", "m"), ("u", "ii"), ("t", "f"), ("g", "q"), ("I", "l"), ("I", "1"), ("cl", "d"), ("ci", "d"), ("d", "cl"), ("é", "è"), ("c", "e"), ("h", "b"), ("b", "h"), ("vi", "w"), ("E", "F"), ("Z", "2"), ("z", "2"), ("s", "5"), ("g", "9"), ("nn", "m"), ("ni", "m"), ("in", "m"), ("á", "a'"), ("f", "t"), ("li", "h")]
HYPHENS = "-‐¬\xad"
LETTERS = "a-zA-ZáéíóúüñÁÉÍÓÚÜÑàâãçêôõÀÂÃÇÊÔÕè"
EDGE = ".,;:()«»\"'[]¿?¡!“”…"
TOKEN = re.compile(f"[{LETTERS}0-9@|'-]*[{LETTERS}][{LETTERS}0-9@|'-]*")
PAGE_MARK = re.compile(r"\[\w+ \d+\]")
NUMBER_LINE = re.compile(r"(?i)(?:[-–—·.\s]*)(?:(?:p[áa]g(?:ina|\.)?|p\.|page|hoja|fol(?:io|\.)?|f\.)\s*)?(?:n[.ºo°]*\s*)?(\d{1,4}|[ivxlc]{1,7})(?:\s*(?:/|de|of|-)\s*\d{1,4})?(?:\s*(?:vto|v|r|recto|vuelto)\.?)?(?:[-–—·.\s]*)")


class Perceptron:
    """Weights by feature and class; predict takes the best class, keep on ties."""

    def __init__(self, weights: dict[str, dict[str, float]]) -> None:
        self.weights = weights

    def scores(self, features: list[str]) -> dict[str, float]:
        total: dict[str, float] = {}
        for f in features:
            for c, w in self.weights.get(f, {}).items():
                total[c] = total.get(c, 0.0) + w
        return total

    def predict(self, features: list[str], allowed: frozenset[str] | None = None) -> str:
        s = self.scores(features)
        best, top = "K", s.get("K", 0.0)
        for c, v in s.items():
            if v > top and (allowed is None or c in allowed):
                best, top = c, v
        return best

    @classmethod
    def train(cls, data: list[tuple[list[str], str]], epochs: int, seed: int = 7) -> Perceptron:
        """Averaged weights over all updates."""
        w: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        total: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        last: dict[tuple[str, str], int] = {}
        order, step, rng = list(range(len(data))), 0, random.Random(seed)
        model = cls(w)

        def add(f: str, c: str, by: float) -> None:
            total[f][c] += (step - last.get((f, c), 0)) * w[f][c]
            last[f, c] = step
            w[f][c] += by

        for _ in range(epochs):
            rng.shuffle(order)
            for i in order:
                features, right = data[i]
                step += 1
                guess = model.predict(features)
                if guess != right:
                    for f in features:
                        add(f, right, 1.0)
                        add(f, guess, -1.0)
        out: dict[str, dict[str, float]] = {}
        for f, by in w.items():
            kept = {c: round(v, 2) for c in by if abs(v := (total[f][c] + (step - last[f, c]) * w[f][c]) / step) >= 0.05}
            if kept:
                out[f] = kept
        return cls(out)


# --- the character editor ---------------------------------------------------------------------------------------------


def sign_features(word: str, i: int) -> list[str]:
    p = f"^^^{word}$$$$"
    j = i + 3
    c = p[j]
    return ["b", f"0{c}", f"1{p[j - 1]}{c}", f"2{c}{p[j + 1]}", f"3{p[j - 1 : j + 2]}", f"4{p[j - 2 : j + 1]}", f"5{p[j : j + 3]}", f"6{p[j - 2 : j + 2]}", f"7{p[j - 1 : j + 3]}", f"8{p[j - 2 : j + 3]}", f"9{p[j - 3 : j + 3]}", f"A{p[j - 2 : j + 4]}", f"B{p[j - 3 : j + 1]}", f"C{p[j : j + 4]}"]


@functools.cache
def replacements() -> dict[str, frozenset[str]]:
    """What may come of a sign: an operation is possible only where a confusion gives it."""
    out: dict[str, set[str]] = defaultdict(set)
    for right, read in CONFUSIONS:
        out[read[0]].add(f"R:{right}" if len(read) == 1 else f"R:{right}")
        for c in read[1:]:
            out[c].add("D")
    return {c: frozenset(ops) for c, ops in out.items()}


class Editor:
    def __init__(self, model: Perceptron) -> None:
        self.model = model
        self.memo: dict[str, str] = {}

    def edit(self, word: str) -> str:
        got = self.memo.get(word)
        if got is None:
            out, may = [], replacements()
            for i, c in enumerate(word):
                op = self.model.predict(sign_features(word, i), may[c]) if c in may else "K"
                out.append(c if op == "K" else "" if op == "D" else op[2:])
            got = "".join(out)
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            self.memo[word] = got
        return got


def join_features(before: str, hyphen: str, after: str, between: bool) -> list[str]:
    b, a = before.lower(), after.lower()
    return ["jb", f"jh{hyphen}", f"jl{after[:1].islower()}", f"ju{before.isupper()}{after.isupper()}", f"jx{between}", f"j1{b[-2:]}", f"j2{a[:2]}", f"j3{b[-1:]}{a[:1]}", f"j4{b[-2:]}{a[:2]}", f"j5{b}", f"j6{a}", f"j7{len(b) > 1}{len(a) > 1}"]


# --- the line model ---------------------------------------------------------------------------------------------------


#: Digits that stand for letters become those, other digits, blanks and punctuation go.
NORMAL = str.maketrans({**{c: None for c in string.punctuation + string.whitespace + string.digits + "·–—«»“”’‘ºª€…¬‐¿¡\xa0\xad"}, "0": "o", "1": "l", "5": "s", "6": "o", "@": "a", "|": "l"})


#: The same for bytes of cp1252, which are translated many times faster: all signs, and those that go.
NORMAL_BYTES = bytes(ord(c.translate(NORMAL) or c) if (c := chr(b)).isascii() else b for b in range(256))
DROPPED_BYTES = bytes(b for b in range(256) if (c := bytes([b]).decode("cp1252", "ignore")) and not c.translate(NORMAL))


def normal_line(line: str) -> str:
    """A line as it is compared from page to page: no case, spacing, digits or signs that scanning mixes up."""
    low = line.lower()
    try:
        return low.encode("cp1252").translate(NORMAL_BYTES, DROPPED_BYTES).decode("cp1252")
    except UnicodeEncodeError:
        return low.translate(NORMAL)


def line_features(lines: list[str], at: int, seen: dict[str, list[int]]) -> list[str]:
    line = lines[at].strip()
    n = len(line)
    places = seen.get(normal_line(line), []) if n >= 4 else []
    gaps = [b - a for a, b in zip(places, places[1:])]
    before = next((x.strip() for x in reversed(lines[max(0, at - 4) : at]) if x.strip()), "")
    after = next((x.strip() for x in lines[at + 1 : at + 5] if x.strip()), "")
    number = NUMBER_LINE.fullmatch(line) is not None
    breaks = before != "" and before[-1] not in ".:;?!»)" and after[:1].islower()
    letters = [c for c in line if c.isalpha()]
    out = [
        "b", f"n{min(n // 8, 8)}", f"num{number}", f"rep{min(len(places), 4)}", f"far{bool(gaps) and min(gaps) >= 6}", f"brk{breaks}", f"hyb{before[-1:] in HYPHENS and before != ''}",
        f"up{bool(letters) and all(c.isupper() for c in letters)}", f"dot{line[-1:] == '.'}", f"low{line[:1].islower()}", f"bl{at > 0 and not lines[at - 1].strip()}{at + 1 < len(lines) and not lines[at + 1].strip()}",
        f"sep{bool(re.search(r'[|·]|  +| - ', line))}", f"end{at == 0 or at + 1 >= len(lines)}", f"nb{bool(NUMBER_LINE.fullmatch(before))}{bool(NUMBER_LINE.fullmatch(after))}", f"verb{bool(re.search(r'(?i)\b(?:queda|como|se|que|por|en|del|la|el|los)\b', line))}", f"item{line[:1] in '-•*' or bool(re.match(r'\d+\.\s', line))}",
        f"word{bool(re.match(r'(?i)p[áa]g|fol|hoja|page', line))}", f"dash{bool(re.fullmatch(r'[-–—]\s*\w+\s*[-–—]', line))}", f"of{bool(re.search(r'/|\bde\b', line))}", f"dig{line.isdigit()}", f"rom{bool(re.fullmatch('[ivxlc]+', line))}{len(line) > 1}", f"code{bool(re.fullmatch(r'(?:contrato )?[A-Z]{3}/[0-9]+/[0-9]+[.:,;]?', line))}", f"cap{line[:1].isupper()}",
    ]
    return out + [f"{out[2]}{out[5]}", f"{out[3]}{out[4]}{out[8]}", f"{out[3]}{out[11]}", f"{out[3]}{out[7]}{out[8]}", f"{out[3]}{out[14]}", f"{out[2]}{out[10]}", f"{out[3]}{out[8]}{out[7]}{out[14]}", f"{out[3]}{out[8]}{out[21]}{out[9]}", f"{out[3]}{out[8]}{out[15]}", f"rep{len(places) >= 2}{line[-1:] in '.:;,'}{out[7]}"]


def furniture(text: str, model: Perceptron) -> tuple[list[str], list[str]]:
    """The lines of a text and the class of each: K (text), H (running header) or N (page number)."""
    lines = text.split("\n")
    seen: dict[str, list[int]] = defaultdict(list)
    keys = []
    for i, line in enumerate(lines):
        keys.append(key := normal_line(line) if len(line) >= 4 else "")
        if len(key) >= 4:
            seen[key].append(i)
    kinds = []
    for i, line in enumerate(lines):
        s = line.strip()
        kind = "K"
        if s and not PAGE_MARK.fullmatch(s):
            number = NUMBER_LINE.fullmatch(s) is not None
            if number or len(seen.get(keys[i], ())) >= 2:
                kind = model.predict(line_features(lines, i, seen))
                if kind == "N" and not number or kind == "H" and number:
                    kind = "N" if number else "K"
        kinds.append(kind)
    return lines, kinds


class Repairer:
    """What the trained models make of one text."""

    def __init__(self, models: dict) -> None:
        self.editor = Editor(Perceptron(models["editor"]))
        self.harmless: set[str] = set()
        self.lines = Perceptron(models["lines"])
        self.joins = Perceptron(models["joins"])

    @classmethod
    def load(cls) -> Repairer:
        with open(model_path("scans.json"), encoding="utf-8") as f:
            return cls(json.load(f))

    def breaks(self, lines: list[str], kinds: list[str]) -> Iterator[tuple[int, int, str, str, str]]:
        """Line ends at a hyphen that the model joins: both lines, the parts and the hyphen."""
        for i, line in enumerate(lines):
            end = line.rstrip()[-1:]
            m = re.search(f"([{LETTERS}0-9@|]+)([{HYPHENS}])\\s*$", line) if kinds[i] == "K" and end != "" and end in HYPHENS else None
            if not m or len(m.group(1)) < 2:
                continue
            j = i + 1
            while j < len(lines) and (kinds[j] != "K" or not lines[j].strip()):
                j += 1
            after = re.match(f"\\s*([{LETTERS}0-9@|]+)", lines[j]) if j < len(lines) else None
            if after and self.joins.predict(join_features(m.group(1), m.group(2), after.group(1), j > i + 1)) == "J":
                yield i, j, m.group(1), m.group(2), after.group(1)

    def candidates(self, text: str) -> tuple[set[str], set[tuple[str, str, str]]]:
        """Furniture kinds for sure, and (kind, form, edited) still to be checked against the corpus."""
        lines, kinds = furniture(text, self.lines)
        sure = {k for k in ("H", "N") if k in kinds}
        found: set[tuple[str, str, str]] = set()
        skip: set[tuple[int, str]] = set()
        for i, j, a, h, b in self.breaks(lines, kinds):
            skip |= {(i, a), (j, b)}
            whole = a + b
            found.add(("hyphenation", f"{a}-{b}", whole))
            if (e := self.editor.edit(whole)) != whole:
                found.add(("hyphenation", f"{a}-{b}", e))
                found.add(("misread", whole, e))
        if suspects := {t for t in set(text.split()) - self.harmless if self.suspect(t)}:
            for i, (line, kind) in enumerate(zip(lines, kinds)):
                if kind == "N":
                    continue
                for t in suspects.intersection(line.split()):
                    for w in words_in(t):
                        if (i, w) not in skip and (e := self.editor.edit(w)) != w:
                            found.add(("misread", w, e))
        return sure, found

    def suspect(self, token: str) -> bool:
        """Whether the editor changes any word of a token between blanks; tokens of letters that it leaves are remembered."""
        if any(self.editor.edit(w) != w for w in words_in(token)):
            return True
        if token.strip(EDGE).isalpha():
            if len(self.harmless) >= MEMO_WORDS:
                self.harmless.clear()
            self.harmless.add(token)
        return False

    def repair(self, text: str, words: dict[str, str], joins: set[str]) -> str:
        """The text without furniture, with checked words put right and lines joined into paragraphs."""
        lines, kinds = furniture(text, self.lines)
        joined = {i: j for i, j, a, h, b in self.breaks(lines, kinds) if f"{a}-{b}" in joins}
        out = ""
        glue = ""
        paragraph_open = False
        scanned = "H" in kinds or "N" in kinds or bool(joined)
        gap = False
        for i, (line, kind) in enumerate(zip(lines, kinds)):
            s = line.strip()
            if kind != "K":
                continue
            if not s:
                gap = True
                continue
            opens = re.match(r"(?:[-•*]\s|\d+[.)]\s|\[\w+ \d+\]|CL[ÁA]USULA|[A-ZÁÉÍÓÚÑ .]+(?::|$))", s) is not None
            runs_on = scanned and paragraph_open and not opens and (glue == "" and out != "" or s[:1].islower() or not gap)
            if out:
                out += "" if i in joined.values() and paragraph_open and glue == "join" else " " if runs_on else "\n\n" if gap else "\n"
            out += re.sub(f"[{HYPHENS}]$", "", s) if i in joined else s
            glue = "join" if i in joined else "line"
            paragraph_open = s[-1] not in ".:" and not opens or i in joined
            gap = False
        return TOKEN.sub(lambda m: words.get(m.group(), m.group()), out) if words else out


@functools.cache
def _repairer() -> Repairer:
    """One for all batches and tasks of a worker."""
    return Repairer.load()


def words_in(line: str) -> Iterator[str]:
    """Words of a line that may be misread; addresses, codes and figures are left out."""
    for w in line.split():
        w = w.strip(EDGE)
        if len(w) < 3 or "/" in w or "@" in w and ("." in w or "+" in w or "_" in w):
            continue
        if w.count("-") and not w.isalpha():
            for part in w.split("-"):
                if len(part) >= 4 and TOKEN.fullmatch(part) and 2 * sum(map(str.isdigit, part)) < len(part):
                    yield part
            continue
        if TOKEN.fullmatch(w) and sum(map(str.isdigit, w)) <= max(2, len(w) // 2) and sum(map(str.isalpha, w)) >= 2:
            yield w


# --- over a corpus ----------------------------------------------------------------------------------------------------


def examine(df: DataFrame, text: str) -> DataFrame:
    """What every distinct text has, and the words of all texts.

    digest, kind, form, edited: sure noise (edited null) and candidates of the text with that md5. Rows of kind word
    have no digest: form is a word, n in how many texts it stands and n_distinct in how many distinct ones; each task
    sums its own words first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = _repairer()
        names = {"H": "running_header", "N": "page_number"}
        distinct: Counter = Counter()
        copied: Counter = Counter()  # what copies add

        def made(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [()] * 6
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:4]), *(pa.array(c, pa.int64()) for c in cols[4:])], ["digest", "kind", "form", "edited", "n", "n_distinct"])

        def flush() -> pa.RecordBatch:
            out = made([(None, "word", w, None, n + copied.get(w, 0), n) for w, n in distinct.items()])
            distinct.clear()
            copied.clear()
            return out

        for batch in batches:
            rows: list[tuple] = []
            for d, t, copies in zip(*(c.to_pylist() for c in batch.columns)):
                words = {w.strip(EDGE) for w in set(t.split())}
                distinct.update(words)
                if copies > 1:
                    copied.update(dict.fromkeys(words, copies - 1))
                if len(distinct) >= COUNT_WORDS:
                    yield flush()
                sure, found = repairer.candidates(t)
                rows += [(d, names[k], None, None, None, None) for k in sorted(sure)] + [(d, *f, None, None) for f in sorted(found)]
            yield made(rows)
        yield flush()

    texts = df.where(F.length(text) > 0).groupBy(F.col(text).alias("t")).agg(F.count("*").alias("copies")).select(F.md5("t").alias("digest"), "t", "copies")
    rows = texts.mapInArrow(run, "digest string, kind string, form string, edited string, n long, n_distinct long")
    return rows.where((F.col("kind") != "word") | F.col("form").rlike(r"^\p{L}[\p{L}-]*$"))


def checked_edits(examined: DataFrame) -> DataFrame:
    """kind, form, edited: the candidates that the corpus' words confirm."""
    counts = examined.where("kind = 'word'").groupBy("form").agg(F.sum("n").alias("known"), F.sum("n_distinct").alias("found"))
    pairs = examined.where("edited is not null").groupBy("kind", "form", "edited").agg(F.count("*").alias("uses"))
    ok = pairs.join(counts.select(F.col("form").alias("edited"), "known"), "edited").join(counts.select("form", "found"), "form", "left")
    return ok.where((F.col("known") >= KNOWN) & (F.col("known") >= RATIO * F.greatest(F.coalesce("found", F.lit(0)), F.when(F.col("kind") == "misread", F.col("uses")).otherwise(0)))).select("kind", "form", "edited")


def noise_of(df: DataFrame, text: str) -> DataFrame:
    """digest, kind, form, edited: sure noise (form and edited null) and checked edits of each distinct text."""
    examined = cut_lineage(examine(df, text))
    noise = examined.where("kind <> 'word'").select("digest", "kind", "form", "edited")
    checked = noise.where("edited is not null").join(checked_edits(examined), ["kind", "form", "edited"], "left_semi")
    return noise.where("edited is null").unionByName(checked.select("digest", "kind", "form", "edited"))


def find_noise(df: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, noise_kind: one row for each text and kind of noise present."""
    kinds = noise_of(df, text).select("digest", F.col("kind").alias("noise_kind")).distinct()
    owners = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where(F.length("text") > 0).select("doc_id", F.md5("text").alias("digest"))
    return owners.join(kinds, "digest").select("doc_id", "noise_kind").distinct()


def repair(df: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, text and repaired, for every text with noise."""
    edit = F.when(F.col("edited").isNotNull(), F.struct("kind", "form", "edited"))
    by_text = noise_of(df, text).groupBy("digest").agg(F.collect_set(edit).alias("edits"))
    rows = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where(F.length("text") > 0).dropDuplicates(["doc_id", "text"]).withColumn("digest", F.md5("text"))

    @F.pandas_udf("string")
    def mend(texts, edits):
        import pandas as pd

        repairer = _repairer()
        out = []
        for t, es in zip(texts, edits):
            out.append(repairer.repair(t, {e["form"]: e["edited"] for e in es if e["kind"] == "misread"}, {e["form"] for e in es if e["kind"] == "hyphenation"}))
        return pd.Series(out)

    return rows.join(by_text, "digest").select("doc_id", "text", mend("text", "edits").alias("repaired"))
