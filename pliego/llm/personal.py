"""Personal information inside free text: found by kind and replaced by typed placeholders.

A character-level bidirectional LSTM with CRF transitions (tagger.py), trained by train_personal, labels every sign of
a text's windows in which the form of any kind can stand. Texts are cut at sentence and paragraph ends; longer stretches into windows that overlap, whose
labels are reconciled by taking each sign's label from the window in which it lies farther from an edge, and spans are
formed over the whole text afterwards. Equal windows are labelled once a task (digits are one sign to the model, so
most windows of a corpus are equal). An exact check follows: a span must have the form of its kind, and is set to the
ends of that form.

To the model a text has no invisible signs, accents or widths, and look-alikes are Latin letters; what is reported is
the text as written. Nulls and empty texts have no findings; values written alike in one field of one key come once.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pliego.llm import forms, tagger
from pliego.llm.common import model_path

KINDS = ["", "email", "phone", "id_number", "address", "name"]
SIGNS = "\0 abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0.,;:()/-@+_[]#'\"&%|$?!*=~"
OTHER = "~"
WINDOW, OVERLAP = 220, 60
BATCH = 256
MEMO_WINDOWS = 300_000


@functools.cache
def sign_table() -> dict[int, str | None]:
    """What the model sees of a character beyond ASCII letters; nothing of invisible signs and separate accents."""
    table: dict[int, str | None] = {}
    for c, t in forms.mapping().items():
        table[ord(c)] = "".join(x for x in unicodedata.normalize("NFD", t) if x in SIGNS[1:])[:1] if t else None
    for c in map(chr, range(0x80, 0x3000)):
        if ord(c) not in table:
            base = unicodedata.normalize("NFD", c)[0]
            table[ord(c)] = None if unicodedata.combining(c) else base if base in SIGNS[1:] else OTHER
    for chars, t in (("«»“”„", '"'), ("’‘´`", "'"), ("–—‐‑¬−", "-"), ("ºª°", "#"), ("€£", "$"), ("¿", "?"), ("¡", "!"), ("…", "."), ("\t\r", " "), ("123456789", "0"), ("{<", "("), ("}>", ")"), ("\\", "/")):
        table |= {ord(c): t for c in chars}
    for c in map(chr, range(0x20)):
        table.setdefault(ord(c), OTHER)
    table[ord("\n")] = "\n"  # line ends only help to cut windows; to the model they are blanks
    return table


def signs_of(text: str) -> tuple[str, list[int] | None]:
    """The signs of a text, and where each stood (None: at the same place)."""
    try:  # most texts lie within one byte table, which is much faster
        raw = text.encode("cp1252")
        if b"\xad" not in raw:
            return raw.translate(_byte_table()).decode("ascii"), None
    except UnicodeEncodeError:
        pass
    points = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0x10000)
    codes = _point_table()[points]
    where = np.flatnonzero(codes)
    return codes[where].tobytes().decode("ascii"), None if len(where) == len(text) else where.tolist()


@functools.cache
def _point_table() -> np.ndarray:
    """The sign of every code point of the basic plane, 0 for those the model doesn't see; all others are one sign."""
    table = sign_table()
    out = np.full(0x10001, ord(OTHER), np.uint8)
    for c in range(0x10000):
        s = table.get(c, chr(c))
        out[c] = 0 if not s else ord(s) if s in SIGNS[1:] or s == "\n" else ord(OTHER)
    return out


@functools.cache
def _byte_table() -> bytes:
    table = sign_table()
    signs = [table.get(ord(c), c) or OTHER for c in (bytes([b]).decode("cp1252", "replace") for b in range(256))]
    return "".join(s if s in SIGNS[1:] or s == "\n" else OTHER for s in signs).encode("ascii")


@functools.cache
def _codes() -> np.ndarray:
    lut = np.full(128, SIGNS.index(OTHER), np.uint8)
    for i, c in enumerate(SIGNS):
        lut[ord(c)] = i
    return lut


def numbers(signs: str) -> np.ndarray:
    return _codes()[np.frombuffer(signs.encode("ascii"), np.uint8)]


#: Ends of sentences, headings and list items; not after abbreviations before a name or a number.
CUT = re.compile(r"[ \n](?:(?<=[a-z0)][a-z0)][a-z0)][.;][ \n])(?<!Avda\.[ \n])(?<!avda\.[ \n])(?<!Ctra\.[ \n])\s*(?=[A-Z(\"-])|(?<=[A-Z][A-Z][A-Z]:[ \n])\s*|(?<=[a-z][a-z][a-z][a-z]:\n)\n*|(?<=\n)\s*\n\s*|(?<=\n)(?=- )|(?<=[A-Z][A-Z][A-Z][A-Z]\n)(?=[A-Z][a-z])|(?<= )  +)")


def windows(signs: str) -> list[tuple[int, int]]:
    """Where windows begin and end, cut at sentence ends and, in longer stretches, overlapping."""
    out, start = [], 0
    for m in CUT.finditer(signs):
        out.append((start, m.start()))
        start = m.end()
    out.append((start, len(signs)))
    all_of: list[tuple[int, int]] = []
    for a, b in out:
        if b - a <= WINDOW:
            if b > a:
                all_of.append((a, b))
            continue
        step = WINDOW - OVERLAP
        s = a
        while True:
            all_of.append((s, min(s + WINDOW, b)))
            if s + WINDOW >= b:
                break
            s += step
    return all_of


# --- the exact check, over signs -------------------------------------------------------------------------------------

_W = r"[A-Z~][A-Za-z~'0|]*"
_DOT = r"(?:\.| ?\[punto\] ?| ?\(punto\) ?| punto | ?\[dot\] ?| dot )"
FORMS = {
    "email": re.compile(rf"[A-Za-z0~_][A-Za-z0~_.+-]* ?(?:@|\(arroba\)|\[arroba\]|\(at\)|\[at\]|\barroba\b|\bat\b) ?[A-Za-z0~-]+(?:{_DOT}[A-Za-z0~-]+)*{_DOT}[A-Za-z]+"),
    "phone": re.compile(r"(?<![A-Za-z0/-])(?:\(?(?:\+|00)00\)?[ .-]?)?0(?:[ .-]?0){8,9}(?![A-Za-z0/-])"),
    "id_number": re.compile(r"(?<![A-Za-z0/])(?:00\.?000\.?000[ .-]?[A-Za-z]|[XYZxyz][ .-]?0{7}[ .-]?[A-Za-z]|[A-Z]{2,3} ?0{6,7}|00[ /.-]0{8}[ /.-]00|0{8})(?![A-Za-z0])"),
    "address": re.compile(rf"(?:[A-Za-z~]+[.]?|C/) (?:(?:de|del|la|las|los|el|do|da|dos|das|DE|DEL|LA|LAS|LOS|EL),? ?){{0,3}}(?:{_W},? ?)(?:(?:de|del|la|las|los|el|do|da|dos|das|DE|DEL|LA|LAS|LOS|EL|{_W}),? ?){{0,5}},?(?: ?(?:n\.?#|num\.|nro\.|no\.|N\.?#|NUM\.|numero))? ?0+(?:,? (?:(?:bajo|BAJO|atico|ATICO|entresuelo|principal)\b|(?:piso|PISO|planta) 0+(?:,? (?:puerta|PUERTA) [0A-Za-z]+)?|0+\.?#(?: ?[A-Z0]\b)?|esc\.[^,]{{1,8}}))*"),
    "name": re.compile(rf"(?:[A-Z]\. ?){{0,2}}{_W}(?:[ -]{_W}){{0,4}}(?:, {_W}(?: {_W}){{0,2}})?"),
}
#: Titles before a name, to the model's signs.
TITLE = r"[Dd]on|[Dd]ona|DON|DONA|D\.|Dna\.|Da\.|D\.#|Sra?\.|SRA?\.|[Ss]enora?|[Ss]enhora?|[Dd]octora?|Dra?\.|[Ll]etrad[oa]|LETRAD[OA]|Mr\.?|Mrs\.?|Ms\.?|Madame|Monsieur"
TITLES = re.compile(rf"^(?:{TITLE}|[Ll]a letrada|[Ee]l letrado|Fdo\.:?|y|and|e|et|C'est|El|La|el|la) +")
TITLE_BEFORE = re.compile(rf"(?:{TITLE}) $")
COMPANY = re.compile(r"^,? ?(?:S\. ?L\.|S\. ?A\.|S\. ?Coop|S\.L|S\.A|SL\b|SA\b)", re.I)


def checked(kind: str, signs: str, a: int, b: int) -> tuple[int, int] | None:
    """The ends of a span's form, or None if it hasn't the form of its kind."""
    while a < b and signs[a] in " ,;:(\"":
        a += 1
    while b > a and signs[b - 1] in " ,;:\"":
        b -= 1
    if b <= a:
        return None
    if kind == "name":
        while m := TITLES.match(signs[a:b]):
            a += m.end()
        if signs[b - 1] in ".)" and not re.search(r"\b[A-Z]\.$", signs[a:b]):
            b -= 1
        m = FORMS["name"].match(signs, a)
        if not m or b - a < 3 or not re.search(r"[A-Za-z]{2}", signs[a:b]):
            return None
        end = m.end() if m.end() <= b + 1 else b
        # a word that the label ends inside is taken whole
        while end < len(signs) and signs[end - 1 : end].isalpha() and signs[end].isalpha():
            end += 1
        # one word is a person's name only after a title; a heading's number before it or its colon after it shows no name
        before = signs[max(0, a - 14) : a]
        if not re.search(r"[ .-]", signs[a:end].strip(".")) and not TITLE_BEFORE.search(before):
            return None
        if re.search(r"(?:^| )(?:0+\.|[A-Z]+A\.-) $", before) or signs[a:end].isupper() and signs[end : end + 1] == ":":
            return None
        if COMPANY.match(signs[end : end + 8]) or re.search(r"(?:[Hh]ij[o0]s de|HIJOS DE) $", signs[max(0, a - 9) : a]):
            return None
        return a, end
    low = max(0, a - 12)
    best = None
    for m in FORMS[kind].finditer(signs, low if kind in ("email", "phone", "id_number") else a, min(len(signs), b + 40)):
        overlap = min(m.end(), b) - max(m.start(), a)
        if overlap > 0 and (best is None or overlap > best[0]):
            best = overlap, m.start(), m.end()
    if best is None:
        return None
    _, s, e = best
    return (s, e) if best[0] >= 0.5 * min(b - a, e - s) else None


#: What a window has if any kind's form can stand in it: two capitalised words, or a title or an initial before one, a
#: capitalised word before a number, nine digits of a phone, an identity number, or what joins an email address.
_CAP = r"[A-Z~][A-Za-z~'0|]"
POSSIBLE = re.compile(
    r"[A-Z~0xyz@adls](?:rroba(?<=arroba)|t\b(?<=\bat)|o(?<=do)(?:na?|ctora?) [A-Z~]|e(?:(?<=se)nh?ora?|(?<=le)trad[oa]) [A-Z~]"  # a set of first signs lets the search skip all others
    rf"|(?<=[A-Z~])[A-Za-z~'0|]*(?:(?: |-|, |\.#? ?){_CAP}|(?:,? (?:de|del|la|las|los|el|do|da|dos|das|DE|DEL|LA|LAS|LOS|EL))*,? ?(?:[nN][A-Za-z]*[.#]{{0,2}} ?)?0|[ -]?0{{6}})"
    r"|(?<=0)(?:(?<![A-Za-z0/-]0)(?:[ .-]?0){8}|(?<![A-Za-z0/]0)(?:0\.?000\.?000|0[ /.-]0{8}))|(?<=[xyz])[ .-]?0{7}|(?<=@))"
)
#: Signs on either side of such places that the network sees.
CONTEXT = 40
RUN = re.compile(rb"([\x01-\x7f])\1*")


def around(window: str) -> tuple[int, int]:
    """The part of a window in which forms can stand, with CONTEXT on either side; (0, 0) if there is none."""
    low = high = None
    for m in POSSIBLE.finditer(window):
        low, high = m.start() - CONTEXT if low is None else low, m.end() + CONTEXT
        if high >= len(window):
            break  # later places change nothing
    if low is None:
        return 0, 0
    end = window.find(" ", high) if high < len(window) else -1
    return 0 if low <= 0 else window.find(" ", low) + 1, len(window) if end < 0 else end


class Finder:
    """Finds personal information in texts; remembers the windows it has labelled."""

    def __init__(self, params: tagger.Params) -> None:
        self.params = params
        self.memo: dict[str, bytes] = {}
        self.parts: dict[str, tuple[int, int]] = {}

    @classmethod
    def load(cls) -> Finder:
        with np.load(model_path("personal.npz")) as f:
            return cls({k: f[k].astype(np.float32) for k in f.files})

    def part(self, window: str) -> tuple[int, int]:
        got = self.parts.get(window)
        if got is None:
            if len(self.parts) >= MEMO_WINDOWS:
                self.parts.clear()
            got = self.parts[window] = around(window)
        return got

    def label(self, wanted: set[str]) -> None:
        """Labels windows that aren't known yet, in batches of like length."""
        if len(self.memo) > MEMO_WINDOWS:
            self.memo.clear()
        todo = sorted((w for w in wanted if w not in self.memo), key=len)
        for i in range(0, len(todo), BATCH):
            part = todo[i : i + BATCH]
            sym, lens = tagger.padded([numbers(w) for w in part])
            labels = tagger.decode(self.params, sym, lens)
            for w, row, n in zip(part, labels, lens):
                self.memo[w] = row[:n].tobytes() if row[:n].any() else b""

    def find_all(self, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        """For each text its findings: kind, and where they begin and end in the text as written."""
        unique = list(dict.fromkeys(texts))
        if len(unique) < len(texts):
            got = dict(zip(unique, self.find_all(unique)))
            return [got[t] for t in texts]
        seen = [signs_of(t) if t else ("", None) for t in texts]
        cut = [windows(s) for s, _ in seen]
        seen = [(s.replace("\n", " "), where) for s, where in seen]
        cut = [[(a + low, a + high) for a, b in ws for low, high in [self.part(s[a:b])] if high] for (s, _), ws in zip(seen, cut)]
        pieces = [[s[a:b] for a, b in ws] for (s, _), ws in zip(seen, cut)]
        self.label({w for ws in pieces for w in ws})
        out = []
        for (signs, where), ws, texts_of in zip(seen, cut, pieces):
            spans = self._spans(ws, [self.memo.get(w, b"") for w in texts_of])
            found = []
            for kind, a, b in spans:
                while a < b and (ends := checked(kind, signs, a, b)):
                    if not found or ends[0] >= found[-1][2]:
                        found.append((kind, *ends))
                    a = ends[1] if kind == "name" else b  # two names in one run of labels
            out.append([(k, where[a] if where else a, (where[b - 1] if where else b - 1) + 1) for k, a, b in found])
        return out

    def _spans(self, ws: list[tuple[int, int]], found: list[bytes]) -> list[tuple[str, int, int]]:
        out: list[tuple[str, int, int]] = []
        if not any(found):
            return out
        i = 0
        while i < len(ws):
            j = i + 1
            while j < len(ws) and ws[j][0] < ws[j - 1][1]:
                j += 1
            start, end, labels = min(a for a, _ in ws[i:j]), max(b for _, b in ws[i:j]), found[i:j]
            if any(labels):
                whole = labels[0] if j == i + 1 else self._reconciled(start, end, ws[i:j], labels)
                out += [(KINDS[m.group(1)[0]], start + m.start(), start + m.end()) for m in RUN.finditer(whole)]
            i = j
        return out

    @staticmethod
    def _reconciled(start: int, end: int, ws: list[tuple[int, int]], found: list[bytes]) -> bytes:
        """One label for each sign of windows that overlap: from the window in which the sign lies deeper."""
        labels, depth = np.zeros(end - start, np.int8), np.full(end - start, -1)
        for (a, b), lab in zip(ws, found):
            at = slice(a - start, b - start)
            inner = np.minimum(np.arange(b - a), np.arange(b - a)[::-1])
            deeper = inner > depth[at]
            depth[at][deeper] = inner[deeper]
            labels[at][deeper] = np.frombuffer(lab, np.int8)[deeper] if lab else 0
        return labels.tobytes()


@functools.cache
def _finder() -> Finder:
    """One for all tasks of a worker, so that a window labelled in one task is known in the next."""
    return Finder.load()


def find_personal(df: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """doc_id, field_name, kind, found_text. fields: name of a field and its column, of strings or arrays of them."""
    names = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            cols: list[list] = [[], [], [], []]
            for j, name in enumerate(names):
                texts, owner = [], []
                for k, v in zip(keys, batch.column(j + 1).to_pylist()):
                    for t in v if isinstance(v, list) else [v]:
                        if t:
                            texts.append(t)
                            owner.append(k)
                for k, t, found in zip(owner, texts, finder.find_all(texts)):
                    for kind, a, b in found:
                        for c, x in zip(cols, (k, name, kind, t[a:b])):
                            c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), *(pa.array(c, pa.string()) for c in cols[1:])], ["doc_id", "field_name", "kind", "found_text"])

    rows = df.select(F.col(key).alias("doc_id"), *[F.col(c).alias(f"f{i}") for i, c in enumerate(fields.values())])
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, field_name string, kind string, found_text string").distinct()


def redact(df: DataFrame, text: str, out: str = "redacted") -> DataFrame:
    """df with the text, or array of texts, in which every finding is replaced by its kind in brackets, [NAME] for instance."""
    kind = dict(df.dtypes)[text]

    @F.pandas_udf(kind if kind == "array<string>" else "string")
    def replace(texts):
        import pandas as pd

        values = [None if t is None else [t] if isinstance(t, str) else list(t) for t in texts]
        flat = [t for v in values if v is not None for t in v]
        done = []
        for t, found in zip(flat, _finder().find_all(flat)):
            for label, a, b in reversed(found):
                t = f"{t[:a]}[{label.upper()}]{t[b:]}"
            done.append(t)
        rest = iter(done)
        got = [None if v is None else [next(rest) for _ in v] for v in values]
        return pd.Series(got if kind == "array<string>" else [v[0] if v else None for v in got], dtype=object)

    return df.withColumn(out, replace(F.col(text)))
