"""Passages of held-out material inside a corpus: Wu-Manber search over words, then direct comparison.

Texts are compared as words without case, accents, punctuation or spacing, numbered by the items' vocabulary. Every
item's runs of SEED words are the patterns. Hashed blocks of BLOCK words index a shift table that says how far the
search window may move; where the shift is nought, the hash of the window's words names the bucket of patterns, and the
words are compared directly. The texts of a batch lie in one array and are searched side by side in lanes, so that the
windows of all lanes move at once. A confirmed run fixes where passage and text lie on each other; along that diagonal
the stretches with at most one replaced word in ten are compared, and a stretch that another one continues in the
passage (a passage broken in two) counts with it.

A text holds an item if the whole passage or MIN_WORDS successive words of it stand there. Passages shorter than that
take seeds of the length that their own word count proves. A stretch with a run of more than SHARED_RUN words is proof.
Without one it may be chance: texts of the same sort share short runs, and a replaced word may chain two of them. That
is told by the corpus: for every SEED words of the items all texts are counted that have them and don't hold the item.
A stretch counts if one of its runs stands in no other text, or if its runs are so rare that fewer than CHANCE such
stretches are expected among all texts and places of the items.

The items are a bounded broadcast: they are split into blocks of ITEMS_PER_BLOCK, and every block searches all texts.
The pairs found and the counts are checkpointed, so texts are searched once.
Nulls, empty and wordless texts and items give no row; repeated rows give one row per pair.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pliego.llm.common import cut_lineage

MIN_WORDS = 20
REPLACED_IN = 10
SEED = 5
BLOCK = 2
#: A stretch begins and ends with so many words that agree.
EDGE = 2
#: Runs of so many words or fewer are shared by texts of the same sort and prove nothing by themselves.
SHARED_RUN = 15
ITEMS_PER_BLOCK = 100_000
#: Cells of the shift table (a power of two); blocks that share a cell share the smaller shift.
SHIFT_BITS = 20
#: A doubtful stretch counts if so few such stretches, or fewer, are expected by chance among all texts and items.
CHANCE = 1e-3
LANE = 64
COMPARED_AT_ONCE = 20_000
#: Characters of texts that are searched at once.
AT_ONCE = 4_000_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)
END = "\x1e"
#: ASCII letters and digits, and END, stay; all else is a blank.
IN_WORDS = bytes(c if chr(c).isalnum() and c < 128 or chr(c) == END else 32 for c in range(256))
AGREE = re.compile(rb"\x01+")


def plain(text: str) -> str:
    """Text without case and accents."""
    import regex

    return text if text.isascii() else regex.sub(r"\p{M}+", "", unicodedata.normalize("NFKD", text))


def words(text: str | None) -> list[str]:
    """Words without case, accents and punctuation."""
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", plain(text.casefold())) if text else []


def seed_length(n: int) -> int:
    """A run that a whole passage of n words keeps however its replaced words fall."""
    if n >= MIN_WORDS:
        return SEED
    replaced = n // REPLACED_IN
    return min(SEED, -(-(n - replaced) // (replaced + 1)))


def hashed(text: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A hash of the size words from each place."""
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            h = (h ^ text[at + i].astype(np.uint64)) * FACTOR
            h ^= h >> np.uint64(29)
    return h


def block_cell(text: np.ndarray, end: np.ndarray, block: int) -> np.ndarray:
    """The shift table's cell of the block of words before each place."""
    return (hashed(text, end - block, block) >> np.uint64(64 - SHIFT_BITS)).astype(np.int64)


class WuManber(NamedTuple):
    """Shift table, and the patterns in the order of their hash with the places where they stand in the items."""

    size: int
    block: int
    shift: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # where each hash's places begin in the three arrays that follow
    slot: np.ndarray
    offset: np.ndarray
    place: np.ndarray

    @classmethod
    def build(cls, size: int, numbers: np.ndarray, slots: np.ndarray, begin: np.ndarray, length: np.ndarray) -> WuManber:
        """Of all runs of size words in the items of those slots."""
        block, counts = min(BLOCK, size), length[slots] - size + 1
        slot = np.repeat(slots, counts)
        offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        place = begin[slot] + offset
        h = hashed(numbers, place, size)
        order = np.argsort(h, kind="stable")
        h, slot, offset, place = h[order], slot[order], offset[order], place[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        shift = np.full(1 << SHIFT_BITS, size - block + 1, np.int8)
        for end in range(block, size + 1):
            np.minimum.at(shift, block_cell(numbers, place + end, block), np.int8(size - end))
        return cls(size, block, shift, h[first], np.r_[first, len(h)], slot, offset, place)

    def search(self, text: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every pattern in text: where it begins there, the item's slot and where it begins in the item."""
        end = np.arange(self.size, len(text) + 1, LANE)
        stop, found = np.minimum(end + LANE, len(text) + 1), []
        while len(end):
            move = self.shift[block_cell(text, end, self.block)]
            found.append(end[move == 0] - self.size)
            end = end + np.maximum(move, 1)
            inside = end < stop
            end, stop = end[inside], stop[inside]
        at = np.concatenate(found) if found else np.zeros(0, np.int64)
        h = hashed(text, at, self.size)
        which = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        at, which = at[self.hashes[which] == h], which[self.hashes[which] == h]
        many = self.first[which + 1] - self.first[which]
        at = np.repeat(at, many)
        of = np.arange(many.sum()) + np.repeat(self.first[which] - (np.cumsum(many) - many), many)
        same = np.ones(len(at), bool)
        for i in range(self.size):
            same &= text[at + i] == numbers[self.place[of] + i]
        return at[same], self.slot[of[same]], self.offset[of[same]]


class Stretch(NamedTuple):
    start: int  # in the item
    end: int
    agree: int
    runs: tuple[tuple[int, int], ...]  # without a replaced word, in the item

    @property
    def size(self) -> int:
        return self.end - self.start

    @property
    def longest(self) -> int:
        return max(b - a for a, b in self.runs)


def best_stretch(same: bytes) -> Stretch | None:
    """The longest stretch with at most one word in ten replaced; same: which of the item's words agree (1) or not."""
    runs = [m.span() for m in AGREE.finditer(same)]
    edge = min(EDGE, len(same))
    agreed = [0]
    for a, b in runs:
        agreed.append(agreed[-1] + b - a)
    best: Stretch | None = None
    for i, (s, s_end) in enumerate(runs):
        if s_end - s < edge:
            continue
        for j in range(len(runs) - 1, i - 1, -1):
            e = runs[j][1]
            if best and e - s <= best.size:
                break
            agree = agreed[j + 1] - agreed[i]
            if e - runs[j][0] >= edge and (e - s) - agree <= (e - s) // REPLACED_IN:
                best = Stretch(s, e, agree, tuple(runs[i : j + 1]))
                break
    return best


def held(need: int, by_diagonal: list[tuple[int, bytes]]) -> Stretch | None:
    """What of an item stands in a text, in one piece or two, if that is enough; the likeliest to be no chance."""
    found = [(d, s) for d, same in sorted(by_diagonal, key=lambda x: x[0]) if (s := best_stretch(same))]
    whole = [s for _, s in found if s.size >= need]
    for i, (d, a) in enumerate(found):
        for e, b in found[i + 1 :]:
            if e > d and 0 <= b.start - a.end <= 1:
                both = Stretch(a.start, b.end, a.agree + b.agree, a.runs + b.runs)
                if both.size >= need and both.size - both.agree <= both.size // REPLACED_IN:
                    whole.append(both)
    return max(whole, key=lambda s: (s.longest, s.size), default=None)


class Search:
    """All items of a block, ready to look for in texts."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.number: dict[str, int] = {}
        kept = [(key, ids) for key, text in items if (ids := [self.number.setdefault(w, len(self.number) + 1) for w in words(text)])]
        self.keys = [key for key, _ in kept]
        self.length = np.array([len(ids) for _, ids in kept], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.numbers = np.array([i for _, ids in kept for i in ids], np.int32)
        self.number[END] = -1
        self.ascii_number = {w.encode(): n for w, n in self.number.items() if w.isascii()}
        self.uses = np.zeros(len(self.numbers), np.int64)
        sizes = np.array([seed_length(n) for n in self.length], np.int64)
        self.searches = [WuManber.build(int(m), self.numbers, np.flatnonzero(sizes == m), self.begin, self.length) for m in np.unique(sizes)]

    def numbered(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The word numbers of all texts in one array, and where each text begins and ends; a nought stands between."""
        import regex

        joined = plain(f" {END} ".join(t.replace(END, " ") for t in texts).casefold())
        for c in set(joined):  # signs beyond ASCII that are no part of a word
            if not c.isascii() and not regex.match(r"[\p{L}\p{N}]", c):
                joined = joined.replace(c, " ")
        if joined.isascii():
            get = self.ascii_number.get
            ids = [get(w, 0) for w in joined.encode().translate(IN_WORDS).split()]
        else:
            get = self.number.get
            ids = [get(w, 0) for w in regex.findall(rf"[\p{{L}}\p{{N}}]+|{END}", joined)]
        numbers = np.array(ids, np.int32)
        stops = np.append(np.flatnonzero(numbers == -1), len(numbers))
        return np.maximum(numbers, 0), np.c_[np.r_[0, stops[:-1] + 1], stops]

    def find(self, texts: list[str]) -> list[tuple[int, int, Stretch]]:
        """Of every text that holds an item: its place among texts, the item's slot and what stands there."""
        if not texts or not self.searches:
            return []
        ids, bounds = self.numbered(texts)
        out = []
        for search in self.searches:
            at, slot, offset = search.search(ids, self.numbers)
            owner = np.searchsorted(bounds[:, 0], at, "right") - 1
            # in how many texts each place's words stand, once a text
            place = self.begin[slot] + offset
            self.uses += np.bincount(np.unique(owner * (len(self.numbers) + 1) + place) % (len(self.numbers) + 1), minlength=len(self.numbers))
            order = np.lexsort((at, at - offset, slot, owner))
            at, slot, owner, diagonal = at[order], slot[order], owner[order], (at - offset)[order]
            if not len(at):
                continue
            new_pair = np.r_[True, (owner[1:] != owner[:-1]) | (slot[1:] != slot[:-1])]
            new_diagonal = new_pair | np.r_[True, diagonal[1:] != diagonal[:-1]]
            new_run = new_diagonal | np.r_[True, at[1:] != at[:-1] + 1]
            pair = np.cumsum(new_pair) - 1
            # words that lie in confirmed runs; in MIN_WORDS words with two replaced, or in two parts, at least two seeds' worth do
            covered = np.bincount(pair, 1 + (search.size - 1) * new_run)
            likely = covered >= np.where(self.length[slot[new_pair]] >= MIN_WORDS, 2 * search.size, search.size)
            kept = likely[pair]
            if kept.any():
                last = np.append(new_run[1:], True)
                offset = at - diagonal
                runs = np.c_[(np.cumsum(new_diagonal & kept) - 1)[new_run & kept], offset[new_run & kept], offset[last & kept] + search.size]
                begins = new_diagonal & kept
                out += self._compared(ids, bounds, owner[begins], slot[begins], diagonal[begins], runs)
        return out

    def _compared(self, ids: np.ndarray, bounds: np.ndarray, owner: np.ndarray, slot: np.ndarray, diagonal: np.ndarray, runs: np.ndarray) -> list[tuple[int, int, Stretch]]:
        """Direct comparison along diagonals, which lie in order of text, item and place.

        Before stretches are sought, all diagonals are compared at once: one piece has MIN_WORDS words with at most two
        replaced or else is longer; of two pieces, a confirmed run (its diagonal, first and last word in the item) of the
        second begins at most two unconfirmed runs and the replaced words between after the end of one of the first.
        """
        out, n = [], len(owner)
        new = np.r_[True, (owner[1:] != owner[:-1]) | (slot[1:] != slot[:-1])]
        starts = np.append(np.flatnonzero(new), n)
        at = 0
        while at < len(starts) - 1:
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + COMPARED_AT_ONCE, "right")) - 1)
            part = slice(starts[at], starts[to])
            o, s, d, begins = owner[part], slot[part], diagonal[part], new[part]
            at = to
            need = np.minimum(self.length[s], MIN_WORDS)
            least = need - need // REPLACED_IN
            width = int(self.length[s].max())
            place = d[:, None] + np.arange(width)
            inside = (np.arange(width) < self.length[s][:, None]) & (place >= bounds[o, 0][:, None]) & (place < bounds[o, 1][:, None])
            item = np.minimum(self.begin[s][:, None] + np.arange(width), len(self.numbers) - 1)
            same = inside & (ids[np.clip(place, 0, len(ids) - 1)] == self.numbers[item])
            total = np.zeros((len(o), width + 1), np.int32)
            np.cumsum(same, 1, out=total[:, 1:])
            agree = total[:, -1]
            window = min(MIN_WORDS, width)
            close = (total[:, window:] - total[:, :-window]).max(1) >= MIN_WORDS - MIN_WORDS // REPLACED_IN
            may = (agree >= least) & (close | (need < MIN_WORDS) | (agree >= MIN_WORDS + 10 - (MIN_WORDS + 10) // REPLACED_IN))
            group = np.cumsum(begins) - 1
            likely = np.zeros(group[-1] + 1, bool)
            likely[group[may]] = True
            lo, hi = np.searchsorted(runs[:, 0], [part.start, part.stop])
            of, low, high = runs[lo:hi, 0] - part.start, runs[lo:hi, 1], runs[lo:hi, 2]
            order = np.lexsort((low, group[of]))
            of, low, high = of[order], low[order], high[order]
            for k in range(1, len(of)):
                a, b = of[:-k], of[k:]
                gap, near = low[k:] - high[:-k], group[a] == group[b]
                if not near.any():
                    break
                reach = 2 * SEED + 1
                both = near & (d[a] < d[b]) & (gap > -SEED) & (gap <= reach)
                a, b = a[both], b[both]
                # what agrees before the break and after it
                enough = total[a, np.minimum(high[:-k][both] + reach, width)] + agree[b] - total[b, np.maximum(low[k:][both] - reach, 0)] >= least[a]
                likely[group[a[enough]]] = True
            groups = np.append(np.flatnonzero(begins), len(o))
            for g in np.flatnonzero(likely):
                a, b = groups[g], groups[g + 1]
                got = held(int(need[a]), [(int(d[i]), same[i, : self.length[s[a]]].tobytes()) for i in range(a, b)])
                if got:
                    out.append((int(o[a]), int(s[a]), got))
        return out


def find_stretches(docs: DataFrame, wanted: DataFrame, doc_key: str, doc_text: str) -> DataFrame:
    """What of the items stands in the texts, and how common their words are.

    Rows with a doc_id tell a pair: item_id, the longest exact run and the runs of at least SEED words (their words'
    places in the item). Rows without one tell how many texts have the item's SEED words from a place on (runs: that
    place); each task sums its own first.
    """
    spark = SparkSession.active()
    blocks = max(1, -(-wanted.count() // ITEMS_PER_BLOCK))
    kind = dict(docs.dtypes)[doc_key]
    texts = docs.select(F.col(doc_key).alias("doc_id"), F.col(doc_text).alias("text")).where(F.col("text").isNotNull())
    found = []
    for block in range(blocks):
        part = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast([(r.k, r.t) for r in part.orderBy("k", "t").collect()])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            search = Search(shared.value)
            names = ["doc_id", "item_id", "longest", "runs", "n"]
            schema = None
            for batch in batches:
                schema = schema or batch.schema
                keys, texts = batch.column(0), batch.column(1).to_pylist()
                begin = 0
                while begin < len(texts):
                    end, size = begin + 1, len(texts[begin])
                    while end < len(texts) and size + len(texts[end]) <= AT_ONCE:
                        size += len(texts[end])
                        end += 1
                    got = search.find(texts[begin:end])
                    owner = pa.array([begin + o for o, _, _ in got], pa.int64())
                    runs = pa.array([[p for a, b in s.runs for p in range(a, b - SEED + 1)] for _, _, s in got], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([keys.take(owner), pa.array([search.keys[s] for _, s, _ in got], pa.int64()), pa.array([s.longest for _, _, s in got], pa.int32()), runs, pa.nulls(len(got), pa.int64())], names)
                    begin = end
            at = np.flatnonzero(search.uses)
            if len(at):
                slot = np.searchsorted(search.begin, at, "right") - 1
                places = pa.array([[p] for p in (at - search.begin[slot]).tolist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(at), schema.field(0).type), pa.array([search.keys[i] for i in slot], pa.int64()), pa.nulls(len(at), pa.int32()), places, pa.array(search.uses[at], pa.int64())], names)

        found.append(texts.mapInArrow(run, f"doc_id {kind}, item_id long, longest int, runs array<int>, n long"))
    return reduce(DataFrame.unionByName, found)


def find_leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id and item_id of every text that holds a passage of an item."""
    wanted = items.select(F.col(item_key).cast("long").alias("k"), F.col(item_text).cast("string").alias("t")).where("k is not null and t is not null").distinct()
    found = cut_lineage(find_stretches(docs, wanted, doc_key, doc_text))
    pairs = found.where("doc_id is not null")
    sure = pairs.where(F.col("longest") > SHARED_RUN).select("doc_id", "item_id")
    doubtful = pairs.where(F.col("longest") <= SHARED_RUN).withColumn("pair", F.monotonically_increasing_id())
    # how many texts have those words that don't hold the item
    places = pairs.select("item_id", F.explode("runs").alias("place")).groupBy("item_id", "place").agg(F.count("*").alias("held"))
    uses = found.where("doc_id is null").groupBy("item_id", F.get("runs", F.lit(0)).alias("place")).agg(F.sum("n").alias("n"))
    size = docs.where(F.col(doc_text).isNotNull()).agg(F.count("*").alias("n_docs")).crossJoin(wanted.agg(F.sum(F.size(F.split("t", r"\s+"))).alias("n_words")))
    each = doubtful.select("pair", "doc_id", "item_id", F.posexplode("runs").alias("i", "place")).join(uses, ["item_id", "place"]).join(places, ["item_id", "place"])
    # places of one run follow each other: place - i is the same for all of them
    runs = each.groupBy("pair", "doc_id", "item_id", (F.col("place") - F.col("i")).alias("run")).agg(F.min(F.greatest(F.col("n") - F.col("held"), F.lit(0))).alias("others"))
    surprise = F.sum(F.log((F.col("n_docs") + 1) / (F.col("others") + 1)))
    told = runs.crossJoin(F.broadcast(size)).groupBy("pair", "doc_id", "item_id", "n_docs", "n_words").agg(surprise.alias("surprise"), F.min("others").alias("least"))
    no_chance = told.where((F.col("least") == 0) | (F.col("surprise") > F.log(F.col("n_docs") * F.col("n_words") / CHANCE)))
    return sure.unionByName(no_chance.select("doc_id", "item_id")).distinct()
