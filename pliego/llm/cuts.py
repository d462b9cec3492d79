"""Texts cut off before their end: a backward character n-gram model of how texts end.

For the last n characters of a text (n in ORDERS, read backward from the end) the model knows how often texts end
there and how often they go on. Both counts cover all texts: continuations at every position, ends once for each
distinct text. Only contexts that end some text are ever asked for, so Spark counts just these, exactly: a bitmap of
fixed size spares other positions, hashes of 64 bits name the contexts, partial counts are summed and joined.

The probability of an end after a context is interpolated from short to long orders; a text's own end is left out of
the count. Its log-odds are held against a threshold found for each language and column by splitting that group's
log-odds into two classes (the valley between them, within THRESHOLDS). A mark of omission at the end is
taken off first: what stands before it decides. Digits count as one sign and case is folded.

Null, empty and blank texts are no cases. Repeated rows are judged alike. A null or unknown language or source is a
group of its own; groups of fewer than FEW texts use the threshold of all texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pliego.llm.common import cut_lineage

ORDERS = (1, 2, 3, 4, 5, 6, 8, 10, 12)
#: Characters of a text's end, without trailing blanks, that its tail is taken from.
REACH = 40
#: A bit for each cell tells tasks which contexts may end a text.
CELL_BITS = 24
SIGNS_AT_ONCE = 400_000
#: Tables of odds and thresholds up to so many rows are broadcast.
BROADCAST_ROWS = 200_000
WIDTH = 0.25
#: Weight of the shorter orders' probability beside the counts of the longer one.
PRIOR = 3.0
FEW = 200
#: Bounds of the threshold on log-odds.
THRESHOLDS = (-5.0, -3.3)
OMISSION = re.compile(r"(?:\s*(?:…|\.\.\.+|\[…\]|\[\.\.\.\]|\(…\)|\(\.\.\.\)|�))+\s*$")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(1099511628211)


def folded(text: str) -> str:
    return re.sub(r"\d", "0", text.lower())


def tail(text: str | None) -> str | None:
    """The end of a text as the model sees it, without a mark of omission; None for blank texts."""
    text = (text or "").rstrip()
    if not text:
        return None
    return folded(OMISSION.sub("", text)[-max(ORDERS) :])


def hashes_of(codes: np.ndarray) -> Iterator[np.ndarray]:
    """For each order a 64-bit hash of the context that ends at every position; earlier signs may be padding."""
    codes = codes.astype(np.uint64) + np.uint64(1)
    h, power, n = np.zeros(len(codes), np.uint64), np.uint64(1), 0
    with np.errstate(over="ignore"):
        for order in ORDERS:
            while n < order:
                h[n:] += codes[: len(codes) - n] * power
                power *= STEP
                n += 1
            mixed = h * MULTIPLIER
            yield (mixed ^ (mixed >> np.uint64(29))) * STEP


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts with padding between them, and the position of each text's last sign."""
    pad = "\0" * max(ORDERS)
    codes = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + len(pad) for t in texts]) - 1
    return codes, ends


def cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def continuations(texts: list[str], ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each order how often a text goes on after the contexts that share a cell with one that ends a text."""
    texts = [t for t in texts if t]
    if not texts:
        return
    codes, last = coded(texts)
    goes_on = codes != 0
    goes_on[last] = False
    for order, h in zip(ORDERS, hashes_of(codes)):
        h = h[goes_on & ends[cell(h)]]
        if len(h):
            yield order, *np.unique(h, return_counts=True)


def split_point(histogram: dict[int, int], width: float) -> float:
    """The value that splits a histogram of log-odds into two classes: the middle of the emptiest stretch in bounds."""
    low, high = THRESHOLDS
    cells = np.arange(int(np.floor(low / width)), int(np.ceil(high / width)) + 1)
    counts = np.array([histogram.get(int(c), 0) for c in cells], float)
    smooth = np.convolve(np.pad(counts, 2, mode="edge"), np.ones(5) / 5, mode="valid")
    least = np.flatnonzero(smooth == smooth.min())
    runs = np.split(least, np.flatnonzero(np.diff(least) > 1) + 1)
    best = max(runs, key=len)
    return float((cells[best[0]] + cells[best[-1]] + 1) / 2 * width)


def _end(text: Column) -> Column:
    # trailing blanks are taken off before the end is cut out, so that any number of them does no harm
    trimmed = F.regexp_replace(text, r"\s+$", "")
    return F.substring(trimmed, -REACH, REACH)


def with_tail(df: DataFrame, text: str) -> DataFrame:
    """df with tail (the end as the model sees it; null for blank texts) and omission (whether a mark of omission stands there)."""

    @F.pandas_udf("struct<tail string, omission boolean>")
    def look(ends):
        import pandas as pd

        return pd.DataFrame({"tail": [tail(t) for t in ends], "omission": [bool(t and OMISSION.search(t)) for t in ends]})

    return df.withColumn("_seen", look(_end(F.col(text)))).withColumn("tail", F.col("_seen.tail")).withColumn("omission", F.col("_seen.omission")).drop("_seen")


class EndModel:
    """A trained model: the log-odds of an end after every tail that some text has."""

    def __init__(self, odds: DataFrame, tails: int) -> None:
        self.odds, self.tails = odds, tails

    @classmethod
    def train(cls, df: DataFrame, text: str) -> EndModel:
        texts = df.select(F.col(text).alias("t")).where("t is not null")
        ends = with_tail(texts.select(F.md5("t").alias("d"), _end(F.col("t")).alias("e")).distinct(), "e").where("tail is not null and tail <> ''")
        tails = cut_lineage(ends.groupBy("tail").agg(F.count("*").alias("n")))

        def contexts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = batch.column(0).to_pylist()
                codes, last = coded(found)
                n = batch.column(1).to_numpy()
                length = np.array([len(t) for t in found])
                for order, h in zip(ORDERS, hashes_of(codes)):
                    long = length >= order
                    yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(long)), pa.array(np.full(long.sum(), order), pa.int32()), pa.array(h[last][long].view(np.int64)), pa.array(n[long])], ["tail", "ord", "h", "n"])

        contexts = tails.mapInArrow(contexts_of, "tail string, ord int, h long, n long")
        ended = contexts.groupBy("ord", "h").agg(F.sum("n").alias("ended"))
        # one bit for each cell of hashes, whatever the corpus: it spares positions whose context ends no text
        marks = np.zeros(1 << CELL_BITS, bool)
        at = ended.select(F.shiftrightunsigned("h", 64 - CELL_BITS).alias("c")).distinct().toArrow()["c"].to_numpy()  # at most 2 ** CELL_BITS
        marks[at] = True
        shared = df.sparkSession.sparkContext.broadcast(np.packbits(marks))

        def count_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            marked = np.unpackbits(shared.value).astype(bool)
            signs = 0
            for batch in batches:
                part: list[str] = []
                size = 0
                for t in [*batch.column(0).to_pylist(), None]:
                    if t is not None:
                        part.append(folded(t.rstrip()))
                        size += len(part[-1])
                        signs += len(part[-1])
                    if size >= SIGNS_AT_ONCE or t is None:
                        for order, h, n in continuations(part, marked):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), order), pa.int32()), pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["ord", "h", "n"])
                        part, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([0], pa.int64()), pa.array([signs], pa.int64())], ["ord", "h", "n"])

        on = cut_lineage(texts.mapInArrow(count_on, "ord int, h long, n long").groupBy("ord", "h").agg(F.sum("n").alias("goes_on")))
        all_signs = on.where("ord = 0").agg(F.coalesce(F.sum("goes_on"), F.lit(0))).first()[0]
        all_ends, n_tails = tails.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        counts = ended.join(on.where("ord > 0"), ["ord", "h"], "left").withColumn("goes_on", F.coalesce("goes_on", F.lit(0)))
        by_tail = contexts.select("tail", "ord", "h").join(counts, ["ord", "h"]).groupBy("tail").agg(F.array_sort(F.collect_list(F.struct("ord", "ended", "goes_on"))).alias("c"))
        # from short to long orders; the tail's own end is left out
        start = F.lit(max(all_ends, 1) / max(all_signs, 2))
        p = F.aggregate("c", start, lambda p, c: (c["ended"] - 1 + PRIOR * p) / (c["ended"] - 1 + c["goes_on"] + PRIOR))
        return cls(cut_lineage(by_tail.withColumn("p", p).select("tail", (F.log("p") - F.log1p(-F.col("p"))).alias("log_odds"))), n_tails)

    def score(self, df: DataFrame, text: str) -> DataFrame:
        """df with log_odds (null for blank texts) and omission (whether a mark of omission stands at the end)."""
        odds = F.broadcast(self.odds) if self.tails <= BROADCAST_ROWS else self.odds
        return with_tail(df, text).join(odds, "tail", "left").drop("tail")


def histogram(scored: DataFrame, language: str, width: float) -> DataFrame:
    return scored.where("log_odds is not null").groupBy(F.coalesce(F.col(language), F.lit("")).alias("l"), F.floor(F.col("log_odds") / width).cast("int").alias("b")).agg(F.count("*").alias("n"))


def whole_threshold(scored: DataFrame, width: float = WIDTH) -> float:
    """The threshold of all texts, from the histogram of their log-odds (a row for each WIDTH of it)."""
    return split_point({r.b: r.n for r in histogram(scored.withColumn("_l", F.lit("")), "_l", width).collect()}, width)


def thresholds(scored: DataFrame, language: str, width: float = WIDTH) -> DataFrame:
    """l and its threshold (at), of every language with FEW texts or more."""

    def split(group):
        import pandas as pd

        return pd.DataFrame({"l": [group.l.iloc[0]], "at": [split_point(dict(zip(group.b, group.n)), width)]})

    counted = histogram(scored, language, width)
    enough = counted.groupBy("l").agg(F.sum("n").alias("n")).where(F.col("n") >= FEW).select("l")
    return counted.join(enough, "l").groupBy("l").applyInPandas(split, "l string, at double")  # a group has a row for each WIDTH


def find_cuts(df: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, source, cut, log_odds and omission of every row; cut is false for null, empty and blank texts."""
    rows = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.lower(F.trim(F.col(language))).alias("language"), F.col(source).alias("source"))
    scored = cut_lineage(EndModel.train(df, text).score(rows, "text").drop("text"))
    at = thresholds(scored, "language")
    at = F.broadcast(at) if at.count() <= BROADCAST_ROWS else at
    limit = F.coalesce("at", F.lit(whole_threshold(scored)))
    judged = scored.withColumn("l", F.coalesce("language", F.lit(""))).join(at, "l", "left")
    return judged.select("doc_id", "source", F.coalesce(F.col("log_odds") < limit, F.lit(False)).alias("cut"), "log_odds", "omission")
