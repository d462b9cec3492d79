"""Loading of document files, and the sinks that keep documents, chunks and conversations.

Files are read by Spark's binaryFile source, so the walk and the pruning by name are Spark's; what a format needs
beyond SQL runs on Arrow batches in the tasks. A file that can't be read never fails the job: it gets a status.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pliego.functions.text import clean_spaces

WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
LOADED = "path string, filename string, extension string, size_bytes long, modified_at timestamp, content string, status string"
#: Most turns, and characters of JSON, in one row of an exported conversation (a longer single turn has its own).
BLOCK_TURNS = 1000
BLOCK_CHARS = 4_000_000


def decoded(raw: bytes) -> str:
    """UTF-8, or else Windows-1252."""
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode("cp1252", "replace")


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.parts: list[str] = []
        self.skipped = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.skipped += tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        self.skipped -= tag in ("script", "style") and self.skipped > 0

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.parts.append(data)


def html_text(raw: bytes) -> str:
    """Text without scripts and styles, a phrase on each line."""
    parser = _Text()
    parser.feed(decoded(raw))
    phrases = (p.strip() for line in "".join(parser.parts).splitlines() for p in line.strip().split("  "))
    return "\n".join(p for p in phrases if p)


def docx_text(raw: bytes) -> str:
    """Paragraphs, then the rows of tables."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")).find(f"{WORD}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{WORD}t")).strip()
    paragraphs = [t for p in body.findall(f"{WORD}p") if (t := text(p))]
    rows = [" | ".join(text(c) for c in r.findall(f"{WORD}tc")) for r in body.iter(f"{WORD}tr")]
    return "\n\n".join(paragraphs + (["[TABLAS]", "\n".join(rows)] if rows else []))


def csv_text(raw: bytes) -> str:
    return pd.read_csv(io.StringIO(decoded(raw)), dtype=str, keep_default_na=False).to_string(index=False)


READERS = {"txt": decoded, "doc": decoded, "html": html_text, "htm": html_text, "docx": docx_text, "csv": csv_text}


def load_directory(spark: SparkSession, path: str, readers: dict | None = None) -> DataFrame:
    """One row per file below path: file metadata, content and status (ok, empty, unsupported or the error's name).

    readers adds formats (for instance pdf or xlsx, whose parsers aren't part of this library): bytes to text by suffix.
    """
    known = READERS | (readers or {})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, states = [], []
            for ext, raw in zip(batch.extension, batch.raw):
                try:
                    text = known[ext](bytes(raw)) if ext in known else None
                    states.append("unsupported" if text is None else "ok" if text.strip() else "empty")
                except Exception as e:  # the file's fault, told in its row
                    text = None
                    states.append(type(e).__name__)
                texts.append(text)
            yield batch.drop(columns="raw").assign(content=texts, status=states)

    name = F.element_at(F.split("path", "/"), -1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = files.select("path", name.alias("filename"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("extension"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), F.col("content").alias("raw"))
    return rows.mapInPandas(read, LOADED)


def as_documents(loaded: DataFrame, keep_lines: bool = True) -> DataFrame:
    """Documents of the files read: id from name and content, and counts. keep_lines keeps line ends while cleaning."""
    text: Column = F.col("content")
    cleaned = F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), r"[^\S\n]+", " ")) if keep_lines else clean_spaces(text)
    rows = loaded.where("status = 'ok'").withColumn("content", cleaned)
    return rows.select(F.concat_ws("_", "filename", F.substring(F.md5("content"), 1, 8)).alias("doc_id"), "content", "filename", "extension", "size_bytes", "modified_at", F.length("content").alias("char_count"), F.size(F.split("content", r"\s+")).alias("word_count"))


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Appends the rows whose key isn't stored yet; each key once. A missing table is created."""
    spark = df.sparkSession
    df = df.dropDuplicates([key])
    try:
        stored = spark.read.parquet(path).select(key)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
    else:
        df = df.join(stored, key, "left_anti")
    df.write.mode("append").parquet(path)


def extraction_report(loaded: DataFrame) -> DataFrame:
    """How many files of each format ended in each state, and how much text they gave."""
    return loaded.groupBy("extension", "status").agg(F.count("*").alias("n_files"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("chars"))


def conversations(turns: DataFrame, key: str, order: str, *cols: str) -> DataFrame:
    """JSON texts with the turns of each conversation in order: its key, first_turn, n_turns and history.

    A conversation has as many rows as it needs: one holds at most BLOCK_TURNS turns and ends at BLOCK_CHARS. Turns are
    sorted by range over conversation and order, so that a long conversation lies in many tasks, and written as they pass.
    """
    sort = [key, order, *cols]
    kinds = dict(turns.dtypes)
    rows = turns.repartitionByRange(*sort).sortWithinPartitions(*sort).select(key, F.col(order).alias("first_turn"), F.to_json(F.struct(order, *cols)).alias("turn"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[str] = []
        chars, begin, schema = 0, None, None

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([begin[0], begin[1], pa.array([len(block)], pa.int64()), pa.array([f"[{','.join(block)}]"], pa.string())], [*schema.names[:2], "n_turns", "history"])

        of: object = None
        for batch in batches:
            schema = batch.schema
            for i, (k, turn) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                if block and (k != of or len(block) >= BLOCK_TURNS or chars + len(turn) > BLOCK_CHARS):
                    yield made()
                    block, chars = [], 0
                if not block:
                    of, begin = k, (batch.column(0).slice(i, 1), batch.column(1).slice(i, 1))
                block.append(turn)
                chars += len(turn)
        if block:
            yield made()

    return rows.mapInArrow(write, f"{key} {kinds[key]}, first_turn {kinds[order]}, n_turns long, history string")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A JSON log with a fixed schema; malformed lines are left out."""
    schema = "timestamp timestamp, level string, logger string, module string, function string, line int, message string, duration double, operation string, status_code int"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


