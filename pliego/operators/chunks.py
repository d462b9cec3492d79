"""Chunking: sections, token windows, paragraphs packed to a size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP = 512, 128
MARK = "\u0001"
#: Line-anchored headings by kind.
HEADINGS = {"roman_numerals": r"(?m)^[IVX]+\.\s+[\p{L}\p{N}_]+", "numbered": r"(?m)^\d+\.\s+[\p{L}\p{N}_]+", "articles": r"(?m)^ARTÍCULO\s+\d+", "clauses": r"(?m)^CLÁUSULA\s+[\p{L}\p{N}_]+", "uppercase_headers": r"(?m)^[A-Z][A-Z ]+:$", "markdown": r"(?m)^#{1,3}\s+[\p{L}\p{N}_]+"}


def heading_counts(text: Column) -> dict[str, Column]:
    return {k: F.regexp_count(text, F.lit(p.replace("(?m)", "(?md)"))) for k, p in HEADINGS.items()}


def predominant(counts: dict[str, Column]) -> Column:
    """The last kind with more than two headings, or plain."""
    return F.coalesce(*[F.when(c > 2, F.lit(k)) for k, c in reversed(counts.items())], F.lit("plain"))


def token_windows(df: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """key, chunk_index, content, n_tokens: windows of size tokens that share overlap; texts without tokens give none."""
    step = size - overlap
    words = df.select(key, F.filter(F.split(F.col(text), r"\s+"), lambda t: t != "").alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("w") - overlap - 1) / step).cast("int")))
    cut = words.select(key, "w", F.posexplode(starts).alias("chunk_index", "i"))
    part = F.slice("w", F.col("chunk_index") * step + 1, size)
    return cut.select(key, "chunk_index", F.array_join(part, " ").alias("content"), F.size(part).alias("n_tokens"))


def with_marks(text: Column) -> Column:
    """The text with MARK before every heading of the kinds that it has more than two of.

    Kinds are counted in the text itself, so every step holds the one before it once: filters that Spark pushes through
    the steps stay small.
    """
    marked = text
    for pattern in HEADINGS.values():
        p = pattern.replace("(?m)", "(?md)")
        marked = F.regexp_replace(marked, F.when(F.regexp_count(text, F.lit(p)) > 2, p).otherwise("(?!)"), F.lit(f"{MARK}$0"))
    return F.regexp_replace(marked, f"{MARK}+", MARK)


def sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, section_index, start_char, title and content of the sections that headings begin; a text without is one section.

    What stands before the first heading is no section. Offsets are places in the text as stored; the title is the
    section's first line, null in a text without headings.
    """
    marked = df.select(key, with_marks(F.col(text)).alias("t"))
    parts = F.split("t", MARK, -1)
    headed = F.size("parts") > 1
    kept = marked.select(key, parts.alias("parts")).select(key, headed.alias("headed"), F.when(headed, F.slice("parts", 2, F.size("parts"))).otherwise(F.col("parts")).alias("kept"), F.when(headed, F.length(F.get("parts", F.lit(0)))).otherwise(0).alias("before"))
    each = kept.select(key, "headed", "before", "kept", F.posexplode("kept").alias("section_index", "content"))
    start = F.col("before") + F.aggregate(F.slice("kept", 1, F.col("section_index")), F.lit(0), lambda n, x: n + F.length(x))
    return each.select(key, "section_index", start.alias("start_char"), F.when(F.col("headed"), F.trim(F.substring_index("content", "\n", 1))).alias("title"), F.trim("content").alias("content")).where("content <> ''")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def packed(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Paragraphs packed greedily into chunks of up to size tokens, as an array.

    A paragraph of more than size tokens is cut into windows that share overlap tokens, so no chunk exceeds size. A full
    chunk's last paragraph is carried over into the next one as overlap if both together have room.
    """

    def pieces(p: Column) -> Column:
        w = words_of(p)
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(w) - overlap - 1) / (size - overlap)).cast("int")))
        cut = F.transform(starts, lambda i: F.struct(F.array_join(F.slice(w, i * (size - overlap) + 1, size), " ").alias("p"), F.least(F.lit(size), F.size(w) - i * (size - overlap)).alias("n")))
        return F.when(F.size(w) > size, cut).otherwise(F.array(F.struct(F.trim(p).alias("p"), F.size(w).alias("n"))))

    paragraphs = F.flatten(F.transform(F.filter(F.split(text, r"\n\s*\n"), lambda p: F.trim(p) != ""), pieces))
    none = F.array().cast("array<struct<p:string,n:int>>")
    texts = lambda open_: F.array_join(F.transform(open_, lambda x: x["p"]), "\n\n")

    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc["open"], -1)
        full = (acc["n"] + x["n"] > size) & (F.size(acc["open"]) > 0)
        carried = F.when((F.lit(overlap) > 0) & (last["n"] + x["n"] <= size), F.array(last)).otherwise(none)
        open_ = F.when(full, carried).otherwise(acc["open"])
        n = F.aggregate(open_, F.lit(0), lambda s, y: s + y["n"]) + x["n"]
        return F.struct(F.when(full, F.concat(acc["done"], F.array(texts(acc["open"])))).otherwise(acc["done"]).alias("done"), F.concat(open_, F.array(x)).alias("open"), n.alias("n"))

    start = F.struct(F.array().cast("array<string>").alias("done"), none.alias("open"), F.lit(0).alias("n"))
    return F.aggregate(paragraphs, start, add, lambda acc: F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(texts(acc["open"])))).otherwise(acc["done"]))


def chunk_documents(df: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """key, chunk_index, chunk_id, title, start_char, n_tokens and content: sections, and large ones packed by paragraphs.

    start_char is where the chunk's section begins. The id is made of the key, the index and the content's md5.
    """
    each = sections(df, key, text)
    cut = F.when(F.size(words_of(F.col("content"))) > size, packed(F.col("content"), size, overlap)).otherwise(F.array("content"))
    chunks = each.select(key, "section_index", "start_char", "title", F.posexplode(cut).alias("part", "content"))
    # a document's chunks are numbered in order; the arrays of one document never leave its row before this
    numbered = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("section_index", "part", "start_char", "title", "content"))).alias("c"))
    out = numbered.select(key, F.posexplode("c").alias("chunk_index", "c"))
    chunk_id = F.concat_ws("_", F.col(key), F.lit("chunk"), F.col("chunk_index").cast("string"), F.substring(F.md5("c.content"), 1, 6))
    return out.select(key, "chunk_index", chunk_id.alias("chunk_id"), "c.title", "c.start_char", F.size(words_of(F.col("c.content"))).alias("n_tokens"), F.col("c.content").alias("content"))


def packed_paragraphs(df: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """key, chunk_index, content of texts packed by paragraphs alone."""
    return df.select(key, F.posexplode(packed(F.col(text), size, overlap)).alias("chunk_index", "content"))
