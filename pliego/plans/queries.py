"""Registered queries of the core, each over its whole tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pliego.functions import text as tx
from pliego.operators import chunks as ch
from pliego.operators import contracts as ca
from pliego.operators import ranking as rk
from pliego.operators import search as se

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- pieces of SQL ----------------------------------------------------------------------------------------------------


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join(map(q, words)) + "]"


def sql_tokens(col: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({col}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' '), lambda t: t <> '' and not list_contains({sql_list(tx.STOP_WORDS)}, t))"


def sql_words(col: str) -> str:
    return f"list_filter(regexp_split_to_array({col}, '\\s+'), lambda t: t <> '')"


def sql_hits(low: str, words: list[str]) -> str:
    return "(" + " + ".join(f"contains({low}, {q(w)})::int" for w in words) + ")"


def sql_count(low: str, pattern: str) -> str:
    return f"len(regexp_extract_all({low}, {q(pattern)}))"


ASKED = f"asked as (select response_id as query_id, {sql_tokens('min(query)')} as terms from responses where response_id % 100 = 0 group by 1)"
HIT_ROWS = "h as (select response_id, chunk_id, min(rank_no) as rank_no, max(score) as score, min(content) as content from hits where chunk_id is not null and score is not null group by 1, 2)"
ANSWERS = "r as (select response_id, min(session_id) as session_id, min(query) as query, min(answer) as answer, max(confidence) as confidence, min(answered_at) as answered_at, max(coalesce(len(sources), 0)) as n_sources, max(coalesce(len(warnings), 0)) as n_warnings from responses group by 1)"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every response whose id is divisible by 100, with its terms."""
    return read(spark, sf_dir, "responses").where("response_id % 100 = 0").groupBy(F.col("response_id").alias("query_id")).agg(F.min("query").alias("query")).select("query_id", tx.tokens(F.col("query")).alias("terms"))


def hit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "hits").where("chunk_id is not null and score is not null").groupBy("response_id", "chunk_id").agg(F.min("rank_no").alias("rank_no"), F.max("score").alias("score"), F.min("content").alias("content"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "responses")
    return r.groupBy("response_id").agg(F.min("session_id").alias("session_id"), F.min("query").alias("query"), F.min("answer").alias("answer"), F.max("confidence").alias("confidence"), F.min("answered_at").alias("answered_at"), F.max(F.coalesce(F.array_size("sources"), F.lit(0))).alias("n_sources"), F.max(F.coalesce(F.array_size("warnings"), F.lit(0))).alias("n_warnings"))


def tokenised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", tx.tokens(F.col("text")).alias("tokens"))


# --- search -----------------------------------------------------------------------------------------------------------


def sql_bm25(terms: str = "terms", robertson: bool = False, k: int = 50) -> str:
    weight = "ln(1 + (n_docs - df + 0.5) / (df + 0.5))" if robertson else "ln((n_docs + 1) / 2)"
    df = ", f as (select term, count(*) as df from p group by 1)" if robertson else ""
    return f"""with d as (select doc_id, {sql_tokens('text')} as w from documents where text is not null), s as (select count(*) as n_docs, avg(len(w)) as avg_len from d), {ASKED},
    t as (select query_id, term, count(*) as times from (select query_id, unnest({terms}) as term from asked) group by 1, 2),
    p as (select doc_id, len, term, count(*) as tf from (select doc_id, len(w) as len, unnest(w) as term from d) where term in (select term from t) group by 1, 2, 3){df},
    sc as (select query_id, doc_id, round(sum(times * {weight} * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg_len))), 6) as score from p join t using (term) {'join f using (term)' if robertson else ''}, s group by 1, 2)
    select * from (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from sc where score > 0) where rank <= {k}"""


@query(sql_bm25())
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.top_k(se.bm25(tokenised(spark, sf_dir), asked(spark, sf_dir), "doc_id"), 50, "query_id", "doc_id")


@query(sql_bm25("list_concat(terms, ['contrato', 'cláusula'])"))
def bm25_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    boosted = asked(spark, sf_dir).withColumn("terms", F.concat("terms", F.array(F.lit("contrato"), F.lit("cláusula"))))
    return se.top_k(se.bm25(tokenised(spark, sf_dir), boosted, "doc_id"), 50, "query_id", "doc_id")


@query(sql_bm25(robertson=True))
def bm25_robertson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.top_k(se.bm25(tokenised(spark, sf_dir), asked(spark, sf_dir), "doc_id", "robertson"), 50, "query_id", "doc_id")


@query(f"""with {ASKED}, sc as (select query_id, doc_id, round(len(list_filter(terms, lambda t: contains(lower(text), t))) / len(terms), 6) as score from documents, asked where text is not null)
    select * from (select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from sc where score > 0) where rank <= 50""")
def keyword_substring_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rk.substring_top(read(spark, sf_dir, "documents"), asked(spark, sf_dir), "doc_id", "text", 50)


VECTORS = "v as (select a.vec_id as query_id, b.vec_id, a.label as query_label, b.label, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as score from embeddings a, embeddings b where a.vec_id % 100 = 0)"
TOP_VECTORS = "select * from (select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from {0}) where rank <= 20"


def vector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    asked_for = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), F.col("label").alias("query_label"))
    return se.vector_scores(e, asked_for.select("query_id", "query_vector"), "vec_id").join(se.small(asked_for.select("query_id", "query_label")), "query_id")


@query(f"with {VECTORS} {TOP_VECTORS.format('v')}")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.top_k(vector_rows(spark, sf_dir), 20, "query_id", "vec_id").select("query_id", "vec_id", "score", "rank")


@query(f"with {VECTORS}, w as (select * from v where label = query_label) {TOP_VECTORS.format('w')}")
def cosine_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.top_k(vector_rows(spark, sf_dir).where("label = query_label"), 20, "query_id", "vec_id").select("query_id", "vec_id", "score", "rank")


@query(f"with {VECTORS}, t as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from v) select query_id, vec_id, score, rank from t where rank <= 40 and label = query_label")
def cosine_postfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.top_k(vector_rows(spark, sf_dir), 40, "query_id", "vec_id").where("label = query_label").select("query_id", "vec_id", "score", "rank")


@query("""with c as (select label, i, avg(x) as x from (select label, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) as i from embeddings) group by 1, 2), m as (select label as query_id, list(x order by i) as m from c group by 1),
    sc as (select query_id, vec_id, round(list_cosine_similarity(embedding::double[], m), 6) as score from embeddings, m) select * from (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from sc) where rank <= 10""")
def centroid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centres = means.groupBy(F.col("label").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("query_vector"))
    return se.top_k(se.vector_scores(e.select("vec_id", "embedding"), centres, "vec_id"), 10, "query_id", "vec_id").select("query_id", "vec_id", "score", "rank")


@query(f"""with d as (select doc_id, {sql_tokens('text')} as w from documents where text is not null), s as (select count(*) as n_docs, avg(len(w)) as avg_len from d),
    t as (select query_id, term, count(*) as times from (select doc_id as query_id, unnest(w) as term from d where doc_id % 100 = 0) group by 1, 2),
    p as (select doc_id, len, term, count(*) as tf from (select doc_id, len(w) as len, unnest(w) as term from d) where term in (select term from t) group by 1, 2, 3),
    sc as (select query_id, doc_id, round(sum(times * ln((n_docs + 1) / 2) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg_len))), 6) as score from p join t using (term), s group by 1, 2),
    {VECTORS}, legs as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as rank from sc where score > 0 union all select query_id, vec_id, row_number() over (partition by query_id order by score desc, vec_id) from v),
    f as (select query_id, doc_id, round(sum(1.0 / (60 + rank)::double), 9) as score, count(*) as n_lists from legs where rank <= 50 group by 1, 2) select * from (select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from f) where rank <= 20""")
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 and cosine legs of 50, fused by reciprocal rank, top 20."""
    docs = tokenised(spark, sf_dir)
    queries = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("tokens").alias("terms"))
    keyword = rk.bm25_top(docs, queries, "doc_id", 50).select("query_id", "doc_id", "rank")
    vector = se.top_k(vector_rows(spark, sf_dir), 50, "query_id", "vec_id").select("query_id", F.col("vec_id").alias("doc_id"), "rank")
    return se.top_k(se.rrf(keyword.unionByName(vector), "query_id", "doc_id"), 20, "query_id", "doc_id")


# --- fusion and reranking over search hits --------------------------------------------------------------------------


@query(f"""with {HIT_ROWS}, l as (select response_id, chunk_id, row_number() over (partition by response_id order by rank_no, chunk_id) as rank from h union all select response_id, chunk_id, row_number() over (partition by response_id order by score desc, chunk_id) from h)
    select response_id, chunk_id, round(sum(1.0 / (60 + rank)::double), 9) as score, count(*) as n_lists from l group by 1, 2""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hit_rows(spark, sf_dir)
    w = Window.partitionBy("response_id")
    ranked = h.withColumn("by_rank", F.row_number().over(w.orderBy("rank_no", "chunk_id"))).withColumn("by_score", F.row_number().over(w.orderBy(F.col("score").desc(), "chunk_id")))
    both = ranked.select("response_id", "chunk_id", F.explode(F.array("by_rank", "by_score")).alias("rank"))
    return se.rrf(both, "response_id", "chunk_id")


@query(f"""with {HIT_ROWS}, l as (select response_id, chunk_id, 'score' as list, score, 0.6 as weight from h union all select response_id, chunk_id, 'rank', 1.0 / rank_no, 0.4 from h),
    m as (select *, min(score) over (partition by response_id, list) as low, max(score) over (partition by response_id, list) as high from l)
    select response_id, chunk_id, round(sum(weight * case when high = low then score else (score - low) / (high - low) end)::double, 6) as score from m group by 1, 2""")
def weighted_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hit_rows(spark, sf_dir)
    lists = h.select("response_id", "chunk_id", F.explode(F.array(F.struct(F.lit("score").alias("list"), F.col("score").alias("score")), F.struct(F.lit("rank").alias("list"), (1.0 / F.col("rank_no")).alias("score")))).alias("l")).select("response_id", "chunk_id", "l.list", "l.score")
    return se.weighted_fusion(lists, "response_id", "chunk_id", {"score": 0.6, "rank": 0.4})


LEXICAL = f"""{HIT_ROWS}, {ANSWERS}, x as (select response_id, chunk_id, rank_no, score, content, query, list_distinct({sql_words('lower(query)')}) as terms from h join r using (response_id) where query is not null and content is not null),
    y as (select *, round(len(list_filter(terms, lambda t: contains(lower(content), t))) * case when contains(lower(content), lower(trim(query))) then 2 else 1 end / nullif(len(terms), 0), 4) as lexical from x)"""


def with_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = hit_rows(spark, sf_dir).join(answers(spark, sf_dir).select("response_id", "query"), "response_id").where("query is not null and content is not null")
    return joined.withColumn("lexical", se.lexical_score(F.col("query"), F.col("content")))


@query(f"with {LEXICAL}, z as (select response_id, chunk_id, rank_no, lexical, round(0.3 * score + 0.7 * lexical + 1e-9, 6) as combined from y) select *, row_number() over (partition by response_id order by combined desc, chunk_id)::int as new_rank from z")
def rerank_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = with_lexical(spark, sf_dir).select("response_id", "chunk_id", "rank_no", "lexical", F.round(se.combine(F.col("score"), F.col("lexical")) + 1e-9, 6).alias("combined"))
    return z.withColumn("new_rank", F.row_number().over(Window.partitionBy("response_id").orderBy(F.col("combined").desc(), "chunk_id")))


@query(f"with {LEXICAL} select response_id, chunk_id, round(length(content) / 1000, 6) as length_score, round(len(list_intersect(terms, list_distinct({sql_words('lower(content)')}))) / nullif(len(terms), 0), 6) as overlap, case when contains(lower(content), lower(trim(query))) then 1 else 0 end as exact, round(coalesce(1.0 / (list_min(list_filter(list_transform(terms, lambda t: instr(lower(content), t)), lambda p: p > 0)) + 0), 0)::double, 6) as position_score from y")
def rerank_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda t: t != ""))
    x = with_lexical(spark, sf_dir).withColumn("terms", words("query"))
    return x.select("response_id", "chunk_id", F.round(F.length("content") / 1000, 6).alias("length_score"), F.round(F.try_divide(F.size(F.array_intersect("terms", words("content"))), F.size("terms")), 6).alias("overlap"), F.contains(F.lower("content"), F.lower(F.trim("query"))).cast("int").alias("exact"), F.round(F.coalesce(1.0 / F.array_min(F.filter(F.transform("terms", lambda t: F.instr(F.lower("content"), t)), lambda p: p > 0)), F.lit(0.0)), 6).alias("position_score"))


@query(f"""with {LEXICAL}, used as (select distinct response_id, s.chunk_id from (select response_id, unnest(sources) as s from responses) where s.chunk_id is not null), n as (select y.response_id, count(*) as n from y join used using (response_id, chunk_id) group by 1),
    g as (select y.response_id, y.chunk_id, w / 10 as weight, round((w / 10) * score + (1 - w / 10) * lexical, 6) as s from y, (select unnest(range(0, 11)) as w)),
    k as (select g.*, row_number() over (partition by response_id, weight order by s desc, chunk_id) as rank from g), p as (select k.weight, k.response_id, count(u.chunk_id) / any_value(n.n) as precision from k join n using (response_id) left join used u on u.response_id = k.response_id and u.chunk_id = k.chunk_id where rank <= n.n group by 1, 2)
    select weight, round(avg(precision), 6) as mean_precision, count(*) as n_queries from p group by 1""")
def rerank_weight_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean precision at the number of relevant hits for each weight of the original score; used sources are relevant."""
    y = with_lexical(spark, sf_dir)
    used = read(spark, sf_dir, "responses").select("response_id", F.explode("sources.chunk_id").alias("chunk_id")).where("chunk_id is not null").distinct().withColumn("relevant", F.lit(1))
    marked = y.join(used, ["response_id", "chunk_id"], "left").withColumn("n", F.count("relevant").over(Window.partitionBy("response_id"))).where("n > 0")
    grid = marked.withColumn("weight", F.explode(F.array(*[F.lit(i / 10) for i in range(11)])))
    scored = grid.withColumn("s", F.round(F.col("weight") * F.col("score") + (1 - F.col("weight")) * F.col("lexical"), 6))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("response_id", "weight").orderBy(F.col("s").desc(), "chunk_id"))).where("rank <= n")
    each = ranked.groupBy("weight", "response_id").agg((F.count("relevant") / F.first("n")).alias("precision"))
    return each.groupBy("weight").agg(F.round(F.avg("precision"), 6).alias("mean_precision"), F.count("*").alias("n_queries"))


# --- inventory --------------------------------------------------------------------------------------------------------

TYPED = "c as (select doc_id, metadata.filename as filename, coalesce(lower(trim(metadata.contract_type)), 'otros') as contract_type, min(content) as content from contracts group by 1, 2, 3)"


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "contracts")
    return c.groupBy("doc_id", F.col("metadata.filename").alias("filename"), F.coalesce(F.lower(F.trim("metadata.contract_type")), F.lit("otros")).alias("contract_type")).agg(F.min("content").alias("content"))


@query(f"with {TYPED} select contract_type, count(*) as n_documents, count(distinct filename) as n_files from c group by 1")
def type_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(spark, sf_dir).groupBy("contract_type").agg(F.count("*").alias("n_documents"), F.countDistinct("filename").alias("n_files"))


@query(f"with {TYPED} select contract_type, doc_id, substr(content, 1, 200) as sample from (select *, row_number() over (partition by contract_type order by doc_id) as n from c where content is not null) where n = 1")
def distinct_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = typed(spark, sf_dir).where("content is not null").groupBy("contract_type").agg(F.min_by(F.struct("doc_id", "content"), "doc_id").alias("f"))
    return first.select("contract_type", "f.doc_id", F.substring("f.content", 1, 200).alias("sample"))


@query(f"with {TYPED} select contract_type, doc_id, n::int as rank from (select *, row_number() over (partition by contract_type order by doc_id) as n from c) where n <= 2")
def per_type_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = typed(spark, sf_dir).withColumn("rank", F.row_number().over(Window.partitionBy("contract_type").orderBy("doc_id")))
    return ranked.where("rank <= 2").select("contract_type", "doc_id", "rank")


# --- cleaning and extraction ------------------------------------------------------------------------------------------


def _contracts(spark: SparkSession, sf_dir: str, **cols: Column) -> DataFrame:
    return read(spark, sf_dir, "contracts").where("content is not null").select("doc_id", *[c.alias(n) for n, c in cols.items()])


CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


@query(f"select doc_id, trim(regexp_replace(regexp_replace(content, '{CONTROL}', '', 'g'), '\\s+', ' ', 'g')) as cleaned from contracts where content is not null")
def clean_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contracts(spark, sf_dir, cleaned=tx.clean_spaces(F.col("content")))


def _sql_repairs(col: str) -> str:
    for bad, good in tx.REPAIRS:
        col = f"replace({col}, {q(bad)}, {q(good)})"
    return f"regexp_replace({col}, '{CONTROL}', '', 'g')"


@query(f"select doc_id, {_sql_repairs('content')} as repaired from contracts where content is not null")
def fix_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contracts(spark, sf_dir, repaired=tx.repair_encoding(F.col("content")))


@query("select doc_id, regexp_replace(translate(content, '„«»‚‛', chr(34) || chr(34) || chr(34) || chr(39) || chr(39)), chr(34) || '{2,}', chr(34), 'g') as quoted from contracts where content is not null")
def standardize_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contracts(spark, sf_dir, quoted=tx.plain_quotes(F.col("content")))


@query(f"select doc_id, regexp_replace(content, {q('(?i)' + tx.WATERMARKS)}, '', 'g') as unmarked from contracts where content is not null")
def watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contracts(spark, sf_dir, unmarked=tx.without_watermarks(F.col("content")))


@query()
def ocr_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contracts(spark, sf_dir, cleaned=tx.clean_ocr(F.col("content")))


@query("select doc_id, concat_ws('_', metadata.filename, substr(md5(content), 1, 8)) as made_id from contracts where content is not null")
def document_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contracts(spark, sf_dir, made_id=F.concat_ws("_", F.col("metadata.filename"), F.substring(F.md5("content"), 1, 8)))


@query(f"select doc_id, length(text) as char_count, len({sql_words('text')}) as word_count, len(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: trim(s)), lambda s: length(s) > 10)) as n_sentences from documents where text is not null")
def content_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.length("text").cast("long").alias("char_count"), F.size(F.filter(F.split("text", r"\s+"), lambda t: t != "")).cast("long").alias("word_count"), F.size(tx.sentences(F.col("text"))).cast("long").alias("n_sentences"))


_FIRST = f"list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '')[1:200]"


@query(f"""with c as (select doc_id, lower(text) as low, len(list_filter({_FIRST}, lambda t: list_contains({sql_list(tx.SPANISH_WORDS)}, t))) as es, len(list_filter({_FIRST}, lambda t: list_contains({sql_list(tx.ENGLISH_WORDS)}, t))) as en from documents where text is not null)
    select doc_id, case when es > en * 1.2 then 'es' when en > es * 1.2 then 'en' when regexp_matches(low, '(?:^|[^\p{{L}}])(?:artículo|cláusula|contrato|acuerdo|partes)(?:[^\p{{L}}]|$)') then 'es' when regexp_matches(low, '(?:^|[^\p{{L}}])(?:article|clause|agreement|contract|parties)(?:[^\p{{L}}]|$)') then 'en' else 'es' end as detected from c""")
def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", tx.language(F.col("text")).alias("detected"))


@query(f"""with t as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as pos from (select doc_id, {sql_tokens('text')} as w from documents where text is not null)), n as (select doc_id, word, count(*) as times, min(pos) as first_at from t where length(word) > 3 group by 1, 2)
    select doc_id, word, times, rank from (select doc_id, word, times, row_number() over (partition by doc_id order by times desc, first_at)::int as rank from n) where rank <= 5""")
def keywords_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokenised(spark, sf_dir).select("doc_id", F.posexplode("tokens").alias("at", "word")).where(F.length("word") > 3)
    n = t.groupBy("doc_id", "word").agg(F.count("*").alias("times"), F.min("at").alias("first_at"))
    ranked = n.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("times").desc(), "first_at")))
    return ranked.where("rank <= 5").select("doc_id", "word", "times", "rank")


def _sql_type(types: dict[str, list[str]], low: str, double: bool, default: str) -> str:
    score = {t: sql_hits(low, ws) + (" + " + sql_hits(low, [w for w in ws if len(w) > 10]) if double and any(len(w) > 10 for w in ws) else "") for t, ws in types.items()}
    best = f"greatest({', '.join(score.values())})"
    return f"case when {best} > 0 then case {' '.join(f'when {s} = {best} then {q(t)}' for t, s in score.items())} end else {q(default)} end"


_EARLY = " ".join(f"when {sql_hits('lower(substr(content, 1, 1000))', ws)} > 0 then {q(t)}" for t, ws in ca.LOADER_TYPES.items())


@query(f"select doc_id, case {_EARLY} else {_sql_type(ca.LOADER_TYPES, 'lower(content)', True, 'otros')} end as contract_type from contracts where content is not null")
def classify_loader(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contracts(spark, sf_dir, contract_type=ca.loader_type(F.col("content")))


@query(f"select doc_id, {_sql_type(ca.ANALYSER_TYPES, 'lower(content)', False, 'genérico')} as contract_type from contracts where content is not null")
def classify_analyser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contracts(spark, sf_dir, contract_type=ca.analyser_type(F.col("content")))


_RISK = " + ".join(f"({w}) * {sql_hits('lower(content)', ps)}" for w, ps in ca.RISKS.items())


@query(f"with s as (select doc_id, ({_RISK})::int as score from contracts where content is not null) select doc_id, score, case when score >= 10 then 'alto' when score >= 5 then 'medio' else 'bajo' end as level from s")
def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contracts(spark, sf_dir, score=ca.risk_score(F.col("content"))).withColumn("level", ca.risk_level(F.col("score")))


_PARTS = " + ".join(f"{w} * {sql_count('lower(content)', p)}" for p, w in ca.COMPLEXITY.values())


@query(f"with s as (select doc_id, least(10.0, (length(content) / 1000 * 0.1 + {_PARTS}) / 10)::double as raw from contracts where content is not null) select doc_id, round(raw, 2) as score, case when raw > 7 then 'alto' when raw > 4 then 'medio' else 'bajo' end as level from s")
def complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contracts(spark, sf_dir, score=ca.complexity(F.col("content")), level=ca.complexity_level(F.col("content")))


_SPECIAL = ", ".join(f"case when {sql_hits('lower(content)', ws)} > 0 then {q(t)} end" for t, ws in ca.SPECIAL.items())


@query(f"select doc_id, unnest(list_filter([{_SPECIAL}], lambda x: x is not null)) as clause_type from contracts where content is not null")
def special_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contracts(spark, sf_dir, clause_type=F.explode(ca.special_clauses(F.col("content"))))


@query(f"with f as (select doc_id, row_number() over () as r, regexp_extract_all(content, {q('(' + ca.DATES + ')')}, 1) as d from contracts where content is not null), u as (select doc_id, r, d, unnest(d) as x, generate_subscripts(d, 1) as pos from f), m as (select doc_id, r, x, min(pos) as pos from u group by 1, 2, 3) select doc_id, x as found_date from (select *, row_number() over (partition by doc_id, r order by pos) as n from m) where n <= {ca.MAX_DATES}")
def dates_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contracts(spark, sf_dir, found_date=F.explode(ca.dates(F.col("content"))))


@query(f"with a as (select doc_id, list_transform(regexp_extract_all(lower(content), {q(ca.AMOUNTS)}, 1), lambda x: replace(replace(x, '.', ''), ',', '.')::decimal(18, 2)) as a from contracts where content is not null) select doc_id, len(a) as n_amounts, coalesce(list_sum(a), 0)::double as total_eur from a")
def amounts_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _contracts(spark, sf_dir, a=ca.amounts(F.col("content")))
    return a.select("doc_id", F.size("a").cast("long").alias("n_amounts"), F.aggregate("a", F.lit(0).cast("decimal(28,2)"), lambda s, x: (s + x).cast("decimal(28,2)")).cast("double").alias("total_eur"))


@query()
def clause_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contracts(spark, sf_dir, c=F.explode(ca.clauses(F.col("content")))).select("doc_id", "c.*")


@query(f"""with {TYPED}, a as (select contract_type, coalesce(list_sum(list_transform(regexp_extract_all(lower(content), {q(ca.AMOUNTS)}, 1), lambda x: replace(replace(x, '.', ''), ',', '.')::decimal(18, 2))), 0)::double as total from c where content is not null)
    select contract_type, count(*) as n, max(total) as most, min(total) as least, round(avg(total), 2) as mean, round(case when min(total) > 0 then (max(total) - min(total)) / min(total) else 0 end, 6) as variation from a group by 1""")
def compare_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = typed(spark, sf_dir).where("content is not null").select("contract_type", F.aggregate(ca.amounts(F.col("content")), F.lit(0).cast("decimal(28,2)"), lambda s, x: (s + x).cast("decimal(28,2)")).cast("double").alias("total"))
    low, high = F.min("total"), F.max("total")
    return a.groupBy("contract_type").agg(F.count("*").alias("n"), high.alias("most"), low.alias("least"), F.round(F.avg("total"), 2).alias("mean"), F.round(F.when(low > 0, (high - low) / low).otherwise(0), 6).alias("variation"))


# --- chunks -----------------------------------------------------------------------------------------------------------

_HEADS = {k: sql_count("content", p) for k, p in ch.HEADINGS.items()}


@query(f"select doc_id, {', '.join(f'{v} as {k}' for k, v in _HEADS.items())}, case {' '.join(f'when {v} > 2 then {q(k)}' for k, v in reversed(_HEADS.items()))} else 'plain' end as predominant from contracts where content is not null")
def section_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = {k: c.cast("long") for k, c in ch.heading_counts(F.col("content")).items()}
    return _contracts(spark, sf_dir, **counts, predominant=ch.predominant(counts))


_W = f"(select doc_id, {sql_words('text')} as w from documents where text is not null)"


@query(f"select doc_id, i::int as chunk_index, array_to_string(w[i * 96 + 1:i * 96 + 128], ' ') as content, len(w[i * 96 + 1:i * 96 + 128])::int as n_tokens from (select doc_id, w, unnest(range(0, greatest(0, floor((len(w) - 33) / 96)::int) + 1)) as i from {_W} where len(w) > 0)")
def chunk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.token_windows(read(spark, sf_dir, "documents").where("text is not null"), "doc_id", "text", 128, 32)


@query()
def chunk_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.packed_paragraphs(read(spark, sf_dir, "contracts").where("content is not null").dropDuplicates(["doc_id", "content"]), "doc_id", "content", 128)


@query("select doc_id, count(*) as n_chunks, round(avg(length(content)), 4) as mean_chars, min(length(content)) as least, max(length(content)) as most from (select distinct chunk_id, doc_id, content from chunks) group by 1")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "chunks").select("chunk_id", "doc_id", "content").distinct()
    n = F.length("content").cast("long")
    return c.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.round(F.avg(n), 4).alias("mean_chars"), F.min(n).alias("least"), F.max(n).alias("most"))


@query("select content_hash, count(*) as n_chunks, min(chunk_id) as first_chunk from (select distinct chunk_id, md5(content) as content_hash from chunks where content is not null) group by 1 having count(*) > 1")
def source_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "chunks").where("content is not null").select("chunk_id", F.md5("content").alias("content_hash")).distinct()
    return c.groupBy("content_hash").agg(F.count("*").alias("n_chunks"), F.min("chunk_id").alias("first_chunk")).where("n_chunks > 1")


KEY_WORDS = ["contrato", "acuerdo", "cláusula", "obligación", "derecho", "parte", "firma", "vigencia", "plazo", "pago"]


@query(f"""with k as (select distinct chunk_id, length(content) as n, {sql_hits('lower(content)', KEY_WORDS)} as hits, metadata.source is not null as has_source from chunks where content is not null)
    select chunk_id, hits::int as hits, round((case when n > 100 then 1.0 when n > 50 then 0.5 else 0.2 end + case when has_source then 1.0 else 0 end + case when hits > 3 then 1.0 when hits > 1 then 0.5 else 0 end)::double / (1 + has_source::int + (hits > 1)::int), 6) as quality from k""")
def source_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, n = F.lower("content"), F.length("content")
    k = read(spark, sf_dir, "chunks").where("content is not null").select("chunk_id", n.alias("n"), sum(F.contains(low, F.lit(w)).cast("int") for w in KEY_WORDS).alias("hits"), F.col("metadata.source").isNotNull().alias("has_source")).distinct()
    score = F.when(F.col("n") > 100, 1.0).when(F.col("n") > 50, 0.5).otherwise(0.2) + F.col("has_source").cast("double") + F.when(F.col("hits") > 3, 1.0).when(F.col("hits") > 1, 0.5).otherwise(0.0)
    return k.select("chunk_id", "hits", F.round(score / (1 + F.col("has_source").cast("int") + (F.col("hits") > 1).cast("int")), 6).alias("quality"))


# --- answers ----------------------------------------------------------------------------------------------------------

LEFT_OUT = ["para", "sobre", "entre", "desde", "hasta"]
_CLAIMS = f"""a as (select distinct response_id, answer, list_transform(sources, lambda s: lower(coalesce(s.excerpt, ''))) as excerpts from responses where answer is not null),
    c as (select response_id, excerpts, unnest(list_filter(list_transform(regexp_split_to_array(answer, '[.!?]+'), lambda s: trim(s)), lambda s: length(s) > 10)) as claim from a),
    w as (select *, list_filter(regexp_split_to_array(lower(claim), '\\s+'), lambda t: length(t) > 3 and not list_contains({sql_list(LEFT_OUT)}, t)) as ws from c),
    v as (select response_id, claim, len(ws) as n_words, len(list_filter(coalesce(excerpts, []), lambda e: len(list_filter(ws, lambda t: contains(e, t))) >= len(ws) * 0.6))::int as n_support from w)"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of answers and how many sources hold at least 60 % of their long words."""
    a = read(spark, sf_dir, "responses").where("answer is not null").select("response_id", "answer", F.transform("sources", lambda s: F.lower(F.coalesce(s["excerpt"], F.lit("")))).alias("excerpts")).distinct()
    c = a.select("response_id", "excerpts", F.explode(tx.sentences(F.col("answer"))).alias("claim"))
    w = c.withColumn("ws", F.filter(F.split(F.lower("claim"), r"\s+"), lambda t: (F.length(t) > 3) & ~t.isin(LEFT_OUT)))
    support = F.size(F.filter(F.coalesce("excerpts", F.array().cast("array<string>")), lambda e: F.size(F.filter("ws", lambda t: F.contains(e, t))) >= F.size("ws") * 0.6))
    return w.select("response_id", "claim", F.size("ws").alias("n_words"), support.alias("n_support"))


@query(f"with {_CLAIMS} select response_id, claim, n_support, n_words < 2 or n_support > 0 as supported from v")
def claim_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims(spark, sf_dir).select("response_id", "claim", "n_support", ((F.col("n_words") < 2) | (F.col("n_support") > 0)).alias("supported"))


@query(f"with {_CLAIMS} select response_id, count(*) as n_claims, count(*) filter (n_support >= 2) as verified, count(*) filter (n_support = 1) as partly, round(avg(case when n_support >= 2 then 1.0 when n_support = 1 then 0.7 else 0 end)::double, 6) as score from v group by 1")
def fact_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("n_support")
    return claims(spark, sf_dir).groupBy("response_id").agg(F.count("*").alias("n_claims"), F.count_if(s >= 2).alias("verified"), F.count_if(s == 1).alias("partly"), F.round(F.avg(F.when(s >= 2, 1.0).when(s == 1, 0.7).otherwise(0.0)), 6).alias("score"))


@query(f"with {ANSWERS} select case when confidence > 0.8 then 'high' when confidence > 0.5 then 'medium' else 'low' end as band, count(*) as n, round(avg(confidence), 6) as mean, count(*) filter (n_warnings > 0) as with_warnings, round(avg(n_sources), 6) as mean_sources from r group by 1")
def confidence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("confidence")
    return answers(spark, sf_dir).groupBy(F.when(c > 0.8, "high").when(c > 0.5, "medium").otherwise("low").alias("band")).agg(F.count("*").alias("n"), F.round(F.avg(c), 6).alias("mean"), F.count_if(F.col("n_warnings") > 0).alias("with_warnings"), F.round(F.avg("n_sources"), 6).alias("mean_sources"))


@query(f"with {ANSWERS} select n_sources::int as n_sources, count(*) as n from r group by 1")
def source_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).groupBy("n_sources").agg(F.count("*").alias("n"))


@query(f"with {ANSWERS} select response_id, session_id, row_number() over w as turn, round(avg(confidence) over w + 1e-9, 6) as running_confidence, lead(query) over o as next_query from r window o as (partition by session_id order by answered_at, response_id), w as (o rows unbounded preceding)".replace("w as (o rows unbounded preceding)", "w as (partition by session_id order by answered_at, response_id rows unbounded preceding)"))
def session_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a session in order, the running mean confidence and the query that follows."""
    o = Window.partitionBy("session_id").orderBy("answered_at", "response_id")
    return answers(spark, sf_dir).select("response_id", "session_id", F.row_number().over(o).cast("long").alias("turn"), F.round(F.avg("confidence").over(o.rowsBetween(Window.unboundedPreceding, 0)) + 1e-9, 6).alias("running_confidence"), F.lead("query").over(o).alias("next_query"))


@query(f"with {ANSWERS} select session_id, response_id, query, n::int as back from (select *, row_number() over (partition by session_id order by answered_at desc, response_id desc) as n from r) where n <= 6")
def last_n_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("answered_at").desc(), F.col("response_id").desc()))
    return answers(spark, sf_dir).withColumn("back", back).where("back <= 6").select("session_id", "response_id", "query", "back")


@query("select count(*) as n_answers, sum(metadata.usage.prompt_tokens)::bigint as prompt_tokens, sum(metadata.usage.completion_tokens)::bigint as completion_tokens, round(avg(confidence), 6) as mean_confidence, count(*) filter (answer is null) as unanswered from (select distinct response_id, answer, confidence, metadata from responses)")
def usage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "responses").select("response_id", "answer", "confidence", "metadata").distinct()
    return r.agg(F.count("*").alias("n_answers"), F.sum("metadata.usage.prompt_tokens").alias("prompt_tokens"), F.sum("metadata.usage.completion_tokens").alias("completion_tokens"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.count_if(F.col("answer").isNull()).alias("unanswered"))


@query(f"""with {HIT_ROWS}, o as (select *, row_number() over (partition by response_id order by rank_no, chunk_id) as n from h where content is not null) select response_id, count(*) as n_blocks, string_agg('[' || n || '] ' || chunk_id || chr(10) || content, chr(10) order by n) as context from o group by 1""")
def context_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered hits of each response as one text; a response has as many hits as a search returns."""
    n = F.row_number().over(Window.partitionBy("response_id").orderBy("rank_no", "chunk_id"))
    o = hit_rows(spark, sf_dir).where("content is not null").withColumn("n", n)
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("n", "chunk_id", "content"))), lambda s: F.concat(F.lit("["), s["n"].cast("string"), F.lit("] "), s["chunk_id"], F.lit("\n"), s["content"]))
    return o.groupBy("response_id").agg(F.count("*").alias("n_blocks"), F.array_join(blocks, "\n").alias("context"))


@query("select event_type, count(*) as n, round(sum(value), 4) as total, round(avg(value), 6) as mean, count(distinct user_id) as users from events group by 1")
def log_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.countDistinct("user_id").alias("users"))


@query("select event_id, user_id, row_number() over w as n, round(avg(value) over w + 1e-9, 6) as running_mean from events window w as (partition by user_id order by ts, event_id rows unbounded preceding)")
def running_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select("event_id", "user_id", F.row_number().over(w).cast("long").alias("n"), F.round(F.avg("value").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1e-9, 6).alias("running_mean"))


@query("select source, count(*) as n_documents, count(distinct lang) as n_langs, any_value(channel) as channel, bool_or(active) as active from documents left join source_catalog using (source) group by 1")
def source_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_documents"), F.countDistinct("lang").alias("n_langs"))
    return d.join(read(spark, sf_dir, "source_catalog").select("source", "channel", "active"), "source", "left")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
