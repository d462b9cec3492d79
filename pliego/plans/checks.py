"""Registered queries that check answers and extract terms, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pliego.functions import text as tx
from pliego.operators import answers as an
from pliego.operators import contracts as ca
from pliego.operators import search as se
from pliego.plans.queries import LEXICAL, _contracts, q, query, read, sql_count, sql_tokens, with_lexical
from pliego.sources.loaders import conversations

ROW = "r as (select distinct response_id, query, answer, list_transform(coalesce(sources, []), lambda s: lower(coalesce(s.excerpt, ''))) as excerpts, coalesce(len(warnings), 0) as n_warnings from responses where answer is not null)"


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    excerpts = F.transform(F.coalesce("sources", F.expr("array()")), lambda s: F.lower(F.coalesce(s["excerpt"], F.lit(""))))
    return read(spark, sf_dir, "responses").where("answer is not null").select("response_id", "query", "answer", excerpts.alias("excerpts"), F.coalesce(F.array_size("warnings"), F.lit(0)).alias("n_warnings")).distinct()


@query(f"with {ROW} select response_id, {sql_count('lower(answer)', an.HEDGES)} as n_hedges from r")
def hedging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).select("response_id", F.regexp_count(F.lower("answer"), F.lit(an.HEDGES)).cast("long").alias("n_hedges"))


@query(f"with {ROW}, t as (select response_id, list_distinct({sql_tokens('query')}) as a, {sql_tokens('answer')} as b from r where query is not null) select response_id, round(len(list_intersect(a, list_distinct(b))) / nullif(len(a), 0), 6) as overlap, coalesce(len(list_intersect(a, list_distinct(b))) / nullif(len(a), 0) < 0.3, false) as off_topic from t")
def query_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = rows(spark, sf_dir).where("query is not null").select("response_id", an.overlap(tx.tokens(F.col("query")), tx.tokens(F.col("answer"))).alias("overlap"))
    return t.withColumn("off_topic", F.coalesce(F.col("overlap") < 0.3, F.lit(False)))


MISSING = f"{ROW}, m as (select response_id, query, answer, n_warnings, len(excerpts) as n_sources, list_filter(list_distinct(regexp_extract_all(lower(answer), {q(an.FIGURES)}, 1)), lambda x: len(list_filter(excerpts, lambda s: contains(s, x))) = 0) as missing, len(list_filter(string_split(regexp_replace(lower(answer), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' '), lambda t: t <> '')) as n_words from r)"


@query(f"with {MISSING} select response_id, len(missing) as n_missing, round(least(1.0, len(missing) / greatest(n_words / 100, 1))::double + 1e-9, 6) as share from m")
def unsupported_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = rows(spark, sf_dir).withColumn("missing", an.unsupported(F.col("answer"), F.col("excerpts")))
    return m.select("response_id", F.size("missing").cast("long").alias("n_missing"), F.round(an.missing_share(F.col("missing"), F.col("answer")) + 1e-9, 6).alias("share"))


@query(f"with {MISSING} select response_id, round(greatest(0, 1 - 0.1 * n_warnings - 0.2 * (n_sources = 0)::int - 0.5 * least(1.0, len(missing) / greatest(n_words / 100, 1)))::double + 1e-9, 6) as score from m")
def answer_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One less what warnings, missing sources and unsupported figures take off, not below nought."""
    m = rows(spark, sf_dir).withColumn("missing", an.unsupported(F.col("answer"), F.col("excerpts"))).withColumn("share", an.missing_share(F.col("missing"), F.col("answer")))
    return m.select("response_id", F.round(F.greatest(F.lit(0.0), 1 - 0.1 * F.col("n_warnings") - 0.2 * (F.size("excerpts") == 0).cast("int") - 0.5 * F.col("share")) + 1e-9, 6).alias("score"))


@query(f"with {ROW}, t as (select response_id, list_filter(list_distinct({sql_tokens('query')}), lambda w: length(w) > 3) as ks, lower(answer) as low from r where query is not null) select response_id, len(ks) as n_keywords, round(len(list_filter(ks, lambda w: contains(low, w))) / nullif(len(ks), 0), 6) as addressed from t")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = rows(spark, sf_dir).where("query is not null").select("response_id", F.filter(F.array_distinct(tx.tokens(F.col("query"))), lambda w: F.length(w) > 3).alias("ks"), F.lower("answer").alias("low"))
    hits = F.size(F.filter("ks", lambda w: F.contains(F.col("low"), w)))
    return t.select("response_id", F.size("ks").cast("long").alias("n_keywords"), F.round(F.try_divide(hits, F.size("ks")), 6).alias("addressed"))



@query(f"""with d as (select distinct doc_id, regexp_extract(content, '(?:comenzando el|con inicio el|from) (\\d{{1,2}} de [\\p{{L}}]+ de \\d{{4}})', 1) as a, regexp_extract(content, '(?:finalizando el|con final el|until) (\\d{{1,2}} de [\\p{{L}}]+ de \\d{{4}})', 1) as b from contracts where content is not null),
    p as (select doc_id, a, b, try_cast(split_part(a, ' ', 5) || '-' || lpad(list_position([{', '.join(map(q, an.MONTHS))}], lower(split_part(a, ' ', 3)))::varchar, 2, '0') || '-' || lpad(split_part(a, ' ', 1), 2, '0') as date) as x, try_cast(split_part(b, ' ', 5) || '-' || lpad(list_position([{', '.join(map(q, an.MONTHS))}], lower(split_part(b, ' ', 3)))::varchar, 2, '0') || '-' || lpad(split_part(b, ' ', 1), 2, '0') as date) as y from d)
    select doc_id, x::varchar as begins, y::varchar as ends, y < x as reversed from p where x is not null and y is not null""")
def term_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts whose term begins and ends on given dates, and whether the end comes first."""
    pick = lambda cue: F.regexp_extract("content", rf"(?:{cue}) (\d{{1,2}} de [\p{{L}}]+ de \d{{4}})", 1)
    d = read(spark, sf_dir, "contracts").where("content is not null").select("doc_id", pick("comenzando el|con inicio el|from").alias("a"), pick("finalizando el|con final el|until").alias("b")).distinct()
    p = d.select("doc_id", an.long_date(F.col("a")).alias("x"), an.long_date(F.col("b")).alias("y")).where("x is not null and y is not null")
    return p.select("doc_id", F.col("x").cast("string").alias("begins"), F.col("y").cast("string").alias("ends"), (F.col("y") < F.col("x")).alias("reversed"))


TERMS = {"terms": r"(?:plazo|período|duración|vigencia)\s+(?:de\s+)?\d+\s+[\p{L}]+", "amounts": r"\d+(?:\.\d+)?(?:,\d+)?\s*(?:euros?|€)", "percents": r"\d+(?:,\d+)?\s*%", "companies": r"s\.a\.|s\.l\.|s\.l\.u\.|s\. coop\."}


@query(f"select doc_id, {', '.join(f'{sql_count('lower(content)', p)} as {k}' for k, p in TERMS.items())} from contracts where content is not null")
def key_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("content")
    return _contracts(spark, sf_dir, **{k: F.regexp_count(low, F.lit(p)).cast("long") for k, p in TERMS.items()})


@query(f"select doc_id, {sql_count('lower(content)', 'cláusula')} as n_clauses, {sql_count('lower(content)', 'art[íi]culo')} as n_articles, regexp_matches(lower(content), 'firmado|fdo\\.|signed|assinado') as has_signatures, regexp_matches(lower(content), 'índice\\s*\\n|contenido\\s*\\n') as has_toc from contracts where content is not null")
def document_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("content")
    return _contracts(spark, sf_dir, n_clauses=F.regexp_count(low, F.lit("cláusula")).cast("long"), n_articles=F.regexp_count(low, F.lit("art[íi]culo")).cast("long"), has_signatures=low.rlike(r"firmado|fdo\.|signed|assinado"), has_toc=low.rlike(r"índice\s*\n|contenido\s*\n"))


@query(f"select distinct doc_id, unnest(regexp_extract_all(text, {q(an.ENTITIES)}, 1)) as entity from documents where text is not null")
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(an.ENTITIES), F.lit(1))).alias("entity")).distinct()


PARTIES = r"(?:Entre|De una parte|REUNIDOS:|Between),? ([^,\n]+),"


@query(f"select distinct doc_id, unnest(list_transform(regexp_extract_all(content, {q(PARTIES)}, 1), lambda x: trim(x))) as party from contracts where content is not null")
def parties_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contracts(spark, sf_dir, party=F.explode(F.transform(F.regexp_extract_all("content", F.lit(PARTIES), F.lit(1)), lambda x: F.trim(x)))).distinct()


@query("with s as (select distinct chunk_id, doc_id from chunks), h as (select chunk_id, count(*) as n_hits, count(distinct response_id) as n_responses, round(avg(score), 6) as mean_score from hits where chunk_id is not null group by 1) select doc_id, count(*) as n_chunks, coalesce(sum(n_hits), 0)::bigint as n_hits, coalesce(max(n_responses), 0) as most_responses, count(mean_score) as n_used from s left join h using (chunk_id) group by 1")
def chunk_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often search returned the chunks of each document; hits are counted before they are joined."""
    h = read(spark, sf_dir, "hits").where("chunk_id is not null").groupBy("chunk_id").agg(F.count("*").alias("n_hits"), F.countDistinct("response_id").alias("n_responses"), F.round(F.avg("score"), 6).alias("mean_score"))
    s = read(spark, sf_dir, "chunks").select("chunk_id", "doc_id").distinct().join(h, "chunk_id", "left")
    return s.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.coalesce(F.sum("n_hits"), F.lit(0)).alias("n_hits"), F.coalesce(F.max("n_responses"), F.lit(0)).alias("most_responses"), F.count("mean_score").alias("n_used"))


@query()
def unicode_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contracts(spark, sf_dir, normalized=an.plain_unicode(F.col("content")))


@query()
def conversation_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "responses").select("session_id", "answered_at", "response_id", "query", "answer").distinct()
    return conversations(r, "session_id", "answered_at", "response_id", "query", "answer")


@query(f"with {LEXICAL}, z as (select response_id, chunk_id, row_number() over (partition by response_id order by rank_no, chunk_id)::int as old_rank, row_number() over (partition by response_id order by round(0.3 * score + 0.7 * lexical + 1e-9, 6) desc, chunk_id)::int as new_rank from y) select *, old_rank - new_rank as change, case when old_rank > new_rank then 'raised' when old_rank < new_rank then 'lowered' else 'kept' end as verdict from z")
def rerank_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each hit before and after reranking."""
    w = Window.partitionBy("response_id")
    z = with_lexical(spark, sf_dir).withColumn("combined", F.round(se.combine(F.col("score"), F.col("lexical")) + 1e-9, 6))
    z = z.withColumn("old_rank", F.row_number().over(w.orderBy("rank_no", "chunk_id"))).withColumn("new_rank", F.row_number().over(w.orderBy(F.col("combined").desc(), "chunk_id")))
    change = F.col("old_rank") - F.col("new_rank")
    return z.select("response_id", "chunk_id", "old_rank", "new_rank", change.alias("change"), F.when(change > 0, "raised").when(change < 0, "lowered").otherwise("kept").alias("verdict"))


@query(f"with {ROW}, f as (select distinct query, response_id, unnest(regexp_extract_all(lower(answer), {q(an.FIGURES)}, 1)) as fact from r where query is not null), n as (select query, count(distinct response_id) as n_answers from r where query is not null group by 1) select f.query, fact, count(distinct response_id) as n_support, any_value(n_answers) as n_answers, count(distinct response_id) > 1 as corroborated from f join n using (query) group by 1, 2")
def cross_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures given in answers to one query, and how many of its answers give them."""
    r = rows(spark, sf_dir).where("query is not null")
    f = r.select("query", "response_id", F.explode(F.regexp_extract_all(F.lower("answer"), F.lit(an.FIGURES), F.lit(1))).alias("fact")).distinct()
    n = r.groupBy("query").agg(F.countDistinct("response_id").alias("n_answers"))
    counted = f.groupBy("query", "fact").agg(F.count("*").alias("n_support"))
    return counted.join(n, "query").select("query", "fact", "n_support", "n_answers", (F.col("n_support") > 1).alias("corroborated"))
