"""Registered queries of extraction, contract comparison, chunking and inventory search, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pliego.functions import text as tx
from pliego.operators import chunks as ch
from pliego.operators import contracts as ca
from pliego.operators.validation import found, located
from pliego.plans.queries import _RISK, ANSWERS, HIT_ROWS, _sql_repairs, answers, hit_rows, q, query, read
from pliego.plans.validation import sql_found


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each contract and text once."""
    return read(spark, sf_dir, "contracts").where("content is not null").select("doc_id", "content").distinct()


TEXTS = "t as (select distinct doc_id, content from contracts where content is not null)"


def sql_located(name: str, text: str, pattern: str) -> str:
    """CTE name: doc_id, content, m (a match) and place (0-based) of every match in a text of t."""
    return f"""{name}_m as (select doc_id, content, regexp_extract_all({text}, {q(pattern)}, 0) as ms, regexp_split_to_array({text}, {q(pattern)}) as ps from t),
    {name} as (select doc_id, content, ms[i] as m, (coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::int as place from (select *, unnest(range(1, len(ms) + 1)) as i from {name}_m))"""


def places(df: DataFrame, text: Column, pattern: str) -> DataFrame:
    """df with m and place of every match."""
    return df.withColumn("_l", F.explode(located(text, pattern))).withColumn("m", F.col("_l.m")).withColumn("place", F.col("_l.at")).drop("_l")


#: Words that make a date important.
IMPORTANT = "firma|vencimiento|inicio|fin|pago|entrega|renovación|terminación|plazo"
DATE_FORMATS = {"es": r"\d{1,2}\s+de\s+[\p{L}\p{N}_]+\s+de\s+\d{4}", "numeric": r"\d{1,2}/\d{1,2}/\d{4}", "iso": r"\d{4}-\d{1,2}-\d{1,2}"}
_DATES = ", ".join(sql_located(f"d_{k}", "content", p) for k, p in DATE_FORMATS.items())
_ALL_DATES = " union all ".join(f"select doc_id, content, m, place, '{k}' as format from d_{k}" for k in DATE_FORMATS)
_CONTEXT = "lower(substr(content, greatest(place - 49, 1), place - greatest(place - 50, 0) + length(m) + 50))"


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = texts(spark, sf_dir)
    parts = [places(t, F.col("content"), p).withColumn("format", F.lit(k)) for k, p in DATE_FORMATS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"with {TEXTS}, {_DATES}, d as ({_ALL_DATES}), c as (select *, {_CONTEXT} as context from d) select doc_id, m as found_date, format, place, trim(context, ' ') as context, regexp_matches(context, {q(IMPORTANT)}) as important from c")
def dates_with_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates by format and place, the 50 signs on either side and whether these make them important."""
    context = F.lower(F.substring(F.col("content"), F.greatest(F.col("place") - 49, F.lit(1)), F.col("place") - F.greatest(F.col("place") - 50, F.lit(0)) + F.length("m") + 50))
    c = dates(spark, sf_dir).withColumn("context", context)
    return c.select("doc_id", F.col("m").alias("found_date"), "format", "place", F.trim("context").alias("context"), F.col("context").rlike(IMPORTANT).alias("important"))


MONEY = r"(\d{1,3}(?:\.\d{3})+(?:,\d+)?|\d+(?:,\d+)?)\s*(?:euros?|€|eur|dólares?|\$|usd)"
#: Kinds of amounts by the words before them, in the order in which they are tried.
AMOUNT_KINDS = {"renta": "renta|alquiler|mensual", "fianza": "fianza|depósito|garantía", "penalización": "penalización|multa|sanción", "precio": "precio|valor|coste"}
_KIND = "case " + " ".join(f"when regexp_matches(context, {q(p)}) then {q(k)}" for k, p in AMOUNT_KINDS.items()) + " else 'otro' end"
_NUMBER = "replace(replace(regexp_extract(m, '^[\\d.,]*\\d'), '.', ''), ',', '.')::decimal(28, 2)::double"
_AMOUNTS = f"{TEXTS}, {sql_located('a', 'lower(content)', MONEY)}, am as (select *, {_NUMBER} as amount, case when regexp_matches(m, 'eur|€') then 'EUR' else 'USD' end as currency, lower(substr(content, greatest(place - 29, 1), place - greatest(place - 30, 0) + length(m))) as context from a)"


def amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.replace(F.replace(F.regexp_extract("m", r"^[\d.,]*\d", 0), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).cast("decimal(28,2)").cast("double")
    context = F.lower(F.substring(F.col("content"), F.greatest(F.col("place") - 29, F.lit(1)), F.col("place") - F.greatest(F.col("place") - 30, F.lit(0)) + F.length("m")))
    return places(texts(spark, sf_dir), F.lower("content"), MONEY).select("doc_id", "content", "place", number.alias("amount"), F.when(F.col("m").rlike("eur|€"), "EUR").otherwise("USD").alias("currency"), context.alias("context"))


@query(f"with {_AMOUNTS} select doc_id, place, amount, currency, context, {_KIND} as kind from am")
def amounts_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts with currency, the 30 signs before them and their kind."""
    kind = F.coalesce(*[F.when(F.col("context").rlike(p), F.lit(k)) for k, p in AMOUNT_KINDS.items()], F.lit("otro"))
    return amounts(spark, sf_dir).select("doc_id", "place", "amount", "currency", "context", kind.alias("kind"))


@query(f"with {_AMOUNTS} select doc_id, currency, count(*) as n, round(sum(amount), 2) as total, max(amount) as most from am group by 1, 2")
def financial_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return amounts(spark, sf_dir).groupBy("doc_id", "currency").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"), F.max("amount").alias("most"))


#: Terms of payment.
PAYMENTS = r"pago\s+(?:mensual|anual|trimestral|semestral)|(?:antes del|hasta el)\s+día\s+\d+|transferencia\s+bancaria|domiciliación\s+bancaria|forma\s+de\s+pago[:\s]+[^.]+|dentro de los primeros \d+ días|por adelantado"


@query(f"with {TEXTS} select distinct doc_id, trim(unnest({sql_found('lower(content)', PAYMENTS)}), ' ') as payment_term from t")
def payment_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", F.explode(found(F.lower("content"), PAYMENTS)).alias("p")).select("doc_id", F.trim("p").alias("payment_term")).distinct()


#: What follows the words for rights, penalties and deadlines.
CLAUSES = {
    "rights": [r"(?:tiene derecho a|podrá|puede|facultado para)\s+([^.]+)", r"(?:derecho de|opción de)\s+([^.]+)"],
    "penalties": [r"(?:penalización|sanción|multa|indemnización)\s+(?:de|por)\s+([^.]+)", r"(?:incumplimiento|retraso|demora)\s+(?:será|conllevará)\s+([^.]+)", r"(?:interés del|interés de)\s+(\d+%[^.]+)"],
    "deadlines": [r"(?:plazo de|antes de|dentro de)\s+(\d+\s+[\p{L}\p{N}_]+)", r"(?:vencimiento|fecha límite|deadline)\s*:?\s*([^.]+)", r"(?:a más tardar el|hasta el)\s+([^.]+)"],
}
_MATCHED = " union all ".join(f"select doc_id, {q(k)} as kind, unnest(list_concat({', '.join(f'regexp_extract_all(lower(content), {q(p)}, 1)' for p in ps)}{', []' if len(ps) == 1 else ''})) as m from t" for k, ps in CLAUSES.items())


@query(f"with {TEXTS}, u as ({_MATCHED}) select distinct doc_id, kind, substr(trim(m, ' '), 1, 200) as matched from u where length(substr(trim(m, ' '), 1, 200)) > 20")
def clause_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rights, penalties and deadlines in the words of the contract, each once."""
    t = texts(spark, sf_dir)
    of_kind = lambda k: lambda m: F.struct(F.lit(k).alias("kind"), F.substring(F.trim(m), 1, 200).alias("matched"))
    kinds = F.concat(*[F.transform(F.concat(*[F.regexp_extract_all(F.lower("content"), F.lit(p), F.lit(1)) for p in ps]), of_kind(k)) for k, ps in CLAUSES.items()])
    return t.select("doc_id", F.explode(kinds).alias("c")).select("doc_id", "c.kind", "c.matched").where("length(matched) > 20").distinct()


SECTION = r"obligaciones del arrendatario[^:]*:([\s\S]*?)(?:cláusula|firmado|\z)"
DUTIES = r"[^.]*(?:debe|deberá|obliga|obligado|mantener|pagar|realizar|destinar)[^.]+"
_BULLETS = f"list_filter(list_transform(list_filter(list_transform(string_split(regexp_extract(lower(content), {q(SECTION)}, 1), chr(10)), lambda l: trim(l, ' ')), lambda l: regexp_matches(l, '^[-•]')), lambda l: trim(substr(l, 2), ' ')), lambda l: length(l) > 10)"
_DUTIES = f"list_filter(list_transform({sql_found('lower(content)', DUTIES)}, lambda s: trim(s, ' ')), lambda s: length(s) > 20 and length(s) < 200)"
_OBLIGATIONS = f"ob as (select distinct doc_id, unnest(case when len({_BULLETS}) > 0 then {_BULLETS} else {_DUTIES} end) as obligation from t)"


@query(f"with {TEXTS}, {_OBLIGATIONS} select * from ob")
def obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bullets of the tenant's duties, or else sentences of duty, each once."""
    low = F.lower("content")
    lines = F.filter(F.transform(F.split(F.regexp_extract(low, SECTION, 1), "\n"), lambda x: F.trim(x)), lambda x: x.rlike("^[-•]"))
    bullets = F.filter(F.transform(lines, lambda x: F.trim(F.substring(x, 2, 1 << 30))), lambda x: F.length(x) > 10)
    duties = F.filter(F.transform(found(low, DUTIES), lambda x: F.trim(x)), lambda x: (F.length(x) > 20) & (F.length(x) < 200))
    return texts(spark, sf_dir).select("doc_id", F.explode(F.when(F.size(bullets) > 0, bullets).otherwise(duties)).alias("obligation")).distinct()


_INDICATOR = {k: "case " + " ".join(f"when contains(lower(content), {q(w)}) then {q(w)}" for w in ws) + " end" for k, ws in ca.SPECIAL.items()}
_SPECIAL = " union all ".join(f"select doc_id, content, {q(k)} as clause_type, {c} as indicator from t" for k, c in _INDICATOR.items())


@query(f"with {TEXTS}, s as ({_SPECIAL}), p as (select *, instr(lower(content), indicator) as place from s where indicator is not null) select doc_id, clause_type, indicator, trim(substr(content, greatest(place - 50, 1), place - greatest(place - 50, 1) + 200), ' ') as context from p")
def special_clause_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first indicator of each special clause, with 50 signs before it and 200 from it on."""
    low = F.lower("content")
    first = F.array(*[F.struct(F.lit(k).alias("clause_type"), F.coalesce(*[F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in ws]).alias("indicator")) for k, ws in ca.SPECIAL.items()])
    s = texts(spark, sf_dir).select("doc_id", "content", F.explode(F.filter(first, lambda x: x["indicator"].isNotNull())).alias("s")).select("doc_id", "content", "s.*")
    place = F.instr(F.lower("content"), F.col("indicator"))
    begin = F.greatest(place - 50, F.lit(1))
    return s.select("doc_id", "clause_type", "indicator", F.trim(F.substring(F.col("content"), begin, place - begin + 200)).alias("context"))


#: Terms with their value.
KEY_TERMS = {"duration": r"(?:plazo|período|duración|vigencia)\s+(?:de\s+)?\d+\s+[\p{L}]+", "amount": r"\d+(?:\.\d+)?(?:,\d+)?\s*(?:euros?|€)", "percent": r"\d+(?:,\d+)?\s*%", "company": r"s\.a\.|s\.l\."}
FIRST_TERMS = 20
_TERMS = ", ".join(sql_located(f"k_{k}", "lower(content)", p) for k, p in KEY_TERMS.items())
_ALL_TERMS = " union all ".join(f"select doc_id, {i} as ord, {q(k)} as kind, m, place, md5(content) as version from k_{k}" for i, k in enumerate(KEY_TERMS))


@query(f"with {TEXTS}, {_TERMS}, a as ({_ALL_TERMS}) select doc_id, kind, m as found_value, place from (select *, row_number() over (partition by doc_id, version order by ord, place) as n from a) where n <= {FIRST_TERMS}")
def key_term_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 terms of a contract in the order of their kinds, with value and place."""
    low = F.lower("content")
    of_kind = lambda k: lambda x: F.struct(F.lit(k).alias("kind"), x["m"].alias("found_value"), x["at"].alias("place"))
    each = F.concat(*[F.transform(located(low, p), of_kind(k)) for k, p in KEY_TERMS.items()])
    return texts(spark, sf_dir).select("doc_id", F.explode(F.slice(each, 1, FIRST_TERMS)).alias("k")).select("doc_id", "k.*")


@query(f"with r as (select distinct response_id, answer from responses where answer is not null), w as (select response_id, list_filter(regexp_split_to_array(regexp_replace(lower(answer), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' '), lambda x: length(x) > 4)[1:10] as ws from r) select response_id, array_to_string(ws, ' ') as terms, len(ws) as n from w")
def answer_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten words of more than four letters, in the order of the text."""
    r = read(spark, sf_dir, "responses").where("answer is not null").select("response_id", "answer").distinct()
    ws = F.slice(F.filter(tx.tokens(F.col("answer"), keep_stop_words=True), lambda w: F.length(w) > 4), 1, 10)
    return r.select("response_id", F.array_join(ws, " ").alias("terms"), F.size(ws).cast("long").alias("n"))


# --- contracts beside each other --------------------------------------------------------------------------------------

KINDS = "k as (select doc_id, min(coalesce(lower(trim(metadata.contract_type)), 'otros')) as contract_type from contracts where content is not null group by 1)"


def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "contracts").where("content is not null").groupBy("doc_id").agg(F.min(F.coalesce(F.lower(F.trim("metadata.contract_type")), F.lit("otros"))).alias("contract_type"))


_ANALYSED = f"""{_AMOUNTS}, {_DATES}, d as ({_ALL_DATES}), {_OBLIGATIONS}, {KINDS}, rs as (select doc_id, max({_RISK})::bigint as risk from t group by 1),
    an as (select k.doc_id, contract_type, risk, coalesce(n_dates, 0) as n_dates, coalesce(n_obligations, 0) as n_obligations, coalesce(total_eur, 0.0) as total_eur from k join rs using (doc_id) left join (select doc_id, count(*) as n_dates from d group by 1) using (doc_id) left join (select doc_id, count(*) as n_obligations from ob group by 1) using (doc_id) left join (select doc_id, round(sum(amount), 2) as total_eur from am where currency = 'EUR' group by 1) using (doc_id))"""


def analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a contract: type, risk, dates, obligations and total; each part is aggregated before it is joined."""
    risk = texts(spark, sf_dir).groupBy("doc_id").agg(F.max(ca.risk_score(F.col("content"))).cast("long").alias("risk"))
    n_dates = dates(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_dates"))
    n_obligations = obligations(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_obligations"))
    total = amounts(spark, sf_dir).where("currency = 'EUR'").groupBy("doc_id").agg(F.round(F.sum("amount"), 2).alias("total_eur"))
    joined = kinds(spark, sf_dir).join(risk, "doc_id")
    for part in (n_dates, n_obligations, total):
        joined = joined.join(part, "doc_id", "left")
    return joined.select("doc_id", "contract_type", "risk", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_dates", "n_obligations")], F.coalesce("total_eur", F.lit(0.0)).alias("total_eur"))


@query(f"with {_ANALYSED} select *, case when risk >= 10 then 'alto' when risk >= 5 then 'medio' else 'bajo' end as risk_level from an")
def contract_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysed(spark, sf_dir).withColumn("risk_level", ca.risk_level(F.col("risk")))


@query(f"with {_ANALYSED} select contract_type, count(*) as n, min(n_obligations) as least_obligations, max(n_obligations) as most_obligations, sum(n_dates)::bigint as total_dates, max(risk) as highest_risk, min(doc_id) filter (risk = top) as riskiest, count(distinct n_dates) > 1 as dates_differ, count(distinct total_eur) > 1 as totals_differ from (select *, max(risk) over (partition by contract_type) as top from an) group by 1")
def compare_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts of a type beside each other: span of obligations, dates, the riskiest one and which figures differ."""
    return analysed(spark, sf_dir).groupBy("contract_type").agg(F.count("*").alias("n"), F.min("n_obligations").alias("least_obligations"), F.max("n_obligations").alias("most_obligations"), F.sum("n_dates").alias("total_dates"), F.max("risk").alias("highest_risk"), F.min(F.struct(-F.col("risk"), "doc_id"))["doc_id"].alias("riskiest"), (F.min("n_dates") < F.max("n_dates")).alias("dates_differ"), (F.min("total_eur") < F.max("total_eur")).alias("totals_differ"))


# --- chunking ---------------------------------------------------------------------------------------------------------


_STEPS = "t0 as (select *, content as stored from t), "
_from = "t0"
for _i, _p in enumerate(ch.HEADINGS.values()):
    _STEPS += f"m{_i} as (select doc_id, stored, case when len(regexp_extract_all(stored, {q(_p)})) > 2 then regexp_replace(content, {q('(?m)(' + _p.replace('(?m)', '') + ')')}, chr(1) || '\\1', 'g') else content end as content from {_from}), "
    _from = f"m{_i}"
_SECTIONS = f"{TEXTS}, {_STEPS}sp as (select doc_id, string_split(regexp_replace(content, chr(1) || '+', chr(1), 'g'), chr(1)) as ps from {_from}), kp as (select doc_id, len(ps) > 1 as headed, case when len(ps) > 1 then ps[2:] else ps end as kept, case when len(ps) > 1 then length(ps[1]) else 0 end as bef from sp), ex as (select *, unnest(range(0, len(kept))) as section_index from kp)"


@query(f"with {_SECTIONS} select doc_id, section_index::int as section_index, (bef + coalesce(list_sum(list_transform(kept[1:section_index], lambda x: length(x))), 0))::int as start_char, case when headed then trim(string_split(kept[section_index + 1], chr(10))[1], ' ') end as title, trim(kept[section_index + 1], ' ') as content from ex where trim(kept[section_index + 1], ' ') <> ''")
def chunk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections by their headings, with their place and title."""
    return ch.sections(texts(spark, sf_dir), "doc_id", "content")


@query()
def chunk_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections as chunks, large ones packed by paragraphs, with ids; held against brute force in the tests."""
    return ch.chunk_documents(texts(spark, sf_dir), "doc_id", "content", 128, 32)


# --- inventory, terms, context ----------------------------------------------------------------------------------------

#: Phrases that ask for the inventory.
INVENTORY = "tipos de contratos|qué contratos|cuántos tipos|tipos disponibles|qué tipos de|listar todos los contratos|contratos en el sistema"


@query(f"select response_id, regexp_matches(lower(min(query)), {q(INVENTORY)}) as asks_inventory from responses where query is not null group by 1")
def inventory_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "responses").where("query is not null").groupBy("response_id").agg(F.min("query").alias("query")).select("response_id", F.lower("query").rlike(INVENTORY).alias("asks_inventory"))


_CHUNK_TYPES = f"{KINDS}, ct as (select distinct chunk_id, doc_id, contract_type from chunks join k using (doc_id))"


def chunk_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "chunks").select("chunk_id", "doc_id").distinct().join(kinds(spark, sf_dir), "doc_id")


@query(f"with {_CHUNK_TYPES} select contract_type, chunk_id, doc_id, case when contract_type <> 'otros' then 0.9 else 0.8 end::double as score from (select *, row_number() over (partition by contract_type order by chunk_id) as n from ct) where n <= 2")
def inventory_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to two chunks of every contract type."""
    n = F.row_number().over(Window.partitionBy("contract_type").orderBy("chunk_id"))
    return chunk_types(spark, sf_dir).withColumn("n", n).where("n <= 2").select("contract_type", "chunk_id", "doc_id", F.when(F.col("contract_type") != "otros", 0.9).otherwise(0.8).alias("score"))


@query(f"with {_CHUNK_TYPES} select contract_type, count(*) as n_chunks, count(distinct doc_id) as n_documents from ct group by 1")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_types(spark, sf_dir).groupBy("contract_type").agg(F.count("*").alias("n_chunks"), F.countDistinct("doc_id").alias("n_documents"))


THRESHOLD = 0.15


@query(f"with {HIT_ROWS} select response_id, chunk_id, score, rank from (select *, row_number() over (partition by response_id order by score desc, chunk_id)::int as rank from h where score >= {THRESHOLD}) where rank <= 20")
def threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of at least the threshold's score, ranked anew, up to 20 a response."""
    rank = F.row_number().over(Window.partitionBy("response_id").orderBy(F.col("score").desc(), "chunk_id"))
    return hit_rows(spark, sf_dir).where(F.col("score") >= THRESHOLD).withColumn("rank", rank).where("rank <= 20").select("response_id", "chunk_id", "score", "rank")


@query(f"with {HIT_ROWS}, {ANSWERS}, x as (select response_id, chunk_id, lower(content) as low, list_distinct(list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda w: w <> '')) as terms from h join r using (response_id) where query is not null and content is not null), m as (select response_id, chunk_id, list_filter(terms, lambda w: contains(low, w)) as ms from x) select response_id, chunk_id, array_to_string(list_sort(ms), ' ') as matched, len(ms) as n_matched from m")
def matched_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query's terms that a hit contains."""
    x = hit_rows(spark, sf_dir).join(answers(spark, sf_dir).select("response_id", "query"), "response_id").where("query is not null and content is not null")
    terms = F.array_distinct(F.filter(F.split(F.lower("query"), r"\s+"), lambda w: w != ""))
    ms = F.filter(terms, lambda w: F.contains(F.lower("content"), w))
    return x.select("response_id", "chunk_id", F.array_join(F.array_sort(ms), " ").alias("matched"), F.size(ms).cast("long").alias("n_matched"))


@query(f"with {HIT_ROWS}, {ANSWERS}, n as (select response_id, count(*) as n_hits from h group by 1) select response_id, coalesce(n_hits, 0) as n_hits, case when n_hits is null then 0.0 else confidence end as confidence, n_hits is null as no_context from r left join n using (response_id)")
def without_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers without a hit have no context and no confidence."""
    n = hit_rows(spark, sf_dir).groupBy("response_id").agg(F.count("*").alias("n_hits"))
    j = answers(spark, sf_dir).join(n, "response_id", "left")
    return j.select("response_id", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.when(F.col("n_hits").isNull(), 0.0).otherwise(F.col("confidence")).alias("confidence"), F.col("n_hits").isNull().alias("no_context"))


@query(f"with {HIT_ROWS}, s as (select response_id, i as doc_index, sources[i].chunk_id as chunk_id, round(sources[i].relevance, 3) as relevance from (select distinct response_id, sources, unnest(range(1, len(sources) + 1)) as i from responses)) select s.response_id, doc_index, s.chunk_id, relevance, h.rank_no from s left join h using (response_id, chunk_id)")
def linked_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer's sources by their index, with the place that search had given them."""
    s = read(spark, sf_dir, "responses").select("response_id", F.posexplode("sources").alias("i", "s")).select("response_id", (F.col("i") + 1).cast("long").alias("doc_index"), "s.chunk_id", F.round("s.relevance", 3).alias("relevance")).distinct()
    return s.join(hit_rows(spark, sf_dir).select("response_id", "chunk_id", "rank_no"), ["response_id", "chunk_id"], "left").select("response_id", "doc_index", "chunk_id", "relevance", "rank_no")


@query("select event_id, user_id, value - lag(value) over w as change, epoch_us(ts) - epoch_us(lag(ts) over w) as gap_us from events window w as (partition by user_id order by ts, event_id)")
def event_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event against the one before it of the same user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select("event_id", "user_id", (F.col("value") - F.lag("value").over(w)).alias("change"), (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))).alias("gap_us"))


_CLEANED = f"trim(regexp_replace(regexp_replace(regexp_replace(translate({_sql_repairs('content')}, '„«»‚‛', chr(34) || chr(34) || chr(34) || chr(39) || chr(39)), chr(34) || '{{2,}}', chr(34), 'g'), {q('(?i)' + tx.WATERMARKS)}, '', 'g'), '\\s+', ' ', 'g'))"


@query(f"with {TEXTS}, c as (select doc_id, content, {_CLEANED} as cleaned from t) select doc_id, length(content) as n_before, length(cleaned) as n_after, round((case when length(content) > 0 then (length(content) - length(cleaned)) * 100.0 / length(content) else 0 end)::double, 4) as reduction_percent, md5(cleaned) as digest from c")
def preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repair, quotes, watermarks and blanks in one pass; a text that cleaning leaves null keeps its original."""
    t = texts(spark, sf_dir).withColumn("cleaned", F.coalesce(F.trim(F.regexp_replace(tx.without_watermarks(tx.plain_quotes(tx.repair_encoding(F.col("content")))), r"\s+", " ")), F.col("content")))
    n, m = F.length("content"), F.length("cleaned")
    return t.select("doc_id", n.cast("long").alias("n_before"), m.cast("long").alias("n_after"), F.round(F.when(n > 0, (n - m) * 100.0 / n).otherwise(0.0), 4).alias("reduction_percent"), F.md5("cleaned").alias("digest"))
