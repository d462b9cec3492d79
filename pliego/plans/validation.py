"""Registered queries of answer validation, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pliego.functions import text as tx
from pliego.operators import validation as va
from pliego.plans.checks import ROW, rows
from pliego.plans.queries import q, query


def sql_words(text: str, more_than: int) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '\\s+'), lambda w: length(w) > {more_than})"


def sql_in_one(words: str, share: float) -> str:
    return f"len(list_filter(excerpts, lambda e: len(list_filter({words}, lambda w: contains(e, w))) >= len({words}) * {share})) > 0"


def sql_found(text: str, pattern: str) -> str:
    return f"regexp_extract_all({text}, {q(pattern)}, 0)"


_SENTENCES = "list_filter(list_transform(regexp_split_to_array(lower(answer), '[.!?]+'), lambda s: trim(s)), lambda s: length(s) > 10)"
_INFO = sql_found("s", va.KEY_INFO)
_COVERED = f"case when len({_INFO}) > 0 then len(list_filter(excerpts, lambda e: len(list_filter({_INFO}, lambda x: not contains(e, x))) = 0)) > 0 else len({sql_words('s', 3)}) > 0 and {sql_in_one(sql_words('s', 3), 0.5)} end"
_CLAIMS = f"list_filter(string_split(lower(answer), '.'), lambda c: regexp_matches(c, {q(va.ATTRIBUTED)}) and len({sql_words('c', 3)}) >= 2 and not ({sql_in_one(sql_words('c', 3), 0.6)}))"
_UNSUPPORTED = f"coalesce(list_sum(list_transform({_CLAIMS}, lambda c: len({sql_found('c', va.ATTRIBUTED)}))), 0)"
_MISSING = f"len(list_filter({sql_found('answer', va.SPECIFIC)}, lambda x: len(list_filter(excerpts, lambda e: contains(e, lower(x)))) = 0))"
_N_WORDS = "len(list_filter(regexp_split_to_array(answer, '\\s+'), lambda w: w <> ''))"
_RAW = f"(({_UNSUPPORTED} + {_MISSING} + (len({sql_found('lower(answer)', va.SPECULATIVE)}) > 2)::int) / greatest({_N_WORDS} / 100.0, 1.0))::double"
_OPPOSED = " + ".join(f"coalesce(list_sum(list_transform(range(1, len(ss) + 1), lambda i: case when regexp_matches(ss[i], {q(a)}) then len(list_filter(ss[i + 1:], lambda b: regexp_matches(b, {q(b)}))) else 0 end)), 0)" for a, b in va.OPPOSITES)
_CITED = f"len(list_filter({sql_found('lower(answer)', va.CITED)}, lambda c: coalesce(try_cast(nullif(regexp_extract(c, '^[^<]*?(\\d+)', 1), '') as int) between 1 and len(excerpts), false)))"
_ALL_CITED = f"len({sql_found('lower(answer)', va.CITED)})"
_ATTRIBUTION = f"coalesce(1 - len(list_filter({sql_found('lower(answer)', va.ATTRIBUTIONS)}, lambda a: not coalesce(try_cast(nullif(regexp_extract(a, '(\\d+)', 1), '') as int) between 1 and len(excerpts), true))) / nullif(len({sql_found('lower(answer)', va.ATTRIBUTIONS)}), 0), 1.0)"
_FACTS = f"list_filter({sql_found('lower(answer)', va.FACTS)}, lambda f: length(trim(f)) > 15)"
_ACCURACY = f"coalesce(len(list_filter({_FACTS}, lambda f: len({sql_words('f', 4)}) >= 2 and {sql_in_one(sql_words('f', 4), 0.7)})) / nullif(len({_FACTS}), 0), 1.0)"
_KEYWORDS = "list_distinct(list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda w: length(w) > 3))"
_COMPLETE = f"coalesce(len(list_filter({_KEYWORDS}, lambda k: contains(lower(answer), k))) / nullif(len({_KEYWORDS}), 0), 1.0)"
_OVERLAP = "coalesce(len(list_intersect(list_distinct(list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda w: w <> '')), regexp_split_to_array(lower(answer), '\\s+'))) / nullif(len(list_distinct(list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda w: w <> ''))), 0), 0.0)"
# the last five numbers of the 200 signs before each stated total
_TOTALS = f"""tm as (select response_id, low, m, p from (select distinct response_id, lower(answer) as low, {sql_found('lower(answer)', va.TOTAL)} as m, regexp_split_to_array(lower(answer), {q(va.TOTAL)}) as p from r)),
    tl as (select response_id, low, m[i] as m, (coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::int as place from (select *, unnest(range(1, len(m) + 1)) as i from tm)),
    tn as (select response_id, {sql_found('substr(low, greatest(place - 199, 1), least(place, 200))', va.NUMBER)} as ns, regexp_extract(m, {q(f'({va.NUMBER})$')}, 1)::double as stated from tl),
    wt as (select response_id, count(*) as n_wrong from (select response_id, stated, len(ns) as n, list_sum(list_transform(list_reverse(ns)[1:5], lambda x: x::double)) as added from tn) where n >= 2 and abs(added - stated) > 0.01 and added < stated * 2 group by 1)"""


@query(f"with {ROW} select response_id, round(coalesce(len(list_filter({_SENTENCES}, lambda s: {_COVERED})) / nullif(len({_SENTENCES}), 0), 0.0) + 1e-9, 6) as coverage, len({_SENTENCES}) as n_sentences from r")
def source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).select("response_id", F.round(va.coverage(F.col("answer"), F.col("excerpts")) + 1e-9, 6).alias("coverage"), F.size(tx.sentences(F.lower("answer"))).cast("long").alias("n_sentences"))


@query(f"with {ROW}, h as (select response_id, {_RAW} as raw from r) select response_id, round(least(raw, 1.0) + 1e-9, 6) as score, case when raw > 0.5 then 'high' when raw > 0.2 then 'medium' else 'low' end as severity from h")
def hallucination_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = rows(spark, sf_dir).select("response_id", va.hallucination(F.col("answer"), F.col("excerpts")).alias("raw"))
    return h.select("response_id", F.round(F.least("raw", F.lit(1.0)) + 1e-9, 6).alias("score"), F.when(F.col("raw") > 0.5, "high").when(F.col("raw") > 0.2, "medium").otherwise("low").alias("severity"))


@query(f"with {ROW} select response_id, {_UNSUPPORTED}::bigint as n_unsupported from r")
def attributed_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).select("response_id", va.unsupported_claims(F.col("answer"), F.col("excerpts")).cast("long").alias("n_unsupported"))


@query(f"with {ROW} select response_id, {_CITED} as valid, {_ALL_CITED} - {_CITED} as invalid, round({_ATTRIBUTION} + 1e-9, 6) as attribution_quality from r")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations by whether their source is there, and how good the attributions are; a row for every answer."""
    good, bad = va.citation_counts(F.col("answer"), F.col("excerpts"))
    return rows(spark, sf_dir).select("response_id", good.cast("long").alias("valid"), bad.cast("long").alias("invalid"), F.round(va.attribution_quality(F.col("answer"), F.col("excerpts")) + 1e-9, 6).alias("attribution_quality"))


_LOGIC = f"{ROW}, s as (select *, {_SENTENCES} as ss from r), {_TOTALS}, lg as (select s.*, ({_OPPOSED})::bigint as n_contradictions, coalesce(n_wrong, 0) as n_wrong_totals from s left join wt using (response_id))"


@query(f"with {_LOGIC} select response_id, n_contradictions, n_wrong_totals, round(greatest(0.0, 1 - 0.2 * (n_contradictions + n_wrong_totals))::double + 1e-9, 6) as consistency from lg")
def logical_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir).select("response_id", va.contradictions(F.col("answer")).cast("long").alias("n_contradictions"), va.wrong_totals(F.col("answer")).cast("long").alias("n_wrong_totals"))
    return r.withColumn("consistency", F.round(F.greatest(F.lit(0.0), 1 - 0.2 * (F.col("n_contradictions") + F.col("n_wrong_totals"))) + 1e-9, 6))


@query(f"""with {_LOGIC}, v as (select response_id, coalesce(len(list_filter(ss, lambda s: {_COVERED})) / nullif(len(ss), 0), 0.0)::double as coverage, {_RAW} as raw, {_ALL_CITED} - {_CITED} as invalid, n_contradictions, n_wrong_totals, {_OVERLAP} as overlap, {_ACCURACY} as accuracy, {_ATTRIBUTION} as attribution, {_COMPLETE} as completeness from lg where query is not null),
    c as (select *, least(raw, 1.0) as hall, (coverage < 0.3)::int + (raw > 0.5)::int + invalid as issues, (overlap < 0.3)::int + n_contradictions as warnings from v),
    b as (select *, round(greatest(0.0, 1 - 0.2 * issues - 0.1 * warnings - 0.3 * (coverage < 0.5)::int - 0.5 * hall)::double * (0.5 + 0.5 * coverage) + 1e-9, 3) as confidence, greatest(0.0, 1 - 0.2 * (n_contradictions + n_wrong_totals)) as logic from c)
    select response_id, coverage >= 0.3 and hall <= 0.5 as is_valid, issues::bigint as n_issues, warnings::bigint as n_warnings, confidence, round((0.3 * confidence + 0.25 * accuracy + 0.2 * logic + 0.15 * attribution + 0.1 * completeness)::double + 1e-9, 3) as overall from b""")
def answer_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything known against an answer, its confidence and the weighted score of all checks."""
    a, e = F.col("answer"), F.col("excerpts")
    words = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    keywords = F.array_distinct(va.long_words(F.col("query"), 3))
    asked = F.array_distinct(words("query"))
    v = rows(spark, sf_dir).where("query is not null").select(
        "response_id",
        va.coverage(a, e).alias("coverage"),
        va.hallucination(a, e).alias("raw"),
        va.citation_counts(a, e)[1].alias("invalid"),
        va.contradictions(a).alias("n_contradictions"),
        va.wrong_totals(a).alias("n_wrong_totals"),
        F.coalesce(F.try_divide(F.size(F.array_intersect(asked, words("answer"))), F.size(asked)), F.lit(0.0)).alias("overlap"),
        va.factual_accuracy(a, e).alias("accuracy"),
        va.attribution_quality(a, e).alias("attribution"),
        F.coalesce(F.try_divide(F.size(F.filter(keywords, lambda k: F.contains(F.lower(a), k))), F.size(keywords)), F.lit(1.0)).alias("completeness"),
    )
    c = v.select("*", F.least("raw", F.lit(1.0)).alias("hall"), ((F.col("coverage") < 0.3).cast("int") + (F.col("raw") > 0.5).cast("int") + F.col("invalid")).alias("issues"), ((F.col("overlap") < 0.3).cast("int") + F.col("n_contradictions")).alias("warnings"))
    less = 1 - 0.2 * F.col("issues") - 0.1 * F.col("warnings") - 0.3 * (F.col("coverage") < 0.5).cast("int") - 0.5 * F.col("hall")
    b = c.withColumn("confidence", F.round(F.greatest(F.lit(0.0), less) * (0.5 + 0.5 * F.col("coverage")) + 1e-9, 3)).withColumn("logic", F.greatest(F.lit(0.0), 1 - 0.2 * (F.col("n_contradictions") + F.col("n_wrong_totals"))))
    overall = sum(w * F.col(x) for w, x in zip(va.WEIGHTS, ["confidence", "accuracy", "logic", "attribution", "completeness"]))
    return b.select("response_id", ((F.col("coverage") >= 0.3) & (F.col("hall") <= 0.5)).alias("is_valid"), F.col("issues").cast("long").alias("n_issues"), F.col("warnings").cast("long").alias("n_warnings"), "confidence", F.round(overall + 1e-9, 3).alias("overall"))


_NAMES, _QUANT = sql_found("answer", va.NAMES), sql_found("lower(answer)", va.QUANTITIES)
_SHORT = "lower(substr(x, 1, 1) || '. ' || split_part(x, ' ', 2))"
_UNKNOWN = f"len(list_filter(list_distinct({_NAMES}), lambda x: len(list_filter(excerpts, lambda e: contains(e, lower(x)) or (len(string_split(x, ' ')) = 2 and contains(e, {_SHORT})))) = 0))"
_CAUSAL = f"len(list_filter(string_split(lower(answer), '.'), lambda c: regexp_matches(c, {q(va.CAUSES)}) and len({sql_words('c', 4)}) >= 2 and len(list_filter(excerpts, lambda e: len(list_filter({sql_words('c', 4)}, lambda w: not contains(e, w))) = 0 and list_max(list_transform({sql_words('c', 4)}, lambda w: instr(e, w))) - list_min(list_transform({sql_words('c', 4)}, lambda w: instr(e, w))) < 200)) = 0))"
_UNQUANTIFIED = f"len(list_filter({_QUANT}, lambda x: not regexp_matches(x, {q(va.VAGUE)}) and len(list_filter(excerpts, lambda e: contains(e, x))) = 0))"


@query(f"with {ROW}, d as (select response_id, {_UNKNOWN} as n_entities, {_CAUSAL} as n_causes, {_UNQUANTIFIED} as n_quantities from r) select *, case when n_entities + n_causes + n_quantities = 0 then 'low' when n_entities + n_causes + n_quantities <= 2 then 'medium' else 'high' end as risk_level from d")
def deep_hallucinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, causes and quantities of an answer that no source holds."""
    a, e = F.col("answer"), F.col("excerpts")

    def known(x):
        short = F.lower(F.concat(F.substring(x, 1, 1), F.lit(". "), F.split_part(x, F.lit(" "), F.lit(2))))
        return F.exists(e, lambda s: F.contains(s, F.lower(x)) | ((F.size(F.split(x, " ")) == 2) & F.contains(s, short)))

    def cause_held(c):
        words = va.long_words(c, 4)
        places = lambda s: F.transform(words, lambda w: F.instr(s, w))
        return F.exists(e, lambda s: F.forall(words, lambda w: F.contains(s, w)) & (F.array_max(places(s)) - F.array_min(places(s)) < 200))

    d = rows(spark, sf_dir).select(
        "response_id",
        F.size(F.filter(F.array_distinct(va.found(a, va.NAMES)), lambda x: ~known(x))).cast("long").alias("n_entities"),
        F.size(F.filter(F.split(F.lower(a), r"\."), lambda c: c.rlike(va.CAUSES) & (F.size(va.long_words(c, 4)) >= 2) & ~cause_held(c))).cast("long").alias("n_causes"),
        F.size(F.filter(va.found(F.lower(a), va.QUANTITIES), lambda x: ~x.rlike(va.VAGUE) & ~F.exists(e, lambda s: F.contains(s, x)))).cast("long").alias("n_quantities"),
    )
    n = F.col("n_entities") + F.col("n_causes") + F.col("n_quantities")
    return d.withColumn("risk_level", F.when(n == 0, "low").when(n <= 2, "medium").otherwise("high"))
