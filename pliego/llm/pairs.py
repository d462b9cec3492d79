"""Broken question and answer pairs, by labelling functions and a label model.

For each defect a few labelling functions vote for it (1), against it (-1) or not at all (0). Votes are columns, so
every response is judged where it lies. Spark counts the vote patterns of each defect over all responses (at most
3 ** VOTES patterns a defect, so the counts are small whatever the corpus), and expectation-maximization on those
counts estimates how often each function is right and each defect's share. A response keeps every defect whose
posterior exceeds that defect's cutoff. Cutoffs come from validate_pairs, which damages pairs on purpose and keeps for each
defect the cutoff with the best F1, with its precision and recall.
primary names the one that explains the pair: an empty answer before a copied one, a refusal, a truncated answer and
an answer in another language, as the later ones presuppose that there is an answer.

Null queries are in no language, so nothing is copied from or contradicts them; a null answer is empty; null confidence
and warnings don't vote. A response logged twice with the same texts gets the same labels.
"""

from __future__ import annotations

import functools
import json
import re
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pliego.llm.common import cut_lineage, model_path
from pliego.llm.cuts import EndModel, whole_threshold

DEFECTS = ("empty", "copied", "refusal", "truncated", "wrong_language")
VOTES = 5
LOW_CONFIDENCE = 0.5

#: Frequent words by language.
WORDS = {
    "es": "contrato dura salvo renta mensual vigencia preaviso sobre pregunta como pagar conservar el la los las del al un una y se con por para su sus es son según más cada año años día días mes meses sí pero sólo debe deberes qué cuál cuánto cómo cuándo hay antes tiempo que no lo le ninguna misma cláusula en de dime indica resume enumera sanciones pactó tiene puede interés plazo fianza garantía incumplimiento",
    "en": "the of and is are to in for a an it this that what which how must under by each per year years month months days contract with not there does much long set ended early on was no be can has any or",
    "pt": "o os as do da dos das em um uma não e é são com por para ao à se qual quais que há dias anos meses mês deve contrato sim cada nos de foi como pode no na ou salvo obrigações renda caução dura",
    "fr": "le la les des du de un une et est en par pour que qui dans au aux ne pas il elle ans jours mois contrat oui chaque sous quel quelle quelles sont a se tout ce y selon comment fin loyer dépôt",
    "it": "il lo la gli dei del della di è un una e per con che non sono ogni anni giorni mese contratto sì entro deve da si i le stato questo nella parte può",
    "de": "der die das des dem den und ist ein eine im in zu von mit für nicht jahr jahre jahren tagen monat monats vertrag vertrags ja wird wurde es kann wenn bei auf an muss sich jede seite",
}
#: Letter groups that point to one language.
GROUPS = {
    "es": "[ñ¿¡]|ción\\b|ciones\\b|miento\\b|idad\\b|\\b(?:el|los|las|una|del|meses|días|más|según)\\b",
    "en": "\\bth|wh|sh\\b|ing\\b|ght|\\b[a-z]+ly\\b|n't|ment\\b|ach\\b|\\bmonth",
    "pt": "[ãõ]|nh|lh|\\b(?:não|é|há|às?|uma|do|das|anos)\\b",
    "fr": "\\b[ldnmsj]['’]|aux\\b|eux\\b|oit\\b|ez\\b|[êèëœ]| \\?|\\b(?:ans|et|des|les|est|dans)\\b",
    "it": "zion[ei]|gli|tà\\b|tt[oaie]\\b|\\b(?:è|il|di|della|anni)\\b|ggi|cch",
    "de": "[äöß]|sch|ung\\b|tz|cht|\\b(?:der|die|das|und|ein|eine|ist|den)\\b",
}
#: How languages are named in a request for one.
NAMES = {
    "es": "español|castellano|spanish|espanhol|espagnol|spagnolo|spanisch",
    "en": "inglés|english|inglês|anglais|inglese|englisch",
    "pt": "portugués|portuguese|português|portugais|portoghese|portugiesisch",
    "fr": "francés|french|francês|français|francese|französisch",
    "it": "italiano|italian|italien|italienisch",
    "de": "alemán|german|alemão|allemand|tedesco|deutsch",
}
#: Words that stand for an answer that isn't there.
PLACEHOLDERS = "null|none|nil|nan|na|n a|nd|n d|sd|s d|tbd|tbc|undefined|empty|blank|vacío|vacio|sin respuesta|sin contestar|no answer|no response|no data|sin datos|pendiente|sem resposta|sans réponse|respuesta|answer|ninguna|todo|xxx+|placeholder|lorem ipsum"
#: Ways to decline in the corpus' languages.
REFUSALS = "|".join([
    r"no (?:le |te |se lo |me )?(?:puedo|podré|podría|podemos) (?:ayudar|responder|contestar|facilitar|atender|tratar|dar|opinar|comentar|ofrecer|proporcionar|pronunciar|asistir|hablar|compartir|entrar)",
    r"no se l[oa] puedo|queda fuera de lo que|fuera de mi (?:ámbito|alcance|competencia)|no estoy (?:autorizad|capacitad|habilitad|en condiciones|facultad)[oa]?|no me (?:es posible|está permitido|corresponde|permiten|dejan)|no (?:l[oa]s? )?(?:voy|vamos) a (?:contestar|responder|comentar|tratar|dar|opinar)",
    r"declin[oa]\b|me abstengo|prefiero no|preferiría no|me niego|rehúso|no deseo|no l[oa] haré|me temo que no|me impiden|me lo impide|me prohíben|no procede que|no admite preguntas|mi función no|no (?:incluye|contempla) valorar|sin respuesta\b.*|no puedo ni debo|no debo|no tengo permi|lamento no poder|siento no poder|no será posible|consulte con un|acuda a un|sólo un abogado|no entra en mis|no doy|no contesto|no respondo|no comento|no facilito|no ofrezco",
    r"\b(?:can ?not|can['’]t|could ?n['’]t|won['’]t|unable to|not able to|not allowed to|not permitted to|not authori[sz]ed to|not in a position to)\b.{0,30}\b(?:help|answer|discuss|assist|comment|respond|reply|share|provide|give|say|do|address|advise|talk)|\bi (?:must |have to |respectfully |will )?(?:decline|refuse|abstain)|rather not|prefer not|outside what i|don['’]t let me|do not let me|beyond (?:my|what i)|something i (?:won|can|do|will)|not something i|(?:ask|consult|see|contact) a (?:qualified |licensed )?(?:lawyer|attorney|professional)|i['’]m afraid i|against my|must decline|not for me to",
    r"não (?:me )?(?:posso|podemos|poderei|estou autorizad[oa]|devo|vou|me é possível|é possível|deixam|permitem|respondo|comento)\b|prefiro não|recuso|abstenho|lamento, não|fora do (?:meu|que)|não me (?:é|deixam|permitem|cabe)",
    r"je (?:ne )?(?:peux|puis|suis|saurais|pourrai|souhaite|préfère|dois|refuse|décline|regrette)[^.]{0,25}(?:pas|refus|abst|déclin|répondre|autorisé)|m['’]interdi|je préfère ne pas|ne me permet|hors de (?:mon|ce que)|je refuse|je décline|je m['’]abstiens|impossible de (?:répondre|traiter)",
    r"non (?:posso|sono autorizzat|mi è possibile|rispondo|intendo)|preferisco non|mi astengo|kann ich (?:nicht|leider)|darf ich nicht|ich (?:kann|darf|möchte|werde)[^.]{0,40}nicht|nicht beantworten|ablehnen",
])
#: Words around a question that is only given back.
AROUND = "siguiente lo following segue suivante folgende número num nº diga dígame dime favor por please senhor você asks ask asking demandez demande es is est é sobre the this esta está señor señora pregunta consulta question query pergunta domanda frage usted pregunto preguntó preguntado ha su la el the your you asked a sua votre vous avez demandé respuesta answer réponse resposta q p r me pide saber quiere"


AROUND_WORDS = frozenset(AROUND.split())
SHORT_ANSWERS = set("sí si no yes sim oui ja nein não non".split())
WORD = re.compile(r"[^\W_]+")
REQUEST = re.compile(r"(?i)respond|contest|repl[iy]|answer|réponds|répondez|responda|rispond|antwort|please|por favor|s'il vous")


@functools.cache
def cutoffs() -> dict[str, float]:
    with open(model_path("pairs.json"), encoding="utf-8") as f:
        return {d: v["cutoff"] for d, v in json.load(f).items()}


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


@functools.cache
def _owners() -> dict[str, list[tuple[str, float]]]:
    by: dict[str, list[str]] = {}
    for language, ws in WORDS.items():
        for w in set(ws.split()):
            by.setdefault(w, []).append(language)
    return {w: [(k, 1 / len(ks)) for k in ks] for w, ks in by.items()}


@functools.cache
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern)


def _top(scores: dict[str, float]) -> str | None:
    best = max(scores.values(), default=0)
    top = [k for k, v in scores.items() if v > best - 1e-9]
    return top[0] if best > 0 and len(top) == 1 else None


def language_by_words(ws: list[str]) -> str | None:
    """The language with most frequent words of its own; None if none or two lead."""
    scores: dict[str, float] = {}
    owners = _owners()
    for w in set(ws):
        for k, weight in owners.get(w, ()):
            scores[k] = scores.get(k, 0) + weight
    return _top(scores)


def language_by_groups(text: str) -> str | None:
    """The language with most of its letter groups; None if none or two lead."""
    low = text.lower()
    return _top({k: float(len(_compiled(p).findall(low))) for k, p in GROUPS.items()})


def requested(query: str) -> set[str]:
    """Languages that a query asks for."""
    if not REQUEST.search(query):
        return set()
    return {k for k, p in NAMES.items() if _compiled(rf"(?:en|in|em|auf)\s+(?:{p})").search(query.lower())}


STOP = re.compile(r"""[.!?»”")\]}]\s*$""")
WEAK_END = re.compile(r"(?:^|[\s(])(?:de|del|la|el|los|las|que|a|al|y|o|en|por|con|su|un|una|para|se|the|of|to|and|in|for|an|or|with|do|da|dos|das|em|um|uma|e|com|le|les|des|du|et|dans|pour|il|di|und|der|die|das)\s*$|[,;:(\-–—/]\s*$|(?:…|\.\.\.)\s*$")
FACT = re.compile(r"\b(?:debe|deve|doit|must) (?:conservar|entretenir|keep)|no (?:prevé|indican|consta|figura)|don['’]t state|- conservar")
PLAIN_YES = re.compile(r"^(?:sí|sim|oui|yes|no|não|non|ja|nein)[,.]")
CONTRACT = re.compile(r"\b[a-z]{3}/\d{4}/\d+")


DIGIT = re.compile("[1-9]")
MEMO_TEXTS = 200_000


class Answer(NamedTuple):
    """What doesn't hang on an answer's figures or its query; the same for all answers that differ in digits only."""

    by_words: str | None
    by_groups: str | None
    refusing: bool
    states: bool
    stops: bool
    weak_end: bool
    whole: bool
    unclosed: bool
    figures: bool
    placeholder: bool


@functools.lru_cache(maxsize=MEMO_TEXTS)
def look_at(a: str) -> Answer:
    low = a.lower().strip()
    ws = words_of(a)
    refusing = bool(_compiled(REFUSALS).search(low))
    whole = bool(re.fullmatch(r"(?s)\s*[\[{].*[\]}]\s*", a))
    return Answer(
        language_by_words(ws),
        language_by_groups(a),
        refusing,
        bool(FACT.search(low)) or bool(PLAIN_YES.search(low)) and not refusing,
        bool(STOP.search(low)),
        bool(WEAK_END.search(low)),
        whole,
        low[:1] in "[{" and low[:1] != "" and not whole or a.count("(") > a.count(")") or a.count("«") > a.count("»"),
        bool(re.search(r"\d", CONTRACT.sub("", low))),
        bool(_compiled(f"(?:{PLACEHOLDERS})").fullmatch(" ".join(ws))),
    )


@functools.lru_cache(maxsize=MEMO_TEXTS)
def look_at_query(q: str) -> tuple[str | None, frozenset[str | None]]:
    """The language of a query, and those an answer may be in."""
    of = language_by_words(words_of(q)) or language_by_groups(q)
    return of, frozenset(requested(q) | {of})


def ballots(query: str | None, answer: str | None, confidence: float | None, n_warnings: int, cut: bool) -> list[str]:
    """For each defect the votes of its functions, joined by commas; the first one's vote weighs most."""
    a, q = answer or "", query or ""
    low = a.lower().strip()
    ws, ask = words_of(a), words_of(q)
    asked, n = set(ask), len(ws)
    by_words, by_groups, refusing, states, stops, weak_end, whole, unclosed, figures, placeholder = look_at(DIGIT.sub("0", a))
    of, fit = look_at_query(DIGIT.sub("0", q))

    def vote(yes: bool, no: bool = False) -> int:
        return 1 if yes else -1 if no else 0

    doubt = vote(confidence is not None and confidence < LOW_CONFIDENCE, confidence is not None and confidence >= 0.9)
    warned = vote(n_warnings >= 2)

    # the question, and what usually stands around one that is given back, taken away
    own = set(ws)
    rest = own - asked - AROUND_WORDS
    said = {w for w in rest if w in SHORT_ANSWERS or w.isdigit()}
    shared = len(own & asked) / max(len(asked), 1)
    same = n > 0 and ws == ask
    given_back = n > 0 and (same or not rest and shared >= 0.6 or len(rest) <= 1 and not said and shared >= 0.8)
    facts = figures or states

    def foreign(language: str | None) -> int:
        # a few words are in a language only if words and letters agree on it
        unsure = language is None or of is None or n < 4 and by_words != by_groups
        return 0 if unsure else -1 if language in fit else 1

    both = foreign(by_words) if by_words == by_groups else -1 if by_words in fit and by_words else 0
    by_defect = [
        [vote(n == 0 or placeholder, n > 0 and not placeholder), vote(placeholder, n > 0 and not placeholder), vote(len(low) <= 2, len(low) > 20), vote(answer is None), doubt],
        [vote(given_back, len(rest) > 1 or bool(said) or shared < 0.5), vote(same, len(rest) > 2), vote(n > 0 and not rest and shared >= 0.6, len(rest) > 1), vote(low.endswith("?") and given_back), doubt],
        [vote(refusing and not facts, not refusing), vote(n > 3 and not facts and not given_back, facts), vote(refusing, figures and not refusing), vote(n > 3 and not figures and not whole and len(rest) > 2, figures), doubt],
        [vote(cut and n > 0, not cut), vote(cut and n > 0 and not stops, stops and not unclosed), vote(weak_end, stops), vote(unclosed, whole), doubt],
        [foreign(by_words), foreign(by_groups), both, vote(confidence is not None and confidence < LOW_CONFIDENCE), warned],
    ]
    return [",".join(map(str, vs)) for vs in by_defect]


#: What is expected of the first function of a defect and of the others before any counts: how often they vote
#: against, not at all and for it, without and with the defect. It weighs as much as PRIOR_SHARE of the class.
EXPECTED = {"lead": ((0.79, 0.20, 0.01), (0.02, 0.08, 0.90)), "other": ((0.50, 0.45, 0.05), (0.05, 0.35, 0.60))}
PRIOR_SHARE = 0.3


def label_model(patterns: dict[str, int], rounds: int = 200) -> dict[str, float]:
    """Posterior of the defect for each vote pattern, by expectation-maximization over pattern counts.

    Each function has its own table of how often it votes with and without the defect, estimated from all responses
    and held to EXPECTED by the prior, so that another split of the corpus can't take the defect's place.
    """
    if not patterns:
        return {}
    keys = sorted(patterns)
    x = np.array([[int(v) for v in k.split(",")] for k in keys]) + 1
    n = np.array([patterns[k] for k in keys], float)
    prior = [[np.array(EXPECTED["lead" if j == 0 else "other"][c]) for c in (0, 1)] for j in range(x.shape[1])]
    tables = [[p.copy() for p in ps] for ps in prior]
    share, y = 0.05, np.zeros(len(keys))
    for _ in range(rounds):
        gap = np.log(share) - np.log1p(-share) + sum(np.log(tables[j][1])[x[:, j]] - np.log(tables[j][0])[x[:, j]] for j in range(x.shape[1]))
        after = 1 / (1 + np.exp(-np.clip(gap, -60, 60)))
        if np.abs(after - y).max() < 1e-9:
            break
        y = after
        share = float(np.clip((n * y).sum() / n.sum(), 1e-4, 0.5))
        for j in range(x.shape[1]):
            for c, weight in ((0, n * (1 - y)), (1, n * y)):
                mass = max(weight.sum(), 1.0)
                t = np.bincount(x[:, j], weight, minlength=3) + PRIOR_SHARE * mass * prior[j][c]
                tables[j][c] = t / t.sum()
    # where neither of the functions that look at the texts speaks for the defect, confidence and warnings can't make one
    return {k: float(p) if "1" in k.split(",")[:3] else 0.0 for k, p in zip(keys, y)}


def label_pairs(df: DataFrame, key: str = "response_id", query: str = "query", answer: str = "answer", confidence: str = "confidence", warnings: str = "warnings") -> DataFrame:
    """response_id, labels (defects over their cutoffs), posteriors and primary, a row per row of df."""
    spark = SparkSession.active()
    rows = df.select(F.col(key).alias("response_id"), F.col(query).alias("query"), F.col(answer).alias("answer"), F.col(confidence).cast("double").alias("confidence"), F.col(warnings).alias("warnings"))
    scored = EndModel.train(df, answer).score(rows, "answer")
    limit = whole_threshold(scored)

    @F.pandas_udf("array<string>")
    def judge(queries, answers, confidences, warned, odds):
        import pandas as pd

        return pd.Series([ballots(q, a, None if c != c else c, w, o < limit) for q, a, c, w, o in zip(queries, answers, confidences, warned, odds)])

    cast = judge("query", "answer", "confidence", F.greatest(F.coalesce(F.size("warnings"), F.lit(0)), F.lit(0)), "log_odds")
    # the ballots are counted, then looked up: they are kept so that the texts are judged once
    cast_votes = cut_lineage(scored.select("response_id", F.zip_with(F.array(*map(F.lit, DEFECTS)), cast, lambda d, v: F.struct(d.alias("defect"), v.alias("votes"))).alias("ballots")))
    counted: dict[str, dict[str, int]] = {d: {} for d in DEFECTS}
    for r in cast_votes.select(F.explode("ballots").alias("b")).groupBy("b.defect", "b.votes").count().collect():  # at most 5 * 3 ** VOTES rows
        counted[r["defect"]][r["votes"]] = r["count"]
    judged = [(d, k, p) for d in DEFECTS for k, p in label_model(counted[d]).items()]
    model = spark.createDataFrame(judged or [("", "", 0.0)], "defect string, votes string, posterior double")
    # the model as one small array column on every row: no join is needed
    table = F.broadcast(model.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "defect", "votes"), "posterior"))).alias("model")))
    posteriors = F.transform("ballots", lambda b: F.struct(b["defect"].alias("defect"), F.coalesce(F.element_at("model", F.concat_ws(":", b["defect"], b["votes"])), F.lit(0.0)).alias("posterior")))
    limits = F.create_map(*[F.lit(x) for kv in cutoffs().items() for x in kv])
    kept = F.transform(F.filter("posteriors", lambda p: p["posterior"] > F.element_at(limits, p["defect"])), lambda p: p["defect"])
    return cast_votes.crossJoin(table).withColumn("posteriors", posteriors).withColumn("labels", kept).select("response_id", "labels", "posteriors", F.get("labels", F.lit(0)).alias("primary"))
