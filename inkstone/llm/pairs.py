"""Problem 4: broken prompt and response pairs, by ordered rules that emit every defect they see.

Emptiness, refusals in eight languages, copied prompts and prefixes, another script or language, unclosed delimiters
and abrupt endings. Every rule reads the whole body. A last line without a full stop is no cut if it is a sign-off,
label, heading or mark after a whole sentence; headings are told by the words of the titles in the data, which are
joined, not gathered. Scripts are compared first; the language models of problem 10 tell languages of one script.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm import _kn, lang_labels
from inkstone.llm import _words as W
from inkstone.plans.lineage import written

#: In the order of their weight: a pair with several defects is named after the first.
DEFECTS = ("empty", "refusal", "copy", "wrong_lang", "truncated")
COPIED = 0.6
COPY_SHINGLE = 3
#: A body that begins with the whole prompt is a copy if the prompt makes up so much of it.
PREFIX = 1 / 3
FOREIGN = 0.5
HEADING_WORDS = 14
#: Pairs whose words are scored together.
ROWS = 500

#: Stand-ins for no content, without their brackets, quotes and marks.
STAND_INS = frozenset(
    "null|none|nil|nan|na|n/a|undefined|tbd|tba|todo|empty|blank|void|missing|placeholder|no output|no content|no answer|no response|no text|not available|not applicable|no data|"
    "leer|kein text|keine antwort|vide|aucun|aucune réponse|vacío|sin respuesta|ninguno|vuoto|nessuno|vazio|nenhum|leeg|geen|нет|пусто|coming soon|lorem ipsum".split("|")
)

_THING = r"(?:request|assignments?|task|brief|commission|piece|texts?|essays?|articles?|columns?|stor(?:y|ies)|prompt|work|answer|response|reply|draft|content|opinion)"
_MAKE = r"(?:write|compose|draft|produce|create|generate|provide|supply|deliver|prepare|continue|finish|complete|do|take(?: on)?|accept|answer|make|offer|submit|handle|go through with)"
_COPY = r"(?:imitate|mimic|impersonate|recreate|re-create|reproduce|fulfil|fulfill|comply|assist|help(?: you)?(?: out)?(?: with)?)"
_CANNOT = r"(?:can ?not|can[’']t|won[’']t|will not|could not|couldn[’']t|wouldn[’']t|would not|(?:am|[’']m) (?:simply |just )?(?:not able|unable|not willing|unwilling|not allowed|not permitted|not in a position|not comfortable|not going)|(?:will not|won[’']t|would not|wouldn[’']t) be able|would rather not|[’']d rather not|(?:would )?prefer not|do not want|don[’']t want|must decline|have to decline|need to decline|decline|refuse|must refuse|have to refuse)"
_OBJECT = rf"(?:(?:this|that|it|one|so)\b(?! (?:again|any ?more|any longer))|(?:an?|the|your|any|such an?|these|those|this|that)\s+(?:[\w-]+\s+){{0,3}}?{_THING}\b|“[^”]*”|\"[^\"]*\")"
_UNWILLING = (
    "can't can’t cannot won't won’t unable unwilling declin refus".split()
    + "can not,will not,could not,couldn't,couldn’t,would not,wouldn't,wouldn’t,'d rather,’d rather,would rather,not able,not willing,not allowed,not permitted,not in a position,not comfortable,not going,prefer not,not want,don't want,don’t want".split(",")
)
#: How an answer declines its task: words of which a sentence has one (in lower case), and what it says.
REFUSALS = (
    (_UNWILLING, rf"\bI\b[^.!?]{{0,60}}?{_CANNOT}\s+(?:to\s+)?(?:\w+ly )?(?:{_COPY}\b(?! (?:but|\w+ing)\b)|{_MAKE}\s+(?:you\s+|up\s+|for you\s+)?{_OBJECT})"),
    (("sorry", "apolog", "unfortunately"), rf"^\W*(?:sorry|apologies|unfortunately)\b[^.!?]{{0,20}}?{_CANNOT}\s+(?:to\s+)?(?:{_MAKE}|{_COPY})\b"),
    (("pass on", "declin", "refus", "reject", "turn down"), rf"\bI (?:have to |must |need to |will )?(?:respectfully |politely |kindly )*(?:pass on|decline|refuse|reject|turn down) (?:it\b|this|that|{_OBJECT})"),
    (("not something", "nothing"), rf"\b{_THING}\b[^.!?]* (?:is|are) (?:not something|nothing) (?:that )?I\b|\bnot something (?:that )?I (?:can|could|will|would|am able to|am willing to|feel able to) (?:do|write|help|provide|offer|produce)"),
    (("be no", "is no", "say no"), r"\bmy answer (?:has to be|must be|is|will be) no\b|\bI (?:have|need) to say no\b"),
    (("for me to",), rf"\b(?:would|is|will)(?: not|n[’']t) (?:be )?(?:appropriate|right|possible|acceptable|proper) for me to (?:{_MAKE}|{_COPY})\b"),
    (("goes against", "runs against", "counter to"), rf"\b(?:this|that|the|your|such an?) {_THING} (?:goes|runs) (?:against|counter to)\b"),
    (("as an ai", "as a large", "as a language", "as a virtual", "as an artificial"), r"\bas an? (?:ai|artificial intelligence|(?:large )?language model|(?:virtual|ai) assistant|ai model)\b[^.!?]*\b(?:cannot|can[’']t|decline|unable|not able)\b"),
    (
        ("nicht", "ablehn", "verweiger", "außerstande", "verzicht"),
        r"^(?=.*\b(?:aufgabe|auftrag|anfrage|bitte|wunsch|text|aufsatz|artikel|essay|kolumne|beitrag|stück|dabei|schreiben|verfassen|erstellen|nachahmen|imitieren|helfen|dienen|übernehmen|nachkommen))"
        r"(?=.*\bich\b).*(?:\b(?:kann|darf|will|werde|möchte|mag)\b.*\bnicht\b|\b(?:ablehn|verweiger|außerstande|verzicht))",
    ),
    (
        ("je ne", "je n’", "je n'", "je dois", "je préfère", "je me vois", "je refuse", "je décline", "impossible", "désolé"),
        r"^(?=.*\b(?:demande|tâche|consigne|commande|texte|article|essai|chronique|écrire|rédiger|composer|imiter|aider|répondre|cela)).*"
        r"(?:\bje (?:ne |n[’'])(?:peux|puis|saurais|pourrai|veux|souhaite|suis pas en mesure)|\bje (?:dois|préfère|me vois)\b.*\b(?:refus|déclin|ne pas)|\bje (?:refuse|décline)\b|\bil m[’']est impossible|\bdésolée?\b.*\b(?:ne|n[’'])\b)",
    ),
    (
        ("no puedo", "no podré", "no voy", "no me es", "no quiero", "no soy capaz", "me es imposible", "rechazar", "declinar", "prefiero no", "me niego"),
        r"^(?=.*\b(?:solicitud|petición|encargo|tarea|texto|artículo|ensayo|columna|escribir|redactar|componer|imitar|ayudar|hacerlo|esto))"
        r".*\b(?:no puedo|no podré|no voy a|no me es posible|no quiero|no soy capaz|me es imposible|(?:debo|tengo que|he de) (?:rechazar|declinar)|prefiero no|me niego a)\b",
    ),
    (
        ("non posso", "non potrò", "non sono in grado", "è impossibile", "rifiut", "declinare", "preferisco non"),
        r"^(?=.*\b(?:richiesta|compito|incarico|testo|articolo|saggio|scrivere|redigere|comporre|imitare|aiutare|farlo|questo)).*\b(?:non posso|non potrò|non sono in grado|mi è impossibile|(?:devo|debbo) (?:rifiutare|declinare)|preferisco non|mi rifiuto)\b",
    ),
    (
        ("não posso", "não poderei", "não vou", "não consigo", "não me é", "recus", "declinar", "prefiro não"),
        r"^(?=.*\b(?:pedido|tarefa|encomenda|texto|artigo|ensaio|escrever|redigir|compor|imitar|ajudar|fazê-lo|isso|isto)).*\b(?:não posso|não poderei|não vou|não consigo|não me é possível|(?:devo|tenho de|tenho que) (?:recusar|declinar)|prefiro não|recuso-me)\b",
    ),
    (("niet", "weiger", "afwijzen"), r"^(?=.*\b(?:verzoek|opdracht|taak|tekst|artikel|essay|stuk|schrijven|opstellen|nabootsen|imiteren|helpen|hierbij|dit)\b)(?=.*\bik\b).*(?:\b(?:kan|mag|wil|zal|ga)\b.*\bniet\b|\b(?:weiger|afwijzen))"),
    (
        ("не могу", "не смогу", "не буду", "не стану", "не хочу", "отказ", "отклон"),
        r"^(?=.*(?:просьб|задани|запрос|текст|стать|эссе|написать|сочинить|помочь|выполнить|подражать|имитировать)).*(?:\bне (?:могу|смогу|буду|стану|хочу)\b|\bвынужден\w* отказ|\bотказываюсь\b|\bотклон)",
    ),
)

_BARE = W.PlainHashes()
_HIDDEN = re.compile("[\\s​-‏‪-‮⁠﻿­­]+")
_REFUSAL = [(frozenset(stems), re.compile(x, re.I | re.S)) for stems, x in REFUSALS]
_STEMS = sorted({x for stems, _ in REFUSALS for x in stems})
_SPOKEN = re.compile("“[^“”\r\n]*”|\"[^\"\r\n]*\"|«[^«»\r\n]*»|„[^„“”\r\n]*[“”]")
_OPEN, _CLOSE = "([{«„", ")]}»"
_SCRIPTS = re.compile("([A-Za-zÀ-ʯ]+)|([Ѐ-ԯ]+)|([Ͱ-Ͽ]+)|([֐-׿]+)|([؀-ۿ]+)|([ऀ-ॿ]+)|([぀-ヿ一-鿿가-힯]+)")
_OTHER_SCRIPT = re.compile("[Ͱ-ԯ֐-ۿऀ-ॿ぀-ヿ一-鿿가-힯]")
_REMARK = re.compile(r"[(\[{<*_]+[^()\[\]{}<>.!?\r\n]+[)\]}>*_]+")
_STOP = re.compile(r"[.!?][\"'”’»)\]]*\s+")
_ALNUM = re.compile(r"[^\W_]")
_LETTER = re.compile(r"[^\W\d_]")
_CLOSERS = "\"'”’»)]}*_ "
_LABEL = re.compile(r"[^\W\d_][\w ]{0,30}:\s*\S[^.!?]{0,60}$")
_PARENTHESIS = re.compile(r"[(\[{<][^()\[\]]{1,50}[)\]}>]$")
_SIGNED = re.compile(r"(?:[-–—~]+\s*)\S.{0,60}$")
_QUOTED = re.compile(r"“[^“”]+”$|\"[^\"]+\"$|«[^«»]+»$|„[^„“”]+[“”]$")
_END = re.compile(r"(?:the )?end|fin|ende|fine|fim|einde|конец|-?30-?|###", re.I)
_DOTS = re.compile(r"(?:\.\.+|…)[\"'”’»)\]]*$")


def is_empty(body: str | None) -> bool:
    """Null, blank, only marks, stand-ins for no content, or one bracketed remark in its place."""
    if body is None or not _ALNUM.search(body):
        return True
    if _REMARK.fullmatch(body.strip()):
        return True
    lines = [_HIDDEN.sub(" ", x).strip("\"'“”‘’«»()[]{}<>*_-–—.…: ").lower() for x in re.split(r"[\r\n]+|\*\s+\*", body)]
    return all(not x or x in STAND_INS or not _ALNUM.search(x) for x in lines)


def is_refusal(body: str) -> bool:
    """A sentence of the body declines the task. Speech in quotation marks is another's, unless all of the body is quoted."""
    body = body.strip()
    if body[:1] in "“\"«„" and body[-1:] in "”\"»“":
        body = body[1:-1]
    low = body.lower()
    seen = {x for x in _STEMS if x in low}
    rules = [r for r in _REFUSAL if not seen.isdisjoint(r[0])] if seen else ()
    for s in _STOP.split(_SPOKEN.sub('"…"', body)) if rules else ():
        low = s.lower()
        for stems, says in rules:
            if any(x in low for x in stems) and says.search(s):
                return True
    return False


def is_copy(body: str, prompt: str | None) -> bool:
    """Most words of the body stand in word triples of the prompt, and these make up most of the prompt; or the body
    begins with the prompt, and that is a good part of it."""
    if not prompt:
        return False
    a, b = (np.array([h for w in t.lower().split() if (h := _BARE[w])], np.uint64) for t in (prompt, body))
    k = min(COPY_SHINGLE, len(a))
    if not k or len(b) < k:
        return False
    if len(b) * PREFIX <= len(a) <= len(b) and (a == b[: len(a)]).all():
        return True
    asked = set(a.tolist())
    if sum(map(asked.__contains__, b.tolist())) < COPIED * k / (k + 1) * len(b):  # between copied stretches of k words stands at most one other
        return False

    def covered(x: np.ndarray, y: np.ndarray) -> float:
        at = np.flatnonzero(np.isin(W.grams(x, k), W.grams(y, k)))
        on = np.zeros(len(x), bool)
        for i in range(k):
            on[at + i] = True
        on[1:-1] |= on[:-2] & on[2:]  # a single changed word between copied ones
        return float(on.mean())

    return covered(b, a) >= COPIED and covered(a, b) >= 0.5


def is_open(body: str) -> bool:
    """A code fence that isn't closed, or a bracket or quotation mark that the last paragraph opens and doesn't close."""
    if body.count("```") % 2:
        return True
    last = body.rstrip().replace("\r\n", "\n").rsplit("\n\n", 1)[-1]
    if not any(c in last for c in _OPEN + "“"):
        return False
    depth = {}
    for i, c in enumerate(last):
        if c in _OPEN:
            depth[c] = depth.get(c, 0) + 1
        elif c in _CLOSE and (o := _OPEN[_CLOSE.index(c)]) in depth:
            depth[o] -= 1
        elif c in "“”" and depth.get("„"):
            depth["„"] -= 1
    return any(n > 0 for n in depth.values()) or last.count("“") > last.count("”") + last.count("„")


def script(text: str) -> int | None:
    """The script that most letters of a text are of, by number; None without letters of a known one."""
    if text.isascii() or not _OTHER_SCRIPT.search(text):
        return 1 if _LETTER.search(text) else None
    sizes = {}
    for m in _SCRIPTS.finditer(text):
        sizes[m.lastindex] = sizes.get(m.lastindex, 0) + len(m.group())
    return max(sizes, key=sizes.get) if sizes else None


def ending(body: str) -> tuple[str, list[str]]:
    """`whole`, `cut`, or `heading` with the words of a last line that may be one."""
    lines = [x for x in (y.strip() for y in re.split(r"[\r\n]+|</p>", body)) if x and x not in ("<p>", "</p>")]
    for _ in range(4):
        if len(lines) < 2:
            break
        last = lines[-1]
        words = last.split()
        mark = not _ALNUM.search(last)
        if mark or len(words) <= 8 and (_PARENTHESIS.match(last) or _SIGNED.match(last) or _LABEL.match(last) or _END.fullmatch(last.strip("*_.()[]- ")) or last.isupper() and len(words) < 5):
            lines.pop()
        else:
            break
    last = lines[-1] if lines else ""
    bare = last.rstrip()
    while bare and not bare[-1].isalnum() and bare[-1] not in ".!?…。！？,;:—–-‒" and (bare[-1] in _CLOSERS or not bare[-1].isascii()):
        bare = bare[:-1].rstrip()
    if bare and bare[-1] in ".!?。！？" and not _DOTS.search(bare):
        return "whole", []
    words = last.split()
    before = len(lines) > 1 and lines[-2].rstrip(_CLOSERS)[-1:] in tuple(".!?。！？")
    title = before and 1 < len(words) <= HEADING_WORDS and last[:1].isupper() and not re.search(r"[,;:.…—–]", last)
    if before and len(words) <= HEADING_WORDS and _QUOTED.match(last):
        return "whole", []  # a quotation set under the text
    if title and len(words) < 5 and all(w[:1].isupper() for w in words):
        return "whole", []  # a name under the text
    return ("heading", [w.lower() for w in words]) if title else ("cut", [])


def foreign(bodies: list, prompts: list, scorer: lang_labels.Scorer) -> list[bool]:
    """For each pair, whether most letters of the body are of another script than the prompt's, or most of its words stand
    in sentences of another language. An empty text is in none."""
    clean = [[_kn.clean(t) if t else "" for t in side] for side in (prompts, bodies)]
    out = [None not in (both := (script(p), script(b))) and both[0] != both[1] for p, b in zip(*clean)]
    words = [[t.split() for t in side] for side in clean]
    rows = scorer.rows(words[0] + words[1])
    asked, said = rows[: len(prompts)], rows[len(prompts) :]
    some = [i for i in range(len(out)) if not out[i] and len(asked[i]) and len(said[i])]
    if not some:
        return out
    add = lambda parts: np.add.reduceat(scorer.scores[np.concatenate(parts)].astype(np.float64), np.cumsum([0, *map(len, parts[:-1])]), axis=0)
    own = add([asked[i] for i in some])
    flat, lengths = np.concatenate([said[i] for i in some]), np.array([len(said[i]) for i in some])
    first = np.zeros(len(flat), bool)
    first[np.cumsum(lengths) - lengths] = True
    first[1:] |= scorer.ended[flat[:-1]]
    begins = np.flatnonzero(first)  # of sentences
    of = np.repeat(np.arange(len(some)), lengths)[begins]
    sums, sizes = np.add.reduceat(scorer.scores[flat].astype(np.float64), begins, axis=0), np.diff(np.append(begins, len(flat)))
    told = sums[:, -1] > 0
    other = told & (sums[:, :-1].max(axis=1) - sums[np.arange(len(of)), own[:, :-1].argmax(axis=1)[of]] > 3.0)
    n, k = (np.bincount(of[x], weights=sizes[x], minlength=len(some)) for x in (told, other))
    for i, yes in zip(some, (own[:, -1] > 0) & (k > FOREIGN * n)):
        out[i] = bool(yes)
    return out


def _judged(batches, model):
    scorer = lang_labels.scorer_of(model)
    for batch in (b.slice(at, ROWS) for b in batches for at in range(0, max(b.num_rows, 1), ROWS)):
        rows = []
        recs, bodies, counts, prompts = (batch.column(i).to_pylist() for i in range(4))
        for rec, body, count, prompt, abroad in zip(recs, bodies, counts, prompts, foreign(bodies, prompts, scorer)):
            if is_empty(body):
                rows.append((rec, True, False, False, False, False, None))
                continue
            short = bool(count) and 2 * len(body.split()) < count
            end, heading = ending(body)
            rows.append((rec, False, is_refusal(body), is_copy(body, prompt), abroad, short or end == "cut" or is_open(body), heading if end == "heading" and not short else None))
        cols = list(zip(*rows)) or [()] * 7
        types = [batch.schema.field(0).type, *[pa.bool_()] * 5, pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["key", *DEFECTS, "heading"])


def defects(pairs: DataFrame, titles: DataFrame, samples: DataFrame, key: str = "rec_id") -> DataFrame:
    """(key, defect, rank): every defect of every pair, rank 1 being the one it is named after.

    pairs: key, body, word_count, prompt; repeated rows of a key are judged once each and count once, so that bodies
    aren't moved to be told apart. A null prompt can be neither copied nor in another language,
    a null word_count proves no truncation. titles: title, whose words tell headings; nulls are ignored.
    """
    kind = pairs.schema[key].dataType.simpleString()
    model = lang_labels.broadcast_model(samples)
    flags = ", ".join(f"{d} boolean" for d in DEFECTS)
    judged = written(pairs.select(F.col(key).alias("key"), "body", "word_count", "prompt").mapInArrow(lambda it: _judged(it, model), f"key {kind}, {flags}, heading array<string>").dropDuplicates(["key"]), "p4-judged")
    split = F.split(F.lower(F.trim("title")), r"(?U)\s+")
    word = titles.where("title is not null").select(F.posexplode(split).alias("at", "word"), F.size(split).alias("n")).groupBy("word").agg(F.max((F.col("at") == F.col("n") - 1)).alias("last"))
    asked = judged.where("heading is not null").select("key", F.size("heading").alias("n"), F.posexplode("heading").alias("at", "word"))
    cut = asked.join(word, "word", "left").groupBy("key").agg(F.min(F.col("last").isNotNull() & ((F.col("at") < F.col("n") - 1) | F.coalesce("last", F.lit(False)))).alias("is_title")).where("not is_title").select("key", F.lit(True).alias("no_title"))
    all_ = judged.drop("heading").join(cut, "key", "left").withColumn("truncated", F.col("truncated") | F.coalesce("no_title", F.lit(False)))
    seen = F.filter(F.array(*(F.when(F.col(d), F.lit(d)) for d in DEFECTS)), lambda x: x.isNotNull())
    return all_.select(F.col("key").alias(key), F.posexplode(seen).alias("at", "defect")).select(key, "defect", (F.col("at") + 1).alias("rank"))
