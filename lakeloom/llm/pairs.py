"""Problem 2: flag defective prompt and response pairs with the type of defect.

Tokens of prompt and response are aligned: shingle containment finds responses that hold little but the
prompt, and the longest common subsequence (of the shared words, in whatever order the parts stand) confirms
it. Refusals are aligned against templates: short phrases of several languages that must be a subsequence of a
stretch of the response, which itself is not taken from the quote. Language is told by script, function
words and letters, truncation by how the response breaks off, seen against the quote.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .forms import unify_texts

SHINGLE = 3
#: Share of a response's words (shingles) that the prompt must hold, and of the prompt's that the response must.
HELD, COVERED = 0.8, 0.7
#: Words that may stand between those of a refusal template, and share of a refusal's words that the quote may have at most.
GAP, SUPPORT = 3, 0.6

# fixed values: responses without content
_BLANK = {"null", "none", "nil", "nan", "n/a", "na", "н/д", "немає", "todo", "tbd", "відповідь", "answer", "ответ", "a", "в", "empty", "порожньо", "odpowiedź", "antwort"}
# fixed values: words that frame a repeated question
_FRAME = {"q", "a", "question", "питання", "запитання", "вопрос", "ви", "запитуєте", "you", "ask", "asked", "вы", "спрашиваете", "відповідь", "answer", "ваше", "your", "was", "is", "це", "на", "щодо", "питаєте", "отже", "so", "repeat", "повторюю"}
# fixed values: how answers are declined, or said to be missing, by language; a star stands for any ending
REFUSALS = {
    "uk": "не можу відпові*; не можемо відпові*; не можу дати; не можу допом*; не можу нада*; не можу обговор*; не можу визначити; не можу знайти; не маю права; не маю змоги; не маю можлив*; не маю інформац*; не маю доступу; не буду відпові*; відпові* не буду; відпові* не можу; відмов* відповід*; відмовляюся; змушен* відмов*; неможливо відпові*; неможливо визначити; неможливо встановити; відпові* неможливо; немає інформац*; немає відповід*; немає даних; немає відомост*; недостатньо даних; недостатньо інформац*; бракує даних; бракує інформац*; не містить відповід*; не містить інформац*; не містить даних; не містить відомост*; про це не згадує; про це не йдеться; про це не сказано; інформац* відсутн*; відповід* відсутн*; відсутн* інформац*; не знаю відповід*; не знаю; не володію; поза межами мо*; виходить за межі; не надаю порад*; не вдалося знайти; як мовна модель; як штучний інтелект",
    "ru": "не могу ответ*; не можем ответ*; не могу дать; не могу помо*; не могу предостав*; не могу обсуждать; не могу определить; не могу найти; не имею права; не имею возможност*; не имею доступа; не буду отвечать; отвечать не буду; ответить не могу; отказ* отвечать; вынужден* отказ*; невозможно ответить; невозможно определить; ответить невозможно; нет информац*; нет ответа; нет данных; нет сведений; недостаточно данных; недостаточно информац*; не содержит ответ*; не содержит информац*; не содержит данных; об этом не говорится; не упоминает*; информац* отсутств*; ответ отсутствует; отсутств* информац*; не знаю; не располагаю; выходит за рамки; вне моей компетенц*; как языковая модель; как искусственный интеллект",
    "en": "cannot answer; can't answer; can not answer; could not answer; couldn't answer; cannot help; can't help; cannot assist; can't assist; cannot provide; can't provide; cannot discuss; can't discuss; cannot determine; can't determine; cannot find; can't find; cannot be answered; can't be answered; cannot be determined; can't be determined; unable to answer; unable to help; unable to assist; unable to provide; unable to determine; unable to find; not able to answer; not able to help; not able to provide; not possible to answer; impossible to answer; not allowed to; not permitted to; will not answer; won't answer; refuse to answer; decline to answer; must decline; have to decline; prefer not to; do not know; don't know; do not have information; don't have information; don't have enough; do not have enough; not enough information; not enough data; not enough context; insufficient information; insufficient data; insufficient context; no information; no answer; no mention; does not contain; doesn't contain; does not mention; doesn't mention; does not say; doesn't say; does not provide; doesn't provide; not mentioned in; not stated in; not specified in; not provided in; beyond my; outside my; as an ai; as a language model; as a large language model",
    "pl": "nie mogę odpowi*; nie mogę pomóc; nie mogę udzielić; nie mogę podać; nie możemy odpowi*; nie jestem w stanie; nie mam dostępu; nie mam informacji; nie mam prawa; nie będę odpowiadać; odmawiam; muszę odmówić; nie można odpowiedzieć; nie da się odpowiedzieć; nie wiem; nie znam odpowiedzi; brak danych; brak informacji; brak odpowiedzi; za mało danych; za mało informacji; nie ma informacji; nie ma odpowiedzi; nie zawiera odpowiedzi; nie zawiera informacji; jako model językowy",
    "de": "kann nicht beantwort*; kann ich nicht beantworten; kann diese frage nicht; kann dir nicht helfen; kann ihnen nicht helfen; kann nicht helfen; kann dabei nicht helfen; kann keine auskunft; kann keine antwort; nicht beantworten; nicht in der lage; darf ich nicht; weiß ich nicht; weiß es nicht; keine informationen; keine angaben; keine antwort; keine daten; nicht genügend informationen; nicht genug informationen; nicht erwähnt; enthält keine; lehne ab; als sprachmodell; als ki",
    "fr": "ne peux pas répondre; ne peux pas vous aider; ne peux pas aider; ne peux pas fournir; ne peux répondre; ne puis répondre; ne pouvons pas répondre; impossible de répondre; pas en mesure de; ne sais pas; refuse de répondre; pas d'information*; aucune information; aucune réponse; aucune donnée; pas assez d'information*; informations insuffisantes; ne contient pas; ne mentionne pas; n'est pas mentionné*; en tant que modèle; en tant qu'ia",
    "es": "no puedo responder; no puedo contestar; no puedo ayudar*; no puedo proporcionar; no puedo dar; no podemos responder; no es posible responder; no sé; no tengo información; no tengo acceso; no hay información; no hay datos; no hay respuesta; información insuficiente; datos insuficientes; no hay suficiente*; no contiene; no menciona; no se menciona; me niego a; como modelo de lenguaje; fuera de mi",
    "pt": "não posso responder; não posso ajudar; não posso fornecer; não consigo responder; não é possível responder; não sei; não tenho informações; não há informações; não há dados; não há resposta; informações insuficientes; dados insuficientes; não contém; não menciona; não é mencionado; recuso-me; como modelo de linguagem",
    "it": "non posso rispondere; non posso aiutar*; non posso fornire; non riesco a rispondere; non è possibile rispondere; impossibile rispondere; non so; non ho informazioni; non ci sono informazioni; nessuna informazione; nessuna risposta; informazioni insufficienti; dati insufficienti; non contiene; non menziona; non è menzionato; mi rifiuto; come modello linguistico",
    "cs": "nemohu odpovědět; nemůžu odpovědět; nemohu pomoci; nemohu poskytnout; nelze odpovědět; nevím; neznám odpověď; nemám informace; nejsou informace; nedostatek informací; nedostatek údajů; není dost informací; neobsahuje odpověď; neobsahuje informace; není uvedeno; odmítám; jako jazykový model",
    "nl": "kan niet beantwoorden; kan deze vraag niet; kan niet helpen; kan u niet helpen; kan je niet helpen; niet mogelijk om; weet ik niet; weet het niet; geen informatie; geen antwoord; geen gegevens; onvoldoende informatie; niet genoeg informatie; bevat geen; niet vermeld; als taalmodel",
}
# fixed values: words after which a text must go on
_CONNECTORS = set(
    "у в на з із зі до від для по при про за під над між через після перед без щодо біля замість протягом і й та або чи але бо що який яка яке які якого якої щоб оскільки адже якщо коли де а також зокрема наприклад тобто не разом станом згідно відповідно "
    "и с из от об под между после или но что который которая чтобы поскольку если когда "
    "the a an of to for from in on at by with and or but that which so as near after before under within because if when plus such according including".split()
)
# fixed values: words of a date, which a quote need not have
_DATE_WORDS = "січня лютого березня квітня травня червня липня серпня вересня жовтня листопада грудня станом року january february march april june july august september october november december".split()
# fixed values: function words by language (articles, pronouns, prepositions, conjunctions, auxiliary verbs)
_FUNCTION = {
    "en": "the a an of to and or in on at by for with from into within under over before after between through about near as is are was were be been has have had do does did not don't doesn't isn't wasn't can't will would shall should may must can that which who whose this these those it its they their he she his her we our you your there if when than then so because but no any all each both such per plus",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber nicht kein keine ist sind war waren wird werden wurde wurden hat haben kann können muss müssen soll sollen darf für mit von vom zu zum zur im in am an auf aus bei nach vor über unter durch gegen ohne um bis seit gemäß sonst wenn weil dass als wie auch nur noch er sie es wir ihr sich sein seine ihre dieser diese dieses",
    "pl": "i oraz a ale lub albo że żeby jeżeli jeśli gdy ponieważ nie tak w we na z ze do od dla po przez przed pod nad przy za o u bez między podczas się jest są był była było były będzie być został została zostało zostały może muszą musi ten ta to te tego tej tym który która które których jego jej ich jako także więc niż",
    "fr": "le la les un une des du de d'un d'une et ou mais ne pas est sont était été être a ont avait que qui quoi dont où ce cet cette ces il elle ils elles on nous vous je au aux en dans sur sous par pour avec sans entre avant après chez vers si comme plus son sa ses leur leurs",
    "es": "el la los las un una unos unas de del y o pero no es son era fue ser está están ha han que quien cual donde cuando si en a al por para con sin sobre entre desde hasta antes después durante según como más se su sus este esta estos estas lo le les",
    "pt": "o a os as um uma de do da dos das e ou mas não é são era foi ser está tem têm que quem qual onde quando se em no na nos nas ao à por pelo pela para com sem sobre entre desde até antes depois durante como mais seu sua este esta",
    "it": "il lo la i gli le un uno una di del della dei delle e o ma non è sono era stato essere ha hanno che chi cui dove quando se in nel nella a al alla da dal dalla per con senza su sul sulla tra fra prima dopo durante come più si suo sua questo questa",
    "cs": "a i nebo ale že aby když protože ne v ve na z ze do od pro po přes před pod nad při za o u bez mezi během se si je jsou byl byla bylo byli bude být může musí ten ta to ty toho který která které jeho její jejich jako také než podle",
    "nl": "de het een en of maar niet geen is zijn was waren wordt worden heeft hebben kan moet mag voor met van in op aan uit bij naar over onder door zonder tot sinds als dat die dit deze wie wat waar er ook nog om te",
    "uk": "і й та або чи але а що щоб який яка яке які як якщо коли бо оскільки не ні у в на з із зі до від для про при по за під над між через після перед без є був була було були буде бути його її їх їхній цей ця це ці той та те свій також більш",
    "ru": "и или но а что чтобы который которая которое которые как если когда поскольку потому не ни в во на с со из до от для о об при по за под над между через после перед без есть был была было были будет быть его её их этот эта это эти тот та те свой также более",
}
_FUNCTION = {k: frozenset(v.split()) for k, v in _FUNCTION.items()}
# fixed values: letters beyond a to z of languages in Latin letters
_LETTERS = {"en": "", "de": "äöüß", "pl": "ąćęłńóśźż", "fr": "àâæçèéêëîïôœùûÿ", "es": "áéíñóúü", "pt": "àáâãçéêíóôõú", "it": "àèéìíòóù", "cs": "áčďéěíňóřšťúůýž", "nl": "éëïóöü"}
_TOKEN = re.compile(r"[^\W_]+(?:['’ʼ\-/][^\W_]+)*")
_CYR = re.compile(r"[Ѐ-ӿ]")
_LAT = re.compile(r"[A-Za-zÀ-ɏ]")
_RU, _UK = re.compile(r"[ыэёъ]"), re.compile(r"[іїєґ]")


def tokens(text: str) -> list[str]:
    return [w.lower().replace("’", "'").replace("ʼ", "'") for w in _TOKEN.findall(text)]


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def containment(a: list[str], b: list[str], size: int = SHINGLE) -> float:
    """Share of the shingles of ``a`` that ``b`` has."""
    size = min(size, len(a))
    if not size:
        return 0.0
    have = {tuple(b[i : i + size]) for i in range(len(b) - size + 1)}
    mine = [tuple(a[i : i + size]) for i in range(len(a) - size + 1)]
    return sum(s in have for s in mine) / len(mine)


def supported(answer: list[str], quote: list[str]) -> float:
    """Share of the answer's words that the quote has."""
    have = set(quote)
    return sum(w in have for w in answer) / len(answer) if answer else 0.0


def _is(word: str, form: str) -> bool:
    return word.startswith(form[:-1]) if form[-1] == "*" else word == form


def aligned(template: list[str], answer: list[str]) -> bool:
    """Whether the whole template is a subsequence of a stretch of the answer with at most ``GAP`` words more."""
    size = len(template) + GAP
    for i, w in enumerate(answer):
        if _is(w, template[0]):
            left = 1
            for x in answer[i + 1 : i + size]:
                if left < len(template) and _is(x, template[left]):
                    left += 1
            if left == len(template):
                return True
    return False


def is_refusal(answer: list[str], quote: list[str]) -> bool:
    """The answer holds a refusal template, and is neither taken from the quote nor, without one, long."""
    if supported(answer, quote) > SUPPORT or not quote and len(answer) > 40:
        return False
    found = set()
    for w in answer:
        found.update(_BY_FIRST.get(w[:2], ()))
    return any(aligned(_TEMPLATES[k], answer) for k in sorted(found))


def is_copy(question: list[str], answer: list[str]) -> bool:
    """The answer has the question's words, hardly others, in stretches of the question's order."""
    rest = [w for w in answer if w not in _FRAME or w in question]
    if len(rest) < 3 or not question:
        return False
    have, asked = Counter(rest), Counter(question)
    inside = sum(n for w, n in have.items() if w in asked)
    if inside < 0.9 * len(rest) or (have & asked).total() < COVERED * len(question):
        return False
    # rotated or repeated parts align within the question written twice
    return containment(rest, question + question) >= HELD - 0.15 or common_subsequence(rest, question + question) >= HELD * len(rest)


def language(text: str) -> str | None:
    """Language of a text by script and function words; None where they don't tell."""
    bare = re.sub(r"«[^»]*»|\"[^\"]*\"|“[^”]*”", " ", text)
    cyr, lat = len(_CYR.findall(bare)), len(_LAT.findall(bare))
    words = tokens(bare)
    if cyr >= lat:
        if cyr < 4:
            return None
        lower = " ".join(w for w in _TOKEN.findall(bare) if w.islower()) or bare.lower()
        ru, uk = len(_RU.findall(lower)), len(_UK.findall(lower))
        if ru != uk:
            return "ru" if ru > uk else "uk"
        hits = {k: sum(w in _FUNCTION[k] for w in words) for k in ("uk", "ru")}
        return max(hits, key=hits.get) if hits["uk"] != hits["ru"] else None
    marks = [c for c in bare.lower() if c > "\x7f" and c.isalpha()]
    points = {}
    for k, own in _LETTERS.items():
        points[k] = sum(w in _FUNCTION[k] for w in words) + sum(1 if c in own else -1 for c in marks)
    best = max(points, key=lambda k: (points[k], k == "en"))
    return best if points[best] > 0 else ("other" if marks else "en")


def is_other_language(question: str, answer: str) -> bool:
    a, q = language(answer), language(question)
    if a is None or q is None or a == q:
        return False
    if (a in ("uk", "ru")) == (q in ("uk", "ru")):
        # the same script: names alone don't tell, so some words are needed
        return len(tokens(answer)) >= 3
    letters = len(_CYR.findall(answer)) + len(_LAT.findall(answer))
    wrong = len((_LAT if q in ("uk", "ru") else _CYR).findall(answer))
    return wrong > 0.6 * letters and len(tokens(answer)) >= 3


def is_truncated(answer: str, quote: str | None) -> bool:
    """Breaks off: an open bracket, a mark or word that must go on, or the middle of a word of the quote."""
    text = answer.rstrip()
    if re.search(r"(?:…|\.\.\.|[,;:(\[{«„\-–—/])$", text) or re.search(r"[:;]\s*[^\W\d_]\)$", text):
        return True
    if text.count("(") > text.count(")") and not re.search(r"\d\)", text) or text.count("«") > text.count("»"):
        return True
    if text[-1:] in ".!?»”\")'":
        return False
    found = tokens(text)
    if not found:
        return False
    last = found[-1]
    if last in _CONNECTORS or (last.islower() and len(last) < 4 and last != "грн" and not re.search(r"[аеєиіїоуюяaeiouy\d]", last)):
        return True
    have = tokens(quote or "")
    if last in have or not have or last.isdigit():
        return False
    if last.islower() and any(w.startswith(last) and w != last for w in _DATE_WORDS):
        return True
    before = found[-2] if len(found) > 1 else None
    return any(w.startswith(last) and w != last and (i == 0 or before is None or have[i - 1] == before) for i, w in enumerate(have))


def defect_of(question: str | None, answer: str | None, quote: str | None) -> str | None:
    """Type of defect, or None. The first that applies: empty, refusal, copied_question, other_language, truncated."""
    found = tokens(answer or "")
    if not found or " ".join(found) in _BLANK:
        return "empty"
    if is_refusal(found, tokens(quote or "")):
        return "refusal"
    if question and is_copy(tokens(question), found):
        return "copied_question"
    if question and is_other_language(question, answer):
        return "other_language"
    if is_truncated(answer, quote):
        return "truncated"
    return None


_TEMPLATES = [x.split() for v in REFUSALS.values() for x in v.split("; ")]
_BY_FIRST: dict[str, list[int]] = {}
for _k, _t in enumerate(_TEMPLATES):
    _BY_FIRST.setdefault(_t[0][:2], []).append(_k)


def defective_pairs(df: DataFrame, key: str = "id", question: str = "question", answer: str = "reference_answer", quote: str = "quote") -> DataFrame:
    """``key, defect`` of every defective pair.

    Texts are compared in one form (full-width, look-alike and invisible characters unified). A null or blank
    answer is empty; without a question only empty, refusal and truncated are told; without a quote a cut
    inside a word isn't. Repeated rows come out repeatedly; other columns are dropped.
    """
    base = df.select(*[F.col(f"`{c}`").alias(n) for c, n in ((key, "k"), (question, "q"), (answer, "a"), (quote, "s"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, a, s = (unify_texts(b.column(i))[0].to_pylist() for i in (1, 2, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([defect_of(*x) for x in zip(q, a, s)], pa.string())], names=["k", "defect"])

    kind = base.schema["k"].dataType.simpleString()
    return base.mapInArrow(run, f"k {kind}, defect string").where("defect is not null").withColumnRenamed("k", key)
