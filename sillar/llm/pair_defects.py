"""Broken question-answer pairs.

Each answer directly after a question of its chat is judged: ``empty``,
``copied``, ``refusal``, ``language``, ``truncated``, or sound.

Plan
----
The turns are ordered as in :mod:`sillar.llm.conversations`. One Arrow pass over each
range partition pairs neighbours and judges them where they lie; the text is not
shuffled again. The first and the last row of each partition are handed on, two
per partition, and paired with the window function.

Judging, cheapest test first:

* *empty*: no letter or digit outside square brackets;
* *copied*: greedy string tiling of the answer with the question;
* *refusal*: a grammar of openings, cores and closings over accent-free text,
  with quotations taken out, counted only if the sources name an article;
* *language*: scripts, then function words, of question and answer with
  quotations taken out;
* *truncated*: a pushdown parser over fences, brackets and quotations, then the
  shape of the last line (list marker, table row, markup) and of its last words.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sillar.functions.roles import ASSISTANT, USER
from sillar.llm.conversations import in_order, turns
from sillar.llm.plaintext import is_blank, plain
from sillar.session import cut

EMPTY, TRUNCATED, REFUSAL, COPIED, LANGUAGE = "empty", "truncated", "refusal", "copied", "language"

# ---------------------------------------------------------------- plain text

_BRACKETED = re.compile(r"\[[^\[\]]*\]")
_QUOTED = re.compile(r"«[^«»]*»|“[^“”]*”|„[^„“”]*[“”]|\"[^\"]*\"|‘[^‘’\n]{3,}’")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_TRAIL = re.compile(r"[\s​-‏⁠﻿]+$")


def without_quotations(text: str) -> str:
    return _QUOTED.sub(" ", text)


# ---------------------------------------------------------------- copied

# Labels that may stand beside a question that is only said again.
LABELS = frozenset("pregunta respuesta preguntas preguntaste preguntaba me tu su la has preguntado quieres saber es usuario asistente question answer user assistant you asked your ask consulta pergunta resposta perguntou reponse demande q a p r".split())


class Runs:
    """A suffix automaton over the words of a pattern: the longest run that ends at each word of
    a text is found in one pass, whatever the lengths."""

    def __init__(self, pattern: list[str]):
        self.step: list[dict[str, int]] = [{}]
        self.link, self.length, self.first_end = [-1], [0], [-1]
        last = 0
        for at, word in enumerate(pattern):
            new = self._state(self.length[last] + 1, at)
            p = last
            while p >= 0 and word not in self.step[p]:
                self.step[p][word] = new
                p = self.link[p]
            if p < 0:
                self.link[new] = 0
            else:
                q = self.step[p][word]
                if self.length[q] == self.length[p] + 1:
                    self.link[new] = q
                else:
                    copy = self._state(self.length[p] + 1, self.first_end[q])
                    self.step[copy], self.link[copy] = dict(self.step[q]), self.link[q]
                    while p >= 0 and self.step[p].get(word) == q:
                        self.step[p][word] = copy
                        p = self.link[p]
                    self.link[q] = self.link[new] = copy
            last = new

    def _state(self, length: int, end: int) -> int:
        self.step.append({})
        self.link.append(0)
        self.length.append(length)
        self.first_end.append(end)
        return len(self.step) - 1

    def longest(self, text: list[str], least: int) -> list[tuple[int, int, int]]:
        """``(length, start in pattern, start in text)`` of the runs that cannot be made longer."""
        out, state, n = [], 0, 0
        before = (0, 0)
        for j, word in enumerate(text):
            while state and word not in self.step[state]:
                state = self.link[state]
                n = self.length[state]
            if word in self.step[state]:
                state, n = self.step[state][word], n + 1
            if j and n <= before[0] and before[0] >= least:
                out.append((before[0], self.first_end[before[1]] - before[0] + 1, j - before[0]))
            before = (n, state)
        if text and before[0] >= least:
            out.append((before[0], self.first_end[before[1]] - before[0] + 1, len(text) - before[0]))
        return out


def tiles(pattern: list[str], text: list[str], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: the longest common runs of words first, each position of
    ``text`` covered once. Unlike for plagiarism scores a stretch of ``pattern`` may
    cover several stretches of ``text``, so a question said twice is covered twice.
    Gives ``(start in pattern, start in text, length)``. One method at every length."""
    runs = Runs(pattern).longest(text, least)
    runs.sort(key=lambda r: (-r[0], r[2]))
    taken = bytearray(len(text))
    out = []
    for k, i, j in runs:
        at, end, shift = j, j + k, i - j
        while (at := taken.find(0, at, end)) >= 0:  # what longer tiles left of this run
            stop = taken.find(1, at, end)
            stop = end if stop < 0 else stop
            if stop - at >= least:
                taken[at:stop] = b"\1" * (stop - at)
                out.append((at + shift, at, stop - at))
            at = stop
    return out


@lru_cache(4096)
def _question_words(question: str) -> list[str]:
    return _WORD.findall(plain(question))


def only_repeats(question: str | None, answer: str) -> bool:
    """The answer's words are the question's, but for labels and bracketed references,
    and it says at least four fifths of the question."""
    if not question:
        return False
    q = _question_words(question)
    a = _WORD.findall(plain(_BRACKETED.sub(" ", answer)))
    if not q or len(a) < 0.8 * len(q):
        return False
    known, strange = set(q), 0
    for word in a:
        if word not in known:
            strange += 1
            if strange > 2:
                return False
    covered, said = bytearray(len(a)), bytearray(len(q))
    for i, j, k in tiles(q, a, min(2, len(q))):
        covered[j : j + k] = b"\1" * k
        said[i : i + k] = b"\1" * k
    rest = [w for w, c in zip(a, covered) if not c]
    return all(w in LABELS for w in rest) and sum(said) >= 0.8 * len(q)


# ---------------------------------------------------------------- language

# Function words and other frequent words, by language.
FUNCTION_WORDS = {
    "es": "el la los las un una unos unas del al de en y o que se su sus con por para como más pero fue es son está están hay no le lo les dos tres este esta ese esa desde hasta hacia entre según también cual cuales quien quién qué cuál cuándo dónde cómo cuántos aunque muy donde cuando tiene sobre ya sigue pese sin ni mi tu yo me te nos eso sur norte este oeste durante además parte dime háblame explícame cuéntame resume artículo favor antes después nada todos fueron puede años llegó nació cierto unos hizo sido cada todo",
    "pt": "o a os as um uma uns umas do da dos das no na nos nas de em e ou que se seu sua com por para como mais mas foi é são está não há ao aos à às pelo pela este esta isso desde até entre segundo também qual quem onde quando quantos embora muito tem sobre já depois antes num numa ele ela perto longe fica ficam construiu conte fale diga resuma artigo história cidade vila chama nasceu fundou chegou têm quais meu sempre ainda vez",
    "en": "the a an of in on at and or that this these those is are was were be been by with for from to as it its which who whom what when where how why not no has have had after before about up most most they he she his her their there than into along you your i can do does did me tell near far town city history article bridge built called born many much year years only also between over",
    "fr": "le la les un une des du de en et ou que qui se sa son ses avec pour par comme plus mais fut est sont était pas ne au aux ce cette ces dans sur depuis entre selon aussi où quand combien il elle ils elles après avant l d qu c n s y à été je vous nous près loin ville histoire parlez dites quel quelle toujours encore très bien fait",
    "it": "il lo la i gli le un una uno del della dello dei delle degli nel nella al alla di da in e o che si suo sua con per come più ma fu è sono non ha dal dalla questo questa tra secondo anche quando dove chi dopo prima ci ed aveva soprattutto vicino lontano città storia dimmi quale quali ancora sempre molto fatto",
    "de": "der die das den dem des ein eine einen einem einer und oder dass ist sind war waren wurde mit für von zu zum zur im am auf aus bei nach nicht kein keine es er sie ich wir wie was wer wo wann auch als noch sich über hat haben durch liegt nahe weit stadt geschichte welche welcher erzähl immer sehr nur",
    "ca": "els uns unes dels als seu seva amb més però és són hi aquest aquesta fins també què quan on tot molt dins ser seves seus altres nosaltres",
    "nl": "de het een van in op en of dat dit is zijn was waren met voor door naar niet geen er hij zij ik wij hoe wat wie waar wanneer ook als nog zich over heeft aan bij uit om te",
}
# The same of further languages. Words they share with those above count for them only.
FURTHER_WORDS = {
    "sv": "och att det som en på är av för med den till inte om ett han men var jag de har från vi så kan när också eller hon efter under mot mycket bara där här vid ligger blev",
    "da": "og at det som en på er af for med den til ikke om et han men var jeg de har fra vi så kan når også eller hun efter under mod meget kun hvor her ved blev ligger",
    "no": "og at det som en på er av for med den til ikke om et han men var jeg de har fra vi så kan når også eller hun etter under mot mye bare hvor her ved ble ligger",
    "fi": "ja on ei että se oli hän mutta kun myös joka ovat ole niin kuin tai sen mukaan sekä vain jos mitä tämä jälkeen vuonna ollut sitä",
    "is": "og að er í á það sem til við var ekki um með en hann hún af frá eru þar fyrir hefur voru einnig eftir",
    "pl": "i w na się nie z że do to jest o jak po co ale od za przez tak był była było oraz dla ma być są który która które tylko już jego jej przy leży",
    "cs": "a v na se je že s z do o i jako pro ale za to byl byla bylo od po který která které jsou není jeho také nebo jen už podle při leží",
    "hr": "i u na je se da su za od s ne koji koja koje što ali kao bio bila nije iz po ili grad nalazi",
    "sl": "in je na se da so za od s ne ki pa kot ali bil bila ni iz po tudi leži mesto",
    "ro": "și în de la cu pe nu este un o din care a fost pentru mai sunt se că ca sau ce dar după prin era au lui ei acest această între până orașul află",
    "hu": "a az és hogy nem is egy van volt meg de ezt mint csak már vagy kell még azt után között város",
    "tr": "ve bir bu da de için ile çok ne o gibi daha var olan olarak sonra kadar ama en her mi değil ise şehir yer alır",
    "eu": "eta da du ez bat zen ere izan dira baino dute edo zuen hau bere egin dago nola zer hiria urte",
    "gl": "unha unhas uns non máis tamén pero moi onde cando foi é á ao do da dos das súa seu cidade está ten",
    "id": "dan yang di ke dari ini itu dengan untuk pada adalah tidak dalam akan oleh juga atau ada sudah telah saya kota",
    "vi": "và là của có không được trong cho một những các người với này đã để khi từ cũng thành phố",
    "eo": "la de kaj en estas ne al por ke kiu per sed kun pri estis urbo ankaŭ",
    "et": "ja on ei et see oli ta ka kui oma aga mis või linn asub",
    "lt": "ir yra kad su iš į buvo bet tai kaip jis ji nuo per ne miestas",
    "lv": "un ir ka no ar uz bija bet tas kā par pilsēta arī",
    "la": "et est non ad cum ut sed qui quae quod ex ab aut enim atque sunt esse eius erat urbs",
}


def _weights() -> dict[str, list[tuple[str, float]]]:
    """What a word says for each language. A word of several counts little for each; what a further language shares
    weighs less there, but no less in the others."""
    first, further = {}, {}
    for lists, words in ((first, FUNCTION_WORDS), (further, FURTHER_WORDS)):
        for lang, text in words.items():
            for word in set(text.split()):
                lists.setdefault(word, []).append(lang)
    out = {}
    for word in first.keys() | further.keys():
        a, b = first.get(word, []), further.get(word, [])
        out[word] = [(lang, len(a) ** -1.5) for lang in a] + [(lang, (len(a) + 1 + 0.25 * (len(b) - 1)) ** -1.5) for lang in b]
    return out


_WEIGHTS = _weights()
# Letters that occur in one of the languages only, or nearly so.
LETTERS = {"es": "ñ¿¡", "pt": "ãõ", "fr": "êœëîû", "de": "ßä", "ca": "ŀ"}
_TELLING_LETTERS = re.compile("[" + "".join(LETTERS.values()) + "]")


_LETTERS_ONLY = re.compile(r"[^\W\d_]+")
_BEYOND_LATIN = re.compile("[\u0250-\U0010ffff]")


def script(text: str) -> str | None:
    """The script most letters are in, by the first word of their names."""
    beyond = "".join(c for c in _BEYOND_LATIN.findall(text) if c.isalpha())
    if not beyond:
        return "LATIN" if _LETTERS_ONLY.search(text) else None
    counts: Counter[str] = Counter()
    for c, n in Counter(text).items():
        if c.isalpha():
            counts["LATIN" if c < "ɐ" else unicodedata.name(c, "?").split(" ")[0].split("-")[0]] += n
    for kana in ("HIRAGANA", "KATAKANA"):
        if counts.get(kana):  # Japanese writes three scripts at once
            counts["JAPANESE"] += counts.pop(kana) + counts.pop("CJK", 0)
    return counts.most_common(1)[0][0] if counts else None


def language_scores(text: str) -> dict[str, float]:
    """Per language, the weight of its function words and letters."""
    scores = dict.fromkeys([*FUNCTION_WORDS, *FURTHER_WORDS], 0.0)
    low = text.lower()
    for word in _LETTERS_ONLY.findall(low):
        for lang, weight in _WEIGHTS.get(word, ()):
            scores[lang] += weight
    if telling := _TELLING_LETTERS.findall(low):
        for lang, letters in LETTERS.items():
            scores[lang] += 0.15 * min(3, sum(c in letters for c in telling))
    return scores


def language(text: str) -> str | None:
    """The language, or the script if it isn't Latin; None if it can't be told."""
    own = script(text)
    if own is None:
        return None
    if own != "LATIN":
        return own
    return _best(language_scores(text))


def _best(scores: dict[str, float]) -> str | None:
    """The language with the greatest score by a margin. Languages of the second list are
    near to each other (Danish, Norwegian), so the margin is to those of the first."""
    best, top, second = None, -1.0, -1.0
    for lang in FUNCTION_WORDS:
        if scores[lang] > top:
            best, top, second = lang, scores[lang], top
        elif scores[lang] > second:
            second = scores[lang]
    far = max(FURTHER_WORDS, key=scores.__getitem__)
    most = scores[far]
    if most >= 1.0 and most >= 1.25 * top + 0.1:
        return far
    return None if top < 0.6 or top < 1.25 * second + 0.1 else best


@lru_cache(4096)
def _asked(question: str) -> tuple[str | None, dict[str, float]]:
    bare = without_quotations(question)
    return script(bare), language_scores(bare)


def other_language(question: str | None, answer: str) -> bool:
    """The answer is surely in a language that the question surely isn't in: a question
    is short, so it may pass for any language that scores near its best."""
    said = _BRACKETED.sub(" ", without_quotations(answer))
    (q, scores), a = _asked(question or ""), script(said)
    if q is None or a is None:
        return False
    if q != "LATIN" or a != "LATIN":
        return q != a
    answered = language_scores(said)
    own = _best(answered)
    if own is None:
        return False
    top = max(scores[x] for x in FUNCTION_WORDS)
    far = {x for x in FURTHER_WORDS if scores[x] >= 1.25 * top + 0.1}
    if (top < 0.3 and not far) or answered[own] < 1.0:
        return False
    near = {x for x in FUNCTION_WORDS if scores[x] >= 0.7 * max(top, *(scores[x] for x in far))} if far else {x for x in FUNCTION_WORDS if scores[x] >= 0.7 * top}
    return all(answered[x] < 0.6 * answered[own] for x in near | far)


# ---------------------------------------------------------------- refusal

# The grammar of a refusal, over text without accents, quotations and
# bracketed references. A refusal is any number of openings, one core, and then
# nothing but closings.
OPENINGS = [
    r"lo siento( mucho)?", r"lo lamento", r"lamento (?!no )\w+( \w+){0,5}", r"lamentablemente", r"desafortunadamente", r"por desgracia", r"disculp[ae]n?( las molestias)?", r"perdon[ae]?", r"mil perdones", r"uf+", r"ay", r"vaya", r"bueno", r"gracias por (tu|su|la) (pregunta|consulta|interes)",
    r"como (un |una )?(asistente|modelo|ia|bot|inteligencia)( de| virtual| artificial| lenguaje| ia)*", r"pero", r"aunque", r"me temo que", r"sintiendolo mucho", r"en este (caso|momento)", r"de momento", r"por ahora", r"hoy por hoy", r"la verdad( es que)?", r"entiendo (tu|su|la) (pregunta|consulta)",
    r"i'?m (very |so |really )?sorry", r"i am (very |so )?sorry", r"sorry", r"unfortunately", r"i apologi[sz]e", r"as an? (ai|assistant|language model)( \w+){0,3}", r"but", r"i'?m afraid( that)?", r"thank you for (your|the) question", r"thanks for asking",
    r"(te|le|os|les) pido (disculpas|perdon)", r"con (todo )?(el )?(debido )?respeto", r"sinceramente", r"francamente", r"my apologies", r"apologies", r"regrettably", r"honestly", r"with (all )?(due )?respect",
    r"ho sento( molt)?", r"em sap greu", r"malauradament", r"s[ei]ntoo?( moito)?", r"desafortunadamente", r"por desgraza", r"het spijt me", r"spijtig genoeg", r"helaas", r"tyvarr", r"jag ar ledsen", r"forlat( mig)?", r"desv(ae|æ)rre", r"dessverre", r"beklager", r"undskyld",
    r"niestety", r"przepraszam", r"przykro mi", r"bohuzel", r"omlouvam se", r"je mi lito", r"imi pare rau", r"din pacate", r"ne pare rau", r"maalesef", r"uzgunum", r"ozur dilerim", r"ne yaz[iı]k ki", r"barkatu", r"sentitzen dut", r"zoritxarrez", r"valitettavasti", r"pahoittelen", r"sajnos", r"sajnalom", r"maaf", r"sayangnya", r"к сожалению", r"извините", r"простите", r"жаль",
    r"desculp[ae]", r"lamento", r"infelizmente", r"mas", r"sinto muito", r"desole[e]?", r"je suis desolee?", r"malheureusement", r"mais", r"pardon", r"mi dispiace", r"purtroppo", r"ma", r"leider", r"es tut mir leid",
]
CORES = [
    # Spanish: what the speaker cannot, will not or does not know
    r"no (me |te |le |lo |la |os |les )?(puedo|podria|podre|pude|podemos|podriamos|quiero|querria|deseo|debo|deberia|sabria|se (?:que|como|cuando|cuantos?|donde|quien|cual|nada|responder|contestar|la respuesta|decirte)|sabemos|consigo|logro|alcanzo a|voy a|vamos a|acierto a)\b",
    r"no (me |nos )?(es|sera|seria|resulta|fue|ha sido) (posible|permitido|facil|viable)",
    r"no (me |nos )(esta|es) (permitid[oa]|dado|autorizad[oa])", r"no (me|nos) (corresponde|compete|permiten|consta)", r"(no estoy|no estamos) (autorizad\w+|en condiciones|en disposicion|capacitad\w+|segur\w+|facultad\w+|al tanto)",
    r"(me|nos) (es|sera|seria|resulta) (imposible|dificil)", r"(me|nos) (temo|tememos) que", r"prefiero (no|callar|abstenerme|guardar silencio|omitir|declinar)", r"preferiria no", r"me abstengo", r"declino", r"rehuso", r"me niego",
    r"(no )?(tengo|tenemos|dispongo|disponemos|cuento|contamos|poseo) (con |de )?(ningun\w* |suficientes? |mas )?(dat\w+|informacion\w*|elemento\w*|referencia\w*|fuente\w*|detalle\w*|articulo\w*|texto\w*|registro\w*|respuesta\w*|conocimiento\w*|noticia\w*|constancia|documento\w*|acceso|idea|pista\w*|contexto|material\w*|forma|manera|modo|nada)",
    r"(carezco|carecemos) de", r"(me|nos) faltan?", r"desconozco", r"desconocemos", r"ignoro\b", r"(no|ni) (encontre|encuentro|encontramos|he encontrado|hemos encontrado|hallo|halle|he hallado|veo|vi|he visto|localizo|localice|hay|existe|existen|aparece|aparecen|consta|constan|figura|figuran|se menciona|se encuentra|se encontro|se indica|se dice|se especifica|se sabe) ",
    r"sin (informacion|datos|referencias|noticias|detalles|elementos|resultados)", r"(los|las|mis) (articulos|textos|fuentes|fragmentos|documentos|paginas)( que \w+)?( consultad[oa]s| disponibles| proporcionad[oa]s| a mi alcance)? no (me |nos )?(dicen|mencionan|contienen|incluyen|hablan|indican|aclaran|recogen|tratan|permiten|traen|bastan|explican|ofrecen)",
    r"(ningun[oa]?|nada) (de |en )?(los|las|mis|el|la)? ?(articulo\w*|texto\w*|fuente\w*|fragmento\w*|documento\w*|pagina\w*)", r"(ese|este|el|esa|esta|la|tal) (dato|informacion|tema|asunto|pregunta|consulta|cuestion|detalle) (no|queda fuera|escapa|excede|sobrepasa)", r"(eso|esto) (no (figura|consta|aparece|esta|lo)|queda fuera|escapa|excede)",
    r"(tendrias|tendria|deberias|deberia|habria|habras) (que |de )?(consultar|buscar|acudir|preguntar|mirar)", r"aqui no (se|hay|figura|aparece|consta|tengo|encuentro)", r"en (la|esta|los|mis|estos) (wiki|copia|copia local|enciclopedia|textos|articulos|fuentes|base)( \w+){0,2} no (hay|se|figura|aparece|consta|encuentro|encontre|tengo)", r"(queda|esta|cae) fuera de (mi|mis|nuestro)", r"(supera|excede|escapa a) (mi|mis)",
    r"la (wiki|enciclopedia|copia|base)( \w+){0,2} no (contiene|incluye|menciona|dice|tiene|recoge|trae|habla)",
    r"me veo (obligad[oa]|forzad[oa]|en la (obligacion|necesidad)) (a |de )?(no |declinar|rechazar|abstenerme|callar)", r"(tengo que|debo|he de|voy a|quiero|prefiero) (no |declinar|rechazar|abstenerme|callar|omitir|evitar)", r"(yo )?paso( palabra)?$", r"paso de (responder|contestar|opinar|hablar|esta|esa|esto|eso|la pregunta)", r"sin comentarios?$", r"(eso|esto|lo) (ignoro|desconozco)", r"lo (ignoro|desconozco)", r"ni idea", r"mejor (no|lo dejamos|callo)", r"me reservo", r"rechazo (responder|contestar|la|esta|esa|dar)", r"imposible (responder|contestar|saber|decir|ayudar|dar|precisar)",
    r"no (te lo |se lo |os lo |te |le |os |les |lo |la )?(respond|contest|di|ayud|d|facilit|revel|habl|opin|entr|coment|aclar|entrar|contar|explicar)[aei]?re(mos)?\b", r"(sobre|acerca de|de) (eso|esto|ell[oa]|(ese|este|esa|esta|tal) \w+) (no|nada|prefiero|mejor)", r"nada (puedo|podemos|se|tengo|consta|hay) ", r"(lamento|siento) (mucho )?no (poder|tener|saber|disponer|haber)", r"no (tengo|tenemos) (permitido|permiso|autorizacion)", r"no (soy|somos) quien(es)? para", r"no (esta|queda|entra) (en|a|dentro de) (mi|mis|nuestr[oa]s?) ", r"no hay (forma|manera|modo) (de|en que) (yo )?(saber|responder|contestar|ayudar|decir)", r"(quisiera|querria|me gustaria|ojala)( \w+){0,6} no (puedo|es posible|se)", r"no (procede|ha lugar) (responder|contestar|que)", r"(es|esa|esta) (una )?(pregunta|cuestion|consulta|informacion) (es )?(que |la que )?(no|excede|escapa|confidencial|reservada)",
    # English
    r"i('?d| would) (rather|prefer) not", r"i('?d| would) (prefer|like) to (pass|abstain|skip)", r"i (refuse|must refuse|will pass|abstain|won'?t be|must (politely )?(decline|refuse|abstain))", r"i'?ll (pass|have to (pass|decline))", r"(no comment|pass|no idea|not sure)$", r"(it|that|this) (is|was)(n'?t| not) (possible|something i|available|covered|mentioned)", r"(that|this|it)('s| is) (not )?(something i|outside|beyond|confidential)", r"not (something|able|in a position)", r"we (cannot|can'?t|are unable|do not|don'?t|have no)", r"i('?m| am) (not |un)(sure|certain|aware|authori[sz]ed|able)", r"i never", r"nothing (in|is|was) ",
    r"i (do not|don'?t|cannot|can'?t|can not|could not|couldn'?t|am unable|'?m unable|am not able|'?m not able|won'?t|will not|would rather not|prefer not|have no|lack|found no|did not find|didn'?t find|am not allowed|'?m not allowed|am not permitted|must decline|have to decline|decline)", r"(there is|there'?s) no (information|data|mention|record)", r"no (information|data) (is |was |about |on |could )", r"(the|these|my) (articles|texts|sources|documents)( \w+){0,3} (do not|don'?t|does not)", r"(that|this) is (beyond|outside)", r"unable to",
    # Portuguese, French, Italian, German
    r"nao (posso|consigo|sei|quero|tenho|temos|disponho|encontrei|encontro|ha (informac|dados|nada)|me e|estou|devo|poderia|saberia)", r"(desconheco|careco de)", r"(os|as) (artigos|textos|fontes)( \w+){0,3} nao", r"(esse|este) dado nao",
    r"je (ne|n')", r"je n", r"(il n'?y a|aucune?) (pas |aucune |d')?(information|donnee|mention)", r"les (articles|textes|sources)( \w+){0,3} ne",
    r"non (posso|so|ho trovato|dispongo|ho (informazioni|dati)|sono in grado|e possibile|ci sono informazioni)", r"ich (kann|weiss|weiß|habe|darf|mochte|will|werde|bin) (\w+ ){0,6}(nicht|keine)", r"(dazu|daruber|hierzu|das) (kann|weiss|weiß|habe|darf|mochte|liegen|gibt) (\w+ ){0,5}(nicht|keine)", r"(es (gibt|liegen)( \w+){0,3} )?keine (angabe|information|daten|ahnung|auskunft)",
    r"(prefiro|preferia) nao", r"(recuso|nego|abstenho|escuso)-?me", r"sem (informac|dados|resposta|comentarios)", r"nao (vou|irei|iremos|podemos|poderei|pude|ha como|me cabe|e possivel|foi possivel|faco ideia)", r"(essa|esta|a) informacao nao",
    r"je (prefere|prefererais|refuse|regrette|decline|dois (refuser|decliner))", r"(il|cela|ce) (m'?est|n'?est pas|ne m'?est pas) (im)?possible", r"impossible de (repondre|dire|vous|le)", r"aucune (idee|information|donnee|reponse)", r"nous (ne|n')",
    r"(preferisco|preferirei) (non|astenermi)", r"(mi rifiuto|mi astengo|rifiuto|declino)", r"non (riesco|trovo|conosco|intendo|voglio|mi e possibile|ci sono dati|abbiamo|possiamo|saprei)", r"nessuna (informazione|idea)", r"(mi dispiace|purtroppo) non",
    # further languages
    r"no (puc|podem|sabria|tinc|tenim|disposo|trobo|vull|em consta|hi ha (informacio|dades))", r"(prefereixo|m'estimo mes) no", r"non (podo|sei|teno|dispono|atopo|quero|hai (informacion|datos))",
    r"ik (kan|weet|heb|mag|wil|ben|zal) (\w+ ){0,6}(niet|geen)", r"(daar|hier)(over)? (kan|weet|heb|mag|wil) (\w+ ){0,4}(niet|geen)", r"geen (idee|informatie|gegevens|commentaar)",
    r"jag (kan|vet|har|far|vill|avstar|hittar) (\w+ ){0,5}(inte|ingen|inga|fran)", r"(det|ingen) (kan jag inte|information|uppgift)", r"(jeg|eg) (kan|ved|vet|har|ma|vil|finder|finner) (\w+ ){0,5}(ikke|ingen|intet)", r"(det kan jeg ikke|ingen (information|informasjon|oplysninger|opplysninger))",
    r"(kan|vet|har|vill|far|ved|vil|kann|weiss|weiß|habe|darf|mochte|weet|heb|mag) (jag|jeg|eg|ich|ik) (\w+ ){0,6}(inte|ikke|ingen|inga|nicht|keine|niet|geen)",
    r"nie (moge|mozemy|wiem|mam|mamy|znam|potrafie|chce|zamierzam|jestem w stanie|odpowiem|znalaz)", r"(odmawiam|wole nie|brak (informacji|danych|odpowiedzi))", r"(nemohu|nemuzu|nevim|nemam|nechci|nelze|neznam|odmitam|zadne informace)", r"(ne mogu|ne znam|nemam|nazalost)", r"nu (pot|putem|stiu|am|avem|dispun|gasesc|doresc|cunosc|vreau)", r"(prefer sa nu|refuz sa|nicio informatie)",
    r"ezin (dut|dizut|da)", r"ez (dakit|daukat|dut|dago)", r"en (voi|tieda|osaa|halua|loytanyt|pysty)", r"nem (tudok|tudom|talal\w+|all modomban|kivanok|valaszol\w*)", r"(saya )?tidak (bisa|dapat|tahu|memiliki|menemukan|ada informasi)", r"(я |мы )?не (могу|можем|знаю|имею|располагаю|наш\w+|буду|хочу|в состоянии)", r"(у меня )?нет (информации|данных|сведении|ответа)", r"(отказываюсь|затрудняюсь)",
]
CLOSINGS = [
    r"(prueba|intenta|pruebe|intente|trata|trate|te (sugiero|recomiendo|aconsejo|invito)|le (sugiero|recomiendo)|quizas?|tal vez|puedes|puede|podrias|podria|consulta|consulte|busca|reformula|si (quieres|lo deseas|necesitas|te parece))\b.*", r"(puedo|podria|quieres|quiere|deseas|necesitas|hay (algo|otra)|en que|te) .*", r"(asi que|por lo que|por eso|de modo que|por tanto|por lo tanto) .*", r"(gracias|saludos|disculp|lo siento|perdon).*",
    r"(pregunta|preguntame|preguntaselo|acude|acuda|mejor|ojala|espero|estare|cualquier|con gusto|para (eso|ello|mas)|otra (cosa|pregunta)|pide|revisa|visita|mira|dime|es (mejor|confidencial|informacion)|no (insistas|insista)|comprende|entiendelo)\b.*",
    r"(please|try|you (can|could|may|might)|can i|could i|may i|is there|let me know|so|therefore|perhaps|maybe)\b.*", r"(tente|posso|pode|quer|talvez|por isso)\b.*", r"(essayez|puis-?je|vous pouvez|peut-etre|donc)\b.*", r"(prova|posso|puoi)\b.*",
]
_OPENING = re.compile(r"(?:" + "|".join(OPENINGS) + r")(?=$|[\s,.;:!…])[\s,.;:!…]*")
_CORE = re.compile(r"(?:" + "|".join(CORES) + r")")
_CLOSING = re.compile(r"(?:" + "|".join(CLOSINGS) + r")$", re.S)
_HAVE = re.compile(r"(tengo|tenemos|dispongo|disponemos|cuento|contamos|poseo) (?!que )")
_KNOW = re.compile(r"\bs[éÉ]\b", re.I)
_SENTENCE = re.compile(r"[.!?…]+(?:\s+|$)|\n+|[¡¿]")
# Last words of refusals in languages where the verb stands at the end.
LAST_WORDS = ("bilmiyorum", "veremem", "veremiyorum", "yanıtlayamam", "yanıtlayamıyorum", "bulamadım", "cevaplayamam", "cevaplayamıyorum")
# Cores that speak of the world unless the rest of the sentence speaks of
# the question, the texts or the speaker.
IMPERSONAL = re.compile(r"(?:no|ni) (hay|existe|existen|aparece|aparecen|consta|constan|figura|figuran|se menciona|se encuentra|se encontro|se indica|se dice|se especifica|se sabe) |sin (informacion|datos|referencias|noticias|detalles|elementos|resultados)|ningun[oa]? |nada (?!puedo|podemos|tengo )")
ABOUT_TEXTS = re.compile(r"informacion|\bdat[oa]s?\b|referencia|fuente|articulos?\b|textos?\b|\bwiki\b|copia local|enciclopedia|detalle|elemento|respuesta|preguntas?\b|\beso\b|consulta|registro")


def declines(text: str) -> bool:
    """The whole text is a refusal by the grammar."""
    bare = plain(_KNOW.sub("sabemos", _BRACKETED.sub(" ", text)))  # "sé" is not "se"
    if "«" in bare or '"' in bare or "“" in bare:
        bare = plain(without_quotations(bare))
        if not re.match(r"\W*" + _OPENING.pattern + r"|\W*(?:" + "|".join(CORES[:4]) + ")", bare):
            return False
    parts = [s for s in (re.sub(r"^[\W_]+|[\s\W_]+$", "", x) for x in _SENTENCE.split(bare)) if s]
    if not parts:
        return False
    found = False
    for part in parts:
        rest, before = part, None
        while before != rest:  # openings, one after another
            before = rest
            m = _OPENING.match(rest)
            if m:
                rest = rest[m.end() :].lstrip(" ,.;:!…")
        if not rest:
            found = found or bool(re.match(r"me temo", part))
            continue
        m = _CORE.match(rest)
        if m and _HAVE.match(rest):
            m = None  # the verb without "no"
        if m and IMPERSONAL.match(rest) and not ABOUT_TEXTS.search(rest):
            m = None
        if m or rest.endswith(LAST_WORDS):
            found = True
        elif not (found and _CLOSING.match(rest)):
            return False
    return found


_TITLE = re.compile(r'"title"\s*:\s*"\s*[^"\s]')


def names_article(sources: str | None) -> bool:
    """The JSON list, whole or cut off, names at least one article."""
    return bool(sources and _TITLE.search(sources))


# ---------------------------------------------------------------- truncated

# Words no sentence ends with.
DANGLING = frozenset(
    """el la los las un una unos unas de del al en y u ni que su sus con por para como más muy pero aunque según sin sobre
    entre desde hasta hacia ante mediante cuando donde cuyo cuya cuyos cuyas lo le les mi si porque pues mientras se a e o
    estos estas aquel cada ha han había muestra es dos tres son esta ese esa
    the an of to and or that which with for from as is are was were be its their than into if but because
    os as um uma do da das no na nas em ao aos à às pelo pela com seu mas
    des du et ou dans avec pour par ce cette ces ses sont qui
    il gli uno della dello dei delle degli nel nella alla di che
    der die das den dem ein eine und oder mit für von zu im""".split()
)

_PAIRS = {"(": ")", "[": "]", "{": "}", "«": "»", "“": "”", "„": "“"}
_OPENERS = {")": ("(",), "]": ("[",), "}": ("{",), "»": ("«",), "”": ("“", "„"), "“": ("„",)}
_LIST_MARK = re.compile(r"^\s*(?:[-*•+–·]|\d{1,3}[.)]|[a-z][.)])(?:\s+|$)")
_BARE_MARK = re.compile(r"^\s*(?:[-*•+–·]|\d{1,3}[.)]?|[a-z][.)])\s*$")
_MEASURE = re.compile(r":\s*[\w.,\s-]*\d[\d.,]*\s*(?:[^\W\d_]{1,4}[²³]?|%|°C?|€|\$)?$")
_STOPS = ".!?。！？؟।"
_CLOSING_MARKS = "»”’\"')]}*_`> "


_MARK = re.compile(r"(?m:^)(?:```|~~~)|[()\[\]{}«»“”„\"]")


def open_at_end(text: str) -> list[tuple[str, int]]:
    """Pushdown parser: the fences, brackets and quotations still open at the end, with
    where they opened. Closers without an opener (as in ``a)``) are passed over; a
    closer ends what was opened inside its pair."""
    stack: list[tuple[str, int]] = []
    count: Counter[str] = Counter()  # how many of each are open

    def close(openers: tuple[str, ...]) -> None:
        while True:
            s, _ = stack.pop()
            count[s] -= 1
            if s in openers:
                return

    for m in _MARK.finditer(text):
        c, i = m.group(), m.start()
        if len(c) == 3:
            if stack and stack[-1][0] == c:
                close((c,))
            elif not (stack and len(stack[-1][0]) == 3):
                stack.append((c, i))
                count[c] += 1
        elif stack and len(stack[-1][0]) == 3:
            continue
        elif c == '"' and count[c]:
            close((c,))
        elif any(count[o] for o in _OPENERS.get(c, ())):
            close(_OPENERS[c])
        elif c in _PAIRS or c == '"':
            stack.append((c, i))
            count[c] += 1
    return stack


def unfinished(text: str) -> bool:
    """The text breaks off before its last sentence or list item is finished."""
    text = _TRAIL.sub("", text)
    if not text:
        return False
    ends_well = text.rstrip(_CLOSING_MARKS)[-1:] in _STOPS and not text.endswith(("...", "…"))
    for opener, at in open_at_end(text):
        if opener in ("```", "~~~") or not ends_well or len(text) - at < 12:
            return True
    last = text.rsplit("\n", 1)[-1].strip()
    if _BARE_MARK.match(last) and "\n" in text:
        return True
    if re.search(r"<[a-zA-Z/][^<>]*$", text) or (last.startswith("|") and not last.endswith("|")) or text.count("**") % 2:
        return True
    item = _LIST_MARK.match(last)
    body = last[item.end() :] if item else last
    shown = body.rstrip(_CLOSING_MARKS)
    if shown.endswith(("...", "…")):
        return True
    if shown[-1:] in _STOPS and shown:
        return False
    if body[-1:] in ",;:–—-/«“([{" or shown[-1:] in ",;:–—/":
        return True
    outer = body
    while outer.endswith((")", "]")):  # what stands before closing references
        cutoff = max(outer.rfind("("), outer.rfind("["))
        if cutoff <= 0:
            break
        outer = outer[:cutoff].rstrip()
    words = _WORD.findall(outer)
    if words and words[-1].lower() in DANGLING and not words[-1].isupper():
        return True
    if item or len(outer) < len(body) or body[-1:] in "»”\"":
        return False
    if _MEASURE.search(body):
        return False
    whole = re.search(r"[.!?…]\s", body) is not None
    return whole or len(words) > 6 or "," in body or "\n" in text


# ---------------------------------------------------------------- the judgement


def defect(question: str | None, answer: str | None, sources: str | None) -> str | None:
    """The one defect of an answer, or None. A null question has no words and no language."""
    if is_blank(answer):
        return EMPTY
    if only_repeats(question, answer):
        return COPIED
    if declines(answer):
        return REFUSAL if names_article(sources) else None
    if unfinished(answer):
        return TRUNCATED
    if other_language(question, answer):
        return LANGUAGE
    return None


PAIR_SCHEMA = "chat_id string, question_id long, message_id long, defect string, question string, answer string, sources string, edge int, who int, ts long, judged boolean"


def _pair_pass(keep_text: bool):
    fields = ["chat_id", "ts", "message_id", "who", "content", "sources"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()]
        names = [f.split(" ")[0] for f in PAIR_SCHEMA.split(", ")]
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def edge(row: tuple, which: int) -> tuple:
        chat, ts, mid, who, content, sources = row
        return (chat, None, mid, None, None, content, sources, which, who, ts, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, first = None, True
        for b in batches:
            out = []
            for row in zip(*(b.column(f).to_pylist() for f in fields)):
                if first:
                    out.append(edge(row, 1))
                    first = False
                elif before[0] == row[0] and before[3] == USER and row[3] == ASSISTANT:
                    q, a, s = before[4], row[4], row[5]
                    texts = (q, a, s) if keep_text else (None, None, None)
                    out.append((row[0], before[2], row[2], defect(q, a, s), *texts, 0, row[3], row[1], True))
                before = row
            if out:
                yield batch(out)
        if before is not None:
            yield batch([edge(before, 2)])

    return run


def _judge_edges(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [b.column(name) for name in ("question", "answer", "sources")]
            found = pa.array([defect(q, a, s) for q, a, s in zip(*(c.to_pylist() for c in texts))], pa.string())
            shown = texts if keep_text else [pa.nulls(b.num_rows, pa.string())] * 3
            ids = [b.column(name) for name in ("chat_id", "question_id", "message_id")]
            yield pa.RecordBatch.from_arrays([*ids, found, *shown], names=["chat_id", "question_id", "message_id", "defect", "question", "answer", "sources"])

    return run


def judged_pairs(messages: DataFrame, keep_text: bool = True) -> DataFrame:
    """``(chat_id, question_id, message_id, defect[, question, answer, sources])``: one row
    per pair of a user message and the assistant message directly after it, with the
    kind of defect or null.

    Order and merging are those of ``dropped_chats``; notes, messages without readable
    role and messages without time are left out first. Broken chats count too. Null
    content is an empty question or answer. An empty table gives no rows.
    """
    rows = turns(messages, texts=True).filter(F.col("who").isin(USER, ASSISTANT) & F.col("ts").isNotNull())
    passed = cut(in_order(rows).mapInArrow(_pair_pass(keep_text), PAIR_SCHEMA))
    inside = passed.filter("judged")
    # a partition of one row gives the same row as its first and its last
    ends = passed.filter("not judged")
    ends = ends.groupBy("chat_id", "ts", "message_id", "who").agg(F.max((F.col("edge") == 1).cast("int")).alias("is_first"), F.max((F.col("edge") == 2).cast("int")).alias("is_last"), F.first("answer").alias("answer"), F.first("sources").alias("sources"))
    w = Window.partitionBy("chat_id").orderBy("ts", "message_id")
    seam = ends.select("*", F.lag("who").over(w).alias("who0"), F.lag("is_last").over(w).alias("last0"), F.lag("message_id").over(w).alias("question_id"), F.lag("answer").over(w).alias("question"))
    seam = seam.filter((F.col("who") == ASSISTANT) & (F.col("who0") == USER) & (F.col("is_first") == 1) & (F.col("last0") == 1))
    seam = seam.select("chat_id", "question_id", "message_id", F.lit(None).cast("string").alias("defect"), "question", "answer", "sources").mapInArrow(_judge_edges(keep_text), "chat_id string, question_id long, message_id long, defect string, question string, answer string, sources string")
    columns = ["chat_id", "question_id", "message_id", "defect", *(["question", "answer", "sources"] if keep_text else [])]
    return inside.select(*columns).unionByName(seam.select(*columns))


def defective_answers(messages: DataFrame) -> DataFrame:
    """``(message_id, defect)`` of the defective answers."""
    return judged_pairs(messages, keep_text=False).filter(F.col("defect").isNotNull()).select("message_id", "defect")
