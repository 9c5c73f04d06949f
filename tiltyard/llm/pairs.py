"""Broken prompt and response pairs: empty answers, copies of the question, refusals, other languages, truncated answers."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltyard.llm import endings
from tiltyard.session import cut, distinct_by

#: What tables and programs write where there is no value; letters only, lower case.
NULL_WORDS = frozenset("na none null nil nan undefined empty blank tbd todo unknown noanswer noresponse".split())
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|&nbsp;")


def is_empty(answer: str | None) -> bool:
    """No content: null, blank, invisible characters, empty markup, marks without a letter or digit, or a null word alone."""
    a = answer or ""
    if len(a) > 200 and "<" not in a and "&" not in a:
        return not _WORD.search(a)
    bare = re.sub(r"[\W_]+", "", _TAG.sub("", a)).lower()
    return not bare or bare in NULL_WORDS


_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def tiles(a: list[str], b: list[str], least: int = 2) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in a, start in b, length) of the longest common runs, longest first, each token of a used once.

    Tokens of b may be used again, so that an answer which repeats the question twice is covered twice.
    """
    used, out = [False] * len(a), []
    at: dict[str, list[int]] = {}
    for j, t in enumerate(b):
        at.setdefault(t, []).append(j)
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            if used[i] or len(a) - i <= best[2]:
                continue
            for j in at.get(a[i], ()):
                n = 0
                while i + n < len(a) and j + n < len(b) and not used[i + n] and a[i + n] == b[j + n]:
                    n += 1
                if n > best[2]:
                    best = (i, j, n)
        if best[2] < least:
            return out
        out.append(best)
        used[best[0] : best[0] + best[2]] = [True] * best[2]


def is_copy(question: str | None, answer: str, extra: int = 4) -> bool:
    """The answer only gives back the question: its words are tiled by runs of the question but for a few framing words.

    A part of the question counts where it starts like the question or covers half of it. Answers of any length are tiled, unless
    more words than the framing allows stand nowhere in the question: those no tile can cover.
    """
    q, a = _WORD.findall((question or "").lower()), _WORD.findall(answer.lower())
    if not q or not a:
        return False
    known, foreign = set(q), 0
    for w in a:
        if w not in known:
            foreign += 1
            if foreign > extra:
                return False
    t = tiles(a, q)
    covered = sum(n for _, _, n in t)
    rest = len(a) - covered
    if rest > extra or covered < 3:
        return False
    whole = max((n for _, _, n in t), default=0) / len(q)
    if rest:
        return whole >= 0.8
    return whole >= 0.5 or any(i == 0 and j == 0 and n >= 3 for i, j, n in t)


#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": """the a an of to and in is are was were be been with for on at by from that this these those it its as or not but if when which what who how why where can will may must should
        before after until then than into your you do does has have had only once""",
    "fr": """le la les un une des du de et en est sont était être avec pour sur dans par que qui ce cette ces il elle ne pas au aux se son sa ses ou mais si quand comment pourquoi combien quel quelle
        avant après jusqu puis être doit peut lorsque depuis je vous nous""",
    "de": """der die das den dem des ein eine einen einem einer und in ist sind war mit für auf an bei von zu zum zur im am nicht auch oder aber wenn wie warum wo was welche welcher welches kann muss soll
        bevor nach bis dann als sie er es ich wird werden sobald""",
    "es": """el la los las un una unos unas de del y en es son era con para por sobre que qué quién cómo cuándo dónde este esta estos estas no se su sus al o pero si cuando cuál cuántas cuántos puede debe
        antes después hasta luego como yo usted lo""",
    "it": """il lo la i gli le un uno una di del della dei delle e in è sono era con per su che chi come quando dove questo questa non si suo sua al alla o ma se quale può deve prima dopo fino poi
        dal dalla essere viene""",
    "nl": """de het een van en in is zijn was met voor op aan bij door dat die dit deze niet ook of maar als hoe waarom waar wat welke kan moet zal voordat na tot dan ze hij ik wordt worden zodra
        te naar om""",
    "pt": """o a os as um uma uns umas de do da dos das e em no na nos nas é são era com para por sobre que quem como quando onde este esta não se seu sua ao à ou mas qual pode deve antes depois até""",
    "sv": """den det en ett av och i är var med för på vid från att som detta dessa inte också eller men om när hur varför var vad vilken kan måste ska innan efter till sedan""",
    "da": """den det en et af og i er var med for på ved fra at som dette disse ikke også eller men hvis når hvordan hvorfor hvor hvad hvilken kan skal må før efter til siden""",
    "pl": """i w na z do od po za przy przez że który która które to jest są był nie się jak kiedy gdzie co czy ten ta te lub ale jeśli może musi przed aby""",
    "tr": """ve bir bu şu o ile için gibi daha çok ne nasıl neden nerede hangi değil mi mı veya ama eğer önce sonra kadar""",
}
_BY_WORD: dict[str, list[str]] = {}
for _l, _ws in FUNCTION_WORDS.items():
    for _w in set(_ws.split()):
        _BY_WORD.setdefault(_w, []).append(_l)
#: Letters that point to a language.
MARKS = {"ß": "de", "ä": "de", "ö": "de", "ü": "de", "ñ": "es", "¿": "es", "¡": "es", "ç": "fr", "œ": "fr", "ê": "fr", "è": "fr", "à": "fr", "ò": "it", "ì": "it", "ù": "it", "ã": "pt", "õ": "pt", "å": "sv", "ø": "da", "ł": "pl", "ż": "pl", "ı": "tr", "ş": "tr"}
_QUOTED = re.compile(r'"[^"\n]{1,120}"|„[^“\n]{1,120}“|«[^»\n]{1,120}»|“[^”\n]{1,120}”|https?://\S+')


#: Scripts by ranges of code points.
SCRIPTS = (
    (0x250, "latin"), (0x370, "other"), (0x400, "greek"), (0x530, "cyrillic"), (0x590, "other"), (0x600, "hebrew"), (0x780, "arabic"), (0x900, "other"), (0x980, "deva"),
    (0xE00, "other"), (0xE80, "thai"), (0x3040, "other"), (0x3100, "kana"), (0x4E00, "other"), (0xA000, "han"), (0xAC00, "other"), (0xD7B0, "hangul"),
)
_ENDS = [e for e, _ in SCRIPTS]


def _script(text: str) -> str:
    """The script of most letters."""
    if text.isascii():
        return "latin" if any(map(str.isalpha, text)) else ""
    n: dict[str, int] = {}
    for c, k in Counter(text).items():
        if c.isalpha():
            i = bisect_right(_ENDS, ord(c))
            s = SCRIPTS[i][1] if i < len(SCRIPTS) else "other"
            n[s] = n.get(s, 0) + k
    return max(n, key=n.get) if n else ""


def languages(text: str) -> dict[str, float]:
    """Weight of each language: its function words, less for words that several share, and its letters."""
    out: dict[str, float] = {}
    words = _WORD.findall(_QUOTED.sub(" ", text).lower())
    for w in words:
        for part in (w, *([w.split("'")[0].split("’")[0]] if "'" in w or "’" in w else [])):
            ls = _BY_WORD.get(part, ())
            for x in ls:
                out[x] = out.get(x, 0) + 1 / len(ls)
    if not text.isascii():
        for c, k in Counter(text.lower()).items():
            if c in MARKS:
                out[MARKS[c]] = out.get(MARKS[c], 0) + 0.3 * k
    return out


def other_language(question: str | None, answer: str) -> bool:
    """The answer's script, or its language, is clearly not that of the question. Short answers without function words are in any language."""
    if not question:
        return False
    sq, sa = _script(question), _script(_QUOTED.sub(" ", answer))
    if sq and sa and sq != sa:
        return True
    lq, la = languages(question), languages(answer)
    if not lq or not la:
        return False
    q, a = max(lq, key=lq.get), max(la, key=la.get)
    return q != a and la[a] >= 1.5 and la[a] >= 2 * la.get(q, 0)


#: The words of the refusal grammar by category. A refusal is a clause by one of the rules of REFUSAL_RULES over them.
LEXICON = {
    # English
    "CANT": "can(?:no|')t|can not|could(?:n't| not)|won't|will not|would(?:n't| not)|am not able|'m not able|not able|unable|isn't possible|not possible|unwilling",
    "DECLINE": "decline|refuse|pass|skip|leave|prefer not|rather not",
    "DUTY": "must|have to|need to|ought to|'d|would",
    "ACT": "answer|help|assist|provide|say|tell|comment|respond|reply|advise|discuss|share|speculate|guess|confirm|resolve|complete|find|locate|give|do that|do this|be able",
    "DONE": "answered|resolved|completed|determined|confirmed|processed|handled|served",
    "EVIDENCE": "answers?|information|info|sources?|records?|documents?|materials?|passages?|data|details|evidence|knowledge|idea|references?|content|text|pages?|manuals?|corpus|library|index|archive|collection",
    "AT_HAND": "found|available|exists?|given|cite|retrieved|located|rely|on hand|indexed",
    "SILENT": "(?:stay|keep|remain|are|is|fall)s? silent|(?:say|hold|contain|mention|offer)s? nothing|(?:end|stop)s? (?:before|short of)|(?:do(?:es)? not|don't|doesn't) (?:cover|mention|say|address|hold|contain)|lacks?",
    "REMIT": "scope|reach|remit|expertise|ability|area|competence|what I|my|me",
    "SUBJECT": "topics?|questions?|subjects?|matters?",
    "REGRET": r"sorry|apolog\w+|regret\w*|unfortunately|sadly|afraid",
    "NEG": "can't|cannot|unable|no|not|nothing|won't",
    "PROPER": "appropriate|at liberty|something I(?:'m| am| can)|my place",
    # French, German, Spanish, Italian, Dutch, Portuguese: negation, evidence, ability
    "FR_NON": "pas|rien|aucune?|guère", "FR_EV": "source|information|réponse|donnée|document",
    "DE_KANN": "kann|könnte|möchte|darf|werde|weiß|habe|finde", "DE_NON": "nicht|nichts|keine?n?", "DE_EV": "Quellen?|Antwort|Angaben?|Informationen?|Daten|Unterlagen",
    "ES_NO": "puedo|encuentro|tengo|dispongo|sé|me es posible|es posible|estoy", "ES_EV": "fuente|respuesta|información",
    "IT_NO": "posso|so|trovo|ho|sono in grado", "IT_EV": "fonte|risposta|informazione",
    "NL_KAN": "kan|mag|wil|weet|vind|heb", "NL_NON": "niet|geen|niets", "NL_EV": "bron|antwoord|informatie",
    "PT_NO": "posso|encontro|tenho|sei|consigo",
}
_GAP = r"[^.!?;]{0,60}?"
#: (category, rule): <NAME> stands for the words of a category, ~ for anything within a clause.
REFUSAL_RULES = (
    ("inability", r"<CANT>\b~\b<ACT>"),
    ("inability", r"\b<ACT>\b~\b(?:isn't|is not|not) possible\b"),
    ("inability", r"\b(?:this|that|it|request|question)\b~\b(?:can't|cannot|could not) be <DONE>"),
    ("unwilling", r"\bI ?<DUTY> <DECLINE>\b"),
    ("ignorance", r"\bI(?: do not| don't|'ve no| have no)\b~\b(?:know|have|see|hold|find|<EVIDENCE>)\b"),
    ("no evidence", r"\b(?:there is|there's|there are|there was|we have|I have|I find|I found|found|offer|see)\s+(?:no|not any|nothing)\b(?:~\b<EVIDENCE>\b|$)"),
    ("no evidence", r"\bno (?:\w+ )?<EVIDENCE>\b~\b<AT_HAND>\b"),
    ("no evidence", r"\bnothing\b~\b(?:<AT_HAND>|relevant|(?:lets|helps|allows|permits) me)\b"),
    ("no evidence", r"\b<EVIDENCE>\b~\b(?:<SILENT>)\b"),
    ("scope", r"\b(?:outside|beyond|not within|out of)\b~\b<REMIT>\b"),
    ("scope", r"\b(?:stick|keep|limit\w*|confine\w*|restrict\w*) (?:\w+ ){0,2}to (?:\w+ ){0,3}<SUBJECT>\b|\bonly (?:answer|cover|discuss|handle) (?:\w+ ){0,2}<SUBJECT>\b"),
    ("propriety", r"\b(?:not|isn't|wouldn't)(?: be)? <PROPER>\b"),
    ("regret", r"\b<REGRET>\b~\b<NEG>\b"),
    ("inability", r"\bje (?:ne|n')\b~\b<FR_NON>\b|\bje ne (?:peux|sais|trouve)\b|\bimpossible de\b|\bje refuse\b"),
    ("no evidence", r"\baucune <FR_EV>\b"),
    ("scope", r"\bdépasse ce que je\b|\bhors de (?:mon|ma)\b"),
    ("regret", r"\bdésolée?\b"),
    ("inability", r"\b(?:<DE_KANN> ich|ich <DE_KANN>)\b~\b<DE_NON>\b"),
    ("no evidence", r"\bkeine <DE_EV>\b"),
    ("scope", r"\baußerhalb meine[rs]\b"),
    ("regret", r"\bleider\b|\btut mir leid\b"),
    ("inability", r"\bno <ES_NO>\b"),
    ("no evidence", r"\bninguna <ES_EV>\b"),
    ("scope", r"\bfuera de mi\b"),
    ("regret", r"\blo siento\b|\blamento\b"),
    ("inability", r"\bnon <IT_NO>\b"),
    ("no evidence", r"\bnessuna <IT_EV>\b"),
    ("scope", r"\bfuori dal(?:la)? mi[oa]\b"),
    ("regret", r"\bmi dispiace\b|\bpurtroppo\b"),
    ("inability", r"\b(?:<NL_KAN> ik|ik <NL_KAN>)\b~\b<NL_NON>\b"),
    ("no evidence", r"\bgeen <NL_EV>\b"),
    ("scope", r"\bbuiten mijn\b"),
    ("regret", r"\bhelaas\b|\bhet spijt me\b"),
    ("inability", r"\bnão <PT_NO>\b"),
    ("regret", r"\binfelizmente\b|\bdesculpe\b"),
)


def _rule(r: str) -> re.Pattern:
    return re.compile(re.sub(r"<(\w+)>", lambda m: f"(?:{LEXICON[m[1]]})", r).replace("~", _GAP), re.I)


REFUSALS = [(c, _rule(r)) for c, r in REFUSAL_RULES]
#: Every refusal holds one of these, in small letters and with a blank before and behind it: a clause without any needs no rule tried.
_CUES = (
    "n't", " no ", " not ", " no:", " no,", "nothing", "cannot", "can not", "unable", "unwilling", "decline", "refuse", " pass ", " skip", " leave", "rather", "prefer", "silent", "lack", "beyond", "outside", "not within", "out of",
    "end before", "ends before", "stop before", "stops before", "short of", "stick", "keep", "limit", "confine", "restrict", "only answer", "only cover", "only discuss", "only handle", "'ve no", "have no",
    " pas", "rien", "aucun", "guère", "je ne", "impossible", "dépasse", " hors ", "désol", "nicht", "kein", "außerhalb", "leid", "ninguna", "fuera", "siento", "lamento", " non ", "nessuna", "fuori", "dispiace", "purtroppo",
    "niet", "geen", "buiten", "helaas", "spijt", " não", "infelizmente", "desculpe",
)


def refuses(clause: str) -> str | None:
    """The category of the first rule that makes a clause a refusal; null for others."""
    low = f" {clause.lower()} "
    if not any(c in low for c in _CUES):
        return None
    return next((c for c, r in REFUSALS if r.search(clause)), None)


_OFFER = re.compile(r"^(?:is there|anything|can I|could I|would you|may I|do you|shall I|please|try|you (?:may|might|could)|feel free|let me know|consult|contact|ask|y a-t-il|kann ich|puedo|posso)\b[^.!]*\?$|^(?:please|try|feel free|let me know|contact|consult|ask)\b", re.I)
_SENTENCE = re.compile(r"(?<=[.!?…])[\"')\]]*\s+|\n+")
_NOISE = re.compile(r"\s*(?:\[\d+\]|\(p\.? ?\d+\))\s*$")


def is_refusal(answer: str) -> bool:
    """Declines and gives no answer: at least one sentence refuses and none but offers of help stands beside it."""
    found = False
    for s in _SENTENCE.split(_NOISE.sub("", answer.strip())):
        s = s.strip()
        if not s or _OFFER.search(s):
            continue
        if refuses(s):
            found = True
        elif len(_WORD.findall(s)) > 2:
            return False
    return found


#: Words of closed classes (articles, prepositions, conjunctions, possessives, auxiliaries) that must be followed by another.
UNFINISHED = frozenset(
    """the a an of to and or nor with from into onto than that which whose my your our their its is are was were be been has have had will would can could may might must should because while
    le la les un une des du de et ou avec dans que qui est sont der die das den dem ein eine einen und oder mit für von ist sind el los las una del y o con para que es son il lo gli della e per che è het een van en of met voor""".split()
)
_PAIR = {")": "(", "]": "[", "}": "{", "»": "«", "”": "“"}
#: Elements that HTML lets stand without an end tag, or that have none.
OPTIONAL_END = frozenset("p li br hr img input td th tr tbody thead dt dd option wbr".split())
_LEX = re.compile(
    r"""(?P<fence>^[ \t]*```[^\n`]*|```)|(?P<tick>`)|(?P<strong>\*\*)|(?P<label>^[ \t]*(?:[-*•+]|\(?\d{1,3}[.)]|\(?[a-zA-Z]\))(?=[ \t\n]|$))
    |(?P<smile>[:;]-?[)(])|(?P<inch>\d\s?")|(?P<tag></?[a-zA-Z][\w-]*(?:\s[^<>]*)?/?>)|(?P<open>[(\[{“„«])|(?P<close>[)\]}”»])|(?P<quote>")|(?P<line>\n)""",
    re.M | re.X,
)


def parse(text: str) -> list[str]:
    """What is still open at the end of a text: a pushdown parse of fences, code, brackets, quotations, emphasis, lists and markup.

    The stack holds what was opened, innermost last; a closing mark closes what it belongs to, and all that was opened inside it.
    Nothing but its own end closes a fence or a piece of code. A list item stands on the stack from its label to the next
    label or blank line, with '' once it has content: one left without any breaks off. Marks that close nothing (labels,
    smileys, inches) and elements that need no end tag are passed over.
    """
    stack: list[str] = []
    at = 0
    for m in _LEX.finditer(text):
        kind, mark = m.lastgroup, m[0]
        if stack and stack[-1] == "item" and text[at : m.start()].strip():
            stack.pop()
        at = m.end()
        if stack and stack[-1] == "```":
            if kind == "fence":
                stack.pop()
            continue
        if stack and stack[-1] == "`" and kind not in ("tick", "line"):
            continue
        if kind == "fence":
            stack.append("```")
        elif kind == "tick":
            stack.pop() if stack and stack[-1] == "`" else stack.append("`")
        elif kind == "line":
            if stack and stack[-1] == "`":
                stack.pop()  # a lone tick is no code
        elif kind == "strong":
            _close(stack, "**") or stack.append("**")
        elif kind == "label":
            if stack and stack[-1] == "item":
                stack.pop()
            stack.append("item")
        elif kind == "tag":
            name = re.match(r"</?([\w-]+)", mark)[1].lower()
            if mark.startswith("</"):
                _close(stack, f"<{name}>")
            elif not mark.endswith("/>") and name not in OPTIONAL_END:
                stack.append(f"<{name}>")
        elif kind == "open":
            # German quotations end with the mark that opens English ones
            if mark != "“" or not _close(stack, "„"):
                stack.append(mark)
        elif kind == "close":
            _close(stack, _PAIR[mark]) or mark == "”" and _close(stack, "„")
        elif kind == "quote":
            _close(stack, '"') or stack.append('"')
    if stack and stack[-1] == "item" and (text[at:].strip() or not re.search(r"\S\s+\S", text)):
        stack.pop()
    if stack and stack[-1] == "`" and not text[at:].strip():
        stack.pop()
    return stack


def _close(stack: list[str], mark: str) -> bool:
    """Pops the innermost `mark` and what was opened inside it; false where none is open."""
    if mark not in stack:
        return False
    while stack.pop() != mark:
        pass
    return True


def _open_link(text: str) -> bool:
    """The text ends in a link whose last part looks cut: no digit, extension or closing slash, or no dotted host."""
    m = re.search(r"https?://(\S*)$|\bhttps?:?/?$|\bwww\.?$", text)
    if not m:
        return False
    u = (m[1] or "").rstrip(".,;")
    last = u.split("/")[-1]
    return "/" not in u or not (u.endswith("/") or any(c.isdigit() or c.isupper() for c in last) or re.search(r"\.\w{2,5}$", last))


def shape_of_end(answer: str) -> tuple[str, str]:
    """(kind, rest) as endings.finished, with 'cut' where the structure alone shows that the text breaks off: something is open
    at its end, or it ends in a mark after which something must follow."""
    kind, rest = endings.finished(answer)
    if kind == "blank":
        return kind, rest
    if parse(answer):
        return "cut", rest
    if kind in ("open", "dots"):
        last = re.search(r"[^\W\d_]+$", rest)
        if _open_link(rest) or re.search(r"(?:[^\W\d_]-|[,;:&/])$", rest) or last and last[0].lower() in UNFINISHED:
            return "cut", rest
    return kind, rest


def defects(df: DataFrame, row: str, question: str, answer: str) -> DataFrame:
    """(row, defect) of the defective pairs, one row per row id: empty, copy, refusal, language or truncated.

    A pair has at most one defect, the first that applies in this order. Null questions can be neither copied nor differ in
    language; null answers are empty. Rows written twice give one row. What the structure of an answer doesn't settle, the
    endings of all answers do.
    """
    row_type = df.schema[row].dataType.simpleString()
    schema = f"r {row_type}, text_hash long, defect string, kind string, keys array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = endings._Hashes()
        for b in batches:
            out, kinds, keys = [], [], []
            for q, a in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                d = kind = k = None
                if is_empty(a):
                    d = "empty"
                elif is_copy(q, a):
                    d = "copy"
                elif is_refusal(a):
                    d = "refusal"
                elif other_language(q, a):
                    d = "language"
                else:
                    kind, rest = shape_of_end(a)
                    if kind in ("cut", "marker", "markup"):
                        d = "truncated"
                    elif kind in ("open", "dots"):
                        k = endings.keys_of_end(rest, hashes)
                out.append(d)
                kinds.append(kind)
                keys.append(k)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(kinds, pa.string()), pa.array(keys, pa.list_(pa.int64()))], names=["r", "text_hash", "defect", "kind", "keys"])

    one = distinct_by(df.select(F.col(row).alias("r"), F.col(question).cast("string").alias("q"), F.col(answer).cast("string").alias("a")), "r")
    judged = cut(one.select("r", F.xxhash64("a").alias("text_hash"), "q", "a").mapInArrow(run, schema), "pairs")
    rest = endings.with_rates(judged.filter("defect is null"), one, "a", "r")
    seen = F.col("word_rate").isNotNull() | F.col("head_rate").isNotNull()
    line, stop, head, dots, word = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("line_rate", "stop_rate", "head_rate", "dots_rate", "word_rate"))
    whole = ((head >= 0.5) & (word > 0.02)) | ((line >= 0.7) & (F.col("head_rate").isNull() | (head >= 0.2)))
    cut_off = F.when(F.col("kind") == "dots", seen & (stop < 0.4) & (dots < 0.5)).when(F.col("kind") == "open", ~whole).otherwise(False)
    late = rest.filter(cut_off).select("r", F.lit("truncated").alias("defect"))
    return judged.filter("defect is not null").select("r", "defect").unionByName(late).select(F.col("r").alias(row), "defect")
