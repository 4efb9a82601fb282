"""Problem 3: prompt and response pairs that are of no use, with the kind of their defect.

Method: each pair is read once by a set of automata. A suffix automaton of the prompt measures which share of the
response's words lies inside runs of the prompt's own wording; an Aho-Corasick automaton of the marks of declining (regret,
first person, ability, negation) finds answers that refuse, by the marks that meet in one sentence; a stack of open
delimiters and the last word show an answer that stops half-way; votes of stopwords name the languages of the prompt and
of the response. What one pair can't show is counted over the whole table: words without a stopword's language are voted
for by the language of the prompts they answer, and a last word that isn't a word anywhere else but begins a common one was
cut off.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.plans.shared import col, cut, sized_broadcast

#: Salts a word's votes are repeated over where the words are too many to broadcast.
SALTS = 16

# Function words by language.
STOPWORDS = {
    "en": "the of and in to is was are what why did how does best way without since after near more than can do on for with from by at an it this that which who when where not be as or".split(),
    "de": "der die das und in im ist war sind was warum wie wirkt sich auf aus für bei rund um seit nach ohne mehr als will kann zu mit von den dem des ein eine einer nicht oder zwischen welche wer wo wann".split(),
    "fr": "le la les l de des du et en est était sont que quoi pourquoi comment quel quelle veut depuis après sans plus autour pour avec par sur un une dans au aux ne pas ou qui rôle change à".split(),
    "es": "el la los las de del y en es era son qué por cómo cuál quiere desde después sin más cerca para con sobre un una al no o afecta significa quien donde".split(),
    "it": "il lo la i gli le di del della dei e è in con per che non una un nel alla sono come perché dove più senza tra".split(),
    "pt": "o os as da do dos das e é em com para que não uma um na no ao são como por mais sem onde qual quando".split(),
    "nl": "de het een en van in is op voor met zijn dat niet aan door over naar bij uit wat hoe waarom wie meer zonder tussen".split(),
    "sv": "och att det som på är för med den till av inte ett hur varför vad när eller utan mellan från om".split(),
    "da": "og at det som på er for med den til af av ikke et hvordan hvorfor hvad når eller uden mellem fra om".split(),
    "pl": "i w na z do nie jest to się że jak dlaczego po od dla przez bez oraz czy między który".split(),
    "cs": "a v na z do je to se že jak proč po od pro přes bez nebo mezi který není".split(),
    "ro": "și în la cu de pe este nu un o din pentru care cum ce fără sau între după mai".split(),
    "hu": "a az és hogy nem egy van is meg mi miért hogyan vagy nélkül között után".split(),
    "fi": "ja on ei se että oli mitä miten miksi kun tai ilman välillä jälkeen kanssa".split(),
    "tr": "ve bir bu için ile da de ne nasıl neden mi değil gibi daha olan veya sonra".split(),
    "ru": "и в на с не что как по из у за от для это почему где или без между после".split(),
    "uk": "і в на з не що як по із у за від для це чому де або без між після".split(),
}
LANGS = tuple(STOPWORDS)

# Marks of declining by language, lower-cased. "sorry": regret, at the beginning of a sentence; "self": the first person,
# and what an assistant calls itself; "able": a verb of ability; "no": a negation; "unable": inability in one expression; "own": all in one.
MARKS = {
    "en": {"sorry": "sorry|i'm sorry|i am sorry|apologies|my apologies|i apologize|i apologise|unfortunately|i regret", "self": "i|i'm|we|as an assistant|as an ai|language model", "able": "", "no": "not|no|never|none", "unable": "cannot|can't|can not|could not|will not|unable|won't|couldn't|decline|refuse|not able|not allowed|not permitted", "own": "my guidelines|our guidelines|my policy|our policy|my policies|my instructions"},
    "de": {"sorry": "leider|es tut mir leid|tut mir leid|entschuldigung|ich bedauere|verzeihung", "self": "ich|wir|als assistent|als ki|sprachmodell", "able": "kann|darf|können|dürfen|möchte|werde", "no": "nicht|kein|keine|keinen|keinerlei", "unable": "unmöglich|außerstande|verweigern|ablehnen", "own": "meine richtlinien|meinen richtlinien"},
    "fr": {"sorry": "désolé|désolée|je suis désolé|je suis désolée|malheureusement|je regrette|pardon|je m'excuse|navré", "self": "je|nous|en tant qu'assistant|en tant qu'ia|modèle de langage", "able": "peux|puis|pouvons|veux|dois", "no": "ne|pas|aucun|aucune", "unable": "impossible|incapable|refuser|décliner", "own": "m'est impossible|mes directives|je ne peux|je ne suis pas"},
    "es": {"sorry": "lo siento|lamentablemente|por desgracia|desgraciadamente|disculpa|disculpe|perdón|lamento", "self": "yo|me|mi|mis|como asistente|como ia|modelo de lenguaje", "able": "puedo|podemos|posible", "no": "no|ningún|ninguna", "unable": "imposible|incapaz|rechazar", "own": "no puedo|no podemos|no me es posible|mis directrices"},
    "it": {"sorry": "mi dispiace|purtroppo|spiacente|scusa|scusate", "self": "io|come assistente", "able": "posso|possiamo", "no": "non|nessun|nessuna", "unable": "impossibile", "own": "non posso|non possiamo|non sono in grado|non mi è possibile"},
    "pt": {"sorry": "desculpe|sinto muito|infelizmente|lamento", "self": "eu|como assistente", "able": "posso|podemos|consigo", "no": "não|nenhum|nenhuma", "unable": "impossível", "own": "não posso|não consigo|não podemos|não me é possível"},
    "nl": {"sorry": "het spijt me|helaas|sorry", "self": "ik|wij|als assistent", "able": "kan|mag|kunnen", "no": "niet|geen", "unable": "onmogelijk", "own": ""},
    "sv": {"sorry": "tyvärr|jag är ledsen|förlåt|jag beklagar", "self": "jag|vi|som assistent", "able": "kan|får", "no": "inte|inga|inget", "unable": "omöjligt", "own": ""},
    "da": {"sorry": "desværre|dessverre|beklager|jeg beklager|undskyld", "self": "jeg|vi|som assistent", "able": "kan|må|får", "no": "ikke|ingen", "unable": "umuligt|umulig", "own": ""},
    "fi": {"sorry": "valitettavasti|olen pahoillani|pahoittelen|anteeksi", "self": "minä", "able": "voi", "no": "en|ei", "unable": "mahdotonta", "own": "en voi|en pysty|emme voi"},
    "pl": {"sorry": "przykro mi|niestety|przepraszam", "self": "ja|jako asystent", "able": "mogę|możemy", "no": "nie", "unable": "niemożliwe", "own": "nie mogę|nie możemy|nie jestem w stanie"},
    "cs": {"sorry": "omlouvám se|bohužel|je mi líto|promiňte", "self": "já|jako asistent", "able": "mohu|můžu", "no": "ne|není", "unable": "nelze", "own": "nemohu|nemůžu|nemůžeme"},
    "ro": {"sorry": "îmi pare rău|din păcate|ne pare rău|scuze", "self": "eu", "able": "pot|putem", "no": "nu", "unable": "imposibil", "own": "nu pot|nu putem"},
    "hu": {"sorry": "sajnálom|sajnos|elnézést", "self": "én", "able": "tudok", "no": "nem", "unable": "lehetetlen", "own": "nem tudok|nem tudunk|nem áll módomban"},
    "tr": {"sorry": "üzgünüm|maalesef|ne yazık ki|özür dilerim", "self": "ben", "able": "", "no": "hayır|değil", "unable": "mümkün değil", "own": "yapamam|edemem|veremem|olamam|yardımcı olamıyorum"},
    "ru": {"sorry": "извините|к сожалению|простите|сожалею", "self": "я|мы", "able": "могу|можем", "no": "не|нет", "unable": "невозможно", "own": "не могу|не можем"},
    "uk": {"sorry": "вибачте|на жаль|перепрошую", "self": "я|ми", "able": "можу|можемо", "no": "не|немає", "unable": "неможливо", "own": "не можу|не можемо"},
    "el": {"sorry": "λυπάμαι|δυστυχώς|συγγνώμη", "self": "εγώ", "able": "μπορώ", "no": "δεν", "unable": "αδύνατο", "own": "δεν μπορώ|δεν μπορούμε"},
    "id": {"sorry": "maaf|mohon maaf|sayangnya", "self": "saya|kami", "able": "bisa|dapat", "no": "tidak", "unable": "mustahil", "own": ""},
    "vi": {"sorry": "xin lỗi|tôi xin lỗi|rất tiếc", "self": "tôi", "able": "thể", "no": "không", "unable": "", "own": "tôi không thể"},
    "ar": {"sorry": "آسف|عذرا|عذرًا|للأسف|نأسف", "self": "أنا", "able": "يمكن", "no": "لا|لن", "unable": "", "own": "لا أستطيع|لا يمكنني|لا يمكننا|لن أتمكن"},
    "he": {"sorry": "מצטער|סליחה|לצערי", "self": "אני", "able": "יכול", "no": "לא", "unable": "", "own": "איני יכול|אינני יכול"},
    "hi": {"sorry": "क्षमा करें|मुझे खेद है|माफ़ कीजिए", "self": "मैं", "able": "सकता|सकती", "no": "नहीं", "unable": "असमर्थ", "own": ""},
}
# The same for scripts written without blanks, found anywhere in a sentence; each is enough by itself.
UNSPACED_MARKS = "抱歉|对不起|對不起|很遗憾|很遺憾|我不能|我无法|我無法|申し訳|お答えできません|できかねます|お手伝いできません|죄송|할 수 없습니다|드릴 수 없|ขออภัย|ไม่สามารถ".split("|")

# What stands where a term is missing.
PLACEHOLDERS = frozenset({"", "-", "--", "_", "n/a", "na", "null", "none", "nil", "nan", "...", "…", ".", "?", "tbd", "unknown", "[]", "{}"})

# Words that can't end an enumeration or a term.
DANGLING = frozenset("and or of the a an with for to in by from und oder der die das dem den des von mit für zu bei et ou de du des le la les un une avec pour y o u del el los las con para por en as such like including wie etwa comme tels telles como tales".split())
OPENERS, CLOSERS = {"(": ")", "[": "]", "{": "}", "«": "»", "“": "”", "„": "“"}, {")", "]", "}", "»", "”"}

_WORDS = re.compile(r"[^\W_]+")
_SPOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)*'?")
#: Letters of scripts that are written without blanks.
_UNSPACED = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\u0e00-\u0e7f]")
_SENTENCE_END = (".", "!", "。", "！", "।")


class SuffixAutomaton:
    """The minimal automaton of all word sequences of a prompt."""

    def __init__(self, words: list[str]):
        self.next, self.link, self.length = [{}], [-1], [0]
        last = 0
        for w in words:
            cur = self._state(self.length[last] + 1, {})
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = cur
                p = self.link[p]
            if p < 0:
                self.link[cur] = 0
            else:
                q = self.next[p][w]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def _state(self, length: int, nxt: dict, link: int = -1) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def longest_matches(self, words: list[str]) -> list[int]:
        """For each position, the length of the longest run of words ending there that the prompt holds."""
        following, link, length = self.next, self.link, self.length
        out, state, size = [], 0, 0
        for w in words:
            to = following[state].get(w)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = following[state].get(w)
            if to is not None:
                state, size = to, size + 1
            out.append(size)
        return out

    def covered(self, words: list[str]) -> int:
        """How many of ``words`` lie in runs of the prompt."""
        if self.next[0].keys().isdisjoint(words):
            return 0
        n = free = 0
        for i, run in enumerate(self.longest_matches(words), 1):
            if run:
                n += min(run, i - free)
                free = i
        return n


#: Marks that are short enough to be inside most words; they are looked for among the words of a sentence that has another mark.
_SHORT = 2


class Marks:
    """The marks of declining as one automaton; made once a task."""

    def __init__(self):
        import ahocorasick

        self.automaton, self.short, self.sorry = ahocorasick.Automaton(), {}, set()
        where: dict[str, list[tuple[str, str]]] = {}
        for lang, kinds in MARKS.items():
            for kind, listed in kinds.items():
                for mark in filter(None, listed.split("|")):
                    where.setdefault(mark, []).append((lang, kind))
                    if kind == "sorry":
                        self.sorry.add(mark)
        for mark, of in where.items():
            if len(mark) <= _SHORT:
                self.short[mark] = of
            else:
                self.automaton.add_word(mark, (len(mark), of, True))
        for mark in UNSPACED_MARKS:
            self.automaton.add_word(mark, (len(mark), [("", "own")], False))
        self.automaton.make_automaton()

    def by_item(self, items: list[str]) -> dict[int, list[tuple[int, str, str]]]:
        """``position, language, kind`` of the marks of each lower-cased item, if any of them says more than who speaks, or no."""
        found: dict[int, list[tuple[int, str, str]]] = {}
        text = "\n".join(items)
        starts, at = [], 0
        for t in items:
            starts.append(at)
            at += len(t) + 1
        k = 0
        for end, (n, of, spaced) in self.automaton.iter(text):
            begin = end - n + 1
            if spaced and ((begin and text[begin - 1].isalnum()) or (end + 1 < len(text) and text[end + 1].isalnum())):
                continue
            while k + 1 < len(starts) and starts[k + 1] <= begin:
                k += 1
            while starts[k] > begin:
                k -= 1
            found.setdefault(k, []).extend((begin - starts[k], lang, kind) for lang, kind in of)
        if all(kind in ("self", "no") for of in found.values() for _, _, kind in of):
            return {}
        for i in found:
            for m in _SPOKEN.finditer(items[i]):
                found[i].extend((m.start(), lang, kind) for lang, kind in self.short.get(m.group(), ()))
        return found


def declines(marks: list[tuple[int, str, str]], opened: frozenset[str] = frozenset()) -> bool:
    """Whether the marks of one sentence together decline, in one of the languages; ``opened`` are languages in which regret went before."""
    kinds: dict[str, set[str]] = {}
    for at, lang, kind in marks:
        kinds.setdefault(lang, set()).add("begins sorry" if kind == "sorry" and at == 0 else kind)
    for lang, k in kinds.items():
        if "own" in k or {"self", "unable"} <= k or {"self", "able", "no"} <= k:
            return True
        if ("begins sorry" in k or lang in opened) and k & {"no", "unable"}:
            return True
    return False


def is_sentence(low: str) -> bool:
    """Whether an item is as long as a sentence, and not as a keyword: four words, or two and a full stop, or eight letters of a script without blanks."""
    n = len(_SPOKEN.findall(low))
    return n >= 4 or (n >= 2 and low.endswith(_SENTENCE_END)) or len(_UNSPACED.findall(low)) >= 8


def is_refusal(said: list[str], marks: Marks, spoken: frozenset[str] = frozenset()) -> bool:
    """Whether an answer's items, in order, decline: each by itself, or together as one sentence that was cut at its commas.

    ``spoken`` are items that are the prompt's own wording, which decline nothing. A broken sentence begins with its regret or
    with the one item that declines, has no other opening, and more than half of its words are at or after a mark of
    their item; a list of keywords about refusals has words of its own from the first item on, or in between.
    """
    low = [t.lower().strip(" \"'«“") for t in said]
    found = marks.by_item(low)
    if not found or any(t in spoken for t in said):
        return False
    if all(i in found and is_sentence(t) and declines(found[i]) for i, t in enumerate(low)):
        return True
    if len(low) < 2 or 0 not in found:
        return False
    openings = [i for i, t in enumerate(low) if t.strip(" .,!") in marks.sorry]
    if openings not in ([], [0]):
        return False
    opened = frozenset(lang for _, lang, kind in found[0] if kind == "sorry") if openings else frozenset()
    if not opened and not (min(at for at, _, _ in found[0]) == 0 and declines(found[0])):
        return False
    if opened:  # after regret a bare negation is a mark too
        bare = {mark: [(lang, kind)] for lang in opened for kind in ("no", "self") for mark in filter(None, MARKS[lang][kind].split("|"))}
        for i, t in enumerate(low):
            found.setdefault(i, []).extend((m.start(), lang, kind) for m in _SPOKEN.finditer(t) for lang, kind in bare.get(m.group(), ()))
    declining = sum(declines(found.get(i, []), opened) for i in range(len(low)))
    if not declining or (not opened and declining > 1):
        return False
    inside = whole = 0
    for i, t in enumerate(low):
        first = min((at for at, _, _ in found.get(i, ())), default=len(t))
        whole += len(_SPOKEN.findall(t))
        inside += len(_SPOKEN.findall(t[first:]))
    return whole >= 4 and 2 * inside > whole


def tidy(term) -> str:
    """A term with single blanks and plain apostrophes; nothing for what isn't a string."""
    if not isinstance(term, str):
        return ""
    if not term.isascii():
        term = term.replace("​", " ").replace("﻿", " ").replace("’", "'")
    return " ".join(term.split())


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def unclosed(term: str) -> bool:
    """Whether a bracket or quote of ``term`` is left open."""
    stack: list[str] = []
    for ch in term:
        if stack and ch == stack[-1]:
            stack.pop()
        elif ch in OPENERS:
            stack.append(OPENERS[ch])
        elif ch in CLOSERS:
            return False
        elif ch == '"':
            stack.append('"')
    return bool(stack)


def stops_short(term: str) -> bool:
    """Whether ``term`` ends in an ellipsis, a comma, an open delimiter or a word that can't be the last."""
    t = term.rstrip()
    if t.endswith(("...", "…", ",", ";", ":", "/", "(", "-", "&")):
        return True
    last = words_of(t)[-1:]
    return unclosed(t) or (len(t.split()) > 1 and bool(last) and last[0] in DANGLING and t[-1].isalnum() and t.split()[-1].lower() == last[0])


def script(words: list[str]) -> str | None:
    """The script of more than half of the letters of ``words``, if there is one."""
    joined = "".join(words)
    if joined.isascii():
        return "LATIN" if any(map(str.isalpha, joined)) else None
    n: Counter[str] = Counter()
    for ch, times in Counter(joined).items():
        if ch.isalpha():
            n["LATIN" if ch < "ɐ" else unicodedata.name(ch, "").split(" ")[0]] += times
    name, most = n.most_common(1)[0] if n else (None, 0)
    return name if most * 2 > n.total() else None


_LANGS_OF: dict[str, tuple[str, ...]] = {}
for _lang, _list in STOPWORDS.items():
    for _word in _list:
        _LANGS_OF[_word] = (*_LANGS_OF.get(_word, ()), _lang)


def stop_votes(words: list[str]) -> Counter[str]:
    """Votes of stopwords for languages; a word of several languages votes for each."""
    return Counter(chain.from_iterable([_LANGS_OF[w] for w in words if w in _LANGS_OF]))


def prompt_language(words: list[str]) -> str | None:
    """The language with most votes, if it is one alone."""
    two = stop_votes(words).most_common(2)
    return two[0][0] if two and (len(two) == 1 or two[0][1] > two[1][1]) else None


def voted_language(words: list[str], home: str | None, least: int, share: float) -> bool | None:
    """Whether the stopwords of a field vote for another language than ``home`` (True), for it (False), or don't decide.

    A language wins by at least ``least`` votes and ``share`` of the words more than the other side has.
    """
    votes = stop_votes(words)
    if home is None or not votes:
        return None
    lead = max((n for k, n in votes.items() if k != home), default=0) - votes[home]
    enough = max(least, share * len(words))
    return True if lead >= enough else False if -lead >= enough else None


_READ = "expansion_id long, defect string, lang string, field_votes array<boolean>, prompt_words array<string>, entity_words array<string>, associated_words array<string>, last_word string, begins_prompt boolean"


def read_pair(prompt, entities, associated, marks: Marks, copied_share: float, least: int, share: float) -> tuple:
    """The columns of :data:`_READ` after the id: what one pair shows by itself, and its words for what the table shows."""
    lists = list(entities.items() if isinstance(entities, dict) else entities or ())
    e_all, a_all = [tidy(x) for _, v in lists for x in v or ()], [tidy(x) for x in associated or ()]
    e_terms, a_terms = ([t for t in ts if t.lower() not in PLACEHOLDERS] for ts in (e_all, a_all))
    p_words = words_of(tidy(prompt))
    lang = prompt_language(p_words)
    e_split, a_split = [words_of(t) for t in e_terms], [words_of(t) for t in a_terms]
    e_words, a_words = [w for ws in e_split for w in ws], [w for ws in a_split for w in ws]
    terms, split = e_terms + a_terms, e_split + a_split
    found = lambda defect: (defect, lang, None, p_words, e_words, a_words, None, None)

    runs = SuffixAutomaton(p_words)
    shares = [runs.covered(ws) for ws in split]
    said = terms or [t for t in (tidy(k) for k, _ in lists) if t.lower() not in PLACEHOLDERS]
    if said:
        spoken = frozenset(t for t, ws, n in zip(terms, split, shares) if ws and n == len(ws))
        if is_refusal(said, marks, spoken):
            return found("refusal")
        if len(said) == 1 and len(words_of(said[0])) >= 4 and said[0].endswith(_SENTENCE_END) and voted_language(words_of(said[0]), lang, 1, 0.0):
            return found("refusal")  # one whole sentence of another language in the place of terms
    if not terms:
        return found("empty")
    total = len(e_words) + len(a_words)
    if total and sum(shares) >= copied_share * total:
        return found("copied")
    # where the answer stops: its last term, of the associated terms or, where there are none, of the entities
    tail = (a_all or e_all)[-1]
    if tail and stops_short(tail):
        return found("truncated")
    home = script(p_words)
    if home and any(s and s != home for s in (script(e_words), script(a_words))):
        return found("other_language")
    votes = [voted_language(ws, lang, least, share) for ws in (e_words, a_words)]
    if True in votes:
        return found("other_language")
    last_word = None
    if tail and tail[-1].isalpha() and tail == terms[-1] and split[-1]:
        last_word = split[-1][-1]
    begins = last_word is not None and last_word not in p_words and any(w.startswith(last_word) for w in p_words)
    return None, lang, votes, p_words, e_words, a_words, last_word, begins


def _reader(*settings):
    words = pa.list_(pa.string())
    schema = pa.schema([("expansion_id", pa.int64()), ("defect", pa.string()), ("lang", pa.string()), ("field_votes", pa.list_(pa.bool_())), ("prompt_words", words), ("entity_words", words), ("associated_words", words), ("last_word", pa.string()), ("begins_prompt", pa.bool_())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks()
        for b in batches:
            given = [b.column(c).to_pylist() for c in ("expansion_id", "text", "key_entities", "associated_terms")]
            rows = [(i, *read_pair(t, e, a, marks, *settings)) for i, t, e, a in zip(*given)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)

    return read


def word_counts(read: DataFrame, langs: list[str]) -> DataFrame:
    """``word``, by how many answers to prompts of each language it is used, by how many to prompts of a known one, and by how many in all."""
    used = read.where(F.col("defect").isNull()).select("lang", F.explode(F.array_distinct(F.concat("prompt_words", "entity_words", "associated_words"))).alias("word"))
    return used.groupBy("word").agg(*[F.count_if(F.col("lang") == k).alias(k) for k in langs], F.count("lang").alias("n"), F.count("*").alias("own_n"))


def _languages(read: DataFrame, counts: DataFrame, rows: dict[str, int], support: int) -> DataFrame:
    """For each pair: the language that the prompt's words vote for, and of each field the votes ``s`` and their number."""
    langs = list(rows)
    logs = [F.log((F.col(k) + 0.2) / (n + 10.0)).alias(k) for k, n in rows.items()]
    fields = F.map_from_arrays(F.array(F.lit("p"), F.lit("e"), F.lit("a")), F.array("prompt_words", "entity_words", "associated_words"))
    each = read.where(F.col("defect").isNull()).select("expansion_id", F.explode(fields).alias("field", "words"))
    each = each.select("expansion_id", "field", F.explode(F.array_distinct("words")).alias("word"))
    known, small = sized_broadcast(cut(counts.where(F.col("n") >= support).select("word", *logs), "pair-words"))
    if small:
        voted = each.join(known, "word")
    else:  # salted, as one word may be in a third of all answers
        known = known.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        voted = each.withColumn("salt", F.pmod(F.xxhash64("expansion_id"), F.lit(SALTS)).cast("int")).join(known, ["word", "salt"])
    scored = voted.groupBy("expansion_id", "field").agg(*[F.sum(k).alias(k) for k in langs], F.count("*").alias("voters"))
    best = F.greatest(*langs) if len(langs) > 1 else F.col(langs[0])
    winner = F.coalesce(*[F.when(F.col(k) == best, F.lit(k)) for k in langs])
    scored = scored.select("expansion_id", "field", winner.alias("voted"), F.struct(*langs).alias("s"), "voters")
    pick = lambda f, c: F.max(F.when(F.col("field") == f, F.col(c)))
    return scored.groupBy("expansion_id").agg(*[pick(f, c).alias(f"{f}_{c}") for f, cs in (("p", ["voted"]), ("e", ["s", "voters"]), ("a", ["s", "voters"])) for c in cs])


def _cut_words(read: DataFrame, counts: DataFrame, more: int, known: int) -> DataFrame:
    """Pairs whose last word was cut off: all but unknown itself, it begins a word that is ``more`` times as frequent, or one of the prompt."""
    last = read.where(F.col("defect").isNull() & F.col("last_word").isNotNull()).select("expansion_id", "last_word", "begins_prompt")
    sought = cut(last.select("last_word").distinct(), "pair-last")
    starts = counts.select("word", F.col("own_n").alias("n"), F.explode(F.sequence(F.lit(2), F.greatest(F.lit(2), F.length("word") - 1))).alias("k")).where(F.col("k") < F.length("word"))
    longer = starts.select(F.substring(F.col("word"), F.lit(1), F.col("k")).alias("last_word"), "n").groupBy("last_word").agg(F.max("n").alias("longer_n"))
    hit = sought.join(longer, "last_word", "left").join(counts.select(F.col("word").alias("last_word"), F.coalesce("own_n", F.lit(0)).alias("own_n")), "last_word", "left").na.fill(0, ["own_n", "longer_n"])
    often = F.col("longer_n") >= more * F.greatest(F.lit(1), F.col("own_n"))
    hit = hit.select("last_word", often.alias("often"), (F.col("own_n") <= known).alias("unknown")).where("often OR unknown")
    return last.join(hit, "last_word").where("often OR (unknown AND begins_prompt)").select("expansion_id", F.lit(True).alias("cut"))


def pair_defects(expansions: DataFrame, copied_share: float = 0.9, margin: float = 0.75, support: int = 5, voters: int = 3, stop_least: int = 3, stop_share: float = 0.25, more: int = 8, known: int = 1) -> DataFrame:
    """``expansion_id, defect`` of each defective pair; ``expansion_id`` and a null defect of every other one.

    Defects, the first that holds: ``refusal``, ``empty``, ``copied``, ``truncated``, ``other_language``. Rows delivered twice count
    once; rows without an id are left out. Null fields, null terms and placeholders are no terms. A null or wordless prompt can't
    be copied and has no language.

    ``copied``: at least ``copied_share`` of the answer's words lie in runs of the prompt's words, each term by itself.
    ``truncated``: the answer's last term (of the associated terms, else of the entities) ends in an open delimiter or a word that
    can't be the last, or in the beginning of a word that is ``more`` times as frequent, or of one of the prompt's if it is used
    ``known`` times at most itself. ``other_language``: a field's letters are of
    another script, or its stopwords lead by ``stop_least`` votes and ``stop_share`` of its words for another language than the
    prompt's; where stopwords don't decide, its words, at least ``voters`` of them used by ``support`` answers, don't answer prompts
    of this language clearly more often than those of any other: by ``margin`` a word (natural log) on average. So a language
    that no prompt is in shows too, as its words answer all prompts alike. Languages of less than 1 % of the prompts don't vote.
    """
    one = expansions.select(*[col(c) for c in ("expansion_id", "text", "key_entities", "associated_terms")]).where(F.col("expansion_id").isNotNull()).dropDuplicates(["expansion_id"])
    read = cut(one.mapInArrow(_reader(copied_share, stop_least, stop_share), _READ), "pairs")
    of = {r["lang"]: r["rows"] for r in read.where("defect IS NULL AND lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("rows")).collect()}  # a row a language
    rows = {k: of[k] for k in LANGS if of.get(k, 0) * 100 >= max(1, sum(of.values()))} or {LANGS[0]: 0}
    counts = cut(word_counts(read, list(rows)), "pair-counts")
    langs, cuts = _languages(read, counts, rows, support), _cut_words(read, counts, more, known)

    home = F.coalesce(F.col("lang"), F.col("p_voted"))

    def foreign(f: str, at: int):
        at_home = F.coalesce(*[F.when(home == k, F.col(f"{f}_s")[k]) for k in rows])
        others = [F.when(home != k, F.col(f"{f}_s")[k]) for k in rows]
        elsewhere = F.greatest(*others) if len(others) > 1 else others[0]
        undecided = F.get("field_votes", F.lit(at)).isNull()
        return undecided & (F.col(f"{f}_voters") >= voters) & (at_home - elsewhere < margin * F.col(f"{f}_voters"))

    other = F.coalesce(foreign("e", 0), F.lit(False)) | F.coalesce(foreign("a", 1), F.lit(False))
    defect = F.coalesce("defect", F.when(F.col("cut"), F.lit("truncated")), F.when(other, F.lit("other_language")))
    return read.join(langs, "expansion_id", "left").join(cuts, "expansion_id", "left").select("expansion_id", defect.alias("defect"))
