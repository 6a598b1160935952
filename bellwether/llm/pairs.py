"""Defective answers of prompt and response pairs.

Each answer is taken apart (fences, quoted JSON, prose with a final object) with a stack of open
delimiters, which also tells JSON that breaks off.  Its prose then walks a suffix automaton of the
prompt's words, which measures how much of it the prompt covers; an automaton of refusal phrases and
votes of stop words for its language look for the other defects.  Prose that breaks off is found by
the trigram counts of ``truncation``.  An answer has one defect, the first of: empty, truncated JSON,
copy, refusal, language, truncated prose."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bellwether.llm.truncation import truncated
from bellwether.session import materialize

#: Phrases that decline to answer (lower case, straight apostrophes); a star stands for the rest of a word.
REFUSALS = {
    "en": "can't provide|cannot provide|can not provide|unable to provide|not able to provide|can't help|cannot help|unable to help|can't assist|cannot assist|unable to assist|i can't predict|i cannot predict|unable to predict|can't answer|cannot answer|unable to answer|must decline|have to decline|i decline|i refuse|won't produce|won't provide|will not provide|will not be given|won't be able|not permitted|not allowed to|do not allow me|don't allow me|against the rules|against my guideline*|against my polic*|against my rules|against my instructions|against my programming|violates my|outside what i am able|outside what i'm able|beyond what i can|beyond what i am|beyond what i'm|beyond my abilit*|beyond my scope|beyond my capabilit*|beyond my remit|i'd rather not|i would rather not|i prefer not to|i'd prefer not to|i would prefer not to|request declined|is not supported|isn't supported|request unanswered|irresponsible of me|as a language model|as an ai|i'm sorry, but|i am sorry, but|amount to personal advice|not comfortable",
    "de": "kann ich nicht helfen|dabei nicht helfen|kann ich nicht beantworten|kann ich keine|darf ich keine|darf ich nicht|ist mir nicht erlaubt|ist mir nicht gestattet|möchte ich nicht|möchte mich nicht|es tut mir leid, aber|tut mir leid, aber|als sprachmodell|als ki|lehne ich ab|muss ich ablehnen|keine auskunft geben|keine prognose",
    "fr": "je ne peux pas|je ne suis pas en mesure|je ne suis pas autorisé|je préfère ne pas|ne pas me prononcer|il ne m'est pas permis|il m'est impossible|je dois refuser|je refuse|désolé, je|désolée, je|en tant que modèle de langage|en tant qu'ia",
    "es": "no puedo ayudar|no puedo responder|no puedo proporcionar|no puedo dar|no puedo ofrecer|no me está permitido|no se me permite|no estoy autorizado|prefiero no|lo siento, no|lo siento, pero|como modelo de lenguaje|como ia|debo rechazar|debo negarme|me niego a",
    "it": "non posso aiutare|non posso rispondere|non posso fornire|non mi è permesso|mi dispiace, ma|preferisco non",
    "pt": "não posso ajudar|não posso responder|não posso fornecer|não me é permitido|sinto muito, mas|prefiro não",
}
#: Frequent function words by language.
STOPWORDS = {
    "en": "the of and to in is that it was for on are with as be at by this from or an which not but have has had were they their its more than when while near because into after before under despite though",
    "de": "der die das und ist nicht ein eine einer einem einen den dem des zu mit von für auf im sich wurde wurden als auch nach bei um wie dass aus hat sind gilt kaum mehr gegenüber trotz seit während obwohl lag",
    "fr": "le la les des du un une et est que qui dans pour pas sur au aux ce cette par plus avec se sont été soit vers peu chez sans selon malgré pendant depuis après face à d l s",
    "es": "el los las un una y en que es por con para no se del al lo como más pero sus ante sin según tras hacia fue este esta poca hasta mientras pese gracias desde",
    "it": "il lo gli un una e di che è per con non si del della dei delle al alla come più ma nel nella sono stato dopo secondo",
    "pt": "o os as um uma e de que é por com para não se do da dos das ao à como mais mas no na são foi após segundo",
    "nl": "de het een en van is dat niet op te zijn met voor aan bij door ook naar maar uit wordt werd na tot",
}
#: The share of the prose that runs of at least COPY_RUN words of the prompt cover, from which it is a
#: copy, and the share of the prompt that it must give back.
COPY_SHARE, COPY_RUN, COPY_PROMPT = 0.85, 4, 0.5
#: An answer of at most so many words that refuses within so many of its first sentences is a refusal, if no other sentence gives a forecast.  Any
#: other is one if it refuses anywhere, and in this share of its sentences or without a sentence of a forecast.
REFUSAL_WORDS, REFUSAL_SENTENCES, REFUSAL_SHARE = 90, 3, 0.5
#: What a sentence of a forecast has.
FORECAST = re.compile(
    r"\d|\b(?:ris(?:e|es|ing)|rose|fall(?:s|ing)?|fell|gain(?:s|ed)?|drop(?:s|ped)?|higher|lower|increas\w+|decreas\w+|declin(?:e|es|ing) (?:in|of)|upward|downward|bullish|bearish|upside|downside|grow(?:s|th|ing)?|grew|steig\w+|sink\w+|höher|niedriger|hausse|baisse|monte\w*|augment\w+|subi\w*|sube\w*|baja\w*|caída|aument\w+|rialzo|ribasso|queda|alta)\b", re.I
)
#: What gives a forecast after all.
GIVEN = re.compile(r"\b(?:i|we) (?:expect|forecast|project|anticipate|estimate|predict|see)\b|\b(?:likely|expected) to (?:rise|fall|gain|drop|close|climb|slip|be unchanged)\b|\b(?:will|should) (?:rise|fall|gain|drop|close|climb|slip)\b", re.I)
#: A language needs so many votes; where it isn't the prompt's, that one has at most this share of them.
LANGUAGE_VOTES, LANGUAGE_SHARE = 3, 0.65
#: What stands for no content.
NOTHING = {"", "null", "none", "n a", "na", "nan", "nil", "undefined", "empty", "json", "no answer", "no content", "no output", "tbd"}

_VOTES: dict[str, list[str]] = {}
for _lang, _words in STOPWORDS.items():
    for _w in _words.split():
        _VOTES.setdefault(_w, []).append(_lang)
_WORDS = re.compile(r"[^\W_]+").findall
#: Marks that may stand before the first word of a phrase.
_MARKS = re.compile(r"[\"“”„«»()\[\]*_>#]")
_SENTENCES = re.compile(r"(?<=[.!?])\s+|\n+")
_FENCE = regex.compile(r"^\s*(```+|~~~+)[ \t]*[\w-]*[ \t]*\n?")
_INVISIBLE = regex.compile(r"[\p{Cf}\p{Cc}--[\n\t\r]]", regex.V1)


@lru_cache(maxsize=1)
def refusal_automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrases in REFUSALS.values():
        for p in phrases.split("|"):
            a.add_word(f" {p.rstrip('*')}", p.endswith("*"))
    a.make_automaton()
    return a


class SuffixAutomaton:
    """The suffix automaton of a sequence of words."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for word in words:
            here = self._state({}, 0, self.length[last] + 1)
            p = last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = here
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                if self.length[q] == self.length[p] + 1:
                    self.link[here] = q
                else:
                    clone = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
                    while p >= 0 and self.next[p].get(word) == q:
                        self.next[p][word] = clone
                        p = self.link[p]
                    self.link[q] = self.link[here] = clone
            last = here

    def _state(self, nxt: dict[str, int], link: int, length: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def covered(self, words: list[str], run: int) -> int:
        """How many of ``words`` lie in runs of at least ``run`` words that the sequence has."""
        state = match = count = upto = 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                match = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                match += 1
            if match >= run:
                count += i + 1 - max(upto, i + 1 - match)
                upto = i + 1
        return count


def open_delimiters(text: str) -> list[str] | None:
    """The stack of delimiters still open at the end of JSON text; '"' on top is an open string.
    None if a closing one doesn't fit."""
    stack: list[str] = []
    escaped = False
    for c in text:
        if stack and stack[-1] == '"':
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                stack.pop()
        elif c in '{["':
            stack.append(c)
        elif c in "}]" and (not stack or stack.pop() != "{["["}]".index(c)]):
            return None
    return stack


def nothing(text: str) -> bool:
    """No answer content: blanks, invisible characters, punctuation, bare tags or a word for nothing."""
    bare = regex.sub(r"</?\w+\s*/?>", " ", _INVISIBLE.sub("", text))
    return " ".join(_WORDS(bare.lower())) in NOTHING


def _void(value) -> bool:
    if value is None:
        return True
    if isinstance(value, str):
        return nothing(value)
    if isinstance(value, dict):
        return all(map(_void, value.values()))
    if isinstance(value, list):
        return all(map(_void, value))
    return False


def _prose(value) -> str:
    """The prose in a decoded answer: its strings, without keys."""
    if isinstance(value, str):
        return value
    if isinstance(value, dict):
        return "\n".join(filter(None, map(_prose, value.values())))
    if isinstance(value, list):
        return "\n".join(filter(None, map(_prose, value)))
    return ""


def unfence(text: str) -> str:
    """The inside of a code fence that the text begins with, closed or not."""
    m = _FENCE.match(text)
    if not m:
        return text
    rest = text[m.end() :]
    end = rest.rfind(m.group(1))
    return rest[:end] if end >= 0 and not rest[end + len(m.group(1)) :].strip() else rest


def take_apart(text: str | None) -> tuple[str | None, str, bool]:
    """(defect or None, prose, whether the answer ends with complete JSON)."""
    if text is None:
        return "empty", "", False
    body = unfence(_INVISIBLE.sub("", text)).strip()
    if nothing(body):
        return "empty", "", False
    if body[0] in '{["':
        while True:  # every text in quotes is shorter than the quotation
            try:
                value = json.loads(body, strict=False)
            except (ValueError, RecursionError):
                break
            if not isinstance(value, str):
                return ("empty" if _void(value) else None), _prose(value), True
            body = unfence(value).strip()
            if nothing(body):
                return "empty", "", False
            if body[0] not in '{["':
                break
        if body[0] in '{["':
            left = open_delimiters(body)
            if left and (body[0] != '"' or '{\\"' in body or '{"' in body):
                return "truncated", "", False
    # Prose, with or without an object at its end.
    at = body.find("{")
    while at >= 0:
        if regex.match(r"\{\s*(?:\"|\\\"|\}|$)", body[at:]):
            tail = body[at:].rstrip("`~ \n")
            if open_delimiters(tail):
                return "truncated", "", False
            try:
                json.loads(tail, strict=False)
                return ("empty" if nothing(body[:at]) and _void(json.loads(tail, strict=False)) else None), body[:at], True
            except (ValueError, RecursionError):
                pass
        at = body.find("{", at + 1)
    return None, body, False


def votes(text: str) -> Counter:
    """Stop words by language; a word of several languages votes for each in part."""
    counts: Counter = Counter()
    for w in _WORDS(text.lower()):
        langs = _VOTES.get(w, ())
        for lang in langs:
            counts[lang] += 1 / len(langs)
    return counts


def language(text: str) -> str | None:
    """The language most stop words vote for, if there are enough."""
    lang, n = max(votes(text).items(), key=lambda x: x[1], default=(None, 0))
    return lang if n >= LANGUAGE_VOTES else None


def foreign(text: str, expected: str) -> bool:
    """Whether another language has enough votes, and clearly more than the expected one."""
    counts = votes(text)
    lang, n = max(counts.items(), key=lambda x: x[1], default=(expected, 0))
    return lang != expected and n >= LANGUAGE_VOTES and counts[expected] <= LANGUAGE_SHARE * n


def _has_refusal(text: str) -> bool:
    plain = " " + " ".join(_MARKS.sub(" ", text.lower().replace("’", "'")).split()) + " "
    return any(begun or not plain[at + 1].isalnum() for at, begun in refusal_automaton().iter(plain))


def refuses(prose: str, automaton: SuffixAutomaton | None = None) -> bool:
    """Whether the prose declines to answer; sentences of the prompt (``automaton``) neither refuse nor forecast."""
    sentences = [s for s in _SENTENCES.split(prose.strip()) if s]
    if len(_WORDS(prose)) <= REFUSAL_WORDS and _has_refusal(" ".join(sentences[:REFUSAL_SENTENCES])):
        return not any(GIVEN.search(s) for s in sentences if not _has_refusal(s))
    if not _has_refusal(prose):
        return False
    if automaton is not None:
        words = [_WORDS(s.lower()) for s in sentences]
        sentences = [s for s, w in zip(sentences, words, strict=True) if len(w) < COPY_RUN or automaton.covered(w, COPY_RUN) < COPY_SHARE * len(w)]
    others = [s for s in sentences if not _has_refusal(s)]
    refusing = len(sentences) - len(others)
    return refusing > 0 and (refusing >= REFUSAL_SHARE * len(sentences) or not any(map(FORECAST.search, others)))


def defect(prose: str, prompt_words: list[str], automaton: SuffixAutomaton | None, prompt_language: str | None) -> str | None:
    """copy, refusal, language or None, for the prose of an answer."""
    words = _WORDS(prose.lower())
    if automaton is not None and len(words) >= COPY_RUN and automaton.covered(words, COPY_RUN) >= COPY_SHARE * len(words):
        if SuffixAutomaton(words).covered(prompt_words, COPY_RUN) >= COPY_PROMPT * len(prompt_words):
            return "copy"
    if refuses(prose, automaton):
        return "refusal"
    if prompt_language and foreign(prose, prompt_language):
        return "language"
    return None


_ANSWER = pa.struct([("field", pa.string()), ("defect", pa.string()), ("prose", pa.string()), ("json", pa.bool_())])
_STAGE = "source_table string, row_id bigint, answers array<struct<field: string, defect: string, prose: string, json: boolean>>"


def judge_row(prompt: str | None, lang: str | None, answers: dict[str, str | None], only_json: frozenset[str]) -> list[dict]:
    """The answers of one prompt, with their defects as far as the row alone tells."""
    prompt_words = _WORDS(prompt.lower()) if prompt else []
    automaton = SuffixAutomaton(prompt_words) if len(prompt_words) >= COPY_RUN else None
    spoken = (language(prompt) if prompt else None) or lang
    out = []
    for field, answer in answers.items():
        found, prose, whole = take_apart(answer)
        if field in only_json:
            if found is None and not whole:
                found = "truncated"
            prose = ""
        elif found is None:
            found = defect(prose, prompt_words, automaton, spoken)
        out.append({"field": field, "defect": found, "prose": prose if found is None and prose.strip() else None, "json": whole})
    return out


def first_stage(rows: DataFrame, source_table: str, key: str, prompt: str, lang: str | None, fields: list[str], only_json: list[str] = ()) -> DataFrame:
    """(source_table, row_id, field, defect, prose, json) of every answer; narrow, one pass."""
    picked = rows.select(F.col(key).cast("bigint").alias("row_id"), F.col(prompt).alias("prompt"), (F.col(lang) if lang else F.lit(None).cast("string")).alias("lang"), *fields)
    strict = frozenset(only_json)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            columns = [batch.column(c).to_pylist() for c in ("prompt", "lang", *fields)]
            out = [judge_row(p, la, dict(zip(fields, answers, strict=True)), strict) for p, la, *answers in zip(*columns, strict=True)]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([source_table] * n), batch.column("row_id"), pa.array(out, pa.list_(_ANSWER))], names=["source_table", "row_id", "answers"])

    return picked.mapInArrow(batches, _STAGE).select("source_table", "row_id", F.inline("answers"))


def with_truncation(stage: DataFrame, complete_json_ends: bool = True) -> DataFrame:
    """(source_table, row_id, answer_field, defect) of all defective answers.

    Prose without other defect is held against the trigram counts; prose that complete JSON follows has
    its end."""
    stage = materialize(stage)
    known = stage.where("defect is not null").select("source_table", "row_id", "field", "defect")
    prose = stage.where("prose is not null")
    cut = truncated(prose, ["source_table", "row_id", "field", "json"], "prose")
    if complete_json_ends:
        cut = cut.where("not json")
    found = known.unionByName(cut.select("source_table", "row_id", "field", F.lit("truncated").alias("defect")))
    return found.withColumnRenamed("field", "answer_field")


def defective_answers(responses: DataFrame, pairs: DataFrame) -> DataFrame:
    """Defective answers of reasoning responses (chain_of_thought, output) and of preference pairs.

    A null, blank or contentless answer is 'empty'; a null prompt has no copies, and its language is
    ``prompt_lang``, if any; prose too short to vote has no language.  Repeated rows are judged each.
    ``output`` is JSON and can only be empty or truncated."""
    a = first_stage(responses, "reasoning_responses", "response_id", "prompt", "prompt_lang", ["chain_of_thought", "output"], ["output"])
    b = first_stage(pairs, "rl_pairs", "pair_id", "input", None, ["output1", "output2"])
    return with_truncation(a.unionByName(b))
