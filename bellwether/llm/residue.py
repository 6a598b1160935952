"""Template residue and error pages: records that hold something other than a finished article.

Sentences are aligned with all others of the same template: a template is the sentence less its
fillings (numbers, names, anything in placeholder marks), and the places of the fillings are its
slots.  A slot that still holds a variable name or a default is residue, and so is a slot left blank
where nearly all records of the template fill it.  Whole pages are aligned the same way: a short page
whose template comes back on several sites is an error page, as is a longer one that also comes back
within them, and any that consists of notices."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bellwether.session import join_counted, materialize

#: The marks of unfilled slots in common template languages, and default fillings.
PLACEHOLDERS = (
    r"\{\{\{?[-~#/&^>!]?\s*[\w.\-\[\]'\" |:,()]+?\s*[-~]?\}?\}\}",  # {{ name }}
    r"\{%-?\s*[^%{}]+?-?%\}",  # {% block %}
    r"\$\{\s*[\w.\-:|]+\s*\}",  # ${name}
    r"#\{\s*[\w.]+\s*\}",  # #{name}
    r"(?<![\w{$#%])\{\s*[A-Za-z_][\w.]*\s*\}",  # {name}
    r"%\([A-Za-z_]\w*\)[sdifr]",  # %(name)s
    r"(?<![\w%])%[A-Z][A-Z0-9_]+%",  # %NAME%
    r"(?<![\w#])#[A-Z][A-Z0-9_]+#",  # #NAME#
    r"<[%?]=?[^<>]*[%?]>",  # <%= name %>
    r"<[A-Z][A-Z' _-]{2,}>",  # <YOUR NAME>
    r"\[(?:[A-Z]{2,}[ _'-])+[A-Z]{2,}\]|\[(?:NAME|TITLE|DATE|COMPANY|CITY|AUTHOR|HEADLINE|BODY|TEXT|LINK|URL|EMAIL|PHONE|ADDRESS|NUMBER|AMOUNT|TBD|TK)\]",  # [INSERT NAME]
    r"(?<![\w$.])\$[a-z_][a-z_0-9]+(?![\w.]\w)",  # $name
    r"(?<!\w)__[A-Za-z]\w*__(?!\w)|@@\w+@@|\[\[[A-Za-z_][\w.]*\]\]",  # __NAME__, @@name@@, [[name]]
    r"(?<!\w)X{4,}(?!\w)|(?<!\w)(?:TK ?){2,}(?!\w)|_{4,}",  # defaults and blanks
)
PLACEHOLDER = regex.compile("|".join(f"(?:{p})" for p in PLACEHOLDERS))
#: A placeholder right after one of these is quoted: the text is about it.
QUOTES = "`'\"“‘«‹„"
#: Phrases of filler copy and of error, access, session, consent, robot and script notices.
NOTICES = (
    r"lorem ipsum|dolor sit amet|\basdf|\bqwer(?:ty)?\b|placeholder (?:copy|text)|filler text|dummy text|replace this (?:paragraph|text)|(?:body|intro|text|copy) (?:text )?to (?:come|be added|follow)|test (?:post|page|article)|please ignore|your text here|headline goes here|\b(?:test ){2,}",
    r"^(?:undefined|null|nan|none|\[object object\]|false|true)$|cannot read propert|traceback|stack trace|uncaught|exception in|fatal error|warning: |upstream (?:timed out|request timeout)|segmentation fault|sql syntax|internal server error|bad gateway|gateway time-?out|service (?:is )?(?:temporarily )?unavailable|temporarily unavailable|invalid response|^error\b|^\d{3} error|^http \d{3}|^(?:4|5)\d\d\b|our engineers have been notified|something went wrong",
    r"not found|could not be found|couldn't be found|page (?:you (?:asked|are looking) for|no longer exists|is gone|has moved)|may have (?:been )?moved|moved or been removed|was withdrawn|its address is wrong|object moved|moved permanently|down for maintenance|under maintenance|scheduled maintenance|back at \d|try again (?:in|later)",
    r"access (?:is )?denied|forbidden|permission to (?:view|access)|not authori[sz]ed|unauthori[sz]ed|not available in your (?:country|region)|unavailable in your (?:country|region)|too many requests|rate limit|limit of (?:pages|articles)|reached (?:your|the) limit|subscribe (?:or|to (?:read|continue))|subscribers? only|log ?in to|sign in|session (?:has |is )?(?:expired|timed out)|register to read",
    r"we use cookies|accept all|manage (?:choices|cookies|preferences)|cookie (?:settings|preferences|policy)|make a choice before|consent (?:to|before)|privacy choices",
    r"are you a (?:robot|human)|not a robot|unusual traffic|complete the (?:puzzle|captcha|check)|captcha|recaptcha|verify (?:that )?you are|checking (?:that )?your (?:connection|browser)|connection is secure|just a moment|ddos protection|security check",
    r"(?:enable|turn on|activate|allow|requires?|needs?) (?:javascript|scripts?|cookies)|javascript (?:is )?(?:disabled|off|required)|scripting is off|scripts? to run|noscript|blocked them|how to allow scripts|enable it|reload this page|browser (?:has|settings|is not supported)",
    r"javascript aktivieren|aktivieren sie javascript|seite (?:wurde )?nicht gefunden|zugriff verweigert|cookies? (?:akzeptieren|zulassen)|sitzung (?:ist )?abgelaufen|activer javascript|activez javascript|page introuvable|acc[eè]s refus[eé]|session (?:a )?expir[eé]|(?:active|activar|habilite) javascript|p[aá]gina no encontrada|acceso denegado|sesi[oó]n (?:ha )?(?:caducado|expirado)",
)


def _alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern outside groups."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(pattern):
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append(pattern[at:i])
            at = i + 1
    return [*out, pattern[at:]]


def _at_words(patterns: tuple[str, ...]) -> str:
    """All alternatives, those that begin with a letter or a group being tried at the beginnings of words only."""
    each = [a for p in patterns for a in _alternatives(p)]
    begin = [a for a in each if a[0].isalpha() or a[0] == "("]
    return rf"\b(?:{'|'.join(begin)})|" + "|".join(a for a in each if a not in begin)


NOTICE = re.compile(_at_words(NOTICES), re.I)
#: The same for lower case, which is faster.
_NOTICE_LOWER = re.compile(NOTICE.pattern)
#: A page of more words than this may be an article that several sites have: its template must come back so
#: many times a site, under other titles.
PAGE_WORDS, PAGE_TIMES = 60, 2
#: The share of a page's sentences that are notices, from which it is one.
NOTICE_SHARE = 0.5
#: The same if the title is a notice too; a short page needs none then.
NOTICE_TITLE_SHARE = 0.25
#: The words of the usual filler; a sentence mostly of these is filler.
FILLER = frozenset("lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum perspiciatis unde omnis iste natus error voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae ab illo inventore veritatis quasi architecto beatae vitae dicta explicabo nemo ipsam quia voluptas aspernatur aut odit fugit consequuntur magni dolores eos ratione sequi nesciunt".split())
FILLER_SHARE, FILLER_WORDS = 0.8, 4
#: A short page whose template comes back on so many sites is no article.
PAGE_SITES = 3
#: A slot is left blank if at least so many records share its template and this share of them fill it.
SLOT_RECORDS, SLOT_SHARE = 8, 0.9

#: A placeholder in one slot of so many texts is one that was left.
LEFT_TEXTS = 3
#: A name is a default if so many different texts have it in a slot, in which at least SLOT_RECORDS others
#: vary, none coming back more than a fifth as often and at least half of them being different.
DEFAULT_TEXTS, DEFAULT_TIMES, DEFAULT_VARY = 5, 5, 0.5

#: A text without any of these has no placeholder.
_MARKS = re.compile(r"[{}<>\[\]$%#@_]|XXXX|TK ")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_PARTS = re.compile(r"\s+[|–—-]\s+|:\s+")
_WORD = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"[0-9]")
_AROUND = ".,;:!?()[]\"'“”‘’«»"
#: Stand for a placeholder that is talked about, a name of a variable's kind, a placeholder that was left.
_SLOT, _OWN, _LEFT = "\x00", "\x01", "\x02"
#: Tags of HTML are no fillings; other bracketed words are, unless quoted.
_HTML = re.compile(r"</?(?:a|abbr|b|blockquote|br|cite|code|div|em|h[1-6]|i|img|li|mark|ol|p|pre|q|s|small|span|strong|sub|sup|table|td|tr|u|ul)(?:\s[^<>]*)?/?>", re.I)
_GROUP = re.compile(rf"(^|[^{QUOTES}])(\[[^\[\]\n]{{1,60}}\]|\{{[^{{}}\n]{{0,60}}\}}|<[^<>\n]{{1,60}}>)")
#: The words that variables and default fillings are named by; two of them are such a name.
_NAMING = "your|insert|company|firm|ticker|symbol|date|city|country|location|author|reporter|editor|person|first|last|full|name|title|headline|number|amount|price|value|percent|percentage|currency|here|placeholder|variable|field|text|sample|default"
_LABEL = re.compile(rf"\b(?:{_NAMING})(?:[ _-](?:{_NAMING}))+\b|\b(?:COMPANY|NAME|DATE|CITY|AMOUNT|NUMBER|TITLE|TICKER)\b|\b(?:Company|Your|Insert|First|City|Person|Author|Ticker)(?: (?:Name|Company|Here|Symbol))+\b")
#: Marked or joined words; cash tags, hash tags and at-names are ordinary.
_IDENTIFIER = re.compile(r"[{}<>|\\^~]|%%|[^\W_]_[^\W_]|^__?[^\W\d]|^%[^\W\d]+%?$|^[a-z]{3,}[A-Z][a-z]{2,}")
_MAIL = re.compile(r"\w@\w|^[@#]")


def placeholders(text: str) -> list[str]:
    """The unfilled slots of a text; those in quotes or back-ticks are talked about, not left."""
    if not _MARKS.search(text):
        return []
    return [m.group() for m in PLACEHOLDER.finditer(text) if not (m.start() and text[m.start() - 1] in QUOTES)]


def template(sentence: str) -> tuple[list[str], list[tuple[int, str, str]]]:
    """(the sentence's words less its fillings, its fillings as (gap, kind, text)).

    Fillings are numbers, placeholders, addresses, names (capitals after the first word) and whatever looks
    like a variable's name; side by side, of one kind and without a comma between they are one.  The gap is the
    number of words before; the kind is 'number', 'name', 'mixed' for letters with digits, 'own' for what
    looks like a variable's name, or 'left' for a placeholder out of quotes."""
    if _MARKS.search(sentence):
        sentence = PLACEHOLDER.sub(lambda m: _SLOT if m.start() and sentence[m.start() - 1] in QUOTES else _LEFT, sentence)
        sentence = _GROUP.sub(lambda m: m.group(1) + _OWN + "_".join(m.group(2).split()), _HTML.sub(" ", sentence))
    sentence = _LABEL.sub(lambda m: _OWN + "_".join(m.group().split()), sentence)
    words: list[str] = []
    fillings: list[tuple[int, str, str]] = []
    apart = False
    for k, token in enumerate(sentence.split()):
        bare = token.strip(_AROUND)
        if bare.islower() and bare.isalpha():
            words.append(bare)
            continue
        if _LEFT not in token and _OWN in token or _IDENTIFIER.search(bare) and "/" not in bare and not _MAIL.search(bare):
            kind = "own" if token[0] not in QUOTES else "name"
        elif not token.isascii() and any(map(str.isdigit, token)) or _DIGIT.search(token):
            kind = "mixed" if any(map(str.isalpha, bare)) else "number"
        elif _LEFT in token:
            kind = "left"
        elif _SLOT in token or "://" in token or ".example" in token or (k and bare[:1].isupper()):
            kind = "name"
        else:
            words.extend(_WORD.findall(bare.lower()))
            continue
        last = fillings[-1] if fillings else None
        if last and last[:2] == (len(words), kind) and kind != "mixed" and not apart:
            fillings[-1] = (*last[:2], f"{last[2]} {bare}")
        else:
            fillings.append((len(words), kind, bare))
        apart = token[-1] in ",;:"
    return words, fillings


def _shape(fillings: list[tuple[int, str, str]]) -> list[int]:
    """Per gap (gap + 1) · 256 + the number of its fillings; before these 1, if there are any."""
    per = Counter(f[0] for f in fillings)
    return [1, *((gap + 1) * 256 + min(k, 255) for gap, k in sorted(per.items()))] if per else []


def _line(kind: str, words: list[str], copy: int, shape=(), gaps=(), own=(), left=(), names=()) -> dict:
    return {"template": _hash(f"{kind} {' '.join(words)}" if kind else " ".join(words)), "copy": copy, "shape": list(shape), "gaps": list(gaps), "own": list(own), "left": list(left), "names": list(names), "head": bool(kind)}


def _lines(sentences: list[tuple[str, list[str], list[tuple[int, str, str]]]], title: str, text: str) -> list[dict]:
    """The whole sentences' templates with their slots' fillings.

    A sentence that begins with a name or a variable's name has a second template, in which that is a slot
    ('head').  Fillings that the row has elsewhere too are what it is about: they have no hash."""
    out, copy = [], _hash(text)
    for sentence, words, fillings in sentences:
        gaps = sorted({f[0] for f in fillings})
        own, left = (sorted({f[0] for f in fillings if f[1] == kind}) for kind in ("own", "left"))
        names = [(gap, name) for gap, kind, name in fillings if kind == "name" and _SLOT not in name]
        if words:
            named = [{"gap": gap, "name": _hash(name.lower())} for gap, name in names if text.count(name) < 2 and name not in title]
            out.append(_line("", words, copy, _shape(fillings), gaps, own, left, named))
        elif left:
            out.append(_line("\x00", [], copy, (), gaps, (), left))
        head = sentence.split()[0].strip(_AROUND)
        if 0 in own and words:
            out.append(_line("\x00", words, copy, (), [0], [0]))
        elif head[:1].isupper() and len(words) > 1 and 0 not in gaps:
            out.append(_line("\x00", words[len(_WORD.findall(head)) :], copy, (), [0]))
    return out


def _title_lines(title: str) -> list[dict]:
    """The same of the parts of a title that have a placeholder left."""
    parts = [template(p) for p in _PARTS.split(title) if p.strip()] if _MARKS.search(title) else []
    return [_line("\x03", words, _hash(title), (), sorted({f[0] for f in fillings}), (), sorted({f[0] for f in fillings if f[1] == "left"})) for words, fillings in parts if any(f[1] == "left" for f in fillings)]


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big", signed=True)


def _is_notice(sentence: str) -> bool:
    sentence = sentence.lower()
    if _NOTICE_LOWER.search(sentence):
        return True
    words = _WORD.findall(sentence)
    return len(words) >= FILLER_WORDS and sum(w in FILLER for w in words) >= FILLER_SHARE * len(words)


def _has_notices(sentences: list[str], share: float) -> bool:
    """Whether this share of the sentences are notices; read only until that is settled."""
    left = len(sentences) - share * len(sentences)
    for s in sentences:
        left -= not _is_notice(s.strip())
        if left < 0:
            return False
    return True


def listed(title: str, text: str, sentences: list[str]) -> str | None:
    """What the lists alone say of a record: 'mark' for a placeholder, 'notice' for a page of notices."""
    if placeholders(title) or placeholders(text):
        return "mark"
    short = len(text.split()) <= PAGE_WORDS
    if sentences:
        if _has_notices(sentences, NOTICE_SHARE):
            return "notice"
    else:  # the title of an empty page: what stands before the site's name
        head = re.split(r"\s+[|–—]\s+", title.strip())[0]
        if len(head.split()) <= 6 and NOTICE.search(head):
            return "notice"
    if title and len(title.split()) <= 6 and NOTICE.search(title) and (short or _has_notices(sentences, NOTICE_TITLE_SHARE)):
        return "notice"
    return None


def examine(title: str | None, text: str | None) -> tuple[str | None, int | None, bool, list[dict]]:
    """(what the lists say or None, hash of the page's template, whether the page is short, the templates of the
    sentences and of the title's parts)."""
    title, text = title or "", text or ""
    sentences = [s for s in _SENTENCE.split(text) if s.strip()]
    parsed = [(s, *template(s)) for s in sentences]
    page = _hash(" ".join(" ".join(words) for _, words, _ in parsed)) if parsed else None
    # The last sentence may be cut off, which is no blank slot.
    whole = [x for x in parsed if any(f[1] == "left" for f in x[2]) or x[0].rstrip()[-1:] in ".!?" and not x[0].rstrip().endswith("...")]
    return listed(title, text, sentences), page, len(text.split()) <= PAGE_WORDS, _lines(whole, title, text) + _title_lines(title)


_INTS = pa.list_(pa.int64())
_LINE = pa.struct([("template", pa.int64()), ("copy", pa.int64()), ("shape", _INTS), ("gaps", _INTS), ("own", _INTS), ("left", _INTS), ("names", pa.list_(pa.struct([("gap", pa.int64()), ("name", pa.int64())]))), ("head", pa.bool_())])
_SCHEMA = "article_id bigint, site string, listed string, page bigint, short boolean, title bigint, lines array<struct<template: bigint, copy: bigint, shape: array<bigint>, gaps: array<bigint>, own: array<bigint>, left: array<bigint>, names: array<struct<gap: bigint, name: bigint>>, head: boolean>>"
#: Reasons in the order they are given in: what alignment finds, then what the lists find alone.
REASONS = ("page", "slot", "blank", "mark", "notice")


def _batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        out = [examine(a, b) for a, b in zip(batch.column("title").to_pylist(), batch.column("text").to_pylist(), strict=True)]
        titles = [_hash(t or "") for t in batch.column("title").to_pylist()]
        arrays = [batch.column("article_id"), batch.column("site"), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.bool_()), pa.array(titles, pa.int64()), pa.array([o[3] for o in out], pa.list_(_LINE))]
        yield pa.RecordBatch.from_arrays(arrays, names=["article_id", "site", "listed", "page", "short", "title", "lines"])


def residue(articles: DataFrame) -> DataFrame:
    """(article_id, reason) of the rows that are no finished article; the reason is the first of REASONS:
    'page' for a whole page whose template comes back, 'slot' for a slot that keeps a name or a default and
    'blank' for an empty one, told by alignment with other records; 'mark' for a placeholder and 'notice' for a
    page of notices that nothing is aligned with.

    ``articles`` needs article_id, site, title and text; other columns are ignored.  A row whose text is
    only null or empty is none unless its title is a notice or has a slot.  Null sites count as one site.
    Repeated rows are judged each.  Only hashes of templates are shuffled, combined before the shuffle."""
    seen = materialize(articles.select("article_id", "site", "title", "text").mapInArrow(_batches, _SCHEMA))
    direct = seen.where("listed is not null").select("article_id", F.col("listed").alias("reason"))
    pages = seen.where("page is not null").select("page", F.coalesce("site", F.lit("")).alias("site"), "title", "short", "article_id")
    # An article that sites take from each other comes once a site, or again under its title.
    templates = pages.groupBy("page", "site").agg(F.countDistinct("title").alias("times"), F.bool_or("short").alias("short")).groupBy("page").agg(F.count("*").alias("sites"), F.sum("times").alias("times"), F.bool_or("short").alias("short"))
    templates = templates.where((F.col("sites") >= PAGE_SITES) & (F.col("short") | (F.col("times") >= PAGE_TIMES * F.col("sites")))).select("page")
    page = pages.join(templates, "page", "left_semi").select("article_id", F.lit("page").alias("reason"))
    # Whole sentences by template and filled slots: combined first, so a hot template is few rows.
    every = seen.select("article_id", "listed", F.explode("lines").alias("l")).select("article_id", "listed", "l.*")
    left = _left(every).select("article_id", F.lit("slot").alias("reason"))
    every = every.where("listed is null")
    lines = every.where("not head")
    counts = materialize(lines.groupBy("template", "shape").count())
    stats = counts.groupBy("template").agg(F.sum("count").alias("n")).where(F.col("n") >= SLOT_RECORDS)
    # By slot the most fillings that nearly all records have; a record with fewer has one left blank.
    filled = counts.select("template", "count", F.explode("shape").alias("s")).select("template", "count", F.expr("s div 256").alias("gap"), F.explode(F.expr("sequence(1, s % 256)")).alias("k"))
    slots = filled.groupBy("template", "gap", "k").agg(F.sum("count").alias("filled")).join(stats, "template").where(F.col("filled") >= SLOT_SHARE * F.col("n"))
    usual = slots.groupBy("template", "gap").agg(F.max("k").alias("k")).groupBy("template").agg(F.collect_list(F.expr("gap * 256 + k")).alias("usual"))
    blank = lines.join(usual, "template").where("exists(usual, u -> not exists(shape, s -> s div 256 = u div 256 and s >= u))").select("article_id", F.lit("blank").alias("reason"))
    named = _named(every).unionByName(_defaults(lines, stats)).select("article_id", F.lit("slot").alias("reason"))
    found = page.unionByName(left).unionByName(named).unionByName(blank).unionByName(direct)
    first = found.groupBy("article_id").agg(F.min(F.array_position(F.array(*map(F.lit, REASONS)), F.col("reason"))).alias("r"))
    return first.select("article_id", F.element_at(F.array(*map(F.lit, REASONS)), F.col("r").cast("int")).alias("reason"))


def _left(lines: DataFrame) -> DataFrame:
    """(article_id) of the lines whose slot keeps a placeholder in several texts of one template, or where others
    fill it."""
    some = materialize(lines.where("size(left) > 0").select("article_id", "copy", "template", F.explode("left").alias("gap")))
    again = some.groupBy("template", "gap").agg(F.countDistinct("copy").alias("n")).where(F.col("n") >= LEFT_TEXTS).select("template", "gap")
    filled = join_counted(lines.where("size(left) = 0"), some.select("template").distinct(), "template", "left_semi").select("template", F.explode("gaps").alias("gap"))
    others = filled.groupBy("template", "gap").count().where(F.col("count") >= SLOT_RECORDS).select("template", "gap")
    return some.join(again.unionByName(others).distinct(), ["template", "gap"], "left_semi").select("article_id")


def _named(lines: DataFrame) -> DataFrame:
    """(article_id) of the lines with a variable's name in a slot that nearly all others fill with something else.

    Few lines have one, so their templates are found first and all lines are held against these."""
    own = materialize(lines.where("size(own) > 0").select("article_id", "template", F.explode("own").alias("gap")))
    filled = join_counted(lines, own.select("template").distinct(), "template", "left_semi").select("template", F.expr("filter(gaps, g -> not array_contains(own, g))").alias("gaps"))
    per = filled.groupBy("template", "gaps").count()
    n = per.groupBy("template").agg(F.sum("count").alias("n"))
    proper = per.select("template", F.explode("gaps").alias("gap"), "count").groupBy("template", "gap").agg(F.sum("count").alias("proper"))
    slots = proper.join(n, "template").where((F.col("n") >= SLOT_RECORDS) & (F.col("proper") >= SLOT_SHARE * F.col("n"))).select("template", "gap")
    return own.join(slots, ["template", "gap"], "left_semi").select("article_id")


def _defaults(lines: DataFrame, stats: DataFrame) -> DataFrame:
    """(article_id) of the lines whose slot has a name that comes back in many texts while the others vary."""
    often = stats.where(F.col("n") >= SLOT_RECORDS + DEFAULT_TEXTS).select("template")
    names = materialize(join_counted(lines.where("size(names) > 0"), often, "template", "left_semi").select("article_id", "copy", "template", F.explode("names").alias("f")).select("article_id", "copy", "template", "f.*"))
    texts = names.groupBy("template", "gap", "name").agg(F.countDistinct("copy").alias("n"))
    top = texts.groupBy("template", "gap").agg(F.max(F.struct("n", "name")).alias("top")).where(F.col("top.n") >= DEFAULT_TEXTS)
    others = texts.join(top, ["template", "gap"]).where(F.col("name") != F.col("top.name")).groupBy("template", "gap", "top").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), F.max("n").alias("second"))
    default = others.where((F.col("n") >= SLOT_RECORDS) & (F.col("second") * DEFAULT_TIMES <= F.col("top.n")) & (F.col("kinds") >= DEFAULT_VARY * F.col("n"))).select("template", "gap", F.col("top.name").alias("name"))
    return names.join(default, ["template", "gap", "name"], "left_semi").select("article_id")
