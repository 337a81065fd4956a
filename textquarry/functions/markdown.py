"""Plain text to structured Markdown, by fixed rules.

``structure`` works on one text; ``markdown`` is the Arrow-batched column
function.  A text passes through three layers: the document (title, paragraphs,
table, rules between sections), the paragraph (the first of ``RULES`` that
applies decides its form), and the line (``Inline`` marks references, figures,
terms and abbreviations, remembering what it has marked).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: words, patterns and labels that results depend on -----------------------------
TERMS = (
    "qonunchilik respublika fuqarolik maʼmuriy harbiy qonun davlat xodim mehnat huquq shaxs sudya hujjat shart himoya aliment bekor rais organ zarar "
    "қонунчилик республика фуқаролик маъмурий ҳарбий қонун давлат ходим меҳнат ҳуқуқ шахс судья ҳужжат шарт ҳимоя алимент бекор раис орган зарар"
).split()
ABBREVIATIONS = {
    "ЖК": "Жиноят кодекси", "ФК": "Фуқаролик кодекси", "МК": "Маъмурий кодекс", "МЖ": "Меҳнат кодекси", "ИЖК": "Иқтисодий жиноятлар кодекси",
    "JK": "Jinoyat kodeksi", "FK": "Fuqarolik kodeksi", "MK": "Maʼmuriy kodeks", "MJ": "Mehnat kodeksi", "IJK": "Iqtisodiy jinoyatlar kodeksi",
}
LETTER = "A-Za-zʻʼʺ'А-Яа-яЁёЎўҚқҒғҲҳ"
CAPITAL = "A-ZʼʻʺА-ЯЁЎҚҒҲ"
CALLOUTS = ["эслатма", r"муҳим(?:\s+эслатма)?", "диққат", "эътибор беринг", "eslatma", r"muhim(?:\s+eslatma)?", "diqqat", "eʼtibor bering", "внимание", "важно", "примечание", "обратите внимание"]
DEFINITIONS = [r"deb\s+tushuniladi", r"деб\s+тушунилади", r"deb\s+topiladi", r"деб\s+топилади", "признаётся", "признается", r"понимается\s+как", "означает"]
ENUMERATORS = [
    r"во[-\s]первых", r"во[-\s]вторых", r"в[-\s]третьих", r"кроме\s+того", "также", "birinchidan", "ikkinchidan", "uchinchidan", "shuningdek", r"bundan\s+tashqari", r"shu\s+bilan\s+birga",
    "биринчидан", "иккинчидан", "учинчидан", "шунингдек", r"бундан\s+ташқари", r"шу\s+билан\s+бирга", "либо", "или", "yoki", "yoxud",
]
CHAPTER_WORD = r"bob|bo['ʻʼ]lim|боб|бўлим"
TABLE_HEAD, ARTICLE_LABEL, SUB_LETTERS, WARNING = ("Нарушение", "Санкция"), "Статья", "абвгдеж", "> ⚠️ "
REFERENCE = r"(часть\s+\d+\s+статьи\s+\d+|статья\s+\d+|статьи\s+\d+|\d+[-\s]?модда|\d+[-\s]?modda|закон\s*№\s*\d+|qonun\s*№\s*\d+)"
FIGURE = r"(?<![`\w])(?:\d{1,2}[./]\d{1,2}[./]\d{2,4}|\d{4}[-\s](?:йил|yil|году?|года)|\d+(?:[.,]\d+)?\s?%|\d[\d\s]{0,12}\d?\s?(?:so['ʻʼ]m|сўм|сум|у\.е\.|доллар|dollar))(?![\w`])"
CONSTRUCTS = r"(^#{1,3}\s+\S)|(^\s*[-*]\s+\S)|(^\s*\d+\.\s+\S)|(^\s*>\s*\S)|(\*\*[^*\n]+\*\*)|(^\s*\|.+\|\s*$)|(^\s*---\s*$)"
# ---------------------------------------------------------------------------------------------

_I = re.IGNORECASE
_constructs = re.compile(CONSTRUCTS, re.MULTILINE)
_title = re.compile(rf"^[\"«]?[{CAPITAL}][^.!?]{{3,79}}[\"»]?$")
_chapter = re.compile(rf"^(глава|раздел|{CHAPTER_WORD})\s+(\d+)\.?\s*(.*)$", _I)
_chapter_after = re.compile(rf"^(\d+)[-\s]({CHAPTER_WORD})\.?\s*(.*)$", _I)
_article = re.compile(r"^(статья\s+(\d+)|(\d+)[-\s]?модда|(\d+)[-\s]?modda)\.?\s*(.*)$", _I)
_row = re.compile(r"^(.{1,60}?)\s*[—–-]\s*(.{1,60})$")
_sentence = re.compile(rf"(?<=[{LETTER}][.!?])\s+(?=[{LETTER}0-9])")
_callout = re.compile(rf"^\s*(?:{'|'.join(CALLOUTS)})\s*[:!.,—-]*\s*", _I)
_definition = re.compile(rf"\b(?:{'|'.join(DEFINITIONS)})\b", _I)
_quoted = re.compile(r"[\"«]([^\"»]{20,})[\"»]")
_number = re.compile(r"(?:(?<=^)|(?<=\s))(\d{1,2})[.)]\s+")
_letter = re.compile(r"(?:(?<=^)|(?<=\s))([a-zа-яё])\)\s+", _I)
_enumerator = re.compile(rf"\b(?:{'|'.join(ENUMERATORS)})\b", _I)
_intro = re.compile(r"^([^:]{1,120}):\s*([^:]*)$")
_reference, _figure = re.compile(REFERENCE, _I), re.compile(FIGURE, _I)
_term = re.compile(rf"(?<![{LETTER}])(?:{'|'.join(sorted(TERMS, key=len, reverse=True))})[{LETTER}]*(?![{LETTER}])", _I)
_abbreviation = re.compile(rf"\b(?:{'|'.join(ABBREVIATIONS)})\b")


@dataclass
class Inline:
    """Marks of one paragraph or list; terms and abbreviations are marked once."""

    terms: set[str] = field(default_factory=set)
    short: set[str] = field(default_factory=set)

    def _once(self, seen: set[str], key: str, plain: str, marked: str) -> str:
        if key in seen:
            return plain
        seen.add(key)
        return marked

    def __call__(self, text: str) -> str:
        text = _reference.sub(r"`\g<0>`", text)
        text = _figure.sub(lambda m: f"`{m[0].strip()}`", text)
        text = _term.sub(lambda m: self._once(self.terms, m[0].lower(), m[0], f"**{m[0]}**"), text)
        return _abbreviation.sub(lambda m: self._once(self.short, m[0], m[0], f"**{m[0]}** ({ABBREVIATIONS[m[0]]})"), text)


def _between(pattern: re.Pattern, text: str, whole: bool) -> tuple[str, list[str]]:
    """What stands before the first match, and the parts after (or from) each match."""
    found = list(pattern.finditer(text))
    if not found:
        return text, []
    stops = [m.start() for m in found[1:]] + [len(text)]
    parts = [text[m.start() if whole else m.end() : stop].strip().rstrip(";,") for m, stop in zip(found, stops, strict=True)]
    return text[: found[0].start()].strip(), [p for p in parts if p]


def _listed(lead: str, items: list[str], numbered: bool) -> str:
    mark, lines = Inline(), []
    if lead:
        lines.append(mark(lead))
    for n, item in enumerate(items, 1):
        bullet = f"{n}. " if numbered else "- "
        subs = _between(_letter, item, False)[1] if numbered and len(_letter.findall(item)) > 1 else []
        if len(subs) < 2:
            lines.append(bullet + mark(item))
            continue
        lines.append(bullet + mark(_letter.split(item, maxsplit=1)[0].strip().rstrip(":")))
        for k, sub in enumerate(subs):
            name = SUB_LETTERS[k] if k < len(SUB_LETTERS) else str(k + 1)
            lines.append(f"    {name}) {mark(sub)}")
    return "\n".join(lines)


def chapter(p: str) -> str | None:
    if m := _chapter.match(p):
        head, rest = f"{m[1].capitalize()} {m[2]}", m[3]
    elif m := _chapter_after.match(p):
        head, rest = f"{m[1]}-{m[2].capitalize()}", m[3]
    else:
        return None
    return f"## {head}" + (f". {rest.strip()}" if rest.strip() else "")


def article(p: str) -> str | None:
    m = _article.match(p)
    if not m or _number.search(p[m.end(1) :]):
        return None
    rest = m[5].strip()
    return f"### {ARTICLE_LABEL} {m[2] or m[3] or m[4]}" + (f"\n\n{rest}" if rest else "")


def callout(p: str) -> str | None:
    m = _callout.match(p)
    rest = p[m.end() :].strip() if m and m[0].strip() else ""
    return WARNING + Inline()(rest) if rest else None


def quotation(p: str) -> str | None:
    m = _quoted.search(p)
    if _definition.search(p) or (m and len(_sentence.split(m[1])) > 1):
        return "> " + Inline()(p)
    return None


def numbered(p: str) -> str | None:
    if not _number.search(p):
        return None
    lead, items = _between(_number, p, False)
    return _listed(lead, items, True) if lead or items else None


def enumerated(p: str) -> str | None:
    if len(_enumerator.findall(p)) < 2:
        return None
    lead, items = _between(_enumerator, p, True)
    return _listed(lead, items, False) if len(items) + bool(lead) > 1 else None


def _short_items(text: str) -> bool:
    """Three or more parts between commas, of 60 characters at most, no colon or semicolon."""
    parts = text.removesuffix(".").split(",")
    return len(parts) > 2 and not set(":;") & set(text) and all(parts) and len(parts[0]) <= 60 and all(len(p.lstrip()) <= 60 for p in parts[1:])


def comma_list(p: str) -> str | None:
    m = _intro.match(p)
    lead, listed = (f"{m[1].strip()}:", m[2]) if m else ("", p)
    if not _short_items(listed):
        return None
    items = [x for x in (part.strip().rstrip(".") for part in listed.rstrip(".").split(",")) if x]
    return _listed(lead, items, False) if len(items) > 2 else None


#: In order; the first that gives a block decides.
RULES: tuple[Callable[[str], str | None], ...] = (chapter, article, callout, quotation, numbered, enumerated, comma_list, lambda p: Inline()(p))


def paragraphs(text: str, sentences_each: int = 2) -> list[str]:
    """Blank lines part paragraphs, else lines do, else every two sentences."""
    for mark in ("\n\n", "\n"):
        parts = [p.strip() for p in text.split(mark) if p.strip()]
        if mark in text.strip("\n" if mark == "\n" else "") and (len(parts) > 1 or (mark == "\n\n" and parts)):
            return parts
    found = [s.strip() for s in _sentence.split(text.strip()) if s.strip()]
    return [" ".join(found[k : k + sentences_each]) for k in range(0, len(found), sentences_each)]


def title_of(text: str) -> tuple[str, str]:
    """A first line that looks like a title, and the rest; else none and all."""
    first, _, rest = text.partition("\n")
    first = first.strip()
    usual = _title.match(first) and len(first.split()) <= 12
    other = any(p.match(first) for p in (_chapter, _chapter_after, _article, _row))
    return (first.strip("\"«»"), rest) if rest.strip() and usual and not other else ("", text)


def tabulated(parts: list[str]) -> list[str]:
    """The first run of three or more ``X — Y`` paragraphs as one table."""
    rows = [_row.match(p) for p in parts]
    at = 0
    while at < len(parts):
        end = at
        while end < len(parts) and rows[end]:
            end += 1
        if end - at > 2:
            lines = [TABLE_HEAD, ("---", "---"), *((m[1].strip(), m[2].strip()) for m in rows[at:end])]
            return [*parts[:at], "\n".join(f"| {a} | {b} |" for a, b in lines), *parts[end:]]
        at = end + 1
    return parts


def is_structured(text: str) -> bool:
    return sum(1 for _ in _constructs.finditer(text)) > 1


def structure(text: str | None) -> str:
    text = (text or "").strip()
    if not text or is_structured(text):
        return text
    title, body = title_of(text)
    blocks = [f"# {title}"] if title else []
    for p in tabulated(paragraphs(body)):
        block = p if p.startswith("| ") else next(b for b in (rule(p) for rule in RULES) if b is not None)
        if block.startswith("## ") and len(blocks) > bool(title):
            blocks.append("---")
        if block:
            blocks.append(block)
    return "\n\n".join(blocks)


@F.pandas_udf(T.StringType())
def markdown(texts: pd.Series) -> pd.Series:
    return texts.astype(object).where(texts.notna(), None).map(structure)


def line_kind(line):
    """Kind of a Markdown line, as a Column of the line."""
    kinds = [("h1", r"^# "), ("h2", r"^## "), ("h3", r"^### "), ("quote", r"^\s*>"), ("table", r"^\s*\|.*\|\s*$"), ("rule", r"^\s*---\s*$"), ("sub-list", r"^\s{2,}(?:[-*]|\S+\))\s"), ("list", r"^\s*(?:[-*]|\d+\.)\s")]
    out = F.when(F.trim(line) == "", F.lit("blank"))
    for name, pattern in kinds:
        out = out.when(line.rlike(pattern), F.lit(name))
    return out.otherwise(F.lit("para"))


def inline_spans(line):
    """Bold and code spans of a line, with their marks."""
    return F.regexp_extract_all(line, F.lit(r"\*\*[^*]+\*\*|`[^`]+`"), F.lit(0))
