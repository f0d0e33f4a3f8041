"""Wiki markup to the text a reader sees, and to running prose.

Two views of one markup string, both plain functions used inside Arrow
batches:

* :func:`visible_text` keeps every word the rendered page shows (headings,
  lists, table cells, quotations, shown link text) and drops templates,
  references, comments, category links and tags.
* :func:`prose_blocks` keeps only running text: no headings, tables,
  templates, lists of bare page names, category links, references, comments.

Defined results for odd input: ``None`` and ``""`` give empty output; an
unclosed comment hides the rest of the text (as a wiki renderer does); an
unclosed template hides its own line only; an unclosed table hides the lines
that start with table marks; an unclosed reference hides nothing but its tag.
"""

from __future__ import annotations

import html
import re
import unicodedata

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_REF = re.compile(r"<ref\b[^<>]*?/>|<ref\b[^<>/]*>(?:(?!<ref\b).)*?</ref\s*>", re.S | re.I)
_PARAM = re.compile(r"\{\{\{[^{}]*\}\}\}")
_TEMPLATE = re.compile(r"\{\{[^{}]*\}\}")
_OPEN_TEMPLATE = re.compile(r"\{\{[^{}\n]*")
_NOWIKI = re.compile(r"<nowiki\s*>(.*?)</nowiki\s*>", re.S | re.I)
_HIDDEN_TAG = re.compile(r"<(math|gallery|timeline|score|syntaxhighlight|source)\b[^<>]*>.*?</\1\s*>", re.S | re.I)
_INLINE_TAG = re.compile(r"</?(?:b|i|u|s|sub|sup|small|big|span|em|strong|tt|code|font|abbr|nowiki)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_LINK = re.compile(r"\[\[([^\[\]]*)\]\]")
_EXT = re.compile(r"\[(?:https?:|ftp:|mailto:)?//[^\s\]]*\s*([^\]]*)\]|\[(?:https?|ftp|mailto):[^\s\]]*\s*([^\]]*)\]")
_QUOTES = re.compile(r"'{2,}")
_CELL_ATTR = re.compile(r'^[^|\[\]]*=\s*"[^"]*"[^|\[\]]*\|(?!\|)')
WORD = re.compile(r"[^\W_]+")

# fixed values: namespace names of categories and media files in the ten languages
CATEGORY_NAMES = frozenset(
    "category kategorie catégorie categoría categoria categorie kategori kategoria категория".split()
)
FILE_NAMES = frozenset("file image datei bild fichier archivo imagen immagine bestand afbeelding ficheiro imagem fil plik grafika файл изображение".split())
# fixed values: templates that set off quoted text
QUOTE_NAMES = frozenset("quote blockquote cquote quotation zitat cita citazione citação citaat citat cytat цитата".split())
_QUOTE_HINT = re.compile(r"\{\{\s*(?:" + "|".join(sorted(QUOTE_NAMES)) + r")\s*\|", re.I)
_BAR = re.compile(r"\|(?![^\[\]]*\]\])")
_NAMED = re.compile(r"^\s*([\w ]+?)\s*=")
_REDIRECT = re.compile(r"^\s*#\s*[^\W\d_]+\s*:?\s*\[\[", re.I)


def _shown(m: re.Match) -> str:
    body = m[1]
    if ":" in body:
        ns = body.split(":", 1)[0].strip().lower()
        if ns in CATEGORY_NAMES or unicodedata.normalize("NFC", ns) in CATEGORY_NAMES:
            return ""
        if ns in FILE_NAMES:
            return " " + body.rpartition("|")[2] + " " if "|" in body else ""
    return body.rpartition("|")[2] if "|" in body else body


def _quoted(m: re.Match) -> str:
    """The text a quotation template shows; nothing for any other template."""
    name, *args = _BAR.split(m[0][2:-2])
    if name.strip().lower() not in QUOTE_NAMES:
        return ""
    named = {n[1].lower(): a[n.end() :] for a in args if (n := _NAMED.match(a))}
    plain = [a for a in args if not _NAMED.match(a)]
    text = next((named[k] for k in ("text", "quote", "1") if k in named), plain[0] if plain else "")
    return f" {text} "


def _strip_hidden(t: str, quotes: bool = False) -> str:
    """Comments, references, parameters, templates (``quotes``: show quoted text)."""
    if "<" in t:
        if "<!--" in t:
            t = _COMMENT.sub("", t)
        if "<ref" in t or "<REF" in t or "<Ref" in t:
            t = _REF.sub("", t)
    if "{{" in t:
        if "{{{" in t:
            t = _PARAM.sub("", t)
        show = _quoted if quotes and _QUOTE_HINT.search(t) else ""
        n = 1
        while n:
            t, n = _TEMPLATE.subn(show, t)
        if "{{" in t:
            t = _OPEN_TEMPLATE.sub("", t)
    return t


def _strip_inline(t: str) -> str:
    """Links by shown text, quotes, tags, entities."""
    n = 1 if "[[" in t else 0
    while n:
        t, n = _LINK.subn(_shown, t)
    if "//" in t or "mailto:" in t:
        t = _EXT.sub(lambda m: m[1] or m[2] or "", t)
    if "''" in t:
        t = _QUOTES.sub("", t)
    if "<" in t:
        t = _HIDDEN_TAG.sub(" ", t)
        t = _INLINE_TAG.sub("", t)
        t = _TAG.sub(" ", t)
    if "&" in t:
        t = html.unescape(t)
    return t


def _hold_nowiki(t: str) -> tuple[str, list[str]]:
    held: list[str] = []

    def hold(m: re.Match) -> str:
        held.append(m[1])
        return f"\x00{len(held) - 1}\x01"

    return _NOWIKI.sub(hold, t), held


def _give_back(t: str, held: list[str]) -> str:
    return re.sub(r"\x00(\d+)\x01", lambda m: html.unescape(held[int(m[1])]), t) if held else t


def visible_text(text: str | None) -> str:
    """All words of the rendered page, in page order, NFC, case kept."""
    if not text:
        return ""
    held: list[str] = []
    if "<nowiki" in text:
        text, held = _hold_nowiki(text.replace("\x00", " "))
    t = _strip_hidden(text, quotes=True)
    if "{|" in t or "\n|" in t or "\n!" in t:
        out = []
        for line in t.split("\n"):
            s = line.lstrip()
            if s[:2] in ("{|", "|}", "|-"):
                s = s[2:] if s[:2] == "|}" else ""
            elif s[:2] == "|+":
                s = s[2:]
            elif s[:1] in ("|", "!"):
                cells = re.split(r"\|\||!!" if s[0] == "!" else r"\|\|", s[1:])
                s = " ".join(_CELL_ATTR.sub("", c) for c in cells)
            out.append(s if s else "")
        t = "\n".join(out)
    t = _give_back(_strip_inline(t), held)
    return t if t.isascii() else unicodedata.normalize("NFC", t)


def words(text: str | None) -> list[str]:
    """Case-folded runs of letters or digits of the visible text."""
    return WORD.findall(visible_text(text).lower())


def plain_words(text: str | None) -> list[str]:
    """Words of a text that carries no markup, normalised alike."""
    return WORD.findall(unicodedata.normalize("NFC", html.unescape(text or "")).lower())


def prose_blocks(text: str | None) -> list[str]:
    """Lines of running prose, in page order.

    A list line counts when anything besides links and punctuation is on it;
    headings, table lines, bare-link lines, redirects and category lines don't.
    """
    if not text or _REDIRECT.match(text):
        return []
    held: list[str] = []
    if "<nowiki" in text:
        text, held = _hold_nowiki(text.replace("\x00", " "))
    t = _strip_hidden(text)
    keep = []
    for line in t.split("\n"):
        s = line.strip()
        if not s or s[0] in "|!" or s[:2] == "{|" or (s[0] == "=" and s[-1] == "="):
            continue
        if s[0] in "*#:;":
            s = s.lstrip("*#:; \t")
            if not WORD.search(_LINK.sub("", s)):
                continue
        elif s[0] == "[" and not WORD.search(_LINK.sub("", s)):
            continue
        keep.append(s)
    if not keep:
        return []
    t = _give_back(_strip_inline("\n".join(keep)), held)
    if not t.isascii():
        t = unicodedata.normalize("NFC", t)
    return [b for b in t.split("\n") if b and not b.isspace()]
