"""A scanner of HTML: text, tags with attributes, raw text, comments and character references, over Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose content is text up to their own end tag; that of the first ones is not even decoded.
RAW = {"script", "style", "xmp", "iframe", "noembed", "noframes"}
DECODED = {"title", "textarea"}
#: Elements that have no visible text.
HIDDEN = {"script", "style", "noscript", "template"}
#: Tags that break a line: these as they come, the others as they end.
BREAKS, BREAKS_AT_END = {"br"}, {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "tr", "title"}
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
#: One attribute: its name, then a value in double or single quotes or none; a quote that is never closed takes all.
_ATTRIBUTE = re.compile(r"""[\s/]*(=?[^\s/>=]*)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s>"'][^\s>]*)?))?""")
_COMMENT_END = re.compile(r"--!?>")
_SPACE = re.compile(r"\s+")
_CLOSED = re.compile(r"&(?:#(?:[0-9]+|[xX][0-9a-fA-F]+)|[A-Za-z][A-Za-z0-9]*);")


def closed_references(text: str) -> str:
    """``text`` with those character references decoded that end in a semicolon; HTML also knows "&amp" and the like without."""
    return _CLOSED.sub(lambda m: unescape(m[0]) if m[0][1] == "#" else html5.get(m[0][1:], m[0]), text)


def _tag(html: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes of the tag whose name ends at ``at``, the first of equal names, and the place behind its ">"; -1 without one."""
    found: dict[str, str] = {}
    while at < len(html) and html[at] != ">":
        m = _ATTRIBUTE.match(html, at)
        if m.end() == at:
            at += 1
            continue
        if m[1]:
            found.setdefault(m[1].lower(), unescape(next((v for v in m.group(2, 3, 4) if v is not None), "")))
        at = m.end()
    return found, at + 1 if at < len(html) else -1


def scan(html: str, decode: Callable[[str], str] = unescape) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(kind, value, attributes) in order: ("text", decoded text), ("raw", text as it is), ("start" or "end", name), ("comment", text).

    What looks like a tag and is none stays text; a tag or comment that the document ends in is dropped.
    """
    at = 0
    while at < len(html):
        opened = html.find("<", at)
        while opened >= 0 and not re.match(r"[A-Za-z/!?]", html[opened + 1 : opened + 2]):
            opened = html.find("<", opened + 1)
        if opened < 0:
            yield "text", decode(html[at:]), {}
            return
        if opened > at:
            yield "text", decode(html[at:opened]), {}
        if html.startswith("<!--", opened):
            short = re.compile(r"-?>").match(html, opened + 4)
            end = short or _COMMENT_END.search(html, opened + 4)
            if not end:
                return
            yield "comment", "" if short else html[opened + 4 : end.start()], {}
            at = end.end()
            continue
        close = html[opened + 1] == "/"
        name = _NAME.match(html, opened + 1 + close)
        if not name:  # a declaration, or a comment in all but name
            end = html.find(">", opened)
            if end < 0:
                return
            at = end + 1
            continue
        attributes, at = _tag(html, name.end())
        if at < 0:
            return
        tag = name[0].lower()
        yield "end" if close else "start", tag, {} if close else attributes
        if not close and tag in RAW | DECODED:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            content = html[at : end.start() if end else len(html)]
            if content:
                yield ("text", decode(content), {}) if tag in DECODED else ("raw", content, {})
            at = end.start() if end else len(html)


def visible(html: str, decode: Callable[[str], str] = unescape) -> str:
    """The text of a document without hidden elements, with white space collapsed; a line's end is a space."""
    out, hidden = [], []
    for kind, value, _ in scan(html, decode):
        if hidden:
            if kind == "start" and value == hidden[-1]:
                hidden.append(value)
            elif kind == "end" and value == hidden[-1]:
                hidden.pop()
        elif kind == "start" and value in HIDDEN:
            hidden.append(value)
        elif kind == "text" or kind == "raw":
            out.append(value)
        elif (kind == "start" and value in BREAKS) or (kind == "end" and value in BREAKS | BREAKS_AT_END):
            out.append(" ")
    return _SPACE.sub(" ", "".join(out)).strip()


def visible_text(html: Column, closed: bool = False) -> Column:
    """``visible`` of a column; null is empty.  With ``closed``, character references count only with their semicolon."""
    decode = closed_references if closed else unescape

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([visible(t, decode) for t in texts.fill_null("").to_pylist()], pa.string())

    return run(html.cast("string"))


def meta(html: str) -> dict[str, str]:
    """The contents of meta elements by property or name, and of link elements by rel as "link:..", the first of each."""
    found: dict[str, str] = {}
    for kind, value, own in scan(html):
        if kind == "start" and value == "meta" and own.get("content"):
            found.setdefault((own.get("property") or own.get("name") or "").lower(), own["content"])
        elif kind == "start" and value == "link" and own.get("href"):
            for rel in own.get("rel", "").lower().split():
                found.setdefault(f"link:{rel}", own["href"])
    found.pop("", None)
    return found


def metadata(html: Column) -> Column:
    """``meta`` of a column as map<string, string>."""

    @F.arrow_udf("map<string,string>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([list(meta(t).items()) for t in texts.fill_null("").to_pylist()], pa.map_(pa.string(), pa.string()))

    return run(html.cast("string"))
