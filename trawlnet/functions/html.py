"""Lenient HTML: an event stream, text nodes, links with base and robots flags, titles, entities.

Functions of strings, and column functions over Arrow batches for what built-in functions can't express.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from html.entities import name2codepoint
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_NAME = r"[A-Za-z_:][A-Za-z0-9_:.-]*"
_ATTR = re.compile(rf"\s+({_NAME})(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)))?")
_START = re.compile(rf"<({_NAME})((?:{_ATTR.pattern.replace('(?:', '(?:').replace('(' + _NAME + ')', _NAME)})*)\s*(/?)>")
_END = re.compile(rf"</({_NAME})[^>]*>")
_PI = re.compile(rf"<\?\s?({_NAME})(.*?)\?>", re.S)
_OTHER = re.compile(r"<([^>]*)>")
_OPENS = re.compile(r"<(?=[^\s<&>])")
#: Elements whose content is skipped.
SKIPPED = ("script", "style", "textarea")


class Event(NamedTuple):
    kind: str
    name: str
    attrs: dict[str, str]


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in _ATTR.finditer(text)}


def events(html: str, skip: tuple[str, ...] = SKIPPED) -> Iterator[Event]:
    """HTML1-HTML5: text, tag, endtag, pi and comment events in order."""
    at, n, start = 0, len(html), 0
    while at < n:
        m = _OPENS.search(html, at)
        cut = m.start() if m else n
        if cut > at:
            yield Event("text", html[at:cut], {})
        if not m:
            return
        at = cut
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            if end < 0:
                yield Event("text", html[at:], {})
                return
            yield Event("comment", html[at + 4 : end], {})
            at = end + 3
        elif m := _START.match(html, at):
            name, empty = m[1].lower(), bool(m[m.re.groups])
            yield Event("tag", name, _attributes(m[2]))
            at = m.end()
            if empty:
                yield Event("endtag", name, {})
            elif name in skip:
                end = re.compile(rf"</{name}[^>]*>", re.I).search(html, at)
                if not end:
                    return
                yield Event("endtag", name, {})
                at = end.end()
        elif m := _END.match(html, at):
            yield Event("endtag", m[1].lower(), {})
            at = m.end()
        elif m := _PI.match(html, at):
            yield Event("pi", m[1].lower(), _attributes(m[2]))
            at = m.end()
        elif html.startswith("<!", at) and (m := _OTHER.match(html, at)):
            yield Event("tag", m[1], {})
            at = m.end()
        else:
            following = _OPENS.search(html, at + 1)
            if html.find(">", at) < 0 or not following:
                yield Event("text", html[at:], {})
                return
            start = following.start()
            yield Event("text", html[at:start], {})
            at = start


_ENTITY = re.compile(r"&(?:#(\d+)|#x([0-9A-Fa-f]+)|([A-Za-z][A-Za-z0-9]*));?")


#: ENT1: the named entities of HTML 4. ENT2: those of letters and digits; all others are a space.
ENTITIES = {name: chr(code) for name, code in name2codepoint.items()}
WORD_ENTITIES = {name: c if c.isalnum() else " " for name, c in ENTITIES.items()}


def decode_entities(text: str, known: Mapping[str, str] = ENTITIES) -> str:
    """ENT1: the entities of ``known`` and numeric ones; unknown names stay."""

    def one(m: re.Match) -> str:
        if m[3]:
            return known.get(m[3], m[0])
        code = int(m[1] or m[2], 10 if m[1] else 16)
        return "" if code == 0 else chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"

    return _ENTITY.sub(one, text) if "&" in text else text


def text_nodes(html: str, known: Mapping[str, str] | None = ENTITIES) -> list[str]:
    """HTML6, FLT9: text nodes, left-stripped, that aren't blank, decoded by ``known`` (None: left as they are)."""
    found = (e.name.lstrip(" \t\n\v\f\r\0") for e in events(html) if e.kind == "text")
    return [t if known is None else decode_entities(t, known) for t in found if t]


_LINKS = {"a": "href", "link": "href", "area": "href", "iframe": "src", "frame": "src"}
_ROBOTS = {"follow": ("follow", True), "nofollow": ("follow", False), "index": ("index", True), "noindex": ("index", False)}


def extract_links(html: str) -> dict[str, Any]:
    """HTML9-HTML11: distinct raw links in order, the last base, and the robots flags."""
    out: dict[str, Any] = {"links": {}, "base": "", "index": True, "follow": True}
    for e in events(html):
        if e.kind != "tag":
            continue
        if e.name in _LINKS and e.attrs.get(_LINKS[e.name]):
            out["links"][e.attrs[_LINKS[e.name]]] = None
        elif e.name == "base" and "href" in e.attrs:
            out["base"] = e.attrs["href"]
        elif e.name == "meta" and e.attrs.get("name", "").lower() == "robots":
            for word in e.attrs.get("content", "").lower().split(","):
                word = word.strip()
                if word in ("all", "none"):
                    out["index"] = out["follow"] = word == "all"
                elif word in _ROBOTS:
                    key, value = _ROBOTS[word]
                    out[key] = value
    return out | {"links": list(out["links"])}


def page_title(html: Column) -> Column:
    """HTML8: the raw title."""
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title", 1)


def text_nodes_of(html: Column, known: Mapping[str, str] | None = ENTITIES) -> Column:
    @F.pandas_udf("array<string>")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else text_nodes(x, known))

    return f(html)


def links_of(html: Column) -> Column:
    @F.pandas_udf("links array<string>, base string, `index` boolean, follow boolean")
    def f(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract_links(x or "") for x in s], columns=["links", "base", "index", "follow"])

    return f(html)


def decoded(text: Column, known: Mapping[str, str] = ENTITIES) -> Column:
    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else decode_entities(x, known))

    return f(text)


def events_of(html: Column, skip: tuple[str, ...] = SKIPPED) -> Column:
    """UX2: the events of a page; ``name`` holds the text of text and comment events."""

    @F.pandas_udf("array<struct<kind:string,name:string,attrs:map<string,string>>>")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else [e._asdict() for e in events(x, skip)])

    return f(html)
