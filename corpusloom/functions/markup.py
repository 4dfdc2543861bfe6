"""Markup without what acts: a tokenizer that reads tags and their attributes, and hands on the rest as it is.

Elements that act or frame go with all they hold, to their closing tag or, unclosed, to the end of the text; stray closing tags of
theirs go too.  Attributes that name an event go, whatever parts them from what stands before.  Addresses are judged as a browser
reads them, with character references resolved and without blanks and controls; those of a script become ``#``.
"""

from __future__ import annotations

import html
from collections.abc import Iterator

# Elements that go, attributes that hold an address, and what addresses may not begin with.
ACTING = ("script", "style", "iframe", "object", "embed", "applet", "form", "link", "meta", "base")
ADDRESSES = ("href", "src", "xlink:href", "action", "formaction")
SCHEMES = ("javascript:", "vbscript:", "data:")

BLANKS = " \t\r\n\f\v"


def skip(text: str, at: int, those: str = BLANKS) -> int:
    """The first place from ``at`` that holds none of ``those``."""
    while at < len(text) and text[at] in those:
        at += 1
    return at


def until(text: str, at: int, those: str) -> int:
    """The first place from ``at`` that holds one of ``those``, or the end."""
    while at < len(text) and text[at] not in those:
        at += 1
    return at


def tag_at(text: str, at: int) -> tuple[bool, str, int] | None:
    """(closing, name, place behind the name) of a tag that begins at ``at``; None if none does."""
    spot = skip(text, at + 1)
    closing = text.startswith("/", spot)
    spot = skip(text, spot + 1) if closing else spot
    end = spot
    while end < len(text) and (text[end].isalnum() or text[end] in "_:"):
        end += 1
    return (closing, text[spot:end].lower(), end) if end > spot and text[spot].isalpha() else None


def closed(text: str, name: str, at: int) -> int:
    """The place behind the next closing tag of ``name``, or the end."""
    while (at := text.find("<", at)) != -1:
        tag = tag_at(text, at)
        if tag and tag[:2] == (True, name) and text.startswith(">", spot := skip(text, tag[2])):
            return spot + 1
        at += 1
    return len(text)


def attributes(text: str, at: int) -> Iterator[tuple[str, str, str | None, int]]:
    """(all of it with what stands before, name, value, place behind it) up to the tag's end."""
    while True:
        start, at = at, skip(text, at, BLANKS + "/")
        if at >= len(text) or text[at] == ">":
            return
        end = until(text, at + 1, BLANKS + "/>=")
        name, value, spot = text[at:end].lower(), None, skip(text, end)
        if text.startswith("=", spot):
            spot = skip(text, spot + 1)
            quote = text[spot : spot + 1]
            if quote and quote in "\"'":
                close = text.find(quote, spot + 1)
                close = len(text) if close == -1 else close
                value, end = text[spot + 1 : close], min(close + 1, len(text))
            else:
                end = until(text, spot, BLANKS + ">")
                value = text[spot:end]
        yield text[start:end], name, value, end
        at = end


def acts(value: str) -> bool:
    """Whether an address runs something."""
    return "".join(c for c in html.unescape(value) if c > " " and not "\x7f" <= c <= "\x9f").lower().startswith(SCHEMES)


def scrub(text: str | None) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    while (lead := text.find("<", at)) != -1:
        out.append(text[at:lead])
        tag = tag_at(text, lead)
        if tag is None:
            out.append("<")
            at = lead + 1
            continue
        closing, name, at = tag
        if name in ACTING:
            spot = text.find(">", at)
            at = (len(text) if spot == -1 else spot + 1) if closing else closed(text, name, at)
            continue
        out.append(text[lead:at])
        for whole, attribute, value, end in attributes(text, at):
            at = end
            if attribute[:2] == "on" and attribute[2:3].isalpha():
                continue
            if attribute in ADDRESSES and value is not None and acts(value):
                whole = f' {attribute}="#"'
            out.append(whole)
    out.append(text[at:])
    return "".join(out)
