"""What a query string asks for, worked out on the driver."""

from __future__ import annotations

import re
import unicodedata


def _folding() -> dict[str, str]:
    """Latin small letters with a mark to the letter alone, and combining marks to nothing."""
    bases = {chr(c).lower(): unicodedata.normalize("NFD", chr(c))[0].lower() for c in range(0xC0, 0x250)}
    return {c: base for c, base in bases.items() if len(c) == 1 and base.isascii() and base.isalpha()} | {chr(c): "" for c in range(0x300, 0x370)}


FOLDING = _folding()

QUOTED = re.compile(r'"([^"]+)"')
IDENTIFIER = re.compile(r"[\w./\\-]*[/.\\_][\w./\\-]*")
TOKEN = re.compile(r"[^\W_]+")
TERM = re.compile(r"[A-Za-z0-9_]{3,}")
EDGES = ".,;:!?()[]{}"


def folded(text: str) -> str:
    """Small letters without diacritics, as the index has them."""
    return "".join(FOLDING.get(c, c) for c in text.lower())


def phrases(query: str) -> list[list[str]]:
    """Phrases of index tokens: quoted stretches, then the other words, each split where the index splits it.

    Every word becomes a phrase, so no punctuation can disable the query; repeated phrases stay.
    """
    parts = [*QUOTED.findall(query), *(w.strip(EDGES) for w in QUOTED.sub(" ", query).split())]
    found = [TOKEN.findall(folded(p)) for p in parts]
    return [p for p in found if p]


def is_exact(query: str) -> bool:
    """Whether the query has a quoted phrase or a word that looks like an identifier."""
    if QUOTED.search(query):
        return True
    return any(len(w) > 2 and IDENTIFIER.fullmatch(w) for w in (w.strip(EDGES) for w in query.split()))


def as_exact(query: str) -> str:
    return query if QUOTED.search(query) else f'"{query}"'


def terms(query: str) -> list[str]:
    return list(dict.fromkeys(t.lower() for t in TERM.findall(query)))


def clamp(limit: int | None, default: int = 20, most: int = 50) -> int:
    return max(1, min(most, default if limit is None else limit))


def is_hosted_model(name: str, marker: str = "cloud") -> bool:
    """Whether a model tag (after the last colon) names a hosted model."""
    tag = name.rsplit(":", 1)[-1].lower() if ":" in name else ""
    return tag == marker or tag.endswith(f"-{marker}")
