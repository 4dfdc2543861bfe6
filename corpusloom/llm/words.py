"""Lower-case ASCII-cased words of Arrow columns of texts, by array operations on their bytes.

A word is a longest stretch of digits, ASCII letters and characters beyond ASCII; only A-Z are lower-cased.  In UTF-8 every
byte of a character beyond ASCII is 0x80 or more, so bytes alone tell words from what lies between them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The same words as a pattern for the JVM.
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _table() -> np.ndarray:
    """What each byte stands as in a word; 0 if it is in none."""
    octets = np.arange(256, dtype=np.uint8)
    inside = (octets >= 0x80) | np.isin(octets, np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8))
    capital = (octets >= ord("A")) & (octets <= ord("Z"))
    return np.where(inside, np.where(capital, octets + 32, octets), 0).astype(np.uint8)


TABLE = _table()


@dataclass
class Words:
    """Words of all texts on end: ``values`` (binary), how many of each text, and where they lie in ``raw``, the texts' bytes on
    end, of which text i begins at ``origin[i]``."""

    values: pa.BinaryArray
    per_text: np.ndarray
    begins: np.ndarray
    sizes: np.ndarray
    raw: np.ndarray
    origin: np.ndarray

    @property
    def text(self) -> np.ndarray:
        """Which text each word is of."""
        return np.repeat(np.arange(len(self.per_text)), self.per_text)


def words_of(column: pa.Array) -> Words:
    """A null text has no words."""
    held = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
    body = held.buffers()[2]
    raw = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and len(held) else np.empty(0, np.uint8)
    origin = offsets - offsets[0]
    code = TABLE[raw]
    inside = code != 0
    head = inside.copy()
    head[1:] &= ~inside[:-1]
    starts = origin[:-1][origin[:-1] < len(raw)]  # no word spans two texts
    head[starts] = inside[starts]
    begins = np.flatnonzero(head)
    kept = code[inside]
    at = np.append(np.cumsum(inside)[begins] - 1, len(kept)).astype(np.int32)
    values = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(at), pa.py_buffer(kept)])
    return Words(values, np.diff(np.searchsorted(begins, origin)), begins, np.diff(at), raw, origin)
