"""Token ids of whole texts, as the tokenizers library gives them, with each distinct pre-token merged once."""

from __future__ import annotations

from array import array
from functools import cache

import numpy as np

from corpusloom.batching import give_back
from corpusloom.llm.pretokens import Pretokenizer, chunks, load_tokenizer

#: Pre-tokens whose ids a worker keeps; beyond it the store starts anew.  It bounds memory, not results.
KEPT_WORDS = 200_000


class TokenIds:
    """Ids of texts from ``tokenizers``; ``dtype`` is the smallest that holds every id."""

    def __init__(self, name: str) -> None:
        self.tokenizer = load_tokenizer(name)
        self.model = self.tokenizer.model
        self.pre = Pretokenizer(self.tokenizer)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 65536 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.kept: dict[str, bytes] = {}
        self.alphabet = self.byte_alphabet()

    @staticmethod
    def byte_alphabet() -> dict[int, str]:
        """Which character stands for each byte, read off the library's byte-level pre-tokenizer."""
        from tokenizers.pre_tokenizers import ByteLevel

        level = ByteLevel(add_prefix_space=False, use_regex=False)
        found = {}
        for c in [*range(128), *range(128, 0x3000), *range(0x3000, 0xD800, 0x40), *range(0xE000, 0x110000, 0x1000)]:
            found |= zip(chr(c).encode(), level.pre_tokenize_str(chr(c))[0][0], strict=True)
        return found

    def forget(self) -> None:
        """Empty the store of words, which an idle worker needs not hold."""
        self.kept = {}
        give_back()

    def word(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.alphabet)
        return array(self.code, [t.id for t in self.model.tokenize(word)]).tobytes()

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        """One array of ids for each text; a null text has none."""
        out: list[np.ndarray] = [np.empty(0, self.dtype)] * len(texts)
        plain: list[int] = []
        for i, text in enumerate(texts):
            if text and self.pre.odd(text):
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)
            elif text:
                plain.append(i)
        got: dict[int, list[np.ndarray]] = {}
        for part, owner in chunks([texts[i] for i in plain]):
            for k, ids in zip(owner, self._chunk(part), strict=True):
                got.setdefault(k, []).append(ids)
        for k, arrays in got.items():
            out[plain[k]] = arrays[0] if len(arrays) == 1 else np.concatenate(arrays)
        return out

    def _chunk(self, texts: list[str]) -> list[np.ndarray]:
        pieces = self.pre.split(texts)
        kept = self.kept
        if len(kept) > KEPT_WORDS:
            kept.clear()
        found = list(map(kept.get, pieces.words))
        for i, (w, ids) in enumerate(zip(pieces.words, found, strict=True)):
            if ids is None:
                found[i] = kept[w] = self.word(w)
        flat = np.frombuffer(b"".join(found), self.dtype)
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        head = np.cumsum(size) - size
        each = size[pieces.which]
        ids = flat[np.repeat(head[pieces.which] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))]
        ends = np.cumsum(np.bincount(pieces.doc, weights=each, minlength=len(texts)).astype(np.int64))
        return np.split(ids, ends[:-1])


@cache
def shared_ids(name: str) -> TokenIds:
    """One ``TokenIds`` for a worker, which serves task after task, so that its file is read once."""
    return TokenIds(name)
