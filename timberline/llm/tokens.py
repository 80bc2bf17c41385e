"""Token ids of whole texts with a ready-made byte-pair tokenizer, at word-cache speed.

Both tokenizers used here cut a text into words before they merge bytes, so the ids of a text are the ids of its words in
order. Words repeat, so the library merges each word once and the worker remembers its ids: at most two generations of
``LIMIT`` words; when one is full the older is forgotten, but for the words met since. The
cut itself is one regular expression for plain texts: printable ASCII, the letters of Latin-1, space and line feed, without
a special token's string. Any other text goes through the whole tokenizer.
"""

from __future__ import annotations

import functools
import re
import struct

import numpy as np

LIMIT = 700_000
_LOWER, _UPPER = "a-zß-öø-ÿ", "A-ZÀ-ÖØ-Þ"
#: UTF-8 bytes of plain texts: the first byte of any other letter is not among them.
_PLAIN_BYTES = bytes([10, *range(32, 127), 0xC3, *range(0x80, 0xC0)])
# How the two tokenizers cut plain texts, the first after lower-casing.
_CUT_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LOWER}]+|[0-9]|[^\s0-9{_LOWER}]+")
_CUT_WITH_SPACE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LOWER}{_UPPER}]+| ?[0-9]+| ?[^\s0-9{_LOWER}{_UPPER}]+|\s+(?!\S)|\s+")


def is_plain(text: str) -> bool:
    return not text.encode().translate(None, _PLAIN_BYTES) and "<|" not in text and "×" not in text and "÷" not in text


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself where it is printable, else the
    next free letter from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in printable else chr(next(rest)) for b in range(256)}


class WordEncoder:
    """``encode(text)`` gives ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, keeps_space: bool) -> None:
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._merge = self._tokenizer.model.tokenize
        self._letters = _byte_letters()
        self._lower = not keeps_space
        self._cut = (_CUT_WITH_SPACE if keeps_space else _CUT_WORDS).findall
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        spelled = word.encode().decode("latin-1").translate(self._letters)
        ids = [t.id for t in self._merge(spelled)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        if not is_plain(text):
            return np.asarray(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = self._cut(text.lower() if self._lower else text)
        known = self._known
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            if len(known) > LIMIT:
                self._older, known = known, {}
                self._known = known
            older = self._older
            for word in set(words).difference(known):
                known[word] = older.get(word) or self._word(word)
            return b"".join(map(known.__getitem__, words))


@functools.lru_cache(maxsize=2)
def word_encoder(path: str, keeps_space: bool) -> WordEncoder:
    """One encoder per worker process, so that its words outlive a task."""
    return WordEncoder(path, keeps_space)


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
