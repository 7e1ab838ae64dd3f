"""Token ids of texts by a public tokenizer file; the file's path is a parameter."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from struct import pack

from tokenizers import Tokenizer


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Characters whose class, lower case and normal form are as simple as ASCII's: printable ASCII and Latin letters below
#: U+017F, but for the dotted capital I and the apostrophe n. Tested code point by code point against the library.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]+")
#: Splits plain text in lower case into the words that byte-pair merging works on; fixed by the tokenizer file.
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u017e"
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")


def _byte_names() -> str:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return "".join(chr(b if b in shown else next(rest)) for b in range(256))


class _Remembered(dict):
    """Values of a function by argument. The ``most`` newest are kept and, of those before them, what is asked for again;
    long arguments are not kept at all."""

    def __init__(self, function: Callable[[str], bytes], most: int, longest: int = 64):
        super().__init__()
        self.function, self.most, self.longest, self.before = function, most, longest, {}

    def __missing__(self, key: str) -> bytes:
        value = self.before.get(key)
        if value is None:
            value = self.function(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.before = dict(self)
                self.clear()
            self[key] = value
        return value


class WordTokenizer:
    """The ids of ``Tokenizer.encode(text, add_special_tokens=False)``, remembered by chunk between spaces.

    No word of this vocabulary spans white space, so a text's ids are those of its chunks in turn. They are kept as
    bytes (little-endian, 4 an id), which join fast and cost the garbage collector nothing. A chunk of plain characters
    is cut and merged here; any other chunk, and a whole text that might hold a special token's string, goes through
    the library.
    """

    def __init__(self, path: str, remembered: int = 250_000):
        self.whole = Tokenizer.from_file(path)
        self.names = dict(enumerate(_byte_names()))
        self.chunks = _Remembered(self._chunk, remembered)

    def _library(self, text: str) -> bytes:
        ids = self.whole.encode(text, add_special_tokens=False).ids
        return pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        named = word if word.isascii() else word.encode("utf-8").decode("latin-1").translate(self.names)
        ids = [t.id for t in self.whole.model.tokenize(named)]
        return pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        if not _PLAIN.fullmatch(chunk):
            return self._library(chunk) if chunk else b""
        # A word in lower case is a chunk too, so both are remembered in one place.
        text = chunk.lower()
        if text.isalpha():
            words = [text]
        elif text[-1] in ",." and text[:-1].isalpha():
            words = [text[:-1], text[-1]]
        else:
            words = _WORDS.findall(text)
        return self._word(text) if words == [chunk] else b"".join([self.chunks[w] for w in words])

    def encode(self, text: str) -> bytes:
        if "<|" in text:
            return self._library(text)
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One instance for each worker process."""
    return WordTokenizer(path)
