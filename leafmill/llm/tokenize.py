"""Exact tokenizers-library encoding with a cache of words.

The pre-tokenizers of both vocabularies never let a token cross the start of a run of white space, so a text's ids
are the ids of its words in order.  Each distinct word is encoded by the library once per worker; texts are then put
together from the cached id bytes.  A bounded cache is emptied when full, which changes only speed.
"""

from __future__ import annotations

import os
import re
from array import array
from unicodedata import is_normalized

#: White space as the byte-level pre-tokenizer's \s knows it (Python's adds 0x1C-0x1F).  Fixed values.
_S = "\t-\r " + "".join(map(chr, (0x85, 0xA0, 0x1680))) + f"{chr(0x2000)}-{chr(0x200A)}" + "".join(map(chr, (0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: A word with its one leading space; a lone line feed; any other run of white space with the word after it.
_BYTE_CHUNKS = re.compile(f" ?[^{_S}]+|\n(?=[^{_S}])|[{_S}]+[^{_S}]*")
#: The byte-level letters: printable Latin-1 bytes stand for themselves, the others for U+0100 onwards in order.
_PLAIN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_LETTERS = {b: chr(0x100 + k) for k, b in enumerate(sorted({*range(256)} - _PLAIN))}
#: Words that the cache holds at most, and the longest that it keeps.
CACHE_WORDS, CACHE_CHARS = 1_200_000, 64


class _Cache(dict):
    """Ids by chunk; a chunk not met before is encoded when it is first looked up.  Long chunks are not kept."""

    def __init__(self, word, ends):
        self.word, self.ends = word, ends

    def __missing__(self, x) -> bytes:
        # A full stop or comma after an ASCII letter or digit is a token of its own: the word before it may be known.
        if x[-1] in self.ends and x[-2:-1].isalnum() and x.isascii():
            found = self[x[:-1]] + self[x[-1:]]
        else:
            found = self.word(x)
        if len(x) <= CACHE_CHARS:
            self[x] = found
        return found


class WordEncoder:
    """``ids(texts)`` equals ``encode_batch(texts, add_special_tokens=False)``, as little-endian uint32 bytes."""

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.spaced = Tokenizer.from_file(path), spaced
        self.model = self.tokenizer.model
        self.cache = _Cache(self.word, ".," if spaced else b".,")

    def chunks(self, text: str) -> list:
        if self.spaced:
            return _BYTE_CHUNKS.findall(text)
        raw = text.encode("utf-8", "surrogatepass")
        # The normalizer lower-cases anyway; only special tokens, which begin with "<|", are matched before it.
        return raw.split() if b"<|" in raw else raw.lower().split()

    def word(self, x) -> bytes:
        """Ids of one chunk.  Letters alone (after one space at most) are one pre-token: the model takes it directly."""
        text = x if self.spaced else x.decode("utf-8", "replace")
        if (text[1:] if self.spaced and text[:1] == " " else text).isalpha() and (self.spaced or x.isascii() or text == text.lower() and is_normalized("NFC", text)):
            letters = text.replace(" ", _BYTE_LETTERS[32]) if text.isascii() else text.encode("utf-8", "surrogatepass").decode("latin-1").translate(_BYTE_LETTERS)
            return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, texts: list[str | None]) -> list[bytes]:
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        get = self.cache.__getitem__
        return [b"".join(map(get, self.chunks(t))) if t else b"" for t in texts]


_ENCODERS: dict[tuple[str, bool], WordEncoder] = {}


def encoder(path: str, spaced: bool) -> WordEncoder:
    """One encoder per worker process and vocabulary.  ``spaced``: words carry their leading space (byte-level BPE)."""
    key = (path, spaced)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(path, spaced)
    return _ENCODERS[key]
