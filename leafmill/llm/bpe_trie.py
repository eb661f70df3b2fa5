"""Byte-pair encoding of distinct words by a depth-first walk over their trie, and decoding.

The encoding of a prefix is that of a shorter prefix and one last token, and the last token is the one vocabulary
entry that ends the prefix, is its own encoding, and forms no earlier merge with the last token before it.  So the
state of a trie node is one token.  Distinct words of a batch go into a trie; the walk finds a node's state from those
of its ancestors, once for all words below it, and a word's ids are read back from its leaf, token by token.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: A symbol that ends a word is its byte letter moved up by this much, so that it is a letter of its own in the trie.
END = 0x1000
#: Words of more symbols are a path of their own; words put into a trie before it is walked; chunks kept in the cache
#: (and half as many words).
LONG, TRIE_WORDS, CACHE_WORDS = 64, 50_000, 800_000
#: Pieces of a lower-case ASCII chunk without white space, as the vocabulary's pre-tokenizer cuts it.  Fixed values.
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


class Lengths(dict):
    """Lengths of the tokens that may end a prefix, longest first, by its last three symbols (all of a shorter one)."""

    def __init__(self, tokens: Iterable[str]):
        self.ends: dict[str, set[int]] = {}
        for s in tokens:
            self.ends.setdefault(s[-3:], set()).add(len(s))

    def __missing__(self, end: str) -> tuple[int, ...]:
        n = {k for e in {end, end[1:], end[2:]} - {""} for k in self.ends.get(e, ()) if k >= len(end) or k == len(e)}
        if len(self) > 1_000_000:
            self.clear()
        self[end] = found = tuple(sorted(n, reverse=True))
        return found


class Merges:
    """Vocabulary and merges of a word-level BPE model with a word-end mark; tokens as strings of symbols."""

    def __init__(self, model: dict):
        mark = model.get("end_of_word_suffix") or ""
        self.name = {i: t for t, i in model["vocab"].items()}
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        made = {a + b for a, b in merges}
        self.symbols: dict[int, str] = {}
        for t, i in model["vocab"].items():
            if t not in made:
                stem = t[: -len(mark)] if mark and len(t) > len(mark) and t.endswith(mark) else t
                self.symbols[i] = stem if stem == t else chr(ord(stem) + END)
        #: Rank of a token (-1: a symbol), the two it is merged from, and the rank by pair.
        self.rank = dict.fromkeys(self.symbols, -1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.pair: dict[tuple[int, int], int] = {}
        for k, (a, b) in enumerate(merges):
            a, b, t = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            self.symbols[t], self.rank[t], self.parts[t], self.pair[a, b] = self.symbols[a] + self.symbols[b], k, (a, b), k
        self._meets: dict[int, bool] = {}
        #: Tokens that are their own encoding, by their symbols, and the lengths of those with a given end, longest first.
        self.token = {s: t for t, s in self.symbols.items() if t not in self.parts}
        for t, (x, y) in self.parts.items():
            if self.symbols[x] in self.token and self.symbols[y] in self.token and not self._merges_early(x, y, own=True):
                self.token[self.symbols[t]] = t
        self.lengths = Lengths(self.token)

    def _spine(self, t: int, side: int) -> list[tuple[int, float]]:
        """Tokens along the right (1) or left (0) edge of a token's merge tree, each with the rank that uses it up."""
        out, until = [(t, float("inf"))], 0
        while t in self.parts:
            until, t = self.rank[t], self.parts[t][side]
            out.append((t, until))
        return out

    def _merges_early(self, a: int, b: int, own: bool = False) -> bool:
        """Whether a merge over the seam of ``a`` and ``b`` comes before both are complete (``own``: but for that of the two).

        Two tokens at the seam meet if both exist at the rank of their merge.  Merges of one rank run from left to
        right, so one inside ``a`` comes first and one inside ``b`` comes after that over the seam.
        """
        left, right = self._spine(a, 1), self._spine(b, 0)
        i = j = 0
        while i < len(left) and j < len(right):
            (x, x_until), (y, y_until) = left[i], right[j]
            k = self.pair.get((x, y))
            if k is not None and k < x_until and k <= y_until and not (own and i == j == 0):
                return True
            if self.rank[x] > self.rank[y]:
                i += 1
            else:
                j += 1
        return False

    def meets(self, key: int) -> bool:
        """Whether two tokens (the first one's id shifted by 32 bits, and the second's) stand side by side as they are."""
        if len(self._meets) > 2_000_000:
            self._meets.clear()
        found = self._meets[key] = not self._merges_early(key >> 32, key & 0xFFFFFFFF)
        return found

    def step(self, word: str, d: int, states: list[int]) -> int:
        """Last token of the first ``d`` symbols of ``word``, given those of its shorter prefixes."""
        token, known = self.token, self._meets
        for n in self.lengths[word[d - 3 : d] if d > 3 else word[:d]]:
            if n < d:
                t = token.get(word[d - n : d])
                if t is not None:
                    found = known.get(key := states[d - n - 1] << 32 | t)
                    if self.meets(key) if found is None else found:
                        return t
            elif n == d and word[:d] in token:
                return token[word[:d]]
        raise ValueError(f"no token ends {word[max(d - 8, 0) : d]!r}")

    def ids(self, states: list[int]) -> bytes:
        """Ids (little-endian uint32) of a whole word from the states on its path, the last token first."""
        out, d = [], len(states)
        while d:
            t = states[d - 1]
            out.append(t)
            d -= len(self.symbols[t])
        return struct.pack(f"<{len(out)}I", *reversed(out))

    def encode(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids by distinct word; a word's last symbol is moved up by ``END``, so a leaf is a word and no other node is."""
        out, trie = {}, {}
        for word in sorted(words):  # neighbours in the trie are then neighbours in memory
            if len(word) <= LONG:
                node = trie
                for c in word:
                    node = node.setdefault(c, {})
            else:
                states: list[int] = []
                for d in range(1, len(word) + 1):
                    states.append(self.step(word, d, states))
                out[word] = self.ids(states)
        path, states, stack = "", [], [(c, 0, n) for c, n in trie.items()]
        while stack:
            c, d, node = stack.pop()
            path = path[:d] + c
            del states[d:]
            d += 1
            states.append(self.step(path, d, states))
            if node:
                stack.extend([(x, d, n) for x, n in node.items()])
            else:
                out[path] = self.ids(states)
        return out


class TrieEncoder:
    """Ids and texts as the tokenizers library gives them for a vocabulary file, without truncation and padding.

    The library's own normalizer and pre-tokenizer cut chunks that are not plain ASCII; encoding is this module's.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer, self.merges = Tokenizer.from_file(path), Merges(spec["model"])
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {t: np.array([i], dtype="<u4").tobytes() for t, i in special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
        names = self.merges.name | {i: t for t, i in special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        #: Ids of chunks and of words met before.
        self.known: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}

    def pieces(self, chunk: bytes) -> list[str | bytes]:
        """Words of a chunk without ASCII white space as symbols, and the ids of special tokens as they are."""
        out: list[str | bytes] = []
        for part in self.cut.split(chunk.decode("utf-8", "replace")) if b"<|" in chunk else [chunk.decode("utf-8", "replace")]:
            if part in self.special:
                out.append(self.special[part])
            elif part.isascii() and part.isprintable():
                out += [w[:-1] + chr(ord(w[-1]) + END) for w in _ASCII_PIECES.findall(part.lower())]
            else:
                out += self._pieces(part)
        return out

    def _pieces(self, part: str) -> list[str]:
        words = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(part))
        return [w[:-1] + chr(ord(w[-1]) + END) for w, _ in words if w]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text.  Chunks not met before are encoded together, as many as ``TRIE_WORDS`` of their words at a time."""
        chunks = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        if len(self.words) > CACHE_WORDS // 2:
            self.words.clear()
        known, own, settled = self.known, {}, self.words
        pending: dict[bytes, list[str | bytes]] = {}
        words: set[str] = set()

        def settle() -> None:
            ids = self.merges.encode(words)
            settled.update((w, i) for w, i in ids.items() if len(w) <= LONG)
            find = lambda p: p if isinstance(p, bytes) else settled[p] if p in settled else ids[p]
            for chunk, parts in pending.items():
                (known if len(chunk) <= LONG else own)[chunk] = find(parts[0]) if len(parts) == 1 else b"".join(map(find, parts))
            pending.clear()
            words.clear()

        fresh = {c for text in chunks for c in text}.difference(known)
        # A full stop or comma after an ASCII letter or digit is a word of its own: the chunk is the one without it and that.
        marked = {c for c in fresh if c[-1:] in b".," and c[-2:-1].isalnum()}
        fresh = (fresh - marked).union([c[:-1] for c in marked], [c[-1:] for c in marked]).difference(known)
        for chunk in fresh:
            pending[chunk] = parts = self.pieces(chunk)
            words.update([p for p in parts if isinstance(p, str) and p not in settled])
            if len(words) >= TRIE_WORDS:
                settle()
        settle()
        for chunk in marked:
            (known if len(chunk) <= LONG else own)[chunk] = (own if len(chunk) > LONG + 1 else known)[chunk[:-1]] + known[chunk[-1:]]
        return [b"".join([known[c] if c in known else own[c] for c in text]) for text in chunks]

    def decode(self, ids: bytes) -> str:
        """Names of the ids with spaces between: the vocabulary has no decoder."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_ENCODERS: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    """One encoder per worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieEncoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` for every row: the whole text's ids as little-endian unsigned 32-bit integers.

    Null and empty texts have no ids.  Repeated rows, rows that share an id and rows without one come out each for
    itself; an empty table gives an empty result; other columns are not read, whatever their names.
    """

    def run(batches):
        enc = encoder(path)
        for batch in slices(batches, weigh="text", most=4 << 20):
            ids = pa.array(enc.encode(batch.column(1).to_pylist()), pa.large_binary()).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, decoded`` of a table that :func:`encode` has made: each row's ids as the library decodes them.

    Null ids give an empty text; unknown ids give nothing in their place.
    """

    def run(batches):
        enc = encoder(path)
        for batch in slices(batches, weigh="ids", most=4 << 20):
            texts = pa.array([enc.decode(i or b"") for i in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded string")


def digest(decoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of what :func:`decode` returns."""
    sha = F.sha2(F.col("decoded").cast("binary"), 256)
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), sha.alias("decoded_sha256"))
