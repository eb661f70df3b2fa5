"""The trie encoder against the tokenizers library, and against a plain merge loop on a small model."""

import hashlib
import json
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from leafmill.llm import bpe_trie
from leafmill.llm.queries import op11_trie_bpe, vocabulary

from .helpers import AWKWARD_SCHEMA, awkward


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def digests(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha(tokenizer.decode(ids, skip_special_tokens=False).encode())


def test_query_equals_the_library(spark, sf, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in op11_trie_bpe(spark, sf).collect()}
    assert got == {i: digests(library, t) for i, t in texts.items()}


def test_awkward_rows_and_clashing_columns(spark, library):
    rows = awkward()
    docs = spark.createDataFrame(rows, AWKWARD_SCHEMA).withColumnRenamed("fp", "ids").withColumnRenamed("n", "decoded")
    path = vocabulary("word_bpe_49k.json")
    got = sorted((tuple(r) for r in bpe_trie.digest(bpe_trie.decode(bpe_trie.encode(docs, path), path)).collect()), key=repr)
    assert got == sorted(((r[0], *digests(library, r[1])) for r in rows), key=repr)
    assert bpe_trie.digest(bpe_trie.decode(bpe_trie.encode(docs.limit(0), path), path)).count() == 0


@pytest.mark.parametrize("letters", ["a", "ab", "aeh", "haха", "the on", "😂❤️ab", "'strevmld1 a", "é̈ İIΣσ", "<|endoftx>sar ", "\x1c\x00\x85\xa0 a,."])
def test_random_strings(library, letters):
    rng, enc = random.Random(letters), bpe_trie.encoder(vocabulary("word_bpe_49k.json"))
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(300)] + [letters * 200, letters[0] * 5000]
    for text, ids in zip(texts, enc.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, dtype="<u4").tolist() == want, text
        assert enc.decode(ids) == library.decode(want, skip_special_tokens=False)


def merged(pairs, word):
    """Plain byte-pair encoding: the first pair of lowest rank is merged until none is left."""
    parts = [*word[:-1], word[-1] + "_"]
    while ranked := [(pairs[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in pairs]:
        k = min(ranked)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return parts


def test_small_random_models():
    for seed in range(30):
        rng = random.Random(seed)
        tokens, pairs = ["a", "b", "c", "a_", "b_", "c_"], {}
        while len(pairs) < 40:
            a, b = rng.choice([t for t in tokens if "_" not in t]), rng.choice(tokens)
            if a + b not in tokens and merged_alone(pairs, a) and merged_alone(pairs, b):
                pairs[a, b] = len(pairs)
                tokens.append(a + b)
        vocab = {t: i for i, t in enumerate(tokens)}
        model = json.loads(json.dumps({"vocab": vocab, "merges": [list(p) for p in pairs], "end_of_word_suffix": "_"}))
        merges = bpe_trie.Merges(model)
        words = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 90))) for _ in range(200)}
        symbols = {w[:-1] + chr(ord(w[-1]) + bpe_trie.END): w for w in words}
        for s, ids in merges.encode(symbols).items():
            assert [tokens[i] for i in np.frombuffer(ids, dtype="<u4")] == merged(pairs, symbols[s]), (seed, symbols[s])


def merged_alone(pairs, token):
    parts = [*token.replace("_", "")]
    if token.endswith("_"):
        parts[-1] += "_"
    while ranked := [(pairs[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in pairs]:
        k = min(ranked)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return parts == [token]
