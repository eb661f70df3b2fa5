"""Small documents with the awkward cases: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import random

AWKWARD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, fp long, rank int, n long"


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "stone", "river,", "Ñandú", "über", "page.", "42", "it's", "x" * 9]) for _ in range(n))


def awkward(seed=1):
    rng = random.Random(seed)
    texts = [None, "", " ", "\n\n", "one", "One two", "a b c", "a b c", prose(rng, 9000), "x" * 30000, "  two  spaces \n\n and\tlines\x0b\x1c ", "mixed space 　wide\n\n\nend\n", "<|endoftext|> here <|endoftext|>", "<|ENDOFTEXT|> é İI ΣΣ", "#*$% | & <b>"]
    texts += [prose(rng, rng.randrange(1, 200)) for _ in range(40)]
    texts += [texts[20]] * 30  # a hot group
    rows = [(i, t, "en" if i % 3 else None, "src0", len(t or ""), 1, 2, 3, 4) for i, t in enumerate(texts)]
    return rows + [rows[5], rows[5], (None, "no id", None, None, None, 1, 2, 3, 4), (None, None, None, None, None, None, None, None, None)]
