"""Small corpora for the tests of the training-text operators."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, key bigint, spans string, label int"


def corpus(seed: int = 3, n: int = 60) -> list[tuple]:
    """Copies, near copies, shared passages, repeats within a text, nulls, empty and odd texts, repeated rows."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéßz") for _ in range(r.randrange(1, 8)))
    words = lambda k: [word() for _ in range(k)]
    passage = words(90)
    texts = [" ".join(words(r.randrange(1, 200))) for _ in range(n)]
    texts += [texts[1]] * 3
    for _ in range(6):
        near = texts[2].split(" ")
        near[r.randrange(len(near))] = "changed"
        texts.append(" ".join(near))
    for _ in range(8):
        a, b = r.randrange(10), r.randrange(10)
        texts.append(" ".join(words(r.randrange(40)) + passage[a : 90 - b] + words(r.randrange(40))))
    texts += [None, "", "   \n\t", "ab" * 700, "w " * 300, "x" * 399, "x" * 399, "1234 !!", "Der " * 200 + "Ende", "日本語 🎉 ▁ text", "MIT License here", "Licensed under the Apache License, Version 2.0\nmit license, GNU General Public License", "one two three", "one two three"]
    rows = [(i, t, r.choice(["en", "fr", None]), r.choice(["a", "b", "b", "b", None, "é"]), len(t or ""), "x", i % 3, None, 1) for i, t in enumerate(texts)]
    return rows + [rows[5], rows[5], (None, texts[3], "en", "a", 1, None, None, None, None), (7, texts[9], "fr", "a", 1, None, None, None, None)]
