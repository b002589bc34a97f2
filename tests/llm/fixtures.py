"""A small corpus with nulls, empty and long texts, ties, repeated rows, near-copies and shared passages."""

from __future__ import annotations

import random

WORDS = "the of and to in der die und le la que un con para tion anble thon eresh wheran schen keit ment eau cion dora entre".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key int, size int, comp string"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "er", "s", "ing"]) for _ in range(n)) + "."


def documents(seed=3):
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randint(1, 120)) + "\n" + sentence(rng, rng.randint(3, 60)) for _ in range(60)]
    passage = sentence(rng, 70)
    for i in range(10):
        texts.append(sentence(rng, 20) + " " + passage + " " + sentence(rng, 15))
    for i in range(8):  # near-copies
        w = texts[i].split(" ")
        w[len(w) // 2] = "CHANGED"
        texts.append(" ".join(w))
    texts += [texts[0], texts[0], texts[5], "", "   \n\t", "one", "one two three", "One TWO three", "ab" * 400, "x y z " * 200, sentence(rng, 6000), "é" * 300, None, None]
    rows = [(i * 3 + 1, t, None if i % 11 == 0 else ["en", "de"][i % 2], None if i % 13 == 0 else f"s{i % 5}", None if t is None else len(t), i, i, "c") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)
