"""Inputs shared by the tests of this folder: plain texts and the awkward rows every operator must stand."""

from __future__ import annotations

import random
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(20_000))


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


def sentence(rng, n=None):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n or rng.randint(4, 12))).capitalize() + "."


def text(rng, n):
    return " ".join(sentence(rng) for _ in range(n))


#: Null id, null, empty and blank texts, a very long one, repeated rows, one id with two texts, a tie in everything but id.
AWKWARD = [
    (None, "Some words without an id stand here alone today."), (900, None), (901, ""), (902, " \n\t "), (903, LONG), (904, "Twice the same row stands here, word by word."),
    (904, "Twice the same row stands here, word by word."), (905, "One id, first text."), (905, "One id, second text."), (906, "tie tie tie"), (907, "tie tie tie"), (908, "é ü 漢字 😀 ."),
]
#: Extra columns whose names clash with names the operators use inside.
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, k int, row string, h long, score double, copies int, id long, spans string, label int, c int, p int"


def awkward(spark, more=()):
    rows = [(d, t, "en", None if i % 3 == 0 else f"s{i % 2}", len(t or ""), i, "r", i, 0.5, 7, i, "x", 1, 2, 3) for i, (d, t) in enumerate([*AWKWARD, *more])]
    return spark.createDataFrame(rows, EXTRA)


def empty(spark):
    return spark.createDataFrame([], EXTRA)


def labels(spark, rows=()):
    return spark.createDataFrame([(900, 1, 0), (901, 0, 1), (904, None, None), (None, 1, 1), (904, 1, 0), *rows], "doc_id long, quality int, toxic int")


def rng():
    return random.Random(5)
