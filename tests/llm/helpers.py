"""Texts and brute-force versions that several tests use."""

from __future__ import annotations

import random

WORDS = "river stone cloud light music paper green house winter summer table window garden bread silver copper north south early later never always under over music".split()


def text(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ed", str(r.randrange(50))]) for _ in range(n))


def edited(r: random.Random, t: str, n: int) -> str:
    w = t.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def twins(n: int = 1024, a: str = "a", b: str = "b") -> tuple[str, str]:
    """The Thue-Morse word of n letters and its complement: polynomial hashes modulo 2**64 can't tell them apart."""
    word = "".join(b if i.bit_count() % 2 else a for i in range(n))
    return word, word.translate(str.maketrans(a + b, b + a))


#: Rows that every operator must take: nulls, empties, ties, repeats, and extra columns of clashing names.
def odd_documents(spark):
    long = "one very long line " * 20_000
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa\nsecond line of text", "x", 7), (2, None, None, None), (3, "", "x", 0), (None, "no id here at all", "x", 1),
        (4, " \n\t\n ", "x", 5), (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa\nsecond line of text", "x", 7), (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa\nsecond line of text", "x", 7),
        (6, long, "x", len(long)), (7, "é ü 日本語 text", "x", 3),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, h1 string, pos int")


def empty_documents(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, h1 string, pos int")
