"""Small corpora with the cases that contracts define."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed: int = 7, n: int = 60) -> list[tuple]:
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéß日") for _ in range(r.randint(1, 7))) for _ in range(400)]
    say = lambda k: " ".join(r.choice(words) for _ in range(k))
    passage, line = say(70), say(9)
    texts: list[str | None] = []
    for i in range(n):
        t = say(r.choice([3, 30, 80, 150]))
        if i % 5 == 0:
            t += f"\n{passage}\n{say(20)}"
        if i % 4 == 0:
            t += f"\n{line}\n"
        texts.append(t)
    texts[10] = texts[3]
    texts[20] = "  ".join(texts[5].split(" "))
    near = say(120).split(" ")
    for k in range(8):
        copy = list(near)
        copy[k * 12] = "changed"
        texts[30 + k] = " ".join(copy)
    texts += [None, "", "  \n\t ", "one", "A b C d E", "a B c D e", "tok " * 3000, "xy " * 90]
    return [(i, t, r.choice(["en", "de", None]), r.choice(["src0", "src0", "src1", None]), None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
