import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

SCHEMA = "doc_id bigint, text string, score string, _id int, size int, hash string, line int, matches string"


@pytest.fixture(scope="session")
def corpus():
    """Prose of few words with copies, near copies, shared passages and everything that may break a text operator."""
    r = random.Random(5)
    words = ["the", "of", "and", "Thorn", "inter", "ation", "lea", "é", "naïve", "ring,", "stone.", "wh", "and-so", "x1", "42"]

    def prose(n):
        out = []
        for k in range(n):
            out.append(r.choice(words) + (str(r.randint(0, 400)) if r.random() < 0.3 else ""))
            if k % 17 == 16:
                out[-1] += "\n"
        return " ".join(out)

    texts = [prose(r.choice([1, 2, 5, 30, 80, 200])) for _ in range(40)]
    passage = prose(70)
    for k in (3, 7, 11, 12):
        texts[k] = prose(30) + " " + passage + " " + prose(20)
    texts += [texts[8], texts[8], texts[7]]
    for k in range(4):
        own = texts[3].split(" ")
        own[10 * k + 5] = f"edit{k}"
        texts.append(" ".join(own))
    texts += [None, "", " \n\t \r", "a", "a b", "A  b", "word" * 30_000, prose(5000), "<|endoftext|> end <|endoftext|>", "  x \n\n y  "]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "no id here at all"), (None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with further columns whose names the operators use themselves; null throughout."""
    return spark.createDataFrame([(i, t, *[None] * 6) for i, t in corpus], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
