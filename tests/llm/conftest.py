import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(rng, n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) with copies, near copies, shared passages and lines, repeats, odd and null texts."""
    rng = random.Random(11)
    passage, lines = sentence(rng, 60), [sentence(rng, 6) for _ in range(5)]
    rows = [(i, sentence(rng, rng.randint(0, 120))) for i in range(40)]
    rows += [(100 + i, rows[i][1]) for i in range(6)]
    rows += [(200 + i, " ".join([rows[i][1], passage, sentence(rng, 9)])) for i in range(8)]
    rows += [(300 + i, "\n".join(rng.sample(lines, 4) + [sentence(rng, 5)] + lines)) for i in range(8)]
    rows += [(400, "x " * 70), (401, "ab " * 3 + "x y " * 40), (402, "a" * 3000), (403, "a" * 500 + " " + "a" * 400)]
    rows += [(500, None), (501, ""), (502, " \n\t \n"), (503, "\n\n\n\n\n"), (504, "é ü ß   日本語 " * 20), (505, sentence(rng, 30_000)), (506, "one"), (507, "Two words")]
    rows += [(500, None), (0, rows[0][1]), (1, "another text of one id " + passage), (None, passage), (None, None)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns whose names the operators use themselves."""
    extra = ", key int, d string, k string, block int, fp string, score string, target int, least int, at string, n_words string, lang string, component_id int"
    return spark.createDataFrame([(i, t, 7, *["x", "y"], 3, "z", "s", 1, 2, "q", "w", "en", 5) for i, t in corpus], "doc_id long, text string" + extra).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
