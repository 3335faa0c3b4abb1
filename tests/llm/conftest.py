import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs():
    rng = random.Random(4)
    vocabulary = ["ta", "Re", "mi", "so,", "la.", "éè", "Don't", "x9", "ÜB", "fin!"] + [f"w{k}" for k in range(300)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    rows = [(k, prose(rng.randint(21, 90)), "en", f"s{k % 3}") for k in range(40)]
    base = rows[3][1].split()
    rows += [(50 + k, " ".join([*base[:-1], f"end{k}"]), "en", "s0") for k in range(4)]  # near copies
    rows += [(60, rows[5][1].upper().replace("É", "é").replace("È", "è").replace("Ü", "Ü"), "fr", "s1"), (61, rows[5][1], "fr", "s1"), (61, rows[5][1], "fr", "s1")]
    rows += [(70, None, None, None), (71, "", "en", "s2"), (72, " \n\t", "en", "s2"), (73, "one two", "en", None), (74, "one  two", "en", "s2"), (75, "a b c d e f g h " * 30, "en", "s0"), (76, prose(6000), "en", "s0"), (77, "<|endoftext|> A!<|startoftext|>b é İs 's", "en", "s1")]
    return [(*r, len(r[1] or "")) for r in rows]


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
