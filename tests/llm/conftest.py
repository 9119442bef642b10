import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, copies int, _doc string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows (doc_id, text[, source]) as documents, with extra columns whose names clash with internal ones."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), 7, 7, "x") for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(3)

    return make


@pytest.fixture(scope="session")
def prose():
    """A few hundred small texts: random sentences, copies, near copies, shared lines, odd cases."""
    rng = random.Random(4)
    words = [a + b for a in ("ka", "lo", "mi", "tu", "re", "so") for b in ("n", "ra", "ti", "vel", "mo", "sk", "der")]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    rows = [(i, "\n".join(sentence(rng.randrange(3, 30)) for _ in range(rng.randrange(1, 5)))) for i in range(120)]
    shared = sentence(20)
    rows += [(200 + i, sentence(12) + "\n" + shared) for i in range(30)]
    rows += [(300 + i, rows[3][1]) for i in range(5)]
    for i in range(20):
        w = rows[5][1].split(" ")
        w[rng.randrange(len(w))] = "changed"
        rows.append((400 + i, " ".join(w)))
    rows += [(500, None), (501, ""), (502, "  \n\n "), (503, "One"), (504, "Two words"), (None, "no id here at all"),
             (None, rows[7][1]), (rows[9][0], rows[9][1]), (505, "é" * 3000 + " " + "日本 " * 500)]
    return rows


def groups(links, items):
    """Smallest reachable item of every item."""
    parent = {x: x for x in items}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in items}


@pytest.fixture(scope="session")
def reach():
    return groups
