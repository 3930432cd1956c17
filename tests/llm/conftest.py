import random

import pytest

WORDS = "the of and river stone cloud maple winter signal harbor copper violet meadow lantern orbit canyon ember willow marble thunder".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, source): prose, copies, near copies, null, empty, long, repeated rows."""
    rng = random.Random(11)
    docs = [prose(rng, rng.randint(5, 120)) for _ in range(60)]
    docs += docs[:8]  # exact copies
    for t in docs[10:16]:  # near copies
        w = t.split()
        w[len(w) // 2] = "changed"
        docs.append(" ".join(w))
    shared = prose(rng, 40)
    docs += [f"{prose(rng, 20)} {shared} {prose(rng, 9)}" for _ in range(5)]
    docs += [None, "", "   \n\t ", "word", prose(rng, 9000), "Ünïcode ▁ text\nwith\nlines\n\n and 😀 signs", "A" * 3000]
    rows = [(i, t, f"h{i % 3}" if i % 7 else None) for i, t in enumerate(docs)]
    return rows + [rows[3], rows[3], (None, "no id here at all", "h1")]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string, source string").repartition(3)
