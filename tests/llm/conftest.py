from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

VOCABULARY = [f"w{i}" for i in range(60)]


@pytest.fixture(scope="session")
def corpus() -> dict[int, str | None]:
    """Texts with exact copies, near copies in chains, shared passages, short, empty, null and long ones."""
    r = random.Random(11)
    say = lambda n: [r.choice(VOCABULARY) for _ in range(n)]
    passage = say(60)
    texts: dict[int, str | None] = {0: None, 1: "", 2: "  \t\n ", 3: "one", 4: "ONE", 5: "one two three", 6: "one  two\nthree"}
    for i in range(10, 40):
        texts[i] = " ".join(say(r.randint(5, 90)))
    for i in range(40, 60):
        texts[i] = texts[r.randint(10, 39)]
    chain = say(120)
    for i in range(60, 100):
        texts[i] = " ".join(chain)
        chain[r.randrange(120)] = r.choice(VOCABULARY)
    for i in range(100, 120):
        texts[i] = " ".join(say(20) + passage + say(20))
    texts[120] = " ".join(say(30_000))
    texts[121] = texts[120] + " tail"
    return texts


@pytest.fixture
def docs(spark, corpus):
    """The corpus with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "s", 1.5, "x", 7) for i, t in corpus.items()], "doc_id long, text string, source string, score double, id string, n long")
