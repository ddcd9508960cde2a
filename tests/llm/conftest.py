import random

import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "tu", "ra", "so") for b in ("ta", "rin", "mel", "dos", "ve", "")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int"


def prose(rng: random.Random, n: int) -> str:
    out = []
    for i in range(n):
        w = rng.choice(WORDS) + rng.choice(WORDS)
        out.append(w.capitalize() + "." if i % 9 == 8 else w)
    return "\n".join(" ".join(out[i : i + 18]) for i in range(0, n, 18))


def corpus() -> list[tuple]:
    """Prose with exact and near copies, junk, nulls, empties, a very long text, and columns that clash with results."""
    rng = random.Random(5)
    rows = []
    for i in range(60):
        text = prose(rng, rng.randint(5, 220))
        if i % 6 == 5:
            text = " ".join(w.upper() + "!!" for w in text.split())
        rows.append((i, text))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, rows[4][1] + " tail"), (103, rows[6][1].replace("ka", "kä", 1)), (104, None), (105, ""), (106, "   \n\t"), (107, "one"), (108, "one"), (109, "a b"), (110, prose(rng, 9000))]
    rows.append(rows[2])
    return [(i, t, None if i % 11 == 0 else ("en", "fr", "de")[i % 3], None if i % 13 == 0 else f"src{0 if i % 3 else i % 5}", len(t or ""), 0.5, 7) for i, t in rows]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3, "doc_id").persist()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
