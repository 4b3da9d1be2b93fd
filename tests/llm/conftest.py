import random

import pytest

#: Columns that bear names the operators use themselves.
CLASH = ("size", "unit", "rows", "copies", "index", "share", "copy", "turn", "winner", "node", "root", "fp", "nodes", "host_", "mix_unit", "mix_copy", "simhash_turn", "simhash_winner")


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from rows of (doc_id, text) or (doc_id, text, source), with columns of clashing names."""

    def make(rows):
        rows = [(*r, "s")[:3] if len(r) < 3 else r for r in rows]
        schema = "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASH)
        return spark.createDataFrame([(*r, *[f"own {c}" for c in CLASH]) for r in rows], schema)

    return make


@pytest.fixture(scope="session")
def prose():
    """Texts of invented words from a seed."""

    def make(seed, n_words, line=11):
        rng = random.Random(seed)
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n_words)]
        return "\n".join(" ".join(words[i : i + line]) for i in range(0, n_words, line))

    return make
