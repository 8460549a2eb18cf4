"""Documents with everything that may go wrong in a table of texts."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size string, ord long, _range int, sid string"


def documents(spark, rows):
    """Rows of (doc_id, text, lang, source), with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(*r, len(r[1] or ""), "k", "s", 1, 2, "x") for r in rows], SCHEMA)


def prose(rng, words, vocabulary=None):
    vocabulary = vocabulary or ["the", "of", "river", "stone", "green", "walks", "under", "light", "over", "hill", "cold", "wind", "tells", "story", "about", "old", "house", "near", "water", "bird"]
    return " ".join(rng.choice(vocabulary) + rng.choice(["", "", "s", "ing", "ed"]) for _ in range(words))


def mixed_rows(seed=0, n=60):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(1, 120)), "en", f"src{i % 4}") for i in range(n)]
    rows += [
        (100, None, None, None), (101, "", "en", "src1"), (102, " \t\n", "en", "src1"), (103, "one", None, "src2"),
        (None, "no id here at all", "en", None), (None, None, None, "src3"), (104, rows[3][1], "en", "src0"), (104, rows[3][1], "en", "src0"),
        (105, "É\u00a0ü \U0001f600 ok", "en", "src2"), (106, prose(rng, 30_000), "en", "src2"), (107, "x" * 200_000, "en", "src3"),
    ]
    return rows
