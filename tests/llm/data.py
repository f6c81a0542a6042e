"""Small titles with the cases every operator must bear: NULLs, empty and long texts, ties, repeated rows, clashing columns."""

import random

SYLLABLES = "ka lo mi ru ten sab vor qui pla dro nes tik".split()


def words(rng, n):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def odd_rows(rng=None):
    rng = rng or random.Random(5)
    long = " ".join(words(rng, 4000))
    return [(1, None), (2, ""), (3, " \t\n "), (4, long), (5, long), (5, long), (None, "kalo mi"), (None, None),
            (6, "Ünïcode straße 日本語 😀"), (7, "a"), (8, "12 34 !!"), (9, "x\x0by\x1cz")]


def frame(spark, rows, id_name="item_id", text_name="title", **more):
    """Rows with columns of names the operators use themselves."""
    schema = f"{id_name} bigint, {text_name} string, size string, score string, key string, start string, hash string, n int"
    df = spark.createDataFrame([(i, t, "s", "s", "k", "st", "h", 1) for i, t in rows], schema)
    return df
