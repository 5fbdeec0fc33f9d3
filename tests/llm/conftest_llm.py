"""Small texts for the tests of the text operators."""

import random

PROSE = "the quick brown fox jumps over a lazy dog while seven wizards brew strong potions beneath old stone bridges near quiet rivers".split()


def words(seed, n):
    """n words, the same for the same seed and different for others."""
    r = random.Random(seed)
    return [r.choice(PROSE) + format(r.randrange(400), "x") for _ in range(n)]


def documents(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)
