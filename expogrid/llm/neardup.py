"""Near-duplicate removal: SimHash links and bands of sketches give candidates, whole shingle sets decide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from expogrid.llm import minhash, simhash
from expogrid.llm.common import scratch, store
from expogrid.llm.windows import row_id

SIMILARITY = 0.8
#: 40 bands of 6 coordinates: two sets at a similarity of 0.8 meet in none of them with probability 6e-6.
BANDS, ROWS = 40, 6
#: Bits in which SimHash fingerprints may differ to be linked.
RADIUS = 4
#: Rounds in which the first row of every key is compared, before all pairs of what is left are.
ROUNDS = 5
#: The key of SimHash links, which is no band.
SIMHASH = -1


def candidate_keys(classes: DataFrame, radius: int) -> DataFrame:
    """(key, band, cid, n): keys that several classes share. ``classes``: cid, n, keys, fp.

    A band of the sketch is a key, and so is each component of fingerprints that BK-trees link within the radius.
    """
    fingerprints = classes.filter("n > 0").select("fp").distinct()
    roots = simhash.components(simhash.links(store(fingerprints, "fingerprints"), radius))
    linked = classes.join(roots, classes.fp == roots.node).select(F.xxhash64("root", F.lit("simhash")).alias("key"), F.lit(SIMHASH).alias("band"), "cid", "n")
    equal = classes.filter("n > 0").select(F.xxhash64("fp", F.lit("equal")).alias("key"), F.lit(SIMHASH).alias("band"), "cid", "n")
    banded = classes.filter("n > 0").select("cid", "n", F.posexplode("keys").alias("band", "key")).select("key", "band", "cid", "n")
    every = banded.union(linked).union(equal.join(roots, equal.key == F.xxhash64("node", F.lit("equal")), "left_anti"))
    shared = every.groupBy("key").agg(F.min("cid").alias("first"), F.max("cid").alias("most")).filter("first < most").select("key")
    return every.join(shared, "key")


def leading(led: DataFrame) -> DataFrame:
    """(first) of rows that come first wherever they are. ``led``: cid and the first row of each place, itself included."""
    return led.groupBy("cid").agg(F.min(F.col("first") == F.col("cid")).alias("leads")).filter("leads").select(F.col("cid").alias("first"))


def resembling(keys: DataFrame, known: DataFrame, texts: DataFrame, percent: int, bands: int, rows: int, rounds: int) -> list[DataFrame]:
    """Tables (cid) of the classes that resemble a class that stays and comes before. ``keys``: key, band, cid, n.

    A class that comes first in all of its keys stays, and what shares a key with it is compared with it: those alike go.
    Both leave the keys, and the next classes come first. What is left after some rounds mostly shares keys
    without being alike: it is compared in tiles of a key, and the same rounds follow on the pairs alike. Sizes
    and coordinates are compared before texts, and the tables of a round go when the next one has its own.
    """
    least, gone = minhash.least_agreed(percent, bands * rows), []
    for _ in range(rounds):
        with scratch(keys.sparkSession) as keep:
            firsts = keys.groupBy("key").agg(F.min("cid").alias("first"), F.max("cid").alias("most")).filter("first <> most").select("key", "first")
            firsts = keep(firsts, "firsts")
            led = keep(keys.join(firsts, "key").select("cid", "first").distinct(), "led")
            stay = keep(leading(led), "stay")
            pairs = led.filter("first <> cid").join(stay, "first").select(F.col("cid").alias("a"), F.col("first").alias("b"))
            alike = minhash.confirmed(keep(minhash.plausible(pairs, known, percent, least), "pairs"), texts, percent)
            gone.append(store(alike.select(F.col("a").alias("cid")).distinct(), "gone"))
            out = gone[-1].union(stay.select(F.col("first").alias("cid")))
            keys = store(keys.join(firsts.select("key"), "key").join(out, "cid", "left_anti"), "keys")
        if keys.isEmpty():
            return gone
    members = keys.select("key", "band", "cid", "n", F.col("cid").alias("label"))
    found = minhash.tiled(members, known, texts, bands, percent, least, every=True)
    edges = store(found.select(F.greatest("a", "b").alias("cid"), F.least("a", "b").alias("first")).distinct(), "alike")
    while not edges.isEmpty():
        behind = edges.select("cid").distinct()
        stay = edges.select("first").distinct().join(behind, F.col("first") == behind.cid, "left_anti")
        gone.append(store(edges.join(stay, "first").select("cid").distinct(), "gone"))
        edges = store(edges.join(gone[-1], "cid", "left_anti").join(gone[-1].select(F.col("cid").alias("first")), "first", "left_anti"), "alike")
    return gone


def decided(docs: DataFrame, similarity: float = SIMILARITY, rounds: int = ROUNDS, bands: int = BANDS, rows: int = ROWS, radius: int = RADIUS) -> DataFrame:
    """(rid, row, stays) of every input row, so that no two alike stay and each that goes resembles one that stays.

    ``docs``: doc_id, text, rid; ``row`` holds 128 bits of id and text. Equal sets of five-word shingles are one class,
    for which its first row in the order of rid and row stands. In that order a class goes if its set has a
    Jaccard similarity of at least ``similarity`` with that of a class that stays.
    Texts of fewer than five words have one shingle, all of their words; those without words are alike.
    """
    percent = round(100 * similarity)
    with scratch(docs.sparkSession) as keep:
        marked = keep(minhash.sketched(docs, bands, rows, ("rid",)), "sketches")
        one = F.min(F.struct("rid", "row")).alias("own")
        classes = marked.groupBy("digest").agg(one, *[F.first(c).alias(c) for c in ("n", "keys", "agree", "fp")]).orderBy("own.rid", "digest")
        # Numbers in the order of rid, given before the table is written.
        classes = keep(classes.select("digest", "own.rid", "own.row", "n", "keys", "agree", "fp", F.monotonically_increasing_id().alias("cid")), "classes")
        known = classes.select("cid", "n", "agree")
        keys = keep(candidate_keys(classes, radius), "keys")
        texts = keep(minhash.packed_texts(docs, keys.select("cid").distinct().join(classes.select("cid", "row"), "cid")), "texts")
        gone = None
        for part in resembling(keys, known, texts, percent, bands, rows, rounds):
            gone = part if gone is None else gone.union(part)
        kept = classes if gone is None else classes.join(gone.distinct(), "cid", "left_anti")
        named = keep(kept.select("digest", F.col("row").alias("first")), "kept")
        stays = F.coalesce(F.col("row") == F.col("first"), F.lit(False))
        return store(marked.select("rid", "row", "digest").join(named, "digest", "left").select("rid", "row", stays.alias("stays")), "decided")


def dropped(docs: DataFrame, **settings) -> DataFrame:
    """(rid) of the rows that go; see ``decided``."""
    return decided(docs, **settings).filter("NOT stays").select("rid").distinct()


def deduplicated(docs: DataFrame, **settings) -> DataFrame:
    """The input rows without near-duplicates, one row of each group kept; see ``decided``.

    Rows alike in id and text are one group; of those that differ elsewhere the one with the smallest hash of all
    columns stays. A null text counts as an empty one. Texts of any length are read whole. No rows give no rows.
    """
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), "doc_id", "text").withColumn("rid", row_id())
    fate = decided(named.select("doc_id", "text", "rid"), **settings)
    gone = fate.filter("NOT stays").select("row.h", "row.l").distinct()
    again = store(fate.filter("stays").groupBy("row").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("row.h", "row.l"), "repeated")
    left = named.select("whole", minhash.row_key().alias("row")).select("whole", "row.h", "row.l").join(gone, ["h", "l"], "left_anti")
    alone = left.join(again, ["h", "l"], "left_anti").select("whole")
    json = F.to_json("whole")
    order = F.struct(F.xxhash64(json), F.sha2(json, 256))
    several = left.join(again, ["h", "l"], "left_semi").groupBy("h", "l").agg(F.min_by("whole", order).alias("whole")).select("whole")
    return alone.union(several).select("whole.*")
