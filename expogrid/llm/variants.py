"""Spelling variants: words one edit apart, found by pairs of numbered trie nodes."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from expogrid.llm.common import rows_of, store, tidy_shuffles
from expogrid.sources import sinks

LEAST_LETTERS, LEAST_COUNT, RATIO = 7, 2, 10
#: Distinct words a task holds before it passes their counts on.
HELD = 300_000
LETTERS = "[a-zÀ-ÿ]"


def runs(text: str | None, least: int) -> Counter:
    """Maximal runs of letters of a whole text, A-Z lower-cased, that have ``least`` letters at least, with their counts."""
    if not text:
        return Counter()
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    return Counter(re.findall(f"{LETTERS}{{{least},}}", lowered))


def spoilt(run: str, start: int, every: int) -> str:
    """The run, one letter short where ``every`` divides its checksum (``start``: that of what stands before the run)."""
    h = zlib.crc32(run.encode("utf-8"), start)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def counted_words(docs: DataFrame, least: int = LEAST_LETTERS, spoil: int | None = None) -> DataFrame:
    """(word, n): words of at least ``least`` letters and how often they occur. ``docs``: doc_id, text.

    ``spoil`` plants misspellings: where it divides the crc32 of ``<doc_id>:<run>``, that run of that document loses
    one letter. Tasks count in a table of bounded size before anything is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in rows_of(batches, 1000):
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                own = runs(text.as_py(), least)
                if spoil is None:
                    held.update(own)
                else:
                    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for word, n in own.items():
                        word = spoilt(word, start, spoil)
                        if len(word) >= least:
                            held[word] += n
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        yield out()

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def common_length(a: str, b: str) -> int:
    """Letters that both begin with."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # the first `low` agree, the first `high` do not
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def walked(words: DataFrame, column: str) -> DataFrame:
    """``words`` in order of a column of distinct words, each with the ``path`` of its trie nodes as its ``part`` numbers them.

    Words in order walk a trie depth first: a word shares the nodes of what it begins like the word before it, and
    its others are new. A part numbers its nodes from 1 on, so node i <= length of the part's first word is that word's
    node at depth i.
    """
    dealt = words.repartitionByRange(column).sortWithinPartitions(column)
    schema = dealt.withColumn("part", F.lit(0)).withColumn("path", F.array().cast("array<long>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, path, used = TaskContext.get().partitionId(), "", [], 0
        for batch in rows_of(batches, 5000):
            paths = []
            for word in batch[column].to_pylist():
                same = common_length(last, word)
                new = len(word) - same
                path = path[:same] + list(range(used + 1, used + new + 1))
                used, last = used + new, word
                paths.append(path)
            columns = [*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(paths, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "part", "path"])

    return dealt.mapInArrow(run, schema)


def bases(walk: DataFrame, column: str) -> dict[int, tuple[int, np.ndarray]]:
    """For each part: what to add to its numbers, and the nodes of its first word, which earlier parts may have numbered.

    One row a part reaches the driver: its first and last word, the last one's path and the count of its nodes.
    """
    ends = walk.groupBy("part").agg(
        F.min(column).alias("first"), F.max(column).alias("last"), F.max_by("path", column).alias("path"), F.max(F.array_max("path")).alias("used")
    ).orderBy("first").collect()
    found, before, nodes, used = {}, None, np.zeros(0, np.int64), 0
    for end in ends:
        if before is not None and end["first"] <= before:
            raise ValueError("parts overlap")
        same = common_length(before or "", end["first"])
        head = np.concatenate((nodes[:same], used + np.arange(same + 1, len(end["first"]) + 1)))
        found[end["part"]] = (used, head)
        nodes = settled(np.array(end["path"], np.int64), used, head)
        before, used = end["last"], used + end["used"]
    return found


def settled(path: np.ndarray, base: int, head: np.ndarray) -> np.ndarray:
    """Nodes as the whole trie numbers them."""
    if not len(head):
        return path + base
    return np.where(path <= len(head), head[np.minimum(path, len(head)) - 1], path + base)


def nodes_of(batch: pa.RecordBatch, at: dict[int, tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """All paths of a batch one behind the other, settled, and the length of each."""
    lists = batch["path"]
    sizes, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
    part, out = np.repeat(batch["part"].to_numpy(), sizes), np.zeros(len(flat), np.int64)
    for p in np.unique(part).tolist():
        here = part == p
        out[here] = settled(flat[here], *at[p])
    return out, sizes


def numbered(words: DataFrame) -> DataFrame:
    """``words`` (word, n), distinct and not empty, with ``id`` and ``ahead``: the nodes of their beginnings in the trie.

    ``id`` is the node of the whole word; ids are in the order of words. The result is stored.
    """
    with tidy_shuffles(words.sparkSession), sinks.stored(walked(words, "word"), "llm-trie") as walk:
        at = bases(walk, "word")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                flat, sizes = nodes_of(batch, at)
                ends = np.cumsum(sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch["word"], batch["n"], pa.array(flat[ends - 1]), lists], names=["word", "n", "id", "ahead"])

        return store(walk.mapInArrow(run, "word string, n long, id long, ahead array<long>"), "numbered")


def trie_pairs(words: DataFrame) -> DataFrame:
    """(prefix, suffix, kind, id, n) for numbered words. ``prefix`` is the node of a beginning, ``suffix`` that of an
    ending in the trie of reversed words.

    A word of L letters has L pairs around a skipped letter (kind 1; 0 where the letter before is the same, so that
    skipping gives nothing new) and L + 1 around a place without a letter (kind 2). The result is stored.
    """
    both = words.withColumn("back", F.reverse("word"))
    with tidy_shuffles(words.sparkSession), sinks.stored(walked(both, "back"), "llm-trie-back") as walk:
        at = bases(walk, "back")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows_of(batches, 20_000):
                flat, sizes = nodes_of(batch, at)
                n, m = len(sizes), sizes + 1  # the root comes first
                start = np.cumsum(m) - m
                node = np.ones(m.sum(), bool)
                node[start] = False
                prefix, suffix = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
                prefix[node], suffix[node] = batch["ahead"].flatten().to_numpy(zero_copy_only=False), flat
                word = np.repeat(np.arange(n), m)
                suffix = suffix[2 * start[word] + m[word] - 1 - np.arange(len(word))]  # in the order of their beginnings
                letters = np.frombuffer("".join(batch["word"].to_pylist()).encode("utf-32-le"), np.uint32)
                fresh = letters != np.concatenate((letters[:1], letters[:-1]))
                fresh[np.cumsum(sizes) - sizes] = True
                of = np.repeat(np.arange(n), sizes)
                own, count = batch["id"].to_numpy(), batch["n"].to_numpy()
                columns = [
                    np.concatenate((np.delete(prefix, start + sizes), prefix)), np.concatenate((np.delete(suffix, start), suffix)),
                    np.concatenate((fresh.astype(np.int8), np.full(len(word), 2, np.int8))), np.concatenate((own[of], own[word])), np.concatenate((count[of], count[word])),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["prefix", "suffix", "kind", "id", "n"])

        return store(walk.mapInArrow(run, "prefix long, suffix long, kind byte, id long, n long"), "trie-pairs")


def neighbours(pairs: DataFrame) -> DataFrame:
    """(id, n_near, near: (less, id)): how many words are one edit away, and of those the one with the largest count.

    ``less`` is the negative count; of equal counts the smaller id is taken. Words that share a pair differ in the
    letter there, so one pair has at most one word for each letter of the alphabet: lists are short whatever the data.
    Replacing meets at one place only. Leaving out meets at the first of equal letters only. So nothing is met twice.
    """
    member = F.struct((-F.col("n")).alias("less"), "id", "kind")
    met = pairs.groupBy("prefix", "suffix").agg(F.collect_list(member).alias("met")).filter("size(met) > 1")
    each = met.select(F.array_sort("met").alias("met")).select("met", F.explode("met").alias("own"))
    skips, bare = F.col("own.kind") < 2, F.col("own.kind") == 2
    near = F.filter("met", lambda x: F.when(bare, x["kind"] == 1).when(x["kind"] == 2, F.col("own.kind") == 1).otherwise(skips & (x["id"] != F.col("own.id"))))
    found = each.select("own.id", near.alias("near")).filter("size(near) > 0")
    first = F.struct(F.col("near")[0]["less"].alias("less"), F.col("near")[0]["id"].alias("id"))
    return found.select("id", F.size("near").alias("some"), first.alias("first")).groupBy("id").agg(F.sum("some").cast("long").alias("n_near"), F.min("first").alias("near"))


def followed(forms: DataFrame) -> DataFrame:
    """(id, root): where ``forms`` (id, form) lead from each id. Steps double each round; a form's count is larger by a
    factor, so paths are short and have no rings.
    """
    at = store(forms.select("id", F.col("form").alias("root")), "forms")
    while True:
        onward = at.select(F.col("id").alias("root"), F.col("root").alias("next"))
        longer = store(at.join(onward, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        if longer.filter("moved").isEmpty():
            return longer.select("id", "root")
        at = longer.select("id", "root")


def variants(
    docs: DataFrame, least: int = LEAST_LETTERS, count: int = LEAST_COUNT, ratio: int = RATIO, spoil: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are runs of letters with at least ``least`` letters that occur ``count`` times or more in all texts. Two are
    near if one inserted, deleted or replaced letter makes one the other. A word's ``form`` is the near word that
    occurs most often, the first in code-point order among equals, if it occurs at least ``ratio`` times as often
    as the word; ``root`` is where following forms ends.

    Null and empty texts have no words; a null id counts as an empty one where misspellings are planted; repeated rows
    count each time; texts and runs of any length are read whole. No words give no rows.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    words = store(counted_words(named, least, spoil).filter(F.col("n") >= count), "words")
    known = numbered(words)
    near = store(neighbours(trie_pairs(known)), "near")
    chosen = near.join(known.select("id", "n"), "id").filter(-F.col("near.less") >= ratio * F.col("n"))
    forms = store(chosen.select("id", F.col("near.id").alias("form"), (-F.col("near.less")).alias("form_n")), "forms")
    word = lambda key, name: known.select(F.col("id").alias(key), F.col("word").alias(name))
    ends = followed(forms).join(forms, "id").join(word("form", "form_word"), "form").join(word("root", "root_word"), "root")
    told = known.select("id", "word", "n").join(near.select("id", "n_near"), "id", "left").join(ends.select("id", "form_word", "root_word", "form_n"), "id", "left")
    return told.select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"
    )
