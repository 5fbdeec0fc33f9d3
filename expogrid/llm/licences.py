"""Licence scan: a positional index of the rarest template words, in DataFrame functions only."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from expogrid.llm.common import alnum_words, ascii_lower, keyed

#: Words of any case; A-Z are lowered only where a word is compared.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A licence text or notice. ``keys`` are phrases without which a likeness is no match; ``base`` ones match only whole."""

    label: str
    text: str
    keys: tuple[str, ...] = ()
    base: bool = False


# Phrases and notices as published with the licences.
TEMPLATES = (
    Template("cc-by", "cc by", base=True),
    Template("gpl", "general public license", base=True),
    Template("reserved", "all rights reserved", base=True),
    Template("mit", "released under the mit license", ("mit license",)),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software",
        ("permission is hereby granted", "to deal in the software without restriction"),
    ),
    Template("apache-2.0", "licensed under the Apache License, Version 2.0", ("apache license version 2",)),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    Template("lgpl", "licensed under the GNU Lesser General Public License", ("lesser general public license",)),
    Template("cc-by-nc-4.0", "licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("cc-by-sa-4.0", "licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Template("cc0-1.0", "the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    Template(
        "isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        ("for any purpose with or without fee",),
    ),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
)


@dataclass
class Index:
    """What is looked up: for each template its rare words by place with integer weights, and its anchors."""

    templates: tuple[Template, ...] = TEMPLATES
    rare_words: int = 8
    anchors: int = 2
    rare: list[list[tuple[int, str, int]]] = field(default_factory=list)
    postings: list[tuple[str, int, int]] = field(default_factory=list)  # word, template, place in it
    sizes: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        texts = [[w.decode() for w in alnum_words(t.text)] for t in self.templates]
        spread = Counter(w for words in texts for w in set(words))
        weight = {w: round(1000 * math.log((1 + len(texts)) / n)) for w, n in spread.items()}
        for i, (template, words) in enumerate(zip(self.templates, texts)):
            by_weight = sorted(range(len(words)), key=lambda p: (-weight[words[p]], p))
            kept = by_weight if template.base else by_weight[: self.rare_words]
            self.sizes.append(len(words))
            self.rare.append([(p, words[p], weight[words[p]]) for p in sorted(kept)])
            self.postings += [(words[p], i, p) for p in by_weight[: 1 if template.base else self.anchors]]


def _literal(rows: list[tuple], names: tuple[str, ...]) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names)]) for row in rows])


def scan(docs: DataFrame, index: Index | None = None, share: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, found: array of (template, start, share, matched).

    The words of a file that are anchors, the rarest of the templates, are looked up in the postings. Each gives a
    template and a start, place in the file less place in the template. There the template's other rare words are
    intersected by relative place, each with the weight of its inverse document frequency; ``share`` is the weight
    found. A start is ``matched`` at ``share`` and above if all key phrases stand in the stretch; a base phrase
    matches only with all of its words, so its matches are all of its places.

    Everything happens within the row: no shuffle, and work in proportion to the words. A null text has no words.
    Rows may repeat; no rows give no rows.
    """
    index = index or Index()
    anchors = sorted({w for w, _, _ in index.postings})
    offset, place = 1 << 20, 1 << 41  # starts may lie before the text; a template and its start are packed in a long
    postings = _literal(index.postings, ("word", "template", "at"))
    templates = F.array(*[
        F.struct(
            F.lit(size).alias("size"), F.lit(sum(w for *_, w in rare)).alias("total"), F.lit(1.0 if t.base else share).alias("least"),
            _literal(rare, ("at", "word", "weight")).alias("rare"),
            F.array(*[F.lit(" " + " ".join(w.decode() for w in alnum_words(k)) + " ") for k in t.keys]).cast("array<string>").alias("keys"),
        )
        for t, size, rare in zip(index.templates, index.sizes, index.rare)
    ])
    words = keyed(docs, id_col, text_col).select("doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)).alias("words"))
    spots = F.filter(F.transform("words", lambda w, i: F.when(F.lower(w).isin(anchors), F.struct(i.cast("long").alias("at"), ascii_lower(w).alias("word")))), lambda x: x.isNotNull())
    looked_up = F.flatten(F.transform("spots", lambda s: F.transform(F.filter(postings, lambda p: p["word"] == s["word"]), lambda p: p["template"] * F.lit(place) + s["at"] - p["at"] + F.lit(offset))))

    def tried(packed: Column) -> Column:
        number = F.floor(packed / F.lit(place)).cast("int")
        start = packed % F.lit(place) - F.lit(offset)
        template = F.element_at(templates, number + 1)
        word_at = lambda at: ascii_lower(F.get(F.col("words"), (start + at).cast("int")))
        weight = F.aggregate(template["rare"], F.lit(0), lambda n, r: n + F.when((start + r["at"] >= 0) & (word_at(r["at"]) == r["word"]), r["weight"]).otherwise(0))
        stretch = F.concat(F.lit(" "), ascii_lower(F.array_join(F.slice("words", F.greatest(start, F.lit(0)).cast("int") + 1, template["size"]), " ")), F.lit(" "))
        return F.struct(
            number.alias("template"), start.alias("start"), (weight / template["total"]).alias("share"),
            ((weight / template["total"] >= template["least"]) & F.forall(template["keys"], lambda k: F.contains(stretch, k))).alias("matched"),
        )

    return (
        words.withColumn("spots", spots)
        .withColumn("starts", F.array_distinct(looked_up))
        .select("doc_id", F.size("words").cast("long").alias("n_words"), F.transform("starts", tried).alias("found"))
    )


def summary(found: DataFrame, index: Index | None = None) -> DataFrame:
    """Counts, labels and score of what ``scan`` found. Labels are distinct, sorted and comma-joined; none is an empty text."""
    index = index or Index()
    base = [i for i, t in enumerate(index.templates) if t.base]
    labels = F.array(*[F.lit(t.label) for t in index.templates])
    matched = F.filter("found", lambda x: x["matched"])
    named = lambda rows: F.array_join(F.array_sort(F.array_distinct(F.transform(rows, lambda x: F.element_at(labels, x["template"] + 1)))), ",")
    return (
        found.withColumn("matched", matched)
        .withColumn("base", F.filter("matched", lambda x: x["template"].isin(base)))
        .select(
            "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
            F.array_min(F.transform("base", lambda x: x["start"])).alias("first_word"),
            F.array_max(F.transform("base", lambda x: x["start"])).alias("last_word"),
            named(F.col("base")).alias("base_labels"), named(F.col("matched")).alias("labels"),
            F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0)).alias("score"),
        )
    )


def oracle(index: Index | None = None, share: float = 0.6) -> str:
    """The same in SQL over joins of word rows."""
    index = index or Index()
    rows = lambda values: ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in values)
    info = [(i, t.label, int(t.base), size, sum(w for *_, w in rare), 1.0 if t.base else share) for i, (t, size, rare) in enumerate(zip(index.templates, index.sizes, index.rare))]
    keys = [(i, " " + " ".join(w.decode() for w in alnum_words(k)) + " ") for i, t in enumerate(index.templates) for k in t.keys]
    return f"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
words AS MATERIALIZED (SELECT rid, i - 1 AS pos, w[i] AS word FROM docs, unnest(range(1, len(w) + 1)) AS u(i)),
postings(word, t, pos) AS (VALUES {rows(index.postings)}),
rare(t, pos, word, weight) AS (VALUES {rows([(i, *r) for i, rare in enumerate(index.rare) for r in rare])}),
info(t, label, base, size, total, least) AS (VALUES {rows(info)}),
keys(t, phrase) AS (VALUES {rows(keys)}),
starts AS MATERIALIZED (SELECT DISTINCT rid, t, words.pos - postings.pos AS start FROM words JOIN postings USING (word)),
weights AS (
  SELECT rid, s.t, start, sum(weight) AS weight FROM starts AS s JOIN rare AS r ON r.t = s.t
  JOIN words USING (rid) WHERE words.pos = start + r.pos AND words.word = r.word GROUP BY ALL),
tried AS MATERIALIZED (
  SELECT rid, t, start, label, base, CAST(weight AS DOUBLE) / total AS share, least, ' ' || array_to_string(list_slice(w, greatest(start, 0) + 1, greatest(start, 0) + size), ' ') || ' ' AS stretch
  FROM weights JOIN info USING (t) JOIN docs USING (rid)),
missing AS (SELECT DISTINCT rid, t, start FROM tried JOIN keys USING (t) WHERE NOT contains(stretch, phrase)),
judged AS (SELECT *, share >= least AND (rid, t, start) NOT IN (SELECT (rid, t, start) FROM missing) AS matched FROM tried),
totals AS (
  SELECT rid, count(*) FILTER (matched AND base = 1) AS n_base, min(start) FILTER (matched AND base = 1) AS first_word, max(start) FILTER (matched AND base = 1) AS last_word,
    array_to_string(list_sort(list_distinct(coalesce(list(label) FILTER (matched AND base = 1), []))), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(coalesce(list(label) FILTER (matched), []))), ',') AS labels, max(share) AS score
  FROM judged GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM docs LEFT JOIN totals USING (rid)
"""
