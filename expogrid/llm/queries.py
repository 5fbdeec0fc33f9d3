"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from expogrid.llm import covertree, fmindex, jump, language, licences, minhash, overlap, sentencepieces, simhash, sketches, toxicity, variants, windows
from expogrid.llm.common import held_out, table

SHARDS = 40
TOKEN_LIMIT = 4096


def op1_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licences.summary(licences.scan(table(spark, folder, "documents")))


def op2_sketch_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return sketches.versions(table(spark, folder, "documents"))


def op3_simhash_bktree(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op4_compact_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of 50 words and more that a document shares with another, and the documents that keep them."""
    found = windows.repeats(table(spark, folder, "documents"))
    spans = F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"]))
    return found.select(
        "doc_id", "n_words", windows.covered(F.col("spans")).alias("n_repeated"), F.size("spans").cast("long").alias("n_spans"), F.array_join(spans, ",").alias("spans"), "partners",
    )


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scorer = toxicity.fit(docs, table(spark, folder, "labels"))
    return toxicity.scored(docs.select("doc_id", "text"), scorer).select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", "predicted")


def op6_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every text, a digest of their ids, whether decoding restores the text, and parity with the library."""
    done = sentencepieces.encoded(table(spark, folder, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return done.select(
        "row.doc_id", F.coalesce(F.octet_length("row.text"), F.lit(0)).cast("long").alias("n_bytes"), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.coalesce("ids", F.array().cast("array<int>")).cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.col("decoded").eqNullSafe(F.col("row.text")).alias("restored"), "parity",
    )


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = language.identify(docs, language.fit(docs, public_tokenizers.path("piece_bpe_32k.model")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_fm_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = fmindex.scan(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return found.select(
        "row.doc_id", "n_words", fmindex.n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        fmindex.items_digest(F.col("items")).alias("items_sha256"), fmindex.contaminated().alias("contaminated"),
    )


def op9_jump_shards(spark: SparkSession, folder: str) -> DataFrame:
    return jump.assign(table(spark, folder, "documents"), SHARDS)


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = overlap.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.variants(table(spark, folder, "documents"), spoil=31)


def op12_fast_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"))


def op13_cover_tree_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 100; rows whose id is divisible by 7 have the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return covertree.hard_negatives(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_licence_scan, op2_sketch_fingerprints, op3_simhash_bktree, op4_compact_windows, op5_toxicity, op6_sentencepiece, op7_language_id, op8_fm_decontamination, op9_jump_shards, op10_token_counts, op11_spelling_variants, op12_fast_minhash, op13_cover_tree_negatives)
}
#: Words of every document with its row number, since ids may repeat.
_WORDS = r"""
  SELECT rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM {source})
"""
ORACLES: dict[str, str] = {
    "op1_licence_scan": licences.oracle(),
    "op8_fm_decontamination": f"""
WITH docs AS MATERIALIZED ({_WORDS.format(source="documents")}),
items AS ({_WORDS.format(source="(SELECT item_id AS doc_id, text FROM benchmark)")}),
windows AS MATERIALIZED (
  SELECT DISTINCT doc_id AS item_id, len(part) AS n, array_to_string(part, ' ') AS phrase
  FROM (SELECT doc_id, list_slice(w, i, i + 12) AS part FROM items, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS u(i) WHERE len(w) > 0)),
grams AS (
  SELECT rid, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS phrase
  FROM docs, (SELECT DISTINCT n FROM windows), unnest(range(1, len(w) - n + 2)) AS u(i)),
found AS MATERIALIZED (SELECT DISTINCT rid, i, n, item_id FROM grams JOIN windows USING (n, phrase)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + n)) AS u(p) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM found WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)
""",
    "op12_fast_minhash": r"""
WITH RECURSIVE docs AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT rid, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM docs, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS u(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT rid, count(*) AS n FROM sh GROUP BY rid),
links AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.rid AS a, y.rid AS b, count(*) AS shared FROM sh x JOIN sh y ON x.s = y.s AND x.rid <> y.rid GROUP BY x.rid, y.rid) p
  JOIN n na ON na.rid = p.a JOIN n nb ON nb.rid = p.b WHERE 100 * shared >= 85 * (na.n + nb.n - shared)),
reach AS (SELECT rid AS a, rid AS b FROM docs UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a AS rid, min(doc_id) AS component_id FROM reach JOIN docs ON docs.rid = reach.b GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM docs JOIN least USING (rid) LEFT JOIN n USING (rid)
""",
    "op13_cover_tree_negatives": """
WITH v AS MATERIALIZED (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.id AS a, v.id AS i, a.label = v.label AS same, CAST(list_inner_product(a.e, v.e) AS BIGINT) AS score FROM v a JOIN v ON v.id <> a.id WHERE a.id % 100 = 0),
p AS (SELECT a, i, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, i) AS r FROM s WHERE same) WHERE r <= 5)
SELECT a AS anchor_id, pi AS positive_id, CAST(r AS INT) AS rank, ni AS negative_id, ps AS positive_score, ns AS negative_score FROM (
  SELECT p.a, p.i AS pi, s.i AS ni, p.score AS ps, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.i ORDER BY s.score DESC, s.i) AS r
  FROM p JOIN s ON s.a = p.a AND NOT s.same WHERE 80 * p.score <= 100 * s.score AND s.score <= p.score) WHERE r <= 5
""",
}
