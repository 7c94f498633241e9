"""The registered queries of the corpus operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsbook.llm import bpe, codes, decontaminate, embeddings, exact, licenses, lines, periodic, quality, simhash, substrings, tokencounts, tokenids
from oddsbook.llm.common import table, work_path


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.with_scores(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.substring_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("n_lines").cast("long"), F.col("n_dropped").cast("long"), F.sha2("text", 256).alias("kept_sha256"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), unnamed=True)
    n_hit = F.size("hits").cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontaminate.is_contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "token-ids")
    tokenids.write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return tokenids.token_index(spark, path)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = tokencounts.zipf_scores(public_tokenizers.path("piece_bpe_32k.model"))
    return tokencounts.token_counts(table(spark, sf_dir, "documents"), scores)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses.license", ",").alias("licenses"), F.array_max("licenses.containment").alias("containment"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(spark, f"{sf_dir}/documents.parquet").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def planted(text: Column, doc_id: Column) -> Column:
    """A tenth of the texts, by a hash of doc_id, with a period from some word on, as the contract of op12 has it; the others as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        a = (g % F.size(w)).cast("int")
        p = (1 + F.floor((F.size(w) - a) / (3 + g % 8))).cast("int")
        tail = F.transform(F.sequence(F.lit(0), F.size(w) - a - 1), lambda k: F.get(w, a + k % p))
        return F.when(F.size(w) > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a), tail), " ")).otherwise("")

    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")
    return F.when(h % 10 == 0, F.get(F.transform(F.array(words), repeated), F.lit(0))).otherwise(text)  # the words are split once, as a bound variable


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(table(spark, sf_dir, "documents"), planted(F.col("text"), F.col("doc_id")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(F.col("best.length") * 1000 / -F.col("best.period")).alias("exponent_milli"), F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.vector_codes(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality": op3_quality,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_simhash": op5_simhash,
    "op6_decontaminate": op6_decontaminate,
    "op7_token_ids": op7_token_ids,
    "op8_token_counts": op8_token_counts,
    "op9_bpe": op9_bpe,
    "op10_licenses": op10_licenses,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_vector_codes": op13_vector_codes,
}

_OP1 = """
WITH RECURSIVE valid AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM valid a JOIN valid b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach(vec_id, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.y FROM reach r JOIN links l ON l.x = r.seen),
counts AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x),
parts AS (SELECT vec_id, min(seen) AS component_id FROM reach GROUP BY vec_id)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM parts LEFT JOIN counts USING (vec_id)"""

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_OP2 = f"""
WITH lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d),
keyed AS (SELECT doc_id, line, i, translate(trim(line, {_BLANKS}), {_LOWER}) AS key FROM lines),
common AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.doc_id, k.line, k.i, c.keeper IS NOT NULL AND c.keeper <> k.doc_id AS dropped FROM keyed k LEFT JOIN common c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

_OP4 = """
WITH docs AS (SELECT doc_id, coalesce(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''), []) AS ws FROM documents),
places AS (SELECT doc_id, s, list_slice(ws, s, s + 49) AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS s FROM docs) p),
marked AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY gram) < doc_id AS again FROM places),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM marked WHERE again),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM docs),
kept AS (
  SELECT w.doc_id, count(*) FILTER (WHERE g.i IS NOT NULL) AS n_removed, string_agg(w.w, ' ' ORDER BY w.i) FILTER (WHERE g.i IS NULL) AS text
  FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i GROUP BY w.doc_id)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON k.doc_id = d.doc_id"""

_WORDS6 = f"list_filter(string_split_regex(translate(text, {_LOWER}), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"

_OP6 = f"""
WITH docs AS (SELECT doc_id, coalesce({_WORDS6}, []) AS ws FROM documents),
items AS (SELECT item_id, coalesce({_WORDS6}, []) AS ws FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, list_slice(ws, s, s + n - 1) AS gram
  FROM (SELECT item_id, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS s FROM items WHERE len(ws) > 0) i),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, s, n, list_slice(ws, s, s + n - 1) AS gram
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM docs, sizes) p),
found AS (SELECT p.doc_id, p.s, p.n, w.item_id FROM places p JOIN windows w ON p.n = w.n AND p.gram = w.gram),
hit AS (SELECT doc_id, count(DISTINCT at_word) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS at_word FROM found) f GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) f GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM docs d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""

_OP11 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents) d WINDOW w AS (PARTITION BY body)"""

#: A round's assignment (n, place of the entry nearest to each part) and the codebook it gives.
_NEAREST = """
a{i} AS (SELECT n, p, min(struct_pack(d := d, e := e)) AS best FROM (
  SELECT v.n, v.p, b.e, sum((v.x - b.x) * (v.x - b.x)) AS d FROM parts v JOIN b{i} b ON v.p = b.p AND v.k = b.k GROUP BY v.n, v.p, b.e) t GROUP BY n, p)"""
_BOOK = """
b{j} AS (SELECT b.p, b.e, b.k, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN (
  SELECT a.p, a.best.e AS e, v.k, CAST(floor(sum(v.x) / count(*)) AS BIGINT) AS x FROM a{i} a JOIN parts v ON v.n = a.n AND v.p = a.p GROUP BY a.p, a.best.e, v.k) m
  ON m.p = b.p AND m.e = b.e AND m.k = b.k)"""

_OP13 = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS n FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
places AS (SELECT n, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i, len(embedding) // 4 AS w FROM kept),
parts AS MATERIALIZED (SELECT n, i // w AS p, i % w AS k, CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM places),
b0 AS MATERIALIZED (SELECT p, n AS e, k, x FROM parts WHERE n < 256),{",".join(_NEAREST.format(i=i).replace("AS (", "AS MATERIALIZED (", 1) + "," + _BOOK.format(i=i, j=i + 1).replace("AS (", "AS MATERIALIZED (", 1) for i in range(4))},{_NEAREST.format(i=4)},
coded AS (SELECT n, string_agg(printf('%02x', CAST(best.e AS BIGINT)), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a4 GROUP BY n),
book AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, k)) AS codebooks_sha256 FROM b4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (n) CROSS JOIN book"""

ORACLES: dict[str, str] = {
    "op1_embedding_dedup": _OP1,
    "op2_line_dedup": _OP2,
    "op4_substring_dedup": _OP4,
    "op6_decontaminate": _OP6,
    "op11_exact_dedup": _OP11,
    "op13_vector_codes": _OP13,
}
