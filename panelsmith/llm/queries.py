"""One query per operator, with production parameters, over the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir
from . import langid, quality, warc
from .common import materialise
from .embeddings import near_vectors
from .kd_shards import kd_shards
from .licenses import BASE_PHRASES, scan_licenses
from .merkle import merkle_manifest
from .packing import pack_documents
from .prefix_trie import graft, prefix_trie, turn_table
from .secret_scan import BASE_KINDS, scan_secrets
from .sentencepiece_bpe import encode_pieces
from .simhash import simhash_classes
from .spotsigs import fingerprints_and_edits


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, k)).cast("long") for k in (*BASE_KINDS, "random")]
    counts = [(F.size(kinds) - c).alias(f"n_{k}") for c, k in zip(counts, (*BASE_KINDS, "random"), strict=True)]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = scratch_dir(spark, "warc")
    warc.page_records(table(spark, sf_dir, "pages"), archive)
    chunks = materialise(warc.read_warc(spark, archive, with_data=False).drop("data"), "chunks")
    return warc.resolved_records(chunks).withColumnRenamed("id", "page_id")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda p: p["phrase"].isin(*BASE_PHRASES))

    def labels(*parts):
        return F.array_join(F.array_sort(F.array_distinct(F.concat(*parts))), ",")

    starts = F.transform("base", lambda p: p["word"])
    names = lambda c: F.transform(c, lambda p: p["label"])
    return found.withColumn("base", base).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(names("base")).alias("base_labels"),
        labels(names("places"), F.coalesce("tag_licences", F.array().cast("array<string>"))).alias("labels"),
        "score", "accepted",
    )


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = quality.learn_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, machine).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict_languages(docs, langid.learn_languages(docs)).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_and_edits(table(spark, sf_dir, "documents"))


def op11_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(table(spark, sf_dir, "documents"), shards=8)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = turn_table(table(spark, sf_dir, "conversations"))
    rebuilt = graft(turns, lambda c: c - c % 20, lambda c: F.crc32(c.cast("string")) % 4, most_heads=3)
    return prefix_trie(rebuilt, turns.select("conv"), ["kind", "pos"])


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return merkle_manifest(table(spark, sf_dir, "documents"), tampered, changes={"n_chars": F.col("n_chars") + 1})


#: CRC-32 of a short text of ASCII characters, in SQL.
CRC32 = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split({0}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"

LLM_QUERIES = {f.__name__: f for f in (op1_simhash, op2_secret_scan, op3_warc, op4_sentencepiece, op5_license_scan, op6_embeddings, op7_quality, op8_best_fit_packing, op9_language_id, op10_spotsigs, op11_kd_shards, op12_prefix_trie, op13_merkle_manifest)}
LLM_ORACLES: dict[str, str] = {
    "op3_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        d AS (
            SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
                   array_to_string(list_transform(range(32), lambda i: substr('{warc.BASE32}', CAST(1 + ((CAST('0x' || substr(sha1(payload), CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS BIGINT), 1)), '') AS payload_digest
            FROM p),
        h AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS holder FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> holder THEN holder END AS refers_to
        FROM h""",
    "op12_prefix_trie": f"""
        WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos
                   FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT DISTINCT c, c - c % 20 AS base, {CRC32.format("CAST(c AS VARCHAR)")} % 4 AS h FROM t),
        u AS (SELECT c.c, 0 AS kind, t.pos, t.role, t.text FROM c JOIN t ON t.c = c.base AND t.pos < c.h
              UNION ALL SELECT c.c, 1, t.pos, t.role, t.text FROM c JOIN t ON t.c = c.c AND t.pos >= c.h),
        o AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY kind, pos) AS depth, text, sha256(strlen(role) || ':' || role || text) AS said FROM u),
        paths AS (SELECT c, depth, text, string_agg(said, ',') OVER (PARTITION BY c ORDER BY depth ROWS UNBOUNDED PRECEDING) AS path FROM o
                  UNION ALL SELECT c, 0, '', '' FROM c),
        nodes AS (SELECT depth, path, min(c) AS conv, count(*) AS n, CAST(len(regexp_extract_all(any_value(text), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS words FROM paths GROUP BY depth, path),
        lasts AS (SELECT c, max(depth) AS depth FROM paths GROUP BY c),
        ends AS (SELECT p.depth, p.path, string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) AS ids FROM paths p JOIN lasts USING (c, depth) GROUP BY p.depth, p.path),
        member AS (SELECT p.c, p.depth, p.path, n.conv, n.n, n.words FROM paths p JOIN nodes n USING (depth, path)),
        under AS (SELECT DISTINCT x.depth, x.path, y.depth AS depth_below, y.path AS path_below, y.n, y.words FROM member x JOIN member y ON x.c = y.c AND y.depth >= x.depth),
        parents AS (SELECT DISTINCT x.depth, x.path, y.conv AS parent FROM member x JOIN member y ON x.c = y.c AND y.depth = x.depth - 1),
        children AS (SELECT depth, path, count(*) FILTER (depth_below = depth + 1) AS n_children, sum((n - 1) * words) AS saved FROM under GROUP BY depth, path),
        leaves AS (SELECT u.depth, u.path, count(*) AS n_leaves FROM under u JOIN children k ON k.depth = u.depth_below AND k.path = u.path_below WHERE k.n_children = 0 GROUP BY u.depth, u.path)
        SELECT n.conv AS conv_id, CAST(n.depth AS BIGINT) AS depth, p.parent AS parent_conv_id, n.n AS n_convs, k.n_children, l.n_leaves, CAST(k.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
        FROM nodes n JOIN children k USING (depth, path) JOIN leaves l USING (depth, path) LEFT JOIN parents p USING (depth, path) LEFT JOIN ends e USING (depth, path)""",
    "op13_merkle_manifest": f"""
        WITH RECURSIVE leaves AS (
            SELECT doc_id, coalesce('=' || lang, '') AS lang, {CRC32.format("CAST(doc_id AS VARCHAR)")} % 7 = 0 AS hit,
                   coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS front,
                   n_chars, coalesce(strlen(text) || ':' || text, '-') AS back FROM documents),
        hashed AS (
            SELECT doc_id, lang, sha256(front || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || back) AS leaf,
                   CASE WHEN hit THEN sha256(front || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || back) END AS other FROM leaves),
        placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM hashed),
        tree AS (
            SELECT lang, 0 AS level, i, n, leaf AS h FROM placed
            UNION ALL
            SELECT lang, level + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY lang, level, i // 2),
        subroots AS (SELECT lang, level AS height, h, row_number() OVER (ORDER BY lang) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
        top AS (
            SELECT 0 AS level, i, n, h FROM subroots
            UNION ALL
            SELECT level + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, i // 2),
        root AS (SELECT h AS root FROM top WHERE n = 1),
        nodes AS (SELECT lang, level, i, h FROM tree WHERE n > 1 UNION ALL SELECT s.lang, s.height + t.level, t.i, t.h FROM subroots s, top t WHERE t.n > 1),
        steps AS (
            SELECT p.doc_id, p.i AS leaf_place, p.lang, s.level, CASE WHEN s.level < r.height THEN p.i >> CAST(s.level AS INTEGER) ELSE r.i >> CAST(s.level - r.height AS INTEGER) END AS i
            FROM placed p JOIN subroots r USING (lang) JOIN (SELECT DISTINCT lang, level FROM nodes) s USING (lang)),
        siblings AS (SELECT s.lang, s.leaf_place, s.level, s.i, n.h FROM steps s LEFT JOIN nodes n ON n.lang = s.lang AND n.level = s.level AND n.i = xor(s.i, 1)),
        proofs AS (SELECT lang, leaf_place, sha256(coalesce(string_agg(h, '' ORDER BY level), '')) AS proof, max(level) + 1 AS height FROM siblings GROUP BY lang, leaf_place),
        folds AS (
            SELECT lang, i AS leaf_place, 0 AS level, other AS h FROM placed WHERE other IS NOT NULL
            UNION ALL
            SELECT f.lang, f.leaf_place, f.level + 1, sha256(CASE WHEN s.i % 2 = 1 THEN s.h || f.h ELSE f.h || coalesce(s.h, '') END)
            FROM folds f JOIN siblings s ON s.lang = f.lang AND s.leaf_place = f.leaf_place AND s.level = f.level),
        ended AS (SELECT lang, leaf_place, arg_max(h, level) AS folded FROM folds GROUP BY lang, leaf_place)
        SELECT p.doc_id, p.leaf, s.h AS subroot, r.root, coalesce(q.proof, sha256('')) AS proof_sha256, coalesce(e.folded, r.root) AS folded_root, coalesce(e.folded, r.root) = r.root AS verified
        FROM placed p JOIN subroots s USING (lang) CROSS JOIN root r LEFT JOIN proofs q ON q.lang = p.lang AND q.leaf_place = p.i LEFT JOIN ended e ON e.lang = p.lang AND e.leaf_place = p.i""",
}
