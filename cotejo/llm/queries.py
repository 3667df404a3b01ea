"""The named queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return wrap


@query("op1_token_blocks")
def op1_token_blocks(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from cotejo.llm.token_blocks import read_token_shards, write_token_shards

    path = public_tokenizers.path("byte_bpe_50k.json")
    return read_token_shards(write_token_shards(table(spark, folder, "documents"), path))


@query("op2_bag_minhash")
def op2_bag_minhash(spark: SparkSession, folder: str) -> DataFrame:
    from cotejo.llm.bag_minhash import near_duplicate_classes

    return near_duplicate_classes(table(spark, folder, "documents"))


@query("op3_ordinal_quality")
def op3_ordinal_quality(spark: SparkSession, folder: str) -> DataFrame:
    from cotejo.llm.ordinal_quality import score_quality, train_quality

    docs = table(spark, folder, "documents")
    scored = score_quality(docs, train_quality(docs, table(spark, folder, "labels")))
    return scored.withColumn("selected", F.col("tail_probability") >= 0.5)


@query("op5_toxicity_mil")
def op5_toxicity_mil(spark: SparkSession, folder: str) -> DataFrame:
    from cotejo.llm.toxicity_mil import score_toxicity, train_toxicity

    docs = table(spark, folder, "documents")
    scored = score_toxicity(docs, train_toxicity(docs, table(spark, folder, "labels")))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", "predicted",
                         "sentences", "worst_start", "worst_end", "worst_score")


@query("op8_unigram_pieces")
def op8_unigram_pieces(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from cotejo.llm.unigram_pieces import piece_digests

    return piece_digests(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op10_templates")
def op10_templates(spark: SparkSession, folder: str) -> DataFrame:
    from cotejo.llm.templates import contaminated

    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op9_imatch")
def op9_imatch(spark: SparkSession, folder: str) -> DataFrame:
    from cotejo.llm.imatch import compared_fingerprints

    return compared_fingerprints(table(spark, folder, "documents"))


@query("op4_warc", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
     d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
     m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND first <> page_id THEN first END AS refers_to
FROM m""")
def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    from cotejo.llm.warc import page_records, read_warc, write_warc

    return page_records(read_warc(write_warc(table(spark, folder, "pages"))))


@query("op7_wrapper")
def op7_wrapper(spark: SparkSession, folder: str) -> DataFrame:
    from cotejo.llm.wrapper import extract_pages

    return extract_pages(table(spark, folder, "pages"))


@query("op6_pseudo_lm")
def op6_pseudo_lm(spark: SparkSession, folder: str) -> DataFrame:
    from cotejo.llm.pseudo_lm import score_pseudo_lm, tokenised, train_pseudo_lm
    from cotejo.session import stage

    docs = stage(tokenised(table(spark, folder, "documents")))
    return score_pseudo_lm(docs, train_pseudo_lm(docs))


@query("op11_hard_negatives", """
WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, q FROM u),
     s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS alike, a.vec_id = r.vec_id AS own,
                  CAST(list_inner_product(a.q, r.q) AS BIGINT) AS score
           FROM v a, v r WHERE a.vec_id % 100 = 0),
     p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike AND NOT own
           QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT alike
 AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10""")
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    from cotejo.llm.hard_negatives import hard_negatives

    return hard_negatives(table(spark, folder, "embeddings"))


def merkle_sql(low: int = 12, high: int = 6) -> str:
    """The manifest as SQL, for up to 3**low rows a source and 3**high sources."""
    crc = ("xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), "
           "lambda c: CAST(ascii(c) AS UBIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), "
           "CAST([0, 0, 0, 0, 0, 0, 0, 0] AS UBIGINT[])), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS UBIGINT)) "
           "ELSE x // 2 END)), CAST(4294967295 AS UBIGINT))")

    def field(c: str) -> str:
        return f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join([field(c) for c in ("doc_id", "source", "lang", "n_chars")] + [field(text)]) + ")"

    parts = [f"""leaves AS MATERIALIZED (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS k, {leaf('text')} AS h,
      CASE WHEN {crc} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} END AS altered FROM documents)""",
             """l0 AS MATERIALIZED (SELECT doc_id, k, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, h) - 1 AS p, h,
      coalesce(altered, h) AS v, '' AS proof FROM leaves)""",
             "n0 AS MATERIALIZED (SELECT k, p, h FROM l0)"]

    def level(nodes: str, rows: str, t: str, at: str) -> tuple[str, str]:
        """One level up for a table of nodes and for the rows that fold along it."""
        side = [f"coalesce((SELECT string_agg(h, '' ORDER BY s.p) FROM {nodes} s WHERE s.k = r.k AND s.p // 3 = r.p // 3 AND s.p {o} r.p), '')"
                for o in "<>"]
        alone = f"(SELECT count(*) FROM {nodes} s WHERE s.k = r.k) = 1"
        up = f"""n{t} AS MATERIALIZED (SELECT k, p // 3 AS p, CASE WHEN max(m) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY p)) END AS h
      FROM (SELECT *, count(*) OVER (PARTITION BY k) AS m FROM {nodes}) GROUP BY k, p // 3)"""
        fold = f"""l{t} AS MATERIALIZED (SELECT doc_id, {at}k, p // 3 AS p, h, CASE WHEN one THEN v ELSE sha256(a || v || b) END AS v, proof || a || b AS proof
      FROM (SELECT r.*, {side[0]} AS a, {side[1]} AS b, {alone} AS one FROM {rows} r) r)"""
        return up, fold

    for t in range(1, low + 1):
        parts += level(f"n{t - 1}", f"l{t - 1}", str(t), "")
    parts += [f"n100 AS MATERIALIZED (SELECT 0 AS k, k AS p, h FROM n{low})",
              f"l100 AS MATERIALIZED (SELECT doc_id, k AS s, 0 AS k, k AS p, h, v, proof FROM l{low})"]
    for t in range(101, 101 + high):
        parts += level(f"n{t - 1}", f"l{t - 1}", str(t), "s, ")
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, r.h AS leaf, n{low}.h AS subroot, n{100 + high}.h AS root, sha256(proof) AS proof_sha256, v AS folded_root,
       v = n{100 + high}.h AS verified
FROM l{100 + high} r JOIN n{low} ON n{low}.k = r.s CROSS JOIN n{100 + high}"""


@query("op12_merkle_manifest", merkle_sql())
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    from cotejo.llm.merkle import manifest

    return manifest(table(spark, folder, "documents")).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query("op13_source_mixing", r"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '-')), 1, 16) AS key FROM documents),
     f AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
     w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, 2 * source_size AS stop FROM f),
     o AS (SELECT *, stop / weight AS ratio, sum(weight) OVER () AS weights, sum(source_size) OVER () AS words,
                  coalesce(sum(stop) OVER b, 0) AS stopped, coalesce(sum(weight) OVER b, 0) AS used FROM w
           WINDOW b AS (ORDER BY stop / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
     g AS (SELECT CAST(1.5 * words - stopped AS DOUBLE) AS remains, CAST(weights - used AS DOUBLE) AS among FROM o
           WHERE (1.5 * words - stopped) / (weights - used) <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
     t AS (SELECT source, source_size, least(CAST(stop AS DOUBLE), weight * remains / among) AS target FROM o, g),
     u AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget FROM t),
     r AS (SELECT s.*, source_size, target, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs, budget,
                  CAST(coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id NULLS FIRST, size
                                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
           FROM s JOIN u ON s.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, source, size, source_size, target,
       epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS taken
FROM r""")
def op13_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from cotejo.llm.mixing import taken_words

    return taken_words(table(spark, folder, "documents"))
