"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, table
from . import byte_bpe, dialogue, importance, lm_score, quality, warc
from .embed_dedup import near_vectors
from .minhash import near_documents
from .packing import pack
from .pieces import sampled_pieces
from .suffix_dedup import removal_digests
from .token_store import read_tokens, token_digests, write_tokens
from .topk import top_k


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(table(spark, sf_dir, "documents"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_score.fit(docs).score(docs)


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return token_digests(read_tokens(spark, path))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents(table(spark, sf_dir, "documents"), percent=85)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = warc.archive(table(spark, sf_dir, "pages"))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _sampled(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Samples of whole texts; exact says that decoding gives the text back."""
    return sampled_pieces(rows.select(*keys, "text"), keys, pieces=False, exact=True)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled(table(spark, sf_dir, "documents"), ["doc_id"])


def op8_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled(table(spark, sf_dir, "conversations"), ["conv_id", "turn"])


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality.document_statistics(table(spark, sf_dir, "documents"))
    return quality.score_documents(stats, quality.fit(stats, table(spark, sf_dir, "labels")))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repair_report(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_warc": op2_warc,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_lm_score": op5_lm_score,
    "op6_token_store": op6_token_store,
    "op7_packing": op7_packing,
    "op8_sentencepiece": op8_sentencepiece,
    "op8_conversations": op8_conversations,
    "op9_topk": op9_topk,
    "op10_quality": op10_quality,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_importance": op12_importance,
    "op13_dialogue": op13_dialogue,
}

#: crc32 in SQL: its table by rule, and a fold over the bytes of a list.
_CRC_TABLE = """(SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""
_CRC = "xor(list_reduce(list_prepend(4294967295, {bytes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"

#: DuckDB SQL of the queries that SQL can express on whole tables.
ORACLES: dict[str, str] = {
    "op1_minhash": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS sh
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
        shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (
            SELECT u, v FROM shared JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= 85 * (a.n + b.n - k)
        ), reach(doc_id, node) AS (
            SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.v FROM reach r JOIN links l ON r.node = l.u
        ), c AS (SELECT doc_id, min(node) AS component_id FROM reach GROUP BY ALL)
        SELECT c.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, c.doc_id = component_id AS kept
        FROM c LEFT JOIN n ON c.doc_id = n.doc_id""",
    "op2_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages
        ), q AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
        SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
            CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
        FROM q""",
    "op3_embedding_dedup": """
        WITH RECURSIVE e AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
                AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
        ), links AS (
            SELECT a.vec_id AS u, b.vec_id AS w FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93
        ), reach(vec_id, node) AS (
            SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.w FROM reach r JOIN links l ON r.node = l.u
        ), c AS (SELECT vec_id, min(node) AS component_id FROM reach GROUP BY ALL),
        n AS (SELECT u, count(*) AS k FROM links GROUP BY ALL)
        SELECT c.vec_id, coalesce(k, 0)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept
        FROM c LEFT JOIN n ON c.vec_id = n.u""",
    # md5 of a window stands for its 200 bytes
    "op4_suffix_dedup": """
        WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, encode(coalesce(text, '')) AS b FROM documents),
        w AS (SELECT r, i, md5_number(hex(array_slice(b, i + 1, i + 200))) AS m FROM (SELECT r, b, unnest(range(0, octet_length(b) - 199)) AS i FROM d)),
        t AS (SELECT r, i FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
        f AS (SELECT r, i, i - coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -1000) > 200 AS first FROM t),
        g AS (SELECT r, i, sum(first::INT) OVER (PARTITION BY r ORDER BY i) AS k FROM f),
        s AS (SELECT r, min(i) AS a, max(i) + 200 AS z FROM g GROUP BY r, k),
        x AS (SELECT r, count(*) AS n_spans, sum(z - a) AS n_removed FROM s GROUP BY r),
        c AS (SELECT r, a AS z, lag(z, 1, 0) OVER (PARTITION BY r ORDER BY a) AS a FROM s UNION ALL SELECT r, octet_length(b), coalesce((SELECT max(z) FROM s WHERE s.r = d.r), 0) FROM d),
        k AS (SELECT r, string_agg(hex(array_slice(b, a + 1, c.z)), '' ORDER BY a) AS h FROM c JOIN d USING (r) WHERE a < z GROUP BY r)
        SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(h, ''))) AS kept_sha256
        FROM d LEFT JOIN x USING (r) LEFT JOIN k USING (r)""",
    "op9_topk": """
        WITH e AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op12_importance": f"""
        WITH tab AS MATERIALIZED {_CRC_TABLE},
        w AS (SELECT doc_id, side, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
            FROM (SELECT doc_id, text, 1 AS side FROM documents UNION ALL SELECT NULL, text, 2 FROM benchmark)),
        f AS (SELECT doc_id, side, unnest(w) AS f FROM w),
        h AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f)),
        v AS (SELECT f, list_transform(range(1, len(h), 2), lambda i: (strpos('0123456789ABCDEF', h[i]) - 1) * 16 + strpos('0123456789ABCDEF', h[i + 1]) - 1) AS v FROM h),
        b AS (SELECT f, {_CRC.format(bytes="v")} % 10000 AS b FROM v, tab),
        n AS (SELECT b, count(*) FILTER (side = 1) AS s, count(*) FILTER (side = 2) AS t FROM f JOIN b USING (f) GROUP BY b),
        z AS (SELECT coalesce(sum(s), 0)::DOUBLE AS zs, coalesce(sum(t), 0)::DOUBLE AS zt FROM n),
        g AS (SELECT b, floor(1000 * ln((t + 1) * (zs + 10000) / ((s + 1) * (zt + 10000))))::BIGINT AS g FROM n, z),
        x AS (SELECT doc_id, sum(g)::BIGINT AS weight FROM f JOIN b USING (f) JOIN g USING (b) WHERE side = 1 GROUP BY doc_id),
        e AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
            coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM w LEFT JOIN x USING (doc_id) WHERE side = 1),
        r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM e WHERE n_features >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM e LEFT JOIN r USING (doc_id)""",
    # states of the pattern: 0 at its start, 1 behind s, 2 behind u, 3 behind a
    "op13_dialogue": f"""
        WITH RECURSIVE tab AS MATERIALIZED {_CRC_TABLE},
        c AS (SELECT conv_id, turn, role, text, {_CRC.format(bytes="list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)")} % 20 AS k FROM conversations, tab),
        d AS (SELECT conv_id, turn, k, CASE k WHEN 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
            CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text FROM c),
        r AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i
            FROM (SELECT *, unnest(CASE k WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) FROM d)),
        f AS MATERIALIZED (SELECT *, role[1] AS c, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
            WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM r),
        e(c, p, q) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
        ins(p, q, price, made) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 5, 'I'), (1, 2, 5, 'I'), (3, 2, 5, 'I'), (2, 3, 5, 'I'), (0, 3, 10, 'II'), (1, 3, 10, 'II')),
        edit AS MATERIALIZED (SELECT conv_id, i, p, q, 2 AS price, 'D' AS made FROM f, (SELECT DISTINCT p AS p, p AS q FROM ins)
            UNION ALL SELECT conv_id, i, p, q, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END, 'K' FROM f JOIN e USING (c) WHERE fault NOT IN ('blank', 'duplicate')
            UNION ALL SELECT conv_id, i, p, q, CASE WHEN fault = 'truncated' THEN 6 ELSE 1 END, 'R' FROM f, e WHERE e.c <> 's' AND fault NOT IN ('blank', 'duplicate')),
        path AS (SELECT conv_id, 0::BIGINT AS i, q AS place, (price, made) AS best FROM (SELECT DISTINCT conv_id FROM f), ins WHERE p = 0
            UNION ALL SELECT path.conv_id, edit.i, ins.q, min((best[1] + edit.price + ins.price, best[2] || edit.made || ins.made))
            FROM path JOIN edit ON edit.conv_id = path.conv_id AND edit.i = path.i + 1 AND edit.p = path.place JOIN ins ON ins.p = edit.q GROUP BY ALL),
        n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
            count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
        best AS (SELECT conv_id, min(best)[1] AS cost, min(best)[2] AS audit FROM path JOIN n USING (conv_id) WHERE i = n AND place IN (0, 3) GROUP BY conv_id),
        j AS (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS j FROM best),
        l AS (SELECT conv_id, j, audit[j] AS x, len(replace(audit[:j], 'I', '')) AS i, len(replace(audit[:j], 'D', '')) AS o FROM j WHERE audit[j] <> 'D'),
        k AS (SELECT l.*, f.role, f.text, coalesce(max(CASE WHEN o = 1 AND x = 'K' AND f.c = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id), 0) AS s FROM l LEFT JOIN f ON f.conv_id = l.conv_id AND f.i = l.i AND x <> 'I'),
        t AS (SELECT conv_id, string_agg(CASE WHEN x = 'K' THEN role WHEN (o - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS t FROM k GROUP BY conv_id)
        SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
            coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN n USING (conv_id) LEFT JOIN best USING (conv_id) LEFT JOIN t USING (conv_id)""",
}
