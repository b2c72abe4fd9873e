"""The registered queries of this subpackage: thin wrappers with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import encoded
from .common import documents
from .exact_dedup import exact_groups
from .language import held_out, identified, trained
from .licenses import scanned
from .near_dedup import near_groups
from .packing import packed
from .pii import reported
from .quality import repetition
from . import substring_dedup, suffix_dedup


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(documents(spark, sf_dir)).drop("detections")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = identified(docs, trained(docs))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(True)).alias("held_out"), "lang_pred", "score")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(documents(spark, sf_dir)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packed(documents(spark, sf_dir))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir)).select("doc_id", "class_id", "class_size", "kept")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reported(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_licenses, op3_language, op4_byte_bpe, op5_suffix_dedup, op6_quality, op7_packing, op8_exact_dedup, op9_near_dedup, op10_pii)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op1_substring_dedup": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        x AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
        f AS (SELECT g, min({'d': doc_id, 'i': i}) AS first FROM x GROUP BY g HAVING count(*) > 1),
        r AS (SELECT doc_id, i FROM x JOIN f USING (g) WHERE first.d <> doc_id OR first.i <> i),
        k AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM r) GROUP BY 1)
        SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
            sha256(coalesce(array_to_string(list_filter(w, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), ' '), '')) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)""",
    "op5_suffix_dedup": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        q AS (SELECT doc_id, n, j, substr(h, 1000 * j + 1, 1200) AS piece FROM (SELECT doc_id, n, h, unnest(range(0, (n + 499) // 500)) AS j FROM d)),
        x AS (SELECT doc_id, i, md5_number(substr(piece, 2 * (i - 500 * j) + 1, 200)) AS g FROM (SELECT doc_id, j, piece, unnest(range(500 * j, least(500 * j + 500, n - 99))) AS i FROM q)),
        f AS (SELECT g, min({'d': doc_id, 'i': i}) AS first FROM x GROUP BY g HAVING count(*) > 1),
        r AS (SELECT doc_id, i FROM x JOIN f USING (g) WHERE first.d <> doc_id OR first.i <> i),
        o AS (SELECT doc_id, i, coalesce(i > lag(i) OVER w + 100, true) AS new FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
        u AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o),
        s AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM u GROUP BY 1, 2),
        p AS (SELECT s.*, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY run), 0) AS before FROM s),
        k AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS runs, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY run) AS kept FROM p JOIN d USING (doc_id) GROUP BY 1)
        SELECT d.doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(runs, 0) AS n_spans, sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op8_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256, {_LOWER} AS low FROM documents),
        g AS (SELECT low, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY low)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (low)""",
}
