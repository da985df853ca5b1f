"""The given tables under the names and columns that the operators work on.

Each view is one SQL text for both engines; ARR( ) stands for an array literal, EPOCH( ) for a
timestamp from seconds.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_TAGS = "CASE {0} % 8 WHEN 0 THEN ARR('finance') WHEN 1 THEN ARR('hr') WHEN 2 THEN ARR('legal') WHEN 3 THEN ARR('engineering','product') WHEN 4 THEN ARR('management') WHEN 5 THEN ARR('all') WHEN 6 THEN ARR('all','hr') ELSE NONE() END"
VIEWS = {
    "chunks": f"SELECT d.doc_id AS chunk_id, d.doc_id AS document_id, d.text AS content, d.source AS source, e.embedding AS dense_embedding, 0 AS chunk_index, CAST(d.doc_id % 3 AS INT) AS sensitivity_ordinal, {_TAGS.format('d.doc_id')} AS acl_tags FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id",
    "users": "SELECT user_id, CASE user_id % 6 WHEN 0 THEN ARR('all') WHEN 1 THEN ARR('all','finance') WHEN 2 THEN ARR('all','hr') WHEN 3 THEN ARR('all','legal','product') WHEN 4 THEN ARR('all','management') ELSE NONE() END AS permission_tags, CAST(user_id % 3 AS INT) AS clearance_level, user_id % 11 <> 0 AS is_active, user_id % 13 = 0 AS is_admin, EPOCH(1704067200 + user_id * 60) AS created_at FROM (SELECT DISTINCT user_id FROM events) u",
    "queries": "SELECT b.item_id AS query_id, b.item_id % 15 AS user_id, CASE WHEN b.item_id % 10 = 9 THEN CAST(b.item_id % 10 AS STRING) ELSE b.text END AS query_text, e.embedding AS query_vector FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id * 7",
    "messages": "SELECT conv_id AS session_id, role, text AS content, EPOCH(1704067200 + conv_id * 3600 + turn * 60) AS created_at, conv_id * 1000 + turn AS message_id FROM conversations",
    "sessions": "SELECT conv_id AS session_id, conv_id % 15 AS user_id, max(EPOCH(1704067200 + conv_id * 3600 + turn * 60)) AS updated_at FROM conversations GROUP BY conv_id",
    "memories": "SELECT vec_id AS memory_id, vec_id % 20 AS user_id, concat('memory ', CAST(vec_id AS STRING)) AS content, embedding, EPOCH(1704067200 + vec_id * 60) AS created_at FROM embeddings",
    "uploads": f"SELECT doc_id, CASE WHEN doc_id % 23 = 0 THEN '' ELSE text END AS text, source, CASE WHEN doc_id % 17 = 0 THEN ARR('typo') ELSE {_TAGS.format('doc_id')} END AS acl_tags, CASE WHEN doc_id % 19 = 0 THEN 'secret' WHEN doc_id % 3 = 0 THEN 'public' WHEN doc_id % 3 = 1 THEN 'internal' ELSE 'confidential' END AS sensitivity_level, concat('file', CAST(doc_id AS STRING), CASE doc_id % 7 WHEN 0 THEN '.PDF' WHEN 1 THEN '.md' WHEN 2 THEN '.txt' WHEN 3 THEN '.docx' WHEN 4 THEN '.tar.gz' WHEN 5 THEN '.pptx' ELSE '' END) AS filename FROM documents",
    "page_groups": "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_number, text AS content FROM documents",
    "progress": "SELECT event_id, user_id AS doc_id, CASE event_type WHEN 'signup' THEN 'parsing' WHEN 'view' THEN 'chunking' WHEN 'click' THEN 'embedding' WHEN 'purchase' THEN 'storing' ELSE 'failed' END AS stage, CAST(event_id % 101 AS INT) AS processed, 100 AS total, ts FROM events",
    "answers": "SELECT conv_id * 1000 + turn AS answer_id, conv_id % 40 AS query_id, concat(text, ' [', CAST(turn % 7 + 1 AS STRING), '] [', CAST(conv_id % 6 AS STRING), '] [', CAST(turn % 7 + 1 AS STRING), '] [123]') AS answer FROM conversations WHERE role = 'assistant'",
    "pages": "SELECT page_id, url, html FROM pages p",
    "phrases": "SELECT conv_id AS phrase_id, conv_id % 15 AS user_id, text AS content, CAST(conv_id % 5 AS INT) AS sort_order, EPOCH(1704067200 + conv_id * 60) AS created_at FROM conversations WHERE turn = 0",
}


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt out over all cores where the table has no more scan tasks than there are cores.

    Such a table may lie in one or two row groups, which would leave most cores idle below texts and
    vectors. A table with more scan tasks is read as it lies, without this shuffle.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() <= cores else rows


def _at_rest(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return _dealt(rows) if table in ("documents", "pages") else rows


def view(spark: SparkSession, sf_dir: str, name: str, read: Callable[[SparkSession, str, str], DataFrame] = _at_rest) -> DataFrame:
    """The view over the tables of a folder, as read(spark, sf_dir, table) gives them."""
    sql = VIEWS[name].replace("ARR(", "array(").replace("NONE()", "cast(array() as array<string>)").replace("EPOCH(", "timestamp_seconds(")
    tables = set(re.findall(r"(?:FROM|JOIN) (documents|embeddings|events|benchmark|conversations|pages)\b", sql))
    for t in tables:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: read(spark, sf_dir, t) for t in tables})


def duck(name: str) -> str:
    """The same view as a DuckDB subquery."""
    sql = re.sub(r"ARR\(([^()]*)\)", r"[\1]", VIEWS[name]).replace("NONE()", "CAST([] AS VARCHAR[])").replace("AS STRING", "AS VARCHAR")
    return f"{name} AS (" + re.sub(r"EPOCH\(([^()]*)\)", r"make_timestamp((\1) * 1000000)", sql) + ")"
