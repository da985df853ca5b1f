"""Continuous ingestion: a micro-batch of uploads goes through admission, cleaning, chunking, embedding and publishing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.functions.vocabulary import CHUNK_LEAST, CHUNK_OVERLAP, CHUNK_TOKENS
from lodestone.operators import chunking, cleaning, embedding, ingest
from lodestone.sources import attempts
from lodestone.streaming.tables import create, read_table

DOCUMENTS = "doc_id long, content_hash string, status string, reason string, total_chunks long"
CHUNKS = "chunk_id string, doc_id long, chunk_index int, content string, tok int, dense_embedding array<float>, acl_tags array<string>, sensitivity_ordinal int, page_number int, section_title string, source string"


def document_sections(docs: DataFrame) -> DataFrame:
    """doc_id, section_no, section_title, parts (page_number, content) of documents (doc_id, text, and filename if types differ).

    A Markdown file (.md) has a section for each heading of level 1 or 2. In other texts form feeds part numbered pages, of which
    repeated header and footer lines are removed; a text without one is a section without page numbers, and isn't shuffled.
    """
    markdown = F.coalesce(ingest.suffix(F.col("filename")) == "md", F.lit(False)) if "filename" in docs.columns else F.lit(False)
    kinds = docs.select("doc_id", "text", markdown.alias("_markdown"), F.coalesce(F.contains("text", F.lit("\f")), F.lit(False)).alias("_paged"))
    part = lambda page, content: F.array(F.struct(page.cast("int").alias("page_number"), content.alias("content"))).alias("parts")
    no_page, no_title = F.lit(None), F.lit(None).cast("string").alias("section_title")
    plain = cleaning.clean_text(kinds.where("not _markdown and not _paged")).select("doc_id", F.lit(0).cast("long").alias("section_no"), no_title, part(no_page, F.col("text")))
    headed = cleaning.heading_sections(kinds.where("_markdown")).select("doc_id", F.col("section_no").cast("long").alias("section_no"), F.col("title").alias("section_title"), part(no_page, F.col("content")))
    pages = kinds.where("not _markdown and _paged").select(F.col("doc_id").alias("source"), F.posexplode(F.split("text", "\f")).alias("page_seq", "content"))
    quiet = cleaning.clean_text(cleaning.remove_noisy_lines(pages, cleaning.noisy_lines(pages)), "content").where("content <> ''")
    paged = chunking.gather_sections(quiet.select(F.col("source").alias("doc_id"), F.lit(0).cast("long").alias("section_no"), "page_seq", (F.col("page_seq") + 1).alias("page_number"), "content"))
    return plain.unionByName(headed).unionByName(paged.select("doc_id", "section_no", no_title, "parts"))


def seen_before(uploads: DataFrame) -> DataFrame:
    """content_hash of the admissible uploads of a stream whose content an earlier micro-batch held, once for each micro-batch.

    The state is one flag for each content, looked up by its hash, so a micro-batch's work doesn't grow with what is stored.
    """

    def mark(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        for _ in frames:
            pass
        if state.exists:
            yield pd.DataFrame({"content_hash": [key[0]]})
        else:
            state.update((True,))

    hashes = uploads.where(ingest.admission_fault().isNull()).select(ingest.admission_hash().alias("content_hash"))
    return hashes.groupBy("content_hash").applyInPandasWithState(mark, "content_hash string", "seen boolean", "append", GroupStateTimeout.NoTimeout)


def stream_ingest(uploads: DataFrame, path: str, max_tokens: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP, least: int = CHUNK_LEAST, make_encoder: Callable | None = None, available_now: bool = True, stored: DataFrame | None = None) -> StreamingQuery:
    """Starts ingestion of a stream of uploads (doc_id, text, acl_tags, sensitivity_level, and filename and source if there) into the tables of path.

    Chunks carry what a citation shows: the page of their first segment, their section's title and the source (see document_sections).
    Every upload gets a row of `documents`: done, failed (no chunk) or rejected with its reason. A
    content that came before, failed or not, is a duplicate: which ones did is kept as state of the stream by
    their hashes (see seen_before; with the RocksDB state store it needn't fit in memory), and no table of hashes
    is read. stored: content_hash of contents that other ways brought in, read for each micro-batch. Chunks and
    documents of a micro-batch become visible together, by a row of their manifest (see sources.attempts): published()
    shows the chunks of documents that are done. A batch that is run again finds the state that it began with and
    replaces its own rows, while readers keep what they hold.
    """
    spark = uploads.sparkSession
    create(spark, f"{path}/documents", DOCUMENTS, f"{path}/attempts")
    create(spark, f"{path}/chunks", CHUNKS, f"{path}/attempts")

    def step(batch: DataFrame, n: int) -> None:
        s, attempt = batch.sparkSession, attempts.new_attempt()
        batch.persist()
        held = batch.where("_seen is not null").select(F.col("_seen").alias("content_hash"))
        held = held if stored is None else held.unionByName(stored.select("content_hash"))
        gated = ingest.admission_gate(batch.where("_seen is null").drop("_seen"), held).persist()
        try:
            accepted = gated.where("reason is null")
            chunks = chunking.chunk_index(chunking.chunk_pack(document_sections(accepted), max_tokens, overlap, least)).withColumn("chunk_id", F.concat_ws("-", "doc_id", "chunk_index"))
            # Tags and source join the chunks before their vectors are there.
            rows = embedding.with_embeddings(ingest.ingest_rows(chunks, accepted), make_encoder)
            rows = rows if "source" in rows.columns else rows.withColumn("source", F.lit(None).cast("string"))
            own = attempts.folder(f"{path}/chunks", n, attempt)
            rows.select(*[c.split()[0] for c in CHUNKS.split(", ")]).write.parquet(own)
            counts = s.read.schema(CHUNKS).parquet(own).groupBy("doc_id").agg(F.count("*").alias("total_chunks"))
            total = F.coalesce("total_chunks", F.lit(0))
            status = F.when(F.col("reason").isNotNull(), "rejected").when(total == 0, "failed").otherwise("done")
            reason = F.coalesce("reason", F.when(total == 0, "chunk empty"))
            documents = gated.join(counts, "doc_id", "left").select("doc_id", "content_hash", status.alias("status"), reason.alias("reason"), total.cast("long").alias("total_chunks"))
            documents.write.parquet(attempts.folder(f"{path}/documents", n, attempt))
            attempts.finish(s, f"{path}/attempts", n, attempt)
        finally:
            gated.unpersist()
            batch.unpersist()

    # The contents that came before travel with the uploads of their micro-batch.
    rows = uploads.withColumn("_seen", F.lit(None).cast("string")).unionByName(seen_before(uploads).select(F.col("content_hash").alias("_seen")), allowMissingColumns=True)
    writer = rows.writeStream.option("checkpointLocation", f"{path}/checkpoint").foreachBatch(step)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def documents(spark: SparkSession, path: str) -> DataFrame:
    """The ingested documents, rejected ones included."""
    return read_table(spark, f"{path}/documents", DOCUMENTS, f"{path}/attempts")


def published(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of the documents that are done; a batch that isn't finished shows none."""
    done = documents(spark, path).where("status = 'done'").select("doc_id", "batch")
    return read_table(spark, f"{path}/chunks", CHUNKS, f"{path}/attempts").join(done, ["doc_id", "batch"], "left_semi")
