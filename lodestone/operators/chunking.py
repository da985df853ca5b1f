"""Sentence-aware chunking under token budgets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.ordering import runs
from lodestone.functions.text import estimate_tokens, split_sentences, strip
from lodestone.functions.vocabulary import CHUNK_LEAST, CHUNK_OVERLAP, CHUNK_TOKENS


#: Sections that are packed in Python at a time.
ROWS = 256


def section_islands(pages: DataFrame) -> DataFrame:
    """pages with section_no: runs of equal titles (null equals null) in page order; a title that comes back is a new section."""
    return runs(pages, "doc_id", "page_seq", "section_title", "section_no")


def segment_array(text, max_tokens: int = CHUNK_TOKENS):
    """Array of segments of one text: paragraphs, or their sentences where a paragraph is over the budget."""
    paragraphs = F.filter(F.transform(F.split(text, "\n{2,}"), strip), lambda p: p != "")
    return F.flatten(F.transform(paragraphs, lambda p: F.when(estimate_tokens(p) > max_tokens, split_sentences(p)).otherwise(F.array(p))))


def gather_sections(pages: DataFrame) -> DataFrame:
    """doc_id, section_no, parts: the pages (page_number, content) of each section in the order of page_seq. A row holds one section of one document."""
    page = F.struct("page_seq", F.struct("page_number", "content").alias("p"))
    return pages.groupBy("doc_id", "section_no").agg(F.transform(F.array_sort(F.collect_list(page)), lambda x: x["p"]).alias("parts"))


def _segment_structs(sections: DataFrame, max_tokens: int):
    """Array of (text, page_number) of each row: of its parts, or of content (and page_number, if there) as the only one."""
    if "parts" not in sections.columns:
        number = F.col("page_number") if "page_number" in sections.columns else F.lit(None).cast("int")
        return F.transform(segment_array(F.col("content"), max_tokens), lambda t: F.struct(t.alias("text"), number.alias("page_number")))
    return F.flatten(F.transform("parts", lambda p: F.transform(F.coalesce(segment_array(p["content"], max_tokens), F.array().cast("array<string>")), lambda t: F.struct(t.alias("text"), p["page_number"].alias("page_number")))))


def segments(sections: DataFrame, max_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """doc_id, section_no, seq, text, page_number, tok of every segment. sections: doc_id, section_no, and parts (see gather_sections) or content."""
    s = sections.select("doc_id", "section_no", F.posexplode(_segment_structs(sections, max_tokens)).alias("seq", "s"))
    return s.select("doc_id", "section_no", "seq", "s.text", "s.page_number", estimate_tokens(F.col("s.text")).alias("tok"))


def pack_spans(tokens: list[int], max_tokens: int, overlap: int) -> list[tuple[int, int]]:
    """Greedy windows (from, to) over one section; each next window begins with the longest suffix within the overlap."""
    out, begin, total = [], 0, 0
    for i, t in enumerate(tokens):
        if i > begin and total + t > max_tokens:
            out.append((begin, i))
            j, total = i, 0
            while j > begin and total + tokens[j - 1] <= overlap:
                j -= 1
                total += tokens[j]
            begin = j
        total += t
    if begin < len(tokens):
        out.append((begin, len(tokens)))
    return out


def chunk_pack(sections: DataFrame, max_tokens: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP, least: int = CHUNK_LEAST) -> DataFrame:
    """doc_id, section_no, pos, content, page_number (of its first segment), tok of every chunk, and section_title if sections have it.

    sections: doc_id, section_no, and parts (see gather_sections) or content, with page_number if there.
    Segments stay an array of their section's row, so packing needs no shuffle. Null content gives no chunk.
    """
    titled = ["section_title"] if "section_title" in sections.columns else []
    s = sections.select("doc_id", "section_no", _segment_structs(sections, max_tokens).alias("seg"), *titled)
    s = s.withColumn("_tok", F.transform("seg", lambda x: estimate_tokens(x["text"])))

    def spans(tokens: pa.Array) -> pa.Array:
        sizes = pc.list_value_length(tokens).fill_null(0).to_numpy()
        flat, ends = tokens.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
        number, at = [np.zeros(1, np.int32)], [np.zeros((0, 2), np.int32)]
        for i in range(0, len(sizes), ROWS):
            made = [pack_spans(flat[end - n : end].tolist(), max_tokens, overlap) for n, end in zip(sizes[i : i + ROWS].tolist(), ends[i : i + ROWS].tolist())]
            number.append(np.array(list(map(len, made)), np.int32))
            at.append(np.array([x for own in made for x in own], np.int32).reshape(-1, 2))
        begin, end = np.concatenate(at).T
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(number), dtype=np.int32)), pa.StructArray.from_arrays([pa.array(begin), pa.array(end)], ["a", "b"]))

    # Python sees the numbers of tokens only; texts stay where they are. Called nondeterministic, so that the optimizer leaves it its own step.
    s = s.withColumn("_spans", F.arrow_udf(spans, "array<struct<a: int, b: int>>").asNondeterministic()("_tok"))
    text = lambda x: F.array_join(F.transform(F.slice("seg", x["a"] + 1, x["b"] - x["a"]), lambda t: t["text"]), "\n\n")
    made = F.transform("_spans", lambda x, i: F.struct(i.alias("pos"), text(x).alias("content"), F.get("seg", x["a"])["page_number"].alias("page_number")))
    c = s.select("doc_id", "section_no", *titled, F.explode(made).alias("c")).select("doc_id", "section_no", "c.pos", "c.content", "c.page_number", *titled)
    return c.withColumn("tok", estimate_tokens(F.col("content"))).where(F.col("tok") >= least)


def chunk_index(chunks: DataFrame) -> DataFrame:
    """chunks with chunk_index, dense from 0 in each document."""
    return chunks.withColumn("chunk_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("section_no", "pos")) - 1)


def chunk_metadata(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("metadata", F.struct(F.length("content").alias("char_count"), F.col("tok").alias("estimated_tokens")))


def chunk_preview(indexed: DataFrame, limit: int = 10) -> DataFrame:
    """The first chunks of each document, with estimated_tokens from their metadata, 0 where there is none."""
    first = indexed.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index"))).where(F.col("n") <= limit).drop("n")
    return first.withColumn("estimated_tokens", F.coalesce("metadata.estimated_tokens", F.lit(0)) if "metadata" in indexed.columns else F.lit(0))
