"""Page text: normalising, repeated header and footer lines, sections."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import clean, strip
from lodestone.operators.markup import element_sections, markdown_elements


#: Texts that are Python strings at a time.
ROWS = 256


@F.arrow_udf(T.StringType())
def _nfc(texts: pa.Array) -> pa.Array:
    parts = [pa.array([None if x is None else unicodedata.normalize("NFC", x) for x in texts.slice(i, ROWS).to_pylist()], pa.string()) for i in range(0, len(texts), ROWS)]
    return pa.concat_arrays([pa.array([], pa.string()), *parts])


def clean_text(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with the column normalised (only rows with non-ASCII characters visit Python) and cleaned."""
    ascii_only = F.octet_length(column) == F.length(column)
    return docs.withColumn(column, clean(F.when(ascii_only, F.col(column)).otherwise(_nfc(F.when(~ascii_only, F.col(column))))))


#: Buckets of the first count of noisy_lines, and rows of it that the driver takes.
BUCKETS, MAX_HOT = 4096, 10_000


def _edge_lines(pages: DataFrame) -> DataFrame:
    lines = F.split("content", "\n")
    edge = F.concat(F.slice(lines, 1, 3), F.slice(lines, F.greatest(F.size(lines) - 2, F.lit(1)), 3))
    return pages.select("source", F.explode(edge).alias("line")).select("source", strip(F.col("line")).alias("line")).where("length(line) > 2 and length(line) < 80")


def noisy_lines(pages: DataFrame, threshold: float = 0.6, buckets: int = BUCKETS) -> DataFrame:
    """source, line, n of lines among the first and last three of at least this share of a source's pages (three pages or more).

    Lines are first counted by source and bucket of their hash, so that this shuffle holds no line and at most
    `buckets` rows a source and task. A bucket counts no less than any of its lines, and a page gives six lines,
    so at most 6 / threshold buckets of a source reach the share: only lines in these are counted themselves.
    Where more than MAX_HOT of them do (many small sources) every edge line is counted; the rows are the same.
    """
    lines = _edge_lines(pages)
    bucket = F.pmod(F.xxhash64("line"), F.lit(buckets)).cast("int")
    n_pages = pages.groupBy("source").agg(F.count("*").alias("pages")).where("pages >= 3 and source is not null")
    reached = F.col("n") / F.col("pages") >= threshold
    hot = lines.groupBy("source", bucket.alias("_bucket")).agg(F.count("*").alias("n")).join(n_pages, "source").where(reached).select("source", "_bucket", "pages")
    known = hot.limit(MAX_HOT + 1).toArrow()
    if known.num_rows > MAX_HOT:
        return lines.groupBy("source", "line").agg(F.count("*").alias("n")).join(n_pages, "source").where(reached).select("source", "line", "n")
    # At most MAX_HOT rows.
    side = F.broadcast(pages.sparkSession.createDataFrame(known, hot.schema))
    few = lines.withColumn("_bucket", bucket).join(side, ["source", "_bucket"])
    return few.groupBy("source", "line").agg(F.count("*").alias("n"), F.first("pages").alias("pages")).where(reached).select("source", "line", "n")


def remove_noisy_lines(pages: DataFrame, noisy: DataFrame) -> DataFrame:
    """pages without the lines that are noisy for their source."""
    sets = noisy.groupBy("source").agg(F.collect_set("line").alias("_noisy"))
    kept = F.array_join(F.filter(F.split("content", "\n"), lambda x: ~F.array_contains("_noisy", strip(x))), "\n")
    return pages.join(sets, "source", "left").withColumn("content", F.when(F.col("_noisy").isNull(), F.col("content")).otherwise(kept)).drop("_noisy")


def ocr_triage(pages: DataFrame, least: int = 50) -> DataFrame:
    """Pages with fewer than least cleaned characters."""
    return pages.withColumn("n_clean", F.length(clean(F.col("content")))).where(F.col("n_clean") < least)


def paragraph_pages(docs: DataFrame, group: int = 10) -> DataFrame:
    """doc_id, page_number, content: paragraphs in groups; blank groups leave gaps in the numbers."""
    paragraphs = F.filter(F.split("text", "\n{2,}"), lambda p: strip(p) != "")
    numbers = F.sequence(F.lit(0), F.floor((F.size("ps") - 1) / group).cast("int"))
    p = docs.select("doc_id", paragraphs.alias("ps")).where("size(ps) > 0").select("doc_id", "ps", F.explode(numbers).alias("i"))
    return p.select("doc_id", (F.col("i") + 1).alias("page_number"), clean(F.array_join(F.slice("ps", F.col("i") * group + 1, F.lit(group)), "\n\n")).alias("content")).where("content <> ''")


def heading_sections(docs: DataFrame) -> DataFrame:
    """doc_id, section_no, title, content of the paragraphs between the headings of levels 1 and 2 of Markdown texts.

    Headings are Markdown's own, with # or underlined, also in quotes and list items; deeper ones are text. Code, HTML blocks and link
    definitions are left out (see markup.markdown_blocks). Empty sections are dropped, an empty heading is a null title.
    """
    return _cleaned(element_sections(markdown_elements(docs), "doc_id"))


def html_sections(elements: DataFrame) -> DataFrame:
    """page_id, section_no, title, content of the texts between h1 and h2 (elements: see markup.html_elements)."""
    return _cleaned(element_sections(elements))


def _cleaned(sections: DataFrame) -> DataFrame:
    return clean_text(sections.withColumn("title", strip(F.col("title"))), "content").where("content <> ''")


def table_rows_markdown(tables: DataFrame) -> DataFrame:
    """table_id, text of table_id, row_no, cells: equal neighbours merged, a rule after the first row."""
    cells = F.transform("cells", lambda c: strip(F.regexp_replace(c, "\n", " ")))
    merged = F.filter("c", lambda x, i: (i == 0) | (x != F.get("c", i - 1)))
    line = lambda a: F.concat(F.lit("| "), F.array_join(a, " | "), F.lit(" |"))
    rows = tables.withColumn("c", cells).withColumn("m", merged).withColumn("line", F.when(F.col("row_no") == 0, F.concat(line(F.col("m")), F.lit("\n"), line(F.array_repeat(F.lit("---"), F.size("m"))))).otherwise(line(F.col("m"))))
    return rows.groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "line"))), lambda x: x["line"]), "\n").alias("text"))


def styled_sections(paragraphs: DataFrame, tables: DataFrame) -> DataFrame:
    """doc_id, page_number, title, content of the sections that heading styles begin.

    paragraphs: doc_id, seq, style, text; tables: doc_id, table_no, text (see table_rows_markdown),
    which follow the last paragraph of their document. Blank paragraphs and null texts are left out, a
    null style is no heading, text before the first heading has a null title. Empty sections are
    dropped, and page_number counts those that stay.
    """
    p = paragraphs.select("doc_id", F.col("seq").cast("long").alias("seq"), strip(F.col("text")).alias("line"), F.coalesce(F.col("style").contains("Heading"), F.lit(False)).alias("heads"), F.lit(0).alias("part"))
    t = tables.select("doc_id", F.col("table_no").cast("long").alias("seq"), F.col("text").alias("line"), F.lit(False).alias("heads"), F.lit(1).alias("part"))
    lines = p.unionByName(t).where("line <> ''")
    s = lines.withColumn("section", F.sum(F.col("heads").cast("int")).over(Window.partitionBy("doc_id").orderBy("part", "seq")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("heads"), F.struct("part", "seq", "line")))), lambda x: x["line"]), "\n")
    full = clean_text(s.groupBy("doc_id", "section").agg(F.max(F.when(F.col("heads"), F.col("line"))).alias("title"), body.alias("content")), "content").where("content <> ''")
    return full.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("section")).alias("page_number"), "title", "content")
