"""Document preparation: pages, headings, tables, images, captions and chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import shared
from .boxes import blocks_near

# Fixed values of the page, image and chunk rules.
SECTION, OCR_SHARE, HEADING = 3000, 0.40, 80
PARENT, PARENT_OVERLAP, CHILD, CHILD_OVERLAP = 512, 64, 128, 16
IMAGE_BYTES, RASTER = 4096, ["png", "jpg", "jpeg", "gif", "bmp", "tiff", "webp"]
BELOW, ABOVE, BESIDE, NEAR = 60, 40, 150, 120
LEAST_TEXT = 8
BREAK_PERCENTILE = 0.85
HEADINGS = ["author", "reviewer", "about", "editor"]
# End of the fixed values.


def split_markdown_pages(docs: DataFrame) -> DataFrame:
    """doc_id, page, text: by page marks, else sections of 3000 characters; blank pages dropped, numbers kept."""
    marks = F.split("text", r"(?i)<!--\s*page\s+\d+\s*-->")
    sections = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("text") - 1) / SECTION).cast("int"))), lambda i: F.substring(F.col("text"), i * SECTION + 1, F.lit(SECTION)))
    kept = lambda parts: F.filter(parts, lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")) != "")
    pages = F.when(F.size(marks) > 1, kept(marks)).otherwise(kept(sections))
    return docs.select("doc_id", F.posexplode(pages).alias("page", "text")).select("doc_id", (F.col("page") + 1).alias("page"), "text")


def needs_ocr(text: Column) -> Column:
    """Empty, or more than 40 % replacement characters."""
    odd = F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))
    return F.coalesce((F.length(F.trim(text)) == 0) | (odd / F.length(text) > OCR_SHARE), F.lit(True))


def select_page_text(candidates: DataFrame) -> DataFrame:
    """doc_id, page, text, method: the first non-empty of three extractions, replaced by OCR where that is needed."""
    given = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c))
    first = F.coalesce(given("odl"), given("plumber"), given("plain"), F.lit(""))
    method = F.when(given("odl").isNotNull(), "odl").when(given("plumber").isNotNull(), "plumber").otherwise("plain")
    use_ocr = needs_ocr(F.col("first")) & given("ocr").isNotNull()
    return candidates.withColumn("first", first).select("doc_id", "page", F.when(use_ocr, F.col("ocr")).otherwise(F.col("first")).alias("text"), F.when(use_ocr, "ocr").otherwise(method).alias("method")).where("trim(text) <> ''")


def section_heading(text: Column) -> Column:
    """The first non-blank line if it is shorter than 80 characters."""
    line = F.trim(F.get(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), F.lit(0)))
    return F.when(F.length(line) < HEADING, line).otherwise("")


def flatten_tables(cells: DataFrame, row_mark: str = " | ") -> DataFrame:
    """doc_id, page, text: rows of trimmed cells joined by bars, blank rows dropped."""
    rows = cells.groupBy("doc_id", "page", "table_idx", "row_idx").agg(F.array_sort(F.collect_list(F.struct("col_idx", F.trim(F.coalesce("cell", F.lit(""))).alias("t")))).alias("cs"))
    text = F.array_join(F.transform("cs", lambda c: c["t"]), row_mark)
    full = rows.where(F.exists("cs", lambda c: c["t"] != "")).select("doc_id", "page", "table_idx", "row_idx", text.alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("table_idx", "row_idx", "line"))), lambda r: r["line"])
    return full.groupBy("doc_id", "page").agg(F.array_join(lines, "\n").alias("text"))


def table_nodes(cells: DataFrame) -> DataFrame:
    """doc_id, page, table_idx, text: a Markdown table under a head line; empty tables dropped."""
    rows = cells.groupBy("doc_id", "page", "table_idx", "row_idx").agg(F.array_sort(F.collect_list(F.struct("col_idx", F.trim(F.coalesce("cell", F.lit(""))).alias("t")))).alias("cs"))
    line = F.concat(F.lit("| "), F.array_join(F.transform("cs", lambda c: c["t"]), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform("cs", lambda c: F.lit("---")), " | "), F.lit(" |"))
    some = F.exists("cs", lambda c: c["t"] != "")
    lines = rows.select("doc_id", "page", "table_idx", "row_idx", line.alias("line"), rule.alias("rule"), some.alias("some"))
    ordered = F.array_sort(F.collect_list(F.struct("row_idx", "line", "rule")))
    tables = lines.groupBy("doc_id", "page", "table_idx").agg(ordered.alias("rs"), F.bool_or("some").alias("some")).where("some")
    head = F.array(F.get("rs", F.lit(0))["line"], F.get("rs", F.lit(0))["rule"])
    body = F.array_join(F.concat(head, F.transform(F.slice("rs", F.lit(2), F.size("rs")), lambda r: r["line"])), "\n")
    return tables.select("doc_id", "page", "table_idx", F.concat(F.lit("[TABLE on page "), F.col("page").cast("string"), F.lit("]\n"), body).alias("text"))


def unique_images(images: DataFrame, min_bytes: int = IMAGE_BYTES) -> DataFrame:
    """Large enough images, the first of each content in a document; the extension is looked at only then."""
    hashed = images.where(F.octet_length("bytes") >= min_bytes).withColumn("hash", F.md5("bytes"))
    first = hashed.groupBy("doc_id", "hash").agg(F.min_by(F.struct("page", "img_idx", "filename", "ext", F.octet_length("bytes").alias("size")), F.struct("page", "img_idx")).alias("x"))
    return first.select("doc_id", "hash", "x.*").where(F.lower("ext").isin(RASTER))


def image_nodes(images: DataFrame) -> DataFrame:
    text = F.concat(F.lit("[IMAGE on page "), F.col("page").cast("string"), F.lit("] Filename: "), F.col("filename"))
    return images.select("doc_id", "page", "img_idx", text.alias("text"))


def clean_caption(text: Column, most: int = 400) -> Column:
    return F.substring(F.regexp_replace(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), "[^\\x20-\\x7EÀ-ɏ]", ""), 1, most)


def first_lines(texts: DataFrame, most: int = 400) -> DataFrame:
    """doc_id, page, whole: the first characters of a page's texts; of each page only as many texts are taken as these can hold."""
    order = Window.partitionBy("doc_id", "page").orderBy("block_id", "text")
    few = texts.select("doc_id", "page", "block_id", F.substring("text", 1, most).alias("text")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= most // (LEAST_TEXT + 1) + 1)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"])
    return few.groupBy("doc_id", "page").agg(F.substring(F.array_join(lines, "\n"), 1, most).alias("whole"))


def attach_captions(image_boxes: DataFrame, text_blocks: DataFrame, part_rows: int = 50_000) -> DataFrame:
    """doc_id, page, img_id, caption, context, combined: text below, above, beside or nearest, in that order.

    combined: the page's first line where it is a heading about people, the caption and the context, in one line.

    Boxes meet texts of their own page only; ties go to the smaller block_id.
    """
    texts = text_blocks.where(F.length("text") >= LEAST_TEXT)
    found = blocks_near(image_boxes, texts, BELOW, ABOVE, BESIDE, part_rows)
    side = F.substring(F.concat_ws(" ", "side1.t", "side2.t"), 1, 300)
    direct = F.coalesce("under.t", "over.t")
    caption = F.coalesce(direct, F.when(F.col("side1").isNotNull(), side))
    near = F.when(F.col("near.d") < NEAR, F.col("near.t"))
    whole = shared.written(first_lines(texts), shared.fresh_dir(image_boxes.sparkSession, "lines"))  # a row a page
    context = F.coalesce(F.when(direct.isNotNull() & F.col("side1").isNotNull(), side), near, F.when(caption.isNull(), F.col("whole")))
    out = found.join(whole, ["doc_id", "page"], "left")
    first = F.trim(F.split("whole", "\n")[0])
    told = out.select("doc_id", "page", "img_id", caption.alias("caption"), context.alias("context"), first.alias("first"))
    heading = F.when(F.lower("first").rlike("|".join(HEADINGS)), F.concat(F.lit("Page heading: "), F.substring("first", 1, 80)))
    caption = F.concat(F.lit("Caption/bio: "), F.substring("caption", 1, 300))
    context = F.when(~F.col("context").eqNullSafe(F.col("caption")), F.concat(F.lit("Nearby text: "), F.substring("context", 1, 200)))
    return told.select("doc_id", "page", "img_id", "caption", "context", F.nullif(F.concat_ws(" | ", heading, caption, context), F.lit("")).alias("combined"))


def windows(text: Column, size: int, overlap: int) -> Column:
    """Array of word windows; together they hold every word."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    step = size - overlap
    last = lambda ws: F.greatest(F.lit(0), F.ceil((F.size(ws) - overlap) / step).cast("int") - 1)
    cut = lambda ws: F.transform(F.sequence(F.lit(0), last(ws)), lambda i: F.array_join(F.slice(ws, i * step + 1, F.lit(size)), " "))
    return F.transform(F.array(words), lambda ws: F.when(F.size(ws) == 0, F.array().cast("array<string>")).otherwise(cut(ws)))[0]


def chunk_windows(pages: DataFrame, size: int = PARENT, overlap: int = PARENT_OVERLAP) -> DataFrame:
    """doc_id, page, chunk, text."""
    return pages.select("doc_id", "page", F.posexplode(windows(F.col("text"), size, overlap)).alias("chunk", "text"))


def pack_sentences(text: str, size: int, overlap: int) -> list[str]:
    """Greedy runs of whole sentences of at most `size` words; the next run starts with the last ones up to `overlap`."""
    import re

    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s]
    out, run, n = [], [], 0
    for s in sentences:
        k = len(s.split())
        if run and n + k > size:
            out.append(" ".join(run))
            tail, m = [], 0
            for old in reversed(run):
                if m + len(old.split()) > overlap:
                    break
                tail.insert(0, old)
                m += len(old.split())
            run, n = (tail, m) if m + k <= size else ([], 0)
        run.append(s)
        n += k
    return [*out, " ".join(run)] if run else out


def chunk_sentences(pages: DataFrame, size: int = PARENT, overlap: int = PARENT_OVERLAP) -> DataFrame:
    @F.pandas_udf("array<string>")
    def pack(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: pack_sentences(t or "", size, overlap))

    return pages.select("doc_id", "page", F.posexplode(pack("text")).alias("chunk", "text"))


def chunk_id(level: str, text: Column, *places: Column) -> Column:
    return F.concat_ws("_", F.lit(level), *[p.cast("string") for p in places], F.substring(F.md5(F.substring(text, 1, 200)), 1, 12))


def hierarchical_chunks(pages: DataFrame) -> DataFrame:
    """doc_id, page, parent_idx, parent_id, child_idx, chunk_id, text (of the child), parent_text."""
    parents = pages.select("doc_id", "page", F.posexplode(windows(F.col("text"), PARENT, PARENT_OVERLAP)).alias("parent_idx", "parent_text"))
    page = F.concat(F.lit("p"), F.col("page").cast("string"))
    named = parents.withColumn("parent_id", chunk_id("parent", F.col("parent_text"), page, F.col("parent_idx")))
    children = named.select("*", F.posexplode(windows(F.col("parent_text"), CHILD, CHILD_OVERLAP)).alias("child_idx", "text"))
    return children.select("doc_id", "page", "parent_idx", "parent_id", "child_idx", chunk_id("child", F.col("text"), page, F.col("parent_idx"), F.col("child_idx")).alias("chunk_id"), "text", "parent_text")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def semantic_chunks(sentences: DataFrame) -> DataFrame:
    """doc_id, chunk, n_sentences, first_pos: breaks where the step to the next sentence exceeds the document's 85th percentile."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    step = sentences.withColumn("step", 1 - cosine(F.col("embedding"), F.lead("embedding").over(order)))
    limits = step.groupBy("doc_id").agg(F.percentile("step", F.lit(BREAK_PERCENTILE)).alias("edge"))
    marked = step.join(limits, "doc_id").withColumn("break", F.coalesce(F.lag(F.col("step") > F.col("edge")).over(order), F.lit(False)).cast("int"))
    return marked.withColumn("chunk", F.sum("break").over(order)).groupBy("doc_id", "chunk").agg(F.count(F.lit(1)).alias("n_sentences"), F.min("pos").alias("first_pos"))


def union_nodes(children: DataFrame, tables: DataFrame, images: DataFrame) -> DataFrame:
    mark = lambda df, kind: df.withColumn("source_type", F.lit(kind))
    return mark(children, "text").unionByName(mark(tables, "table"), allowMissingColumns=True).unionByName(mark(images, "image"), allowMissingColumns=True)


def document_stats(nodes: DataFrame) -> DataFrame:
    """doc_id, total, text, table and image nodes, parents."""
    kind = lambda k: F.count_if(F.col("source_type") == k)
    return nodes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_nodes"), kind("text").alias("n_text"), kind("table").alias("n_table"), kind("image").alias("n_image"), F.count_distinct("parent_id").alias("n_parents"))


def embed(df: DataFrame, column: str, dim: int = 64, model=None) -> DataFrame:
    """Add `embedding`: by `model` (a function from texts to vectors), else by hashing words."""
    import zlib

    import numpy as np

    def hashed(texts: list[str]) -> list:
        out = np.zeros((len(texts), dim), np.float32)
        for k, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
                out[k, h % dim] += 1 if h & 0x80000000 else -1
        return list(out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9))

    encode = model or hashed

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([v for k in range(0, len(texts), 64) for v in encode([t or "" for t in texts.iloc[k : k + 64]])])

    return df.withColumn("embedding", run(F.col(column)))
