"""Chunks with exact character locators, and texts put together again."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from marginalia.config import CHUNK_OVERLAP, CHUNK_SIZE, PAGE_SEP

# Places to cut at, best first.
BREAKS = ("\n\n", "\n", ". ", "! ", "? ", " ")


def ranges(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[tuple[int, int]]:
    """Start and end of each chunk of one page; an end is behind the last best break of its second half."""
    out, pos, n = [], 0, len(text)
    while pos < n:
        end = min(pos + size, n)
        if end < n:
            for sep in BREAKS:
                at = text.rfind(sep, pos + size // 2, end)
                if at >= 0:
                    end = at + len(sep)
                    break
        out.append((pos, end))
        if end == n:
            break
        pos = max(end - overlap, pos + 1)
    return out


def chunk_pages(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """One row for each chunk of each (doc_id, pages array<struct<page,text>>).

    Chunks never cross pages; ordinals and offsets run over all pages, which lie a separator
    apart.  Null and empty pages have no chunks.  No shuffle; each text is read once.
    """
    names = ["chunk_id", "doc_id", "ordinal", "page", "char_start", "char_end", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                ids = batch.column(0).slice(at, 200)
                cols: list[list] = [[] for _ in range(6)]
                for row, pages in enumerate(batch.column(1).slice(at, 200).to_pylist()):
                    base = ordinal = 0
                    for p in pages or ():
                        text = (p and p["text"]) or ""
                        for s, e in ranges(text, size, overlap):
                            for c, v in zip(cols, (row, ordinal, p["page"], base + s, base + e, text[s:e]), strict=True):
                                c.append(v)
                            ordinal += 1
                        base += len(text) + len(PAGE_SEP)
                doc_ids = ids.take(pa.array(cols[0], pa.int64()))
                chunk_ids = [None if d is None else f"{d}-{k}" for d, k in zip(doc_ids.to_pylist(), cols[1], strict=True)]
                ints = [pa.array(c, pa.int32()) for c in cols[1:5]]
                yield pa.RecordBatch.from_arrays([pa.array(chunk_ids, pa.string()), doc_ids, *ints, pa.array(cols[5], pa.string())], names)

    kinds = [StringType(), docs.schema["doc_id"].dataType, *[IntegerType()] * 4, StringType()]
    return docs.select("doc_id", "pages").mapInArrow(run, StructType([StructField(n, k) for n, k in zip(names, kinds, strict=True)]))


def chunk(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Chunks of each (doc_id, text) as one page without a number."""
    page = F.struct(F.lit(None).cast("int").alias("page"), F.col("text"))
    return chunk_pages(docs.select("doc_id", F.array(page).alias("pages")), size, overlap).drop("page")


def joined_pages(pages: Column) -> Column:
    """Text of array<string>: pages a separator apart."""
    return F.array_join(pages, PAGE_SEP)


def rebuilt(pieces: Column) -> Column:
    """Text of array<struct<s,e,t>>: gaps become line breaks, overlaps are trimmed, covered pieces skipped."""

    def add(state: Column, p: Column) -> Column:
        gap = F.repeat(F.lit("\n"), F.greatest(p["s"] - state["pos"], F.lit(0)))
        tail = F.substring(p["t"], F.greatest(state["pos"] - p["s"], F.lit(0)) + 1, F.length(p["t"]))
        grown = F.struct(p["e"].alias("pos"), F.concat(state["out"], gap, tail).alias("out"))
        return F.when(p["e"] > state["pos"], grown).otherwise(state)

    return F.aggregate(F.array_sort(pieces), F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), add, lambda s: s["out"])
