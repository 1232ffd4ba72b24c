"""Word documents as rows in document order: doc, pos, style, kind, text, cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions.text import markdown_table

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
ROWS = "doc string, pos int, style string, kind string, text string, cells array<array<string>>"


def paragraph_text(node) -> str:
    out = []
    for x in node.iter():
        if x.tag == f"{W}t":
            out.append(x.text or "")
        elif x.tag == f"{W}tab":
            out.append("\t")
        elif x.tag in (f"{W}br", f"{W}cr"):
            out.append("\n")
    return "".join(out)


def table_cells(table) -> list[list[str]]:
    """The texts of a table row by row. A cell over several columns stands once; one that goes on from the row above
    repeats its text."""
    rows, above = [], {}
    for row in table.findall(f"{W}tr"):
        before = row.find(f"{W}trPr/{W}gridBefore")
        at, own = int(before.get(f"{W}val", 0)) if before is not None else 0, []
        for cell in row.findall(f"{W}tc"):
            span, merge = cell.find(f"{W}tcPr/{W}gridSpan"), cell.find(f"{W}tcPr/{W}vMerge")
            text = "\n".join(paragraph_text(p) for p in cell.findall(f"{W}p"))
            if merge is not None and merge.get(f"{W}val") != "restart":
                text = above.get(at, text)
            own.append(text)
            for _ in range(int(span.get(f"{W}val", 1)) if span is not None else 1):
                above[at] = text
                at += 1
        rows.append(own)
    return rows


def body_rows(content: bytes):
    """(style, kind, text, cells) of the body's children, paragraphs and tables interleaved as they stand."""
    import io
    import xml.etree.ElementTree as ET
    import zipfile

    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ET.fromstring(archive.read("word/document.xml")).find(f"{W}body")
        names = {}
        if "word/styles.xml" in archive.namelist():
            for s in ET.fromstring(archive.read("word/styles.xml")).iter(f"{W}style"):
                name = s.find(f"{W}name")
                if name is not None:
                    names[s.get(f"{W}styleId")] = name.get(f"{W}val")
    for child in body if body is not None else ():
        if child.tag == f"{W}p":
            style = child.find(f"{W}pPr/{W}pStyle")
            style_id = style.get(f"{W}val") if style is not None else None
            name = names.get(style_id, style_id) or "Normal"
            yield name[0].upper() + name[1:] if name.startswith("heading") else name, "paragraph", paragraph_text(child), None
        elif child.tag == f"{W}tbl":
            yield None, "table", None, table_cells(child)


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all .docx files under a path; tables as pipe tables."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    return docx_rows(files.select(F.regexp_extract("path", r"([^/]+)\.docx$", 1).alias("doc"), "content"))


def docx_rows(files: DataFrame) -> DataFrame:
    """files: doc, content."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            for doc, content in zip(frame.doc, frame.content):
                rows = [(doc, i, *r) for i, r in enumerate(body_rows(content))]
                yield pd.DataFrame(rows, columns=["doc", "pos", "style", "kind", "text", "cells"])

    rows = files.mapInPandas(run, ROWS)
    return rows.withColumn("text", F.when(F.col("kind") == "table", markdown_table(F.col("cells"))).otherwise(F.col("text"))).drop("cells")
