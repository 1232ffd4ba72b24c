"""Clause trees from styled paragraphs: headings, blocks, breadcrumbs, dropped clauses.

Rows come in document order: doc, pos, style, kind (paragraph or table), text. All of it is windows over
(doc, pos) and a stream along headings, so documents are independent and no document has to fit in one call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.functions.text import bound, one_line, strip
from siftstone.operators import nesting

# Heading patterns, dropped titles, placeholder bodies, styles.
NUMBERED = r"(?s)^([A-Za-z0-9]+(?:\.[A-Za-z0-9]+)*)\s+(.+)$"
ANNEX = r"(?is)^Annex\s+([A-Za-z0-9]+)\s*\(([^)]*)\)\s*:\s*(.+)$"
DASH = r"^[–—\-•]\s*"
DROPPED_TITLES = (
    "foreword", "scope", "references", "definitions of terms, symbols and abbreviations", "change history", "introduction", "void",
)
VOID_BODIES = ("void", "<void>", "(void)", "-", "–")
ANNEX_LEVEL = 8
CODE_STYLE = "PL"


def parse_heading(style: Column, raw: Column) -> Column:
    """struct(clause_id, title, level, is_annex_banner, annex_kind)."""
    text = one_line(raw)
    level = F.coalesce(F.regexp_extract(style, r"(?:^|.* )(-?\d+)$", 1).try_cast("int"), F.lit(1))

    def parsed(args: Column) -> Column:
        t, n = args["t"], args["n"]
        get = lambda pattern, i: F.regexp_extract(t, pattern, i)
        clean = F.regexp_replace(t, DASH, "")
        clean = F.when(strip(clean) == "", t).otherwise(strip(clean))
        made = lambda i, title, lv, banner, kind: F.struct(
            i.alias("clause_id"), title.alias("title"), lv.alias("level"), F.lit(banner).alias("is_annex_banner"), kind.alias("annex_kind")
        )
        one, none = F.lit(1), F.lit("")
        banner = F.when(
            t.rlike(ANNEX), made(F.concat(F.lit("Annex "), get(ANNEX, 1)), strip(get(ANNEX, 3)), one, True, F.lower(strip(get(ANNEX, 2))))
        ).otherwise(made(t, t, one, True, none))
        plain = F.when(t.rlike(NUMBERED), made(get(NUMBERED, 1), strip(get(NUMBERED, 2)), n, False, none)).otherwise(
            made(clean, clean, n, False, none)
        )
        return F.when(n == ANNEX_LEVEL, banner).otherwise(plain)

    return bound(F.struct(text.alias("t"), level.alias("n")), parsed)


def clauses(rows: DataFrame) -> DataFrame:
    """doc, order, clause_id, clause_title, level, breadcrumb, blocks, full_text; empty clauses included.

    Table-of-contents rows and text before the first heading go; blank rows are skipped; neighbours of
    one type become one block.
    """
    rows = rows.where(~F.coalesce(F.col("style"), F.lit("Normal")).startswith("toc"))
    is_heading = (F.col("kind") != "table") & F.coalesce(F.col("style").startswith("Heading"), F.lit(False))
    rows = rows.withColumn("h", F.when(is_heading & (strip(F.col("text")) != ""), parse_heading(F.col("style"), F.col("text"))))
    rows = rows.where(~is_heading | F.col("h").isNotNull())
    upto = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("nth", F.count("h").over(upto)).where("nth > 0")
    return with_breadcrumbs(rows.where("h is not null").select("doc", "nth", "h.*")).join(
        merge_blocks(rows.where("h is null")), ["doc", "nth"], "left"
    ).select(
        "doc", F.col("nth").cast("int").alias("order"), "clause_id", F.col("title").alias("clause_title"), "level", "breadcrumb",
        F.coalesce("blocks", F.array().cast("array<struct<type:string,text:string>>")).alias("blocks"),
        F.coalesce(F.array_join(F.transform("blocks", lambda b: b["text"]), "\n\n"), F.lit("")).alias("full_text"),
    )


def with_breadcrumbs(headings: DataFrame) -> DataFrame:
    """Adds the open ancestors as "id title > id title". headings: doc, nth, clause_id, title, level.

    A heading is open until the next one of its level or a higher one, at any depth.
    """
    named = headings.select("*", F.concat_ws(" ", "clause_id", "title").alias("name"), F.lit(False).alias("closes")).repartition("doc")
    found = nesting.streamed(named, ["doc"], ["nth"], ["level", "closes", "name"], "above", "array<string>", nesting.open_ancestors)
    return found.select(*headings.columns, F.array_join("above", " > ").alias("breadcrumb"))


def merge_blocks(rows: DataFrame) -> DataFrame:
    """(doc, nth, blocks): runs of one type joined by line breaks."""
    kind = F.when(F.col("kind") == "table", "table").when(F.col("style") == CODE_STYLE, "asn1").otherwise("prose")
    rows = rows.withColumn("type", kind).withColumn("text", F.when(F.col("kind") == "table", F.col("text")).otherwise(strip(F.col("text"))))
    rows = rows.where("text <> ''")
    order = Window.partitionBy("doc", "nth").orderBy("pos")
    new = F.coalesce((F.lag("type").over(order) != F.col("type")).cast("int"), F.lit(1))
    rows = rows.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n")
    blocks = rows.groupBy("doc", "nth", "run").agg(F.first("type").alias("type"), joined.alias("text"))
    ordered = F.array_sort(F.collect_list(F.struct("run", "type", "text")))
    return blocks.groupBy("doc", "nth").agg(
        F.transform(ordered, lambda b: F.struct(b["type"].alias("type"), b["text"].alias("text"))).alias("blocks")
    )


def keep_useful(found: DataFrame) -> DataFrame:
    """Without boilerplate titles, placeholders and empty bodies."""
    body = F.lower(strip(F.col("full_text")))
    return found.where(~F.lower(strip(F.col("clause_title"))).isin(*DROPPED_TITLES) & (body != "") & ~body.isin(*VOID_BODIES))


def with_uids(found: DataFrame) -> DataFrame:
    """clause_uid = doc::clause_id, with #n for the nth repeat of an id."""
    nth = F.row_number().over(Window.partitionBy("doc", "clause_id").orderBy("order"))
    uid = F.concat("doc", F.lit("::"), "clause_id")
    return found.withColumn("clause_uid", F.when(nth > 1, F.concat(uid, F.lit("#"), nth.cast("string"))).otherwise(uid))


def find_clause(found: DataFrame, clause_id: str) -> DataFrame:
    return found.where(F.col("clause_id") == clause_id).orderBy("doc", "order").limit(1)
