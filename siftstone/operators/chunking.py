"""Chunks of clauses: units, merge-up, greedy packing with enclosing conditions, quality gates.

Tokens are counted by a column function (words by default); limits are parameters.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.functions.text import bound, citation, context_header, has_normative, n_words, strip
from siftstone.operators import nesting, splitting

# Token limits and line patterns.
MAX_TOKENS = 1000
TARGET_TOKENS = 800
OVERLAP_TOKENS = 120
MIN_TOKENS = 80
NEST = r"^(\d+)>"
CONTINUATION = (
    r"^(NOTE\s*\d*\b|Editor's [Nn]ote\b|[-–—•*][\s\t]|\(?[a-zA-Z][)\.][\s\t]|\(?\d+[)][\s\t]|\(?[ivxIVX]+[)][\s\t])"
)
UNIT = "array<struct<kind:string,text:string,tokens:int,atomic:boolean>>"


def split_words(text: Column, limit: int) -> Column:
    """Every ``limit`` words of a text as a piece."""
    words = lambda t: F.filter(F.split(t, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    cut = lambda w: F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1)), F.lit(limit)), lambda i: F.array_join(F.slice(w, i, F.lit(limit)), " ")
    )
    return bound(words(text), cut)


def oversized_pieces(max_tokens: int = MAX_TOKENS, target: int = TARGET_TOKENS, count=splitting.n_words):
    """Function from blocks to the pieces of each that has a text; the others are null. Only tables and code
    above the maximum are sent to it."""

    @F.pandas_udf("array<array<string>>")
    def cut(blocks: pd.Series) -> pd.Series:
        one = lambda b: None if b["text"] is None else splitting.split_block(b["type"], b["text"], max_tokens, target, count)
        return blocks.map(lambda own: [one(b) for b in own])

    return cut


def with_units(clauses: DataFrame, max_tokens: int = MAX_TOKENS, target: int = TARGET_TOKENS, count=n_words) -> DataFrame:
    """clauses (blocks) with units: lines of prose; tables and code whole, or cut at their own borders."""
    atomic = lambda b: b["type"].isin("table", "asn1")
    large = F.transform(
        "blocks", lambda b: F.struct(b["type"].alias("type"), F.when(atomic(b) & (count(b["text"]) > max_tokens), b["text"]).alias("text"))
    )
    unit = lambda b, t: F.struct(b["type"].alias("kind"), t.alias("text"), count(t).alias("tokens"), atomic(b).alias("atomic"))
    prose = lambda b: F.filter(F.transform(F.split(b["text"], "\n"), strip), lambda x: x != "")
    texts = lambda b, i: F.when(F.get("cut", i).isNotNull(), F.get("cut", i)).when(atomic(b), F.array(b["text"])).otherwise(prose(b))
    units = F.flatten(F.transform("blocks", lambda b, i: F.transform(texts(b, i), lambda t: unit(b, t))))
    rows = clauses.withColumn("cut", oversized_pieces(max_tokens, target)(large))
    return rows.withColumn("units", units.cast(UNIT)).drop("cut")


def merge_up(clauses: DataFrame, min_tokens: int = MIN_TOKENS, max_tokens: int = MAX_TOKENS, strict_ancestor: bool = False) -> DataFrame:
    """(doc, order, into): the order of the clause that each clause's units join, its own for a group.

    A running budget has no relational form: a stream along the clauses of a document, small rows only.
    strict_ancestor also asks that the ancestor stands in the clause's breadcrumb.
    """
    small = clauses.where(F.size("units") > 0).select(
        "doc", "order", "level", "breadcrumb", F.concat_ws(" ", "clause_id", "clause_title").alias("name"),
        F.aggregate("units", F.lit(0).cast("long"), lambda a, u: a + u["tokens"]).alias("tokens"),
    )

    def fold():
        # Open heads of groups by level, each with its size, place and name.
        levels, sizes, heads, into = [], [], [], None
        while True:
            level, tokens, order, name, breadcrumb = yield into
            keep = next((k for k, x in enumerate(levels) if x >= level), len(levels))
            del levels[keep:], sizes[keep:], heads[keep:]
            joins = keep > 0 and tokens < min_tokens and sizes[-1] + tokens <= max_tokens
            if joins and (not strict_ancestor or heads[-1][1] in (breadcrumb or "").split(" > ")):
                sizes[-1] += tokens
                into = heads[-1][0]
            else:
                levels.append(level)
                sizes.append(tokens)
                heads.append((order, name))
                into = order

    kind = dict(clauses.dtypes)["order"]
    inputs = ["level", "tokens", "order", "name", "breadcrumb"]
    return nesting.streamed(small.repartition("doc"), ["doc"], ["order"], inputs, "into", kind, fold).select("doc", "order", "into")


def flat_units(clauses: DataFrame, merged: DataFrame, max_tokens: int = MAX_TOKENS, target: int = TARGET_TOKENS) -> DataFrame:
    """(doc, group, pos, clause_id, kind, text, tokens, atomic): units of merged groups in order."""
    rows = clauses.join(merged, ["doc", "order"]).select(
        "doc", F.col("into").alias("group"), "order", "clause_id", F.posexplode("units").alias("i", "u")
    )
    order = Window.partitionBy("doc", "group").orderBy("order", "i")
    return rows.withColumn("pos", F.row_number().over(order) - 1).select("doc", "group", "pos", "clause_id", "u.*")


def hard_split(units: DataFrame, key: list[str], max_tokens: int = MAX_TOKENS, target: int = TARGET_TOKENS, count=n_words) -> DataFrame:
    """Prose units above the maximum cut by words; positions anew."""
    over = ~F.col("atomic") & (F.col("tokens") > max_tokens)
    cut = units.withColumn("texts", F.when(over, split_words(F.col("text"), target)).otherwise(F.array("text")))
    cut = cut.select(*[c for c in units.columns if c not in ("text", "tokens")], F.col("tokens").alias("whole"), F.posexplode("texts").alias("i", "text"))
    order = Window.partitionBy(*key).orderBy("old", "i")
    cut = cut.withColumnRenamed("pos", "old").withColumn("pos", F.row_number().over(order) - 1)
    tokens = F.when(~F.col("atomic") & (F.col("whole") > max_tokens), count(F.col("text"))).otherwise(F.col("whole"))
    return cut.withColumn("tokens", tokens).drop("old", "i", "whole")


def with_ancestors(units: DataFrame, key: list[str]) -> DataFrame:
    """Adds depth and ancestors: positions of the lines that enclose each line, however deep.

    A line of some depth is open until the next one of its depth or less, or until prose closes the list: prose that
    doesn't continue and is followed by no deeper line.
    """
    w = Window.partitionBy(*key).orderBy("pos")
    rows = units.withColumn("depth", F.regexp_extract("text", NEST, 1).try_cast("int"))
    rows = rows.withColumn("next_depth", F.first("depth", True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    closes = F.col("depth").isNull() & (F.col("kind") == "prose") & ~F.col("text").rlike(CONTINUATION)
    rows = rows.withColumn("closes", closes & (F.col("next_depth").isNull() | (F.col("next_depth") == 1)))
    pos = dict(units.dtypes)["pos"]
    rows = nesting.streamed(rows, key, ["pos"], ["depth", "closes", "pos"], "ancestors", f"array<{pos}>", nesting.open_ancestors)
    return rows.select(*units.columns, "depth", "ancestors")


def pack(units: DataFrame, key: list[str], target: int = TARGET_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """(key, piece, pos, role): the units of each piece in order; role body, overlap or condition.

    units: key, pos, tokens, atomic, ancestors. Cuts are a fold along the sizes of a group; the rest is windows.
    """
    body = nesting.streamed(units.repartition(*key), key, ["pos"], ["tokens"], "piece", "int", nesting.pieces(target))
    back = Window.partitionBy(*key, "piece").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    last = F.max("piece").over(Window.partitionBy(*key))
    tail = (F.sum("tokens").over(back) <= overlap) & ~F.bool_or("atomic").over(back) & (F.col("piece") < last)
    body = body.withColumn("tail", tail)
    own = body.select(*key, "piece", "pos", F.lit("body").alias("role"), "ancestors")
    carried = body.where("tail").select(*key, (F.col("piece") + 1).alias("piece"), "pos", F.lit("overlap").alias("role"), "ancestors")
    inside = own.union(carried)
    needed = inside.where("piece > 0").select(*key, "piece", F.explode("ancestors").alias("pos")).distinct()
    needed = needed.join(inside.select(*key, "piece", "pos"), [*key, "piece", "pos"], "left_anti")
    return inside.drop("ancestors").union(needed.select(*key, "piece", "pos", F.lit("condition").alias("role")))


def emit(groups: DataFrame, units: DataFrame, key: list[str], max_tokens: int = MAX_TOKENS, count=n_words, **sizes) -> DataFrame:
    """Chunks. groups: key, clause_uid, spec, spec_id, spec_title, version, release, clause_id, clause_title,
    breadcrumb, level, merged_clause_ids, order; units: as flat_units gives them (hard-split and with ancestors)."""
    small = units.groupBy(*key).agg((F.sum("tokens") <= max_tokens).alias("small"))
    rows = units.join(small, key)
    whole = rows.where("small").select(*key, F.lit(0).alias("piece"), "pos")
    cut = pack(rows.where("not small"), key, **sizes).select(*key, "piece", "pos")
    placed = whole.union(cut).join(units, [*key, "pos"])
    pieces = placed.groupBy(*key, "piece").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n\n").alias("text"),
        F.array_sort(F.collect_set("kind")).alias("block_types"),
    )
    pieces = pieces.withColumn("n_parts", F.count("*").over(Window.partitionBy(*key))).withColumn("part", F.col("piece") + 1)
    out = pieces.join(groups, key)
    c = F.col
    header = context_header(c("spec_id"), c("version"), c("release"), c("spec_title"), c("breadcrumb"), c("clause_id"), c("clause_title"), c("part"), c("n_parts"))
    uid = F.when(c("n_parts") > 1, F.concat("clause_uid", F.lit("::"), c("part").cast("string"))).otherwise(c("clause_uid"))
    return out.select(
        uid.alias("chunk_id"), "spec", "spec_id", "spec_title", "version", "release", "clause_id", "clause_title", "breadcrumb", "level",
        "part", "n_parts", "merged_clause_ids", "block_types", has_normative(c("text")).alias("has_normative"),
        citation(c("spec_id"), c("version"), c("clause_id")).alias("citation"), "text",
        F.concat(header, F.lit("\n\n"), c("text")).alias("embed_text"), count(c("text")).alias("token_count"), "order",
    )


def chunk(clauses: DataFrame, titles: DataFrame | None = None, strict_ancestor: bool = False, **limits) -> DataFrame:
    """Chunks of clauses (doc, clause_uid, spec, spec_id, version, release, clause_id, clause_title, level, breadcrumb, blocks, order)."""
    # Read by several branches below; lost blocks of the cache are worked out again.
    ready = with_units(clauses, **limits).persist()
    merged = merge_up(ready, strict_ancestor=strict_ancestor)
    folded = ready.join(merged, ["doc", "order"]).where(F.col("into") != F.col("order"))
    ids = folded.groupBy("doc", F.col("into").alias("group")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("order", "clause_id"))), lambda x: x["clause_id"]).alias("merged_clause_ids")
    )
    groups = ready.withColumn("group", F.col("order")).drop("blocks", "units").join(ids, ["doc", "group"], "left")
    groups = groups.withColumn("merged_clause_ids", F.coalesce("merged_clause_ids", F.array().cast("array<string>")))
    if titles is None:
        groups = groups.withColumn("spec_title", F.lit(""))
    else:
        groups = groups.join(titles.select("spec", F.col("title").alias("spec_title")), "spec", "left").fillna("", ["spec_title"])
    key = ["doc", "group"]
    units = with_ancestors(hard_split(flat_units(ready, merged.persist()), key), key).persist()
    return emit(groups, units, key)


def nested_lines(chunks: DataFrame, id_column: str = "chunk_id") -> DataFrame:
    """(chunk_id, pos, line, depth) of the nested lines of chunk texts."""
    lines = chunks.select(F.col(id_column).alias("chunk_id"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("line", strip(F.col("line")))
    return lines.withColumn("depth", F.regexp_extract("line", NEST, 1).try_cast("int")).where("depth is not null")


def orphans(chunks: DataFrame) -> DataFrame:
    """Nested lines without any line of smaller depth above them in their chunk; there must be none."""
    before = Window.partitionBy("chunk_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    least = nested_lines(chunks).withColumn("least", F.min("depth").over(before))
    return least.where("depth > 1 and (least is null or least >= depth)").select("chunk_id", "depth", F.substring("line", 1, 100).alias("line"))


def level_skips(chunks: DataFrame) -> DataFrame:
    """One row with the number of lines whose next smaller depth is missing though a smaller one stands above."""
    before = Window.partitionBy("chunk_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    seen = nested_lines(chunks).withColumn("seen", F.collect_set("depth").over(before))
    skipped = seen.where((F.col("depth") > 1) & ~F.array_contains("seen", F.col("depth") - 1) & (F.array_min("seen") < F.col("depth")))
    return skipped.agg(F.count("*").alias("n_skips"))


def duplicate_ids(chunks: DataFrame, id_column: str = "chunk_id") -> DataFrame:
    return chunks.groupBy(F.col(id_column).alias("chunk_id")).count().where("count > 1")


def oversize(chunks: DataFrame, limit: int = MAX_TOKENS) -> DataFrame:
    """One row: how many chunks are above the limit and the worst of them."""
    over = chunks.where(F.col("token_count") > limit)
    return over.agg(
        F.count("*").alias("n_over"), F.max("token_count").alias("worst_tokens"),
        F.max_by("chunk_id", F.struct("token_count", "chunk_id")).alias("worst_chunk"),
    )


def running_sum(rows: DataFrame, order: list[str], value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """rows with the sum of value up to and with each row in the order, per ``by``, which comes first in the order.

    The rows are dealt by ranges to a fixed number of partitions; sums of the partitions (one row each) come on top.
    """
    by = by or []
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *by, *order).withColumn("__part", F.spark_partition_id())
    inner = Window.partitionBy("__part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    dealt = dealt.withColumn("__inner", F.sum(value).over(inner))
    sizes = dealt.groupBy("__part", *by).agg(F.sum(value).alias("__own"))
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("__part").alias("__p"), *(F.col(c).alias(f"__{c}") for c in by), F.coalesce(F.sum("__own").over(earlier), F.lit(0)).alias("__before"))
    same = F.col("__part") == F.col("__p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return dealt.join(F.broadcast(sizes), same).select(*rows.columns, (F.col("__inner") + F.col("__before")).alias(out))


def index_percentiles(rows: DataFrame, value: str, shares: dict[str, tuple[float, int]], by: list[str] | None = None) -> DataFrame:
    """Values at an index of the sorted list, never interpolated: name: (share, shift of the index).

    Works on counts of distinct values, summed map-side and then along ranges of values.
    """
    by = by or []
    counted = rows.groupBy(*by, value).agg(F.count("*").alias("c"))
    total = counted.groupBy(*by).agg(F.sum("c").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"))
    along = running_sum(counted, [value], "c", "upto", by)
    whole = total.select(*(F.col(c).alias(f"of_{c}") for c in by), "n", "min", "max")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    along = along.join(F.broadcast(whole), same) if by else along.crossJoin(F.broadcast(whole))  # one row a class
    at = lambda share, shift: F.greatest(F.lit(0), F.least(F.floor(F.col("n") * F.lit(share)) + shift, F.col("n") - 1))
    return along.groupBy(*by).agg(
        F.first("n").alias("n"), F.first("min").alias("min"), F.first("max").alias("max"),
        *(F.min(F.when(F.col("upto") > at(*x), F.col(value))).alias(name) for name, x in shares.items()),
    )


def systematic_sample(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """Every (rows // n)-th row in order, n at most; evenly spaced, so that reruns agree."""
    step = max(1, rows.count() // n)
    ranked = running_sum(rows.withColumn("__one", F.lit(1).cast("long")), order, "__one", "place").drop("__one")
    return ranked.withColumn("place", F.col("place") - 1).where(f"place % {step} = 0 and place < {step * n}")
