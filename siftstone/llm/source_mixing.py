"""Mixing sources to target weights with a low-discrepancy schedule.

* Targets. Sources take weights by code point order; together they share 150 % of all words. A
  source stops at twice its size and the excess is shared again, which has a closed form: with sources
  ordered by cap / weight, the capped ones are a prefix of that order.
* Schedule. The mix is a line of slots, and every slot is a block of the same number of words, whatever
  its source. Slot i has the point frac(i * golden ratio) in 32-bit integers, mapped through the
  cumulative targets to a source. Slots of a source are ranked; rank r takes the words
  [r * block, (r + 1) * block) of the source's shuffled line of documents, which repeats from its start
  where it ends. So a source gets as many blocks as points fell to it, which is near its target because
  the points are evenly spread; its last block is cut where the target is reached. A source whose points
  stay ``SHORT_PERCENT`` or more below its target (one with a target of a few blocks) gets the missing
  blocks in slots after all others.
* Join. Documents stand on their source's line in an order shuffled by hash of id and text; each is cut
  where blocks end, and the pieces join the slots on (source, rank). What a document gives to the mix, and
  its first slot, come out of that join.

Slots grow with the corpus: one for every ``SLOT_WORDS`` words, or about ``SLOTS`` smaller ones in a small mix.
Nothing is ordered in one task: documents are ranked within (source, hash bucket) and slots within
(stretch, source), with prefix sums in two levels over the small tables of buckets and stretches.

Defined results: null or empty text has size 0 and is never taken; a null source is a source of its
own, the last in order; repeated rows each have their own place; an empty table gives an empty mix;
null and repeated ids are shuffled by their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.llm.common import WORD_JAVA, materialize, table, without

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST_REPEATS = 2
#: Words of a slot, and the fewest slots of a mix (a small mix has smaller blocks).
SLOT_WORDS = 2048
SLOTS = 1 << 16
SHORT_PERCENT = 1
#: Documents ranked by one window, slots in one stretch, and rows of the prefix sums' lower level.
BUCKET_DOCS = 1 << 10
STRETCH = 1 << 14
PREFIX = 1 << 12
GOLDEN = 2654435769
POINTS = 1 << 32
CELLS = 256
#: The table of sources (a name and five numbers each) is broadcast up to this many rows; beyond, skewed joins are split at run time.
BROADCAST_SOURCES = 100_000
OUTPUTS = ("size", "source_size", "target", "taken", "first_slot")


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_JAVA)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_REPEATS) -> DataFrame:
    """One row per source: __source, source_size, docs, target, and its stretch [low, high) of points.

    The windows here run over sources, one row each, with map-side sums before them.
    """
    by_source = sized.groupBy("__source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    every = Window.partitionBy(F.lit(0))
    named = every.orderBy(F.col("__source").asc_nulls_last())
    place = F.pmod(F.row_number().over(named) - 1, F.lit(len(weights)))
    sources = by_source.select(
        "*",
        F.element_at(F.array(*map(F.lit, weights)), place + 1).cast("double").alias("weight"),
        (F.sum("source_size").over(every) * share_percent / 100).cast("double").alias("all"),
        (F.col("source_size") * most).cast("double").alias("cap"),
    )
    ranked = every.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("__source").asc_nulls_last())
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    # The first source whose cap is above the level fixes it for itself and all after it.
    levelled = sources.select("*", level.alias("level"), (F.col("cap") / F.col("weight") >= level).alias("free"))
    fixed = F.first(F.when(F.col("free"), F.col("level")), True).over(ranked.rowsBetween(Window.unboundedPreceding, 0))
    settled = levelled.select(
        "__source", "source_size", "docs", F.coalesce(F.least("cap", F.col("weight") * fixed), F.col("cap")).alias("target")
    )
    whole = lambda c: c.cast("decimal(19,0)")
    aims = settled.withColumn("aim", F.floor("target").cast("long"))
    upto, every_aim = F.sum(whole(F.col("aim"))).over(named), F.sum(whole(F.col("aim"))).over(every)
    # Whole numbers of up to 38 digits: neither words nor points can overflow.
    points = lambda x: F.coalesce(F.expr(f"cast(({x}) * cast({POINTS} as decimal(10,0)) div all_aims as long)"), F.lit(0))
    summed = aims.withColumn("upto", upto.cast("decimal(28,0)")).withColumn("all_aims", F.when(every_aim > 0, every_aim.cast("decimal(28,0)")))
    return summed.select(
        "__source", "source_size", "docs", "target", "aim", points("upto - cast(aim as decimal(19,0))").alias("low"), points("upto").alias("high")
    )


def before(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """rows (key, order, value) with ``before``: the sum of value over the smaller orders of the key, in two levels."""
    rows = rows.withColumn("__top", F.floor(F.col(order) / PREFIX).cast("long"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy(F.col(key).alias("__k"), F.col("__top").alias("__t")).agg(F.sum(value).alias("__v"))
    tops = tops.select("__k", "__t", F.coalesce(F.sum("__v").over(earlier(Window.partitionBy("__k").orderBy("__t"))), F.lit(0)).alias("__v"))
    inner = F.coalesce(F.sum(value).over(earlier(Window.partitionBy(key, "__top").orderBy(order))), F.lit(0))
    joined = rows.withColumn("__in", inner).join(tops, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__top") == F.col("__t")))
    return joined.select(*[c for c in rows.columns if c != "__top"], (F.col("__in") + F.col("__v")).alias("before"))


def schedule(goals: DataFrame, slots: int, block: int, step: int = GOLDEN, stretch: int = STRETCH) -> DataFrame:
    """(slot, __source, rank): which source each slot draws on and the slot's rank there.

    goals: __source, aim, low, high. step: the multiplier of the point sequence, modulo 2**32.
    """
    spark = goals.sparkSession
    cell = POINTS // CELLS
    # Sources by the cells of the point range that they touch: one row a source, and one a cell.
    spread = goals.where("high > low").select(
        "__source", "low", "high",
        F.explode(F.sequence((F.col("low") / cell).cast("long"), ((F.col("high") - 1) / cell).cast("long"))).alias("cell"),
    )
    point = F.pmod(F.pmod(F.col("slot"), F.lit(1 << 31)) * step, F.lit(POINTS))
    drawn = (
        spark.range(slots)
        .select(F.col("id").alias("slot"), point.alias("point"))
        .withColumn("cell", (F.col("point") / cell).cast("long"))
        .join(spread, "cell")
        .where("point >= low and point < high")
        .select("slot", "__source", F.floor(F.col("slot") / stretch).alias("stretch"))
    )
    counted = drawn.groupBy("stretch", "__source").agg(F.count("*").alias("own"))
    offset = before(counted, "__source", "stretch", "own").select(
        F.col("stretch").alias("s"), F.col("__source").alias("src"), F.col("before").alias("offset")
    )
    inside = F.row_number().over(Window.partitionBy("stretch", "__source").orderBy("slot")) - 1
    had = (
        drawn.withColumn("inside", inside)
        .join(offset, (F.col("stretch") == F.col("s")) & F.col("__source").eqNullSafe(F.col("src")))
        .select("slot", "__source", (F.col("inside") + F.col("offset")).alias("rank"))
    )
    # Sources that their points leave short of the target: missing blocks, after all other slots, in order of source.
    got = counted.groupBy(F.col("__source").alias("src")).agg(F.sum("own").alias("got"))
    short = goals.join(got, F.col("__source").eqNullSafe(F.col("src")), "left").select(
        "__source", "aim", F.coalesce("got", F.lit(0)).alias("got"), F.expr(f"(aim + {block} - 1) div {block}").alias("full")
    )
    low = F.col("got") * block < F.col("aim") - F.expr(f"aim div {100 // SHORT_PERCENT}")
    short = short.where(low & (F.col("full") > F.col("got"))).withColumn("missing", F.col("full") - F.col("got"))
    upto = F.sum("missing").over(Window.partitionBy(F.lit(0)).orderBy(F.col("__source").asc_nulls_last()))
    late = short.withColumn("first", upto - F.col("missing") + slots).select(
        "__source", "got", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("missing") - 1)).alias("k")
    )
    return had.unionByName(late.select((F.col("first") + F.col("k")).alias("slot"), "__source", (F.col("got") + F.col("k")).alias("rank")))


def placed(sized: DataFrame, buckets: int) -> DataFrame:
    """Each row with [begin, begin + size) on its source's line. sized: __source, __order, size."""
    # __order has 60 bits; buckets are equal stretches of it.
    rows = sized.withColumn("bucket", F.shiftright(F.shiftright("__order", 30) * F.lit(buckets).cast("long"), 30))
    by = before(rows.groupBy("__source", "bucket").agg(F.sum("size").alias("words")), "__source", "bucket", "words")
    offset = by.select(F.col("__source").alias("src"), F.col("bucket").alias("b"), F.col("before").alias("offset"))
    inside = Window.partitionBy("__source", "bucket").orderBy("__order", "__id", "size").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("upto", F.sum("size").over(inside))
        .join(offset, F.col("__source").eqNullSafe(F.col("src")) & (F.col("bucket") == F.col("b")))
        .withColumn("begin", F.col("offset") + F.col("upto") - F.col("size"))
        .drop("src", "b", "offset", "upto", "bucket")
    )


def order_of(id_column: str, text: str) -> Column:
    """60 bits of a hash of id and text."""
    own = F.concat_ws(" ", F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(own.cast("binary")), 1, 15), 16, 10).cast("long")


def mix(
    docs: DataFrame, id_column: str = "doc_id", source: str = "source", text: str = "text", keep: bool = False,
    slot_words: int = SLOT_WORDS, min_slots: int = SLOTS, step: int = GOLDEN,
) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, first_slot (null if none); with all its columns if keep."""
    docs = without(docs, *OUTPUTS)
    row = F.struct("*") if keep else F.struct(id_column)
    sized = docs.select(
        row.alias("__row"), F.col(id_column).alias("__id"), F.col(source).alias("__source"), size_of(F.col(text)).alias("size"),
        order_of(id_column, text).alias("__order"),
    )
    return mix_sized(materialize(sized, "mix-sizes"), slot_words, min_slots, step).select(
        *([F.col("__row")[c].alias(c) for c in docs.columns] if keep else [F.col("__id").alias(id_column)]), *OUTPUTS
    )


def mix_sized(sized: DataFrame, slot_words: int = SLOT_WORDS, min_slots: int = SLOTS, step: int = GOLDEN) -> DataFrame:
    """The mix of documents of known sizes: __row, __id, __source, size, __order."""
    goals = materialize(targets(sized), "mix-targets")
    docs_in, words, sources = goals.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("aim"), F.lit(0)), F.count("*")).first()
    block = max(1, -(-int(words) // max(min_slots, int(words) // slot_words)))
    slots = -(-int(words) // block)
    plan = materialize(schedule(goals, slots, block, step), "mix-plan")
    got = plan.groupBy(F.col("__source").alias("src")).agg(F.count("*").alias("got"))
    aims = goals.join(got, F.col("__source").eqNullSafe(F.col("src")), "left").select(
        F.col("__source").alias("s0"), "source_size", "target", F.least(F.coalesce("got", F.lit(0)) * block, F.col("aim")).alias("goal")
    )
    lines = placed(sized, max(1, -(-int(docs_in) // BUCKET_DOCS)))
    aims = materialize(aims, "mix-aims")
    if sources <= BROADCAST_SOURCES:  # one source may have a third of the documents
        aims = F.broadcast(aims)
    lines = lines.join(aims, F.col("__source").eqNullSafe(F.col("s0"))).drop("s0")
    # A document comes round once a lap of its line; a piece is its part in one block.
    laps = F.explode(F.sequence(F.lit(0), F.lit(MOST_REPEATS - 1)))
    pieces = (
        lines.where("size > 0")
        .select("__source", "begin", "size", "source_size", "goal", laps.alias("lap"))
        .withColumn("from", F.col("lap") * F.col("source_size") + F.col("begin"))
        .withColumn("to", F.least(F.col("from") + F.col("size"), F.col("goal")))
        .where("to > `from`")
        .withColumn("rank", F.explode(F.sequence(F.expr(f"`from` div {block}"), F.expr(f"(to - 1) div {block}"))))
    )
    drawn = plan.select(F.col("__source").alias("src"), F.col("rank").alias("r"), "slot")
    words_in = F.least(F.col("to"), (F.col("rank") + 1) * block) - F.greatest(F.col("from"), F.col("rank") * block)
    taken = (
        pieces.withColumn("words", words_in)
        .join(drawn, F.col("__source").eqNullSafe(F.col("src")) & (F.col("rank") == F.col("r")))
        .groupBy(F.col("__source").alias("src"), F.col("begin").alias("b"))
        .agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    )
    out = lines.join(
        taken, F.col("__source").eqNullSafe(F.col("src")) & (F.col("begin") == F.col("b")) & (F.col("size") > 0), "left"
    )
    return out.select("__row", "__id", "__source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def op6_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


#: Targets, golden-ratio points, slots and blocks written out again; whole numbers are exact in both engines.
OP6_SQL = r"""
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0) AS BIGINT) AS size,
  CAST('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ' ', md5(coalesce(text, '')))), 1, 15) AS BIGINT) AS o FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight,
  CAST(source_size * 2 AS DOUBLE) AS cap, CAST(sum(source_size) OVER () * 150 AS DOUBLE) / 100 AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level FROM w
  WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN cap / weight >= level THEN least(cap, weight * (SELECT level FROM l WHERE cap / weight >= level
  ORDER BY cap / weight, source NULLS LAST LIMIT 1)) ELSE cap END AS target FROM l),
a AS (SELECT *, CAST(floor(target) AS HUGEINT) AS aim FROM t),
n AS (SELECT greatest(65536, CAST(sum(aim) AS BIGINT) // 2048) AS slots, CAST(sum(aim) AS HUGEINT) AS words FROM a),
b AS (SELECT words, CAST(greatest(1, (words + slots - 1) // slots) AS BIGINT) AS block FROM n),
z AS (SELECT words, block, CAST((words + block - 1) // block AS BIGINT) AS slots FROM b),
c AS (SELECT a.*, sum(aim) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING) AS upto FROM a),
r AS (SELECT source, aim, CAST((upto - aim) * 4294967296 // words AS BIGINT) AS low, CAST(upto * 4294967296 // words AS BIGINT) AS high FROM c, z WHERE words > 0),
points AS (SELECT i AS slot, (i % 2147483648 * 2654435769) % 4294967296 AS point FROM z, unnest(range(slots)) AS u(i)),
drawn AS (SELECT slot, source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM points JOIN r ON point >= low AND point < high),
g AS (SELECT a.source, a.aim, (SELECT count(*) FROM drawn WHERE drawn.source IS NOT DISTINCT FROM a.source) AS got, (aim + block - 1) // block AS full_, block FROM a, z),
short AS (SELECT *, full_ - got AS missing FROM g WHERE got * block < aim - aim // 100 AND full_ > got),
late AS (SELECT source, got, missing, slots + sum(missing) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING) - missing AS first_ FROM short, z),
plan AS (SELECT slot, source, rank FROM drawn UNION ALL SELECT CAST(first_ + k AS BIGINT), source, CAST(got + k AS BIGINT) FROM late, unnest(range(CAST(missing AS BIGINT))) AS u(k)),
goal AS (SELECT t.*, CAST(least(floor(target), block * (SELECT count(*) FROM plan WHERE plan.source IS NOT DISTINCT FROM t.source)) AS BIGINT) AS goal FROM t, z),
p AS (SELECT sized.*, source_size, target, goal, CAST(sum(size) OVER (PARTITION BY sized.source ORDER BY o, doc_id, size
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS begin FROM sized JOIN goal ON sized.source IS NOT DISTINCT FROM goal.source),
laps AS (SELECT doc_id, source, lap * source_size + begin AS from_, least(lap * source_size + begin + size, goal) AS to_ FROM p, unnest([0, 1]) AS u(lap)),
pieces AS (SELECT doc_id, source, from_, to_, rank, block FROM laps, z, unnest(range(from_ // block, (to_ - 1) // block + 1)) AS u(rank) WHERE to_ > from_),
taken AS (SELECT doc_id, sum(least(to_, (pieces.rank + 1) * block) - greatest(from_, pieces.rank * block)) AS taken, min(slot) AS first_slot
  FROM pieces JOIN plan ON plan.source IS NOT DISTINCT FROM pieces.source AND plan.rank = pieces.rank GROUP BY doc_id)
SELECT p.doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, first_slot FROM p LEFT JOIN taken ON taken.doc_id = p.doc_id
"""
