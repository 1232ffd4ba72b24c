"""Quality rules: counted statistics, base limits, and robust multivariate outliers.

The counts come from array functions inside the JVM. Documents that pass the base limits get a
transformed vector (log mean word length; square roots of symbols per word, of the share of repeated
lines and of the share of repeated words), rounded to a grid, and the documents of each grid cell are
counted per language and source. A minimum-covariance-determinant estimate is made from the counts:

1. Starts: the mean and covariance of all, and ``STARTS`` cells chosen by hash as centres.
2. A concentration step takes the half of smallest Mahalanobis distance and its mean and covariance,
   scaled for the trimmed half, with a floor added to the diagonal (most clean texts have no symbols at all,
   a variance of zero); it never raises the determinant. After ``FIRST_ROUNDS`` steps the ``BEST`` starts of
   smallest determinant go on for ``MORE_ROUNDS``, and the smallest determinant of all gives the estimate.
3. A document is kept if its squared distance is at most ``CUTOFF``. The floors let each part of the vector pass the
   cutoff alone: repeated lines or repeated words above 41 % of a text are enough.

Groups below ``MIN_GROUP`` documents use their language's estimate, then that of all.

A step sums moments by distance bins (``BINS`` to a factor of e), map-side first, and finds the half from the
cumulated bins, so no task sees all documents or cells of a group, however many there are. The bin in which the half
ends counts in part. Sums are whole numbers, so reruns agree.

Defined results: null text counts as empty (0 words, base_failed); null language or source is a
group of its own; without any group of MIN_GROUP documents, all that pass the base limits are kept;
repeated rows get one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.llm.common import materialize, table, without, words_column

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Grid steps to the unit, and the floor of the standard deviation, of each part of the vector.
STEPS = (200, 100, 50, 50)
FLOORS = (0.05, 0.06, 0.12, 0.12)
#: Consistency of the covariance of the central half of a normal distribution in four dimensions.
SCALE = 2.11
#: Chi-square quantile, four degrees of freedom, 0.99999.
CUTOFF = 28.47
MIN_GROUP = 20
STARTS, FIRST_ROUNDS, BEST, MORE_ROUNDS = 40, 2, 8, 5
#: Distance bins to a factor of e.
BINS = 1024
#: Estimates are broadcast up to this many rows (15 numbers each), else joined by their keys.
BROADCAST_ROWS = 200_000
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines_")
D = range(1, 5)
PAIRS = [(i, j) for i in D for j in range(1, i + 1)]


def bound(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words in windows of three that the text holds at least twice."""

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def positions(z: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(z, i)["h"] == x["h"], F.lit(False))
        at = F.transform(z, lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x["p"]))
        return F.sort_array(F.filter(at, lambda p: p.isNotNull()))

    triple = lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p"))
    triples = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), triple))
    return F.when(F.size(words) < 3, 0).otherwise(bound(triples, lambda z: bound(positions(z), covered)))


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with the counted statistics."""
    docs = without(docs, *STATS, "__w", "__l")
    whole = F.coalesce(F.col(text), F.lit(""))
    by_word = bound(
        words_column(F.col(text)),
        lambda w: F.struct(
            F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), repeated_words(w).alias("again")
        ),
    )
    by_line = bound(
        F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")),
    )
    symbols = F.length(whole) - F.length(F.regexp_replace(whole, "[#*$%&|<>]", ""))
    return docs.select("*", by_word.alias("__w"), by_line.alias("__l")).select(
        *docs.columns,
        *[
            c.cast("long").alias(n)
            for n, c in zip(STATS, ("__w.n", "__w.chars", symbols, "__l.dup", "__w.again", "__l.n"))
            for c in [F.col(c) if isinstance(c, str) else c]
        ],
    )


def part(name: str) -> Column:
    """Text of a key; null is a key of its own."""
    c = F.col(name).cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.length(c).cast("string"), F.lit(":"), c))


def vectors_of(counted: DataFrame) -> DataFrame:
    """Adds base_failed, the group keys k2, k1, k0 and the grid vector q1 to q4 (null where base_failed)."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    share = lambda a, b: F.col(a).cast("double") / F.col(b)
    value = (F.log(share("word_chars", "n_words")), *map(F.sqrt, (share("n_symbols", "n_words"), share("n_dup_lines", "n_lines_"), share("n_repeat_words", "n_words"))))
    rows = counted.withColumn("base_failed", failed)
    return rows.select(
        "*", F.concat(part("lang"), F.lit(" "), part("source")).alias("k2"), part("lang").alias("k1"), F.lit("all").alias("k0"),
        *(F.when(~F.col("base_failed"), F.floor(v * k)).cast("long").alias(f"q{i}") for i, v, k in zip(D, value, STEPS)),
    )


def cells_of(vectors: DataFrame) -> DataFrame:
    """(lv, k, q1..q4, n): documents of each grid cell, for the groups and levels that need an estimate."""
    q = [f"q{i}" for i in D]
    cells = materialize(vectors.where("not base_failed").groupBy("k2", "k1", "k0", *q).agg(F.count("*").alias("n")), "quality-cells")
    # One row a group: its own level if it is large, else its language's, else that of all.
    groups = cells.groupBy("k2", "k1", "k0").agg(F.sum("n").alias("n2"))
    small = F.col("n2") < MIN_GROUP
    by = lambda *k: Window.partitionBy(*k)
    groups = groups.select("*", F.sum("n2").over(by("k1")).alias("n1"), F.max(small).over(by("k1")).alias("use1"))
    groups = groups.select("*", F.max(F.col("use1") & (F.col("n1") < MIN_GROUP)).over(by("k0")).alias("use0"), F.sum("n2").over(by("k0")).alias("n0"))
    level = lambda i, use: F.when(use, F.struct(F.lit(i).alias("lv"), F.col(f"k{i}").alias("k")))
    use = F.array_compact(F.array(level(2, ~small), level(1, F.col("use1") & (F.col("n1") >= MIN_GROUP)), level(0, F.col("use0") & (F.col("n0") >= MIN_GROUP))))
    levels = groups.select(F.col("k2").alias("g"), F.explode(use).alias("l"))
    rows = cells.join(levels, F.col("k2") == F.col("g")).select("l.lv", "l.k", *q, "n")
    return materialize(rows.groupBy("lv", "k", *q).agg(F.sum("n").alias("n")), "quality-levels")


NUMBERS = [*(f"m{i}" for i in D), *(f"l{i}{j}" for i, j in PAIRS)]
#: Sums of the vector's parts and of their products.
SUMS = {f"s{i}": f"q{i}" for i in D} | {f"s{i}{j}": f"q{i} * q{j}" for i, j in PAIRS}
MOMENTS = ", ".join(f"sum(n * {x}) AS {c}" for c, x in SUMS.items())


def factored(sums: str) -> str:
    """(lv, k, s) with the mean and the Cholesky factor of the floored covariance; sums: SQL of lv, k, s, weight w and SUMS."""
    mean = ", ".join(f"s{i} / w AS m{i}" for i in D)
    sql = f"SELECT *, {', '.join(f'(s{i}{j} / w - m{i} * m{j}) * {SCALE}D AS c{i}{j}' for i, j in PAIRS)} FROM (SELECT *, {mean} FROM ({sums}))"
    for i, j in PAIRS:  # one entry a layer
        less = "".join(f" - l{i}{x} * l{j}{x}" for x in range(1, j))
        floor = (FLOORS[i - 1] * STEPS[i - 1]) ** 2
        value = f"sqrt(greatest(c{i}{i}, 0D) + {floor}D{less})" if i == j else f"(c{i}{j}{less}) / l{j}{j}"
        sql = f"SELECT *, {value} AS l{i}{j} FROM ({sql})"
    return f"SELECT lv, k, s, {', '.join(NUMBERS)} FROM ({sql})"


def distances(rows: str) -> str:
    """rows (SQL of a vector and an estimate) with d2, by forward substitution."""
    for i in D:
        less = "".join(f" - l{i}{j} * y{j}" for j in range(1, i))
        rows = f"SELECT *, (q{i} - m{i}{less}) / l{i}{i} AS y{i} FROM ({rows})"
    return f"SELECT *, y1 * y1 + y2 * y2 + y3 * y3 + y4 * y4 AS d2 FROM ({rows})"


def starts(cells: DataFrame) -> DataFrame:
    """(lv, k, s, estimate): all documents' moments as start 0, and cells chosen by hash as centres."""
    every = f"SELECT lv, k, 0 AS s, cast(sum(n) AS double) AS w, {MOMENTS} FROM (SELECT lv, k, q1, q2, q3, q4, cast(n AS decimal(19,0)) AS n FROM {{c}}) GROUP BY lv, k"
    every = f"SELECT lv, k, s, w, {', '.join(f'cast({c} AS double) AS {c}' for c in SUMS)} FROM ({every})"
    scale = ", ".join(f"{FLOORS[i - 1] * STEPS[i - 1] if i == j else 0.0}D AS l{i}{j}" for i, j in PAIRS)
    by_hash = "row_number() OVER (PARTITION BY lv, k ORDER BY md5(cast(concat_ws(',', q1, q2, q3, q4) AS binary)))"
    centres = f"SELECT lv, k, s, {', '.join(f'cast(q{i} AS double) AS m{i}' for i in D)}, {scale} FROM (SELECT *, {by_hash} AS s FROM {{c}}) WHERE s <= {STARTS}"
    return cells.sparkSession.sql(f"{factored(every)} UNION ALL {centres}", c=cells)


def concentrated(cells: DataFrame, now: DataFrame, few: bool) -> DataFrame:
    """One concentration step of every start. few: the estimates may be broadcast."""
    far = distances(f"SELECT {'/*+ BROADCAST(e) */ ' if few else ''}c.*, s, {', '.join(NUMBERS)} FROM {{c}} AS c JOIN {{e}} AS e ON c.lv = e.lv AND c.k = e.k")
    binned = f"SELECT lv, k, s, b, sum(n) AS n, {MOMENTS} FROM (SELECT *, cast(floor(ln(1 + d2) * {BINS}) AS int) AS b FROM ({far})) GROUP BY lv, k, s, b"
    upto = "sum(n) OVER (PARTITION BY lv, k, s ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    half = f"SELECT * FROM (SELECT *, {upto} AS upto, sum(n) OVER (PARTITION BY lv, k, s) / 2D AS w FROM ({binned})) WHERE upto - n < w"
    # Bins within the half, and the share of the bin in which it ends.
    sums = ", ".join(f"sum(CASE WHEN upto <= w THEN cast({c} AS decimal(38,0)) END) AS in_{c}, max(CASE WHEN upto > w THEN {c} END) AS on_{c}" for c in SUMS)
    summed = f"SELECT lv, k, s, first(w) AS w, max(CASE WHEN upto > w THEN (w - (upto - n)) / n END) AS f, {sums} FROM ({half}) GROUP BY lv, k, s"
    both = ", ".join(f"coalesce(cast(in_{c} AS double), 0D) + coalesce(f * on_{c}, 0D) AS {c}" for c in SUMS)
    return cells.sparkSession.sql(factored(f"SELECT lv, k, s, w, {both} FROM ({summed})"), c=cells, e=now)


def smallest(now: DataFrame, n: int) -> DataFrame:
    """The n estimates of smallest determinant of each group."""
    det = F.col("l11") * F.col("l22") * F.col("l33") * F.col("l44")
    order = Window.partitionBy("lv", "k").orderBy(det, "s")
    return now.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n).drop("__r")


def robust_estimates(vectors: DataFrame) -> DataFrame:
    """(lv, k, s, mean and Cholesky factor), one row a group, from documents that pass the base limits."""
    cells = cells_of(vectors)
    now = materialize(starts(cells), "quality-starts")
    few = now.count() <= BROADCAST_ROWS
    for i in range(FIRST_ROUNDS + MORE_ROUNDS):
        now = materialize(concentrated(cells, smallest(now, BEST) if i == FIRST_ROUNDS else now, few), "quality-mcd")
    return smallest(now, 1)


def counted_rows(docs: DataFrame) -> DataFrame:
    """Each document whole as __row, with lang, source and the counts; texts are counted once, estimates read numbers only."""
    counted = with_counts(docs.select(F.struct("*").alias("__row"), "text", "lang", "source"))
    return materialize(counted.drop("text"), "quality-counts")


def verdicts(counted: DataFrame, estimates: DataFrame | None = None) -> DataFrame:
    """counted (__row, lang, source, counts) with base_failed, d2 and kept."""
    vectors = vectors_of(counted)
    if estimates is None:
        estimates = materialize(robust_estimates(vectors.drop("__row")), "quality-estimates")
    for level in (2, 1, 0):
        one = estimates.where(F.col("lv") == level).select(F.col("k").alias(f"e{level}"), F.struct(*NUMBERS).alias(f"at{level}"))
        vectors = vectors.join(one, F.col(f"k{level}") == F.col(f"e{level}"), "left")
    at = F.coalesce("at2", "at1", "at0")
    placed = vectors.withColumn("at", at).select("*", "at.*").drop("at2", "at1", "at0", "at")
    out = vectors.sparkSession.sql(distances("SELECT * FROM {v}"), v=placed)
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= CUTOFF, F.lit(True)))


def judge(docs: DataFrame, estimates: DataFrame | None = None) -> DataFrame:
    """The documents (text, lang, source and any further columns) with the counts, base_failed, kept, distance."""
    docs = without(docs, *STATS, "base_failed", "kept", "distance")
    out = verdicts(counted_rows(docs), estimates)
    return out.select(*[F.col("__row")[c].alias(c) for c in docs.columns], *STATS[:5], "base_failed", "kept", F.col("d2").alias("distance"))


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    counted = with_counts(docs.select(F.struct("doc_id").alias("__row"), "text", "lang", "source")).drop("text")
    out = verdicts(materialize(counted, "quality-counts"))
    return out.select("__row.doc_id", *STATS[:5], "base_failed", "kept")


def op2_sql() -> str:
    """The same from documents instead of cells, with covariances inverted by cofactors; shares no expression with the above."""
    counted = r"""
w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
tri AS (SELECT doc_id, i, list_slice(w, i, i + 2) AS g FROM w, unnest(range(1, len(w) - 1)) AS u(i)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) AS x WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS r FROM again, unnest(range(0, 3)) AS u(o) GROUP BY doc_id),
counted AS (SELECT w.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words,
  len(ls) AS all_lines FROM w LEFT JOIN rep USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
points AS (SELECT doc_id, lang, source, floor(200 * ln(word_chars::DOUBLE / n_words)) AS a, floor(100 * sqrt(n_symbols::DOUBLE / n_words)) AS b,
  floor(50 * sqrt(n_dup_lines::DOUBLE / all_lines)) AS c, floor(50 * sqrt(n_repeat_words::DOUBLE / n_words)) AS d FROM judged WHERE NOT base_failed),
sized AS (SELECT *, count(*) OVER (PARTITION BY lang, source) AS n_own, count(*) OVER (PARTITION BY lang) AS n_lang, count(*) OVER () AS n_all FROM points),
wanted AS (SELECT *, CASE WHEN n_own >= 20 THEN 2 WHEN n_lang >= 20 THEN 1 WHEN n_all >= 20 THEN 0 END AS lv FROM sized),
member AS (SELECT DISTINCT lv, CASE WHEN lv > 0 THEN lang END AS g1, CASE WHEN lv = 2 THEN source END AS g2 FROM wanted WHERE lv IS NOT NULL),
p AS MATERIALIZED (SELECT m.lv, m.g1, m.g2, a, b, c, d FROM points AS x JOIN member AS m ON (m.lv = 0 OR m.g1 IS NOT DISTINCT FROM x.lang) AND (m.lv < 2 OR m.g2 IS NOT DISTINCT FROM x.source))"""
    axes, key = "abcd", "lv, g1, g2, s"
    pairs = [(x, y) for i, x in enumerate(axes) for y in axes[i:]]
    floor = dict(zip(axes, (100.0, 36.0, 36.0, 36.0)))  # (0.05 * 200) squared, (0.06 * 100) squared, (0.12 * 50) squared
    cell = lambda x, y: f"v{min(x, y)}{max(x, y)}"

    def det(rows, columns):
        if not rows:
            return "1.0::DOUBLE"
        terms = (f"{'-' if k % 2 else '+'} {cell(rows[0], y)} * ({det(rows[1:], columns[:k] + columns[k + 1:])})" for k, y in enumerate(columns))
        return " ".join(terms).lstrip("+ ")

    def inverse(source):
        """Adds det and the entries i** of the inverse."""
        minor = lambda x, y: det(axes.replace(x, ""), axes.replace(y, ""))
        cofactors = ", ".join(f"{'-' if (axes.index(x) + axes.index(y)) % 2 else ''}({minor(x, y)}) AS k{x}{y}" for x, y in pairs)
        return (
            f"SELECT {key}, " + ", ".join(f"m{x}" for x in axes) + ", det, " + ", ".join(f"k{x}{y} / det AS i{x}{y}" for x, y in pairs)
            + f" FROM (SELECT *, {det(axes, axes)} AS det, {cofactors} FROM ({source}) AS cov) AS cof"
        )

    def covariance(sums, weight):
        mean = ", ".join(f"{sums(x)} / {weight} AS m{x}" for x in axes)
        cov = ", ".join(
            f"(greatest({sums(f'{x} * {y}')} / {weight} - ({sums(x)} / {weight}) * ({sums(y)} / {weight}), 0) * 2.11 + {floor[x]})::DOUBLE AS v{x}{y}" if x == y
            else f"({sums(f'{x} * {y}')} / {weight} - ({sums(x)} / {weight}) * ({sums(y)} / {weight})) * 2.11::DOUBLE AS v{x}{y}" for x, y in pairs
        )
        return f"{mean}, {cov}"

    gap = lambda x: f"(p.{x} - e.m{x})"
    far = " + ".join(f"{'' if x == y else '2 * '}e.i{x}{y} * {gap(x)} * {gap(y)}" for x, y in pairs)
    same = "e.lv = p.lv AND e.g1 IS NOT DISTINCT FROM p.g1 AND e.g2 IS NOT DISTINCT FROM p.g2"
    plain = lambda x: f"sum({x})"
    rows = f"SELECT lv, g1, g2, 0 AS s, {covariance(plain, 'count(*)')} FROM p GROUP BY lv, g1, g2 UNION ALL "
    rows += (
        f"SELECT {key}, " + ", ".join(f"{x} AS m{x}" for x in axes) + ", " + ", ".join(f"{floor[x] if x == y else 0.0}::DOUBLE AS v{x}{y}" for x, y in pairs)
        + " FROM (SELECT *, row_number() OVER (PARTITION BY lv, g1, g2 ORDER BY md5(concat_ws(',', a::BIGINT, b::BIGINT, c::BIGINT, d::BIGINT))) AS s FROM (SELECT DISTINCT * FROM p) AS u) AS c WHERE s <= 40"
    )
    steps, last = [f"e0 AS MATERIALIZED ({inverse(rows)})"], 7
    for i in range(last):
        before = f"e{i}" if i != 2 else "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lv, g1, g2 ORDER BY det, s) AS r FROM e2) AS ranked WHERE r <= 8)"
        steps.append(f"d{i} AS (SELECT p.*, e.s, floor(ln(1 + greatest(0, {far})) * 1024) AS bin FROM p JOIN {before} AS e ON {same})")
        steps.append(
            f"n{i} AS (SELECT {key}, bin, cnt, sum(cnt) OVER (PARTITION BY {key} ORDER BY bin) AS upto, sum(cnt) OVER (PARTITION BY {key}) * 0.5::DOUBLE AS half "
            f"FROM (SELECT {key}, bin, count(*) AS cnt FROM d{i} GROUP BY ALL) AS t)"
        )
        steps.append(
            f"x{i} AS (SELECT d.*, half, CASE WHEN upto <= half THEN 1 ELSE (half - (upto - cnt)) / cnt END::DOUBLE AS share FROM d{i} AS d JOIN n{i} AS n ON "
            "d.lv = n.lv AND d.g1 IS NOT DISTINCT FROM n.g1 AND d.g2 IS NOT DISTINCT FROM n.g2 AND d.s = n.s AND d.bin = n.bin WHERE upto - cnt < half)"
        )
        part_sums = lambda x: f"sum(share * {x})"
        steps.append(f"e{i + 1} AS MATERIALIZED ({inverse(f'SELECT {key}, {covariance(part_sums, 'max(half)')} FROM x{i} GROUP BY {key}')})")
    steps.append(f"won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lv, g1, g2 ORDER BY det, s) AS r FROM e{last}) AS ranked WHERE r = 1)")
    steps.append(f"verdict AS (SELECT p.doc_id, ({far}) <= 28.47 AS inside FROM wanted AS p JOIN won AS e ON e.lv = p.lv AND (p.lv = 0 OR e.g1 IS NOT DISTINCT FROM p.lang) AND (p.lv < 2 OR e.g2 IS NOT DISTINCT FROM p.source))")
    return (
        f"WITH {counted.strip()},\n" + ",\n".join(steps)
        + "\nSELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(inside, true) AS kept FROM judged AS j LEFT JOIN verdict AS v ON v.doc_id = j.doc_id"
    )
