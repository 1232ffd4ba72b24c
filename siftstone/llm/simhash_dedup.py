"""SimHash near-duplicate classes by covering locality-sensitive hashing.

Every bit position i of a 64-bit fingerprint gets a non-zero vector m(i) of radius + 1 bits. Table v
(any non-zero vector of as many bits) keeps the bits with an odd inner product <m(i), v>. Two
fingerprints that differ in at most ``radius`` positions leave at most ``radius`` linear equations
<m(i), v> = 0 in radius + 1 unknowns, so some table keeps none of the differing bits and both meet in
one bucket there: no linked pair is missed.

Buckets hold distinct fingerprints only, and a bucket emits one edge from each member to the
smallest member of its local component, never all pairs. Buckets of more than ``hot_bucket`` members
are split again by pigeonhole over their free bits (radius + 1 pieces, one of which agrees).
Components come from alternating large-star and small-star rounds over tables in the shared folder.

Defined results: null or empty text has the fingerprint zero and links like any other; repeated rows
have one class; null doc_ids take part but are never a class id (a class of null ids alone has null).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import appended, byte_slices, materialize, partitions, table, without

SEED = 42
RADIUS = 3
SHINGLE = 3
HOT_BUCKET = 8192
#: A bucket with more members probes neighbours in its sorted array instead of comparing blocks.
PROBE_FROM = 100_000


def fingerprint(data: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of a UTF-8 text; bit set if it is set in over half the shingle hashes."""
    import numpy as np
    from xxhash import xxh64_intdigest as digest

    found = (data or b"").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    size = np.fromiter(map(len, found), np.int64, len(found))
    end = np.cumsum(size + 1) - 1
    start = (end - size).tolist()
    ends = end[shingle - 1 :].tolist() or [len(joined)]
    n = len(ends)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 16320):
        some = np.array(
            [digest(joined[a:b], SEED) for a, b in zip(start[at : at + 16320], ends[at : at + 16320])],
            "<u8",
        )
        bits = np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # Up to 255 rows add up in the bytes of 64-bit lanes without a carry.
        pad = -len(bits) % 255
        if pad:
            bits = np.concatenate([bits, np.zeros((pad, 64), np.uint8)])
        lanes = bits.view("<u8").reshape(-1, 255, 8).sum(axis=1, dtype=np.uint64)
        ones += lanes.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(ones * 2 > n).tolist())


def with_fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The documents with ``__fp``, their fingerprint as a signed 64-bit value."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part, texts in byte_slices(batch, text):
                prints = np.array([fingerprint(x, shingle) for x in texts], np.uint64)
                yield appended(part, __fp=pa.array(prints.view(np.int64)))

    docs = without(docs, "__fp")
    return docs.mapInArrow(run, docs.selectExpr("*", "0L as __fp").schema)


def masks(radius: int = RADIUS) -> list[int]:
    """The kept bits of each table, unsigned."""
    most = (1 << (radius + 1)) - 1
    vector = [1 + i % most for i in range(64)]
    return [sum(1 << i for i in range(64) if (vector[i] & v).bit_count() & 1) for v in range(1, most + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pieces(mask: int, radius: int = RADIUS) -> list[int]:
    """The free bits of a table, dealt to radius + 1 pieces."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [sum(1 << i for i in free[j :: radius + 1]) for j in range(radius + 1)]


def local_edges(members, free: int, radius: int):
    """Edges (member, smallest member of its component) of one bucket of sorted distinct values."""
    import numpy as np

    n = len(members)
    label = np.arange(n)

    def join(i, j):
        while True:
            low = np.minimum(label[i], label[j])
            if (label[i] == low).all() and (label[j] == low).all():
                return
            np.minimum.at(label, label[i], low)
            np.minimum.at(label, label[j], low)
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
            while (label[label] != label).any():
                label[:] = label[label]

    if n <= PROBE_FROM:
        for at in range(0, n, 512):
            some = members[at : at + 512, None] ^ members[None, at:]
            i, j = np.nonzero(np.bitwise_count(some) <= radius)
            one = i < j
            if one.any():
                join(i[one] + at, j[one] + at)
    else:
        bits = [np.uint64(1 << i) for i in range(64) if free >> i & 1]
        for k in range(1, radius + 1):
            for some in combinations(bits, k):
                other = members ^ np.bitwise_or.reduce(some)
                at = np.minimum(np.searchsorted(members, other), n - 1)
                i = np.flatnonzero(members[at] == other)
                if len(i):
                    join(i, at[i])
    while (label[label] != label).any():
        label = label[label]
    i = np.flatnonzero(label != np.arange(n))
    return members[i], members[label[i]]


def links(prints: DataFrame, radius: int = RADIUS, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Edges (a, b) between distinct values of ``__fp`` that span every component of links."""
    kept = masks(radius)
    split = [pieces(m, radius) for m in kept]
    keyed = prints.select("__fp").distinct().select(
        "__fp",
        F.posexplode(F.array(*[F.col("__fp").bitwiseAND(F.lit(signed(m))) for m in kept])).alias("v", "key"),
    )
    hot = keyed.groupBy("v", "key").count().where(F.col("count") > hot_bucket).select("v", "key", F.lit(True).alias("hot"))
    sub = F.element_at(
        F.array(*[
            F.array(*[F.struct(F.lit(j + 1).alias("j"), F.col("__fp").bitwiseAND(F.lit(signed(p))).alias("sub")) for j, p in enumerate(ps)])
            for ps in split
        ]),
        F.col("v") + 1,
    )
    whole = F.array(F.struct(F.lit(0).alias("j"), F.lit(0).cast("long").alias("sub")))
    rows = (
        keyed.join(hot, ["v", "key"], "left")
        .select("__fp", "v", "key", F.explode(F.when(F.col("hot"), sub).otherwise(whole)).alias("s"))
        .select("v", "key", "s.j", "s.sub", "__fp")
        .repartition(partitions(prints.sparkSession), "v", "key", "j", "sub")
        .sortWithinPartitions("v", "key", "j", "sub")
    )

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def edges(group, rows):
            v, j = int(group[0]), int(group[2])
            free = ~kept[v] & ((1 << 64) - 1) & ~(split[v][j - 1] if j else 0)
            return local_edges(np.unique(rows.view(np.uint64)), free, radius)

        def out(found):
            a = np.concatenate([x for x, _ in found]).view(np.int64)
            b = np.concatenate([y for _, y in found]).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        last, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
            fps = batch.column(4).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            bounds = [0, *cut.tolist(), len(fps)]
            found = []
            if last is not None and (keys[0] != last).any():
                if sum(map(len, held)) > 1:
                    found.append(edges(last, np.concatenate(held)))
                held = []
            if len(bounds) > 2:
                size = np.diff(bounds)
                if held or size[0] > 1:
                    found.append(edges(keys[0], np.concatenate([*held, fps[: bounds[1]]])))
                for k in np.flatnonzero(size[1:-1] > 1) + 1:
                    found.append(edges(keys[bounds[k]], fps[bounds[k] : bounds[k + 1]]))
                held = []
            last = keys[-1]
            held.append(fps[bounds[-2] :].copy())
            if found:
                yield out(found)
        if sum(map(len, held)) > 1:
            yield out([edges(last, np.concatenate(held))])

    return rows.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge and a smaller node in its component."""

    def known(df: DataFrame):
        df = materialize(df, "star")
        return df, tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now, mark = known(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    while mark[0]:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        now, seen = known(small)
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    radius: int = RADIUS,
    shingle: int = SHINGLE,
    hot_bucket: int = HOT_BUCKET,
) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    prints = materialize(
        with_fingerprints(docs.select(F.col(id_column).alias("__id"), F.col(text).alias("__text")), "__text", shingle).drop("__text"),
        "prints",
    )
    distinct = prints.groupBy("__fp").agg(F.min("__id").alias("first"))
    root = components(links(prints, radius, hot_bucket))
    named = distinct.join(root, distinct["__fp"] == root["node"], "left").select(
        "__fp", "first", F.coalesce("root", "__fp").alias("root")
    )
    named = materialize(named, "roots")
    class_id = named.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = named.join(class_id, "root").select("__fp", "component_id")
    return prints.join(ids, "__fp").select(
        F.col("__id").alias(id_column),
        F.lpad(F.lower(F.hex("__fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
