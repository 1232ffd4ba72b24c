"""Line deduplication through a sharded minimal perfect hash.

1. Every document sends the 128-bit hashes of its distinct line keys that are long enough. Counts of
   documents and the largest doc_id of each key are aggregated with map-side partial sums.
2. Keys are dealt to shards of about ``SHARD_KEYS``. A shard is a minimal perfect hash (levels of bit
   arrays, ranks by prefix counts) that indexes compact arrays: a 32-bit fingerprint, a saturating
   16-bit count and the owner of each key. All probing keys are in the index, so a slot is always
   the key's own; the fingerprint guards against foreign keys.
3. Hashes, never lines, are routed to the shards and probe the arrays as a stream. A shard that
   many documents probe is handed out in several copies; how many comes from the counts, so that no
   task gets much more than its share even if one line is in a third of all documents.
4. A document gets back the hashes of the lines it loses and is rewritten.

Defined results: ids are whole numbers (others raise TypeError); a null or empty text is one empty line; rows that repeat a doc_id are one document;
a null doc_id is a document of its own that never owns a line; lines that are too short always stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import appended, byte_slices, check_whole_ids, materialize, partitions, table, without

MIN_DOCS = 5
MIN_CHARS = 40
SHARD_KEYS = 1 << 18
BLANK = b" \t\n\r\x0b\x0c"
GAMMA = 2.0
OUTPUTS = ("kept_text", "n_lines", "n_dropped", "__lost")


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line, or None if it is too short to count."""
    key = line.strip(BLANK).lower()
    if len(key) < min_chars or not key.isascii() and len(key.decode()) < min_chars:
        return None
    return key


def keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(a, b, doc_id): the hashes of each row's distinct keys. docs: __id, __text."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_128_digest as digest

        for batch in batches:
            for part, texts in byte_slices(batch, "__text"):
                found, size = [], []
                for text in texts:
                    own = {digest(k) for x in (text or b"").split(b"\n") if (k := line_key(x, min_chars)) is not None}
                    found += own
                    size.append(len(own))
                ab = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(size)), size)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ab[:, 0].copy()), pa.array(ab[:, 1].copy()), ids], names=["a", "b", "__id"]
                )

    kind = docs.schema["__id"].dataType.simpleString()
    return docs.select("__id", "__text").mapInArrow(run, f"a long, b long, __id {kind}")


def positions(a, b, level: int, size: int):
    """Where keys fall in the bit array of a level."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = a ^ (b * np.uint64(2 * level + 1) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1))
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return (x >> np.uint64(11)) % np.uint64(size)


class PerfectHash:
    """Minimal perfect hash of distinct 128-bit keys: level by level, keys alone at their bit stay."""

    def __init__(self, levels):
        import numpy as np

        self.levels = levels
        self.before, total = [], 0
        for bits in levels:
            rank = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])
            self.before.append(rank[:-1] + total)
            total += int(rank[-1])
        self.size = total

    @classmethod
    def build(cls, a, b):
        import numpy as np

        levels, left = [], np.arange(len(a))
        while len(left):
            n = max(64, -(-int(GAMMA * len(left)) // 64) * 64)
            at = positions(a[left], b[left], len(levels), n).astype(np.int64)
            one = np.bincount(at, minlength=n) == 1
            levels.append(np.packbits(one, bitorder="little").view("<u8"))
            left = left[~one[at]]
        return cls(levels)

    def slots(self, a, b):
        """The slot of each key; -1 for a key that no level has."""
        import numpy as np

        out, left = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, bits in enumerate(self.levels):
            if not len(left):
                break
            at = positions(a[left], b[left], level, 64 * len(bits))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            has = (bits[word] >> bit & np.uint64(1)).astype(bool)
            w, under = word[has], (np.uint64(1) << bit[has]) - np.uint64(1)
            out[left[has]] = self.before[level][w] + np.bitwise_count(bits[w] & under)
            left = left[~has]
        return out


PAYLOAD = "sizes binary, bits binary, prints binary, counts binary, owners binary"


def index(counted: DataFrame, shards: int) -> DataFrame:
    """One row per shard: the perfect hash and its arrays. counted: a, b, n, owner."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def shard(which, parts):
            a, b, n, owner = (np.concatenate([p[i] for p in parts]) for i in range(4))
            a, b = a.view(np.uint64), b.view(np.uint64)
            mph = PerfectHash.build(a, b)
            at = mph.slots(a, b)
            arrays = np.empty(len(a), "<u4"), np.empty(len(a), "<u2"), np.empty(len(a), "<i8")
            for array, values in zip(arrays, ((b & np.uint64(0xFFFFFFFF)), np.minimum(n, 65535), owner)):
                array[at] = values
            sizes = np.array([len(x) for x in mph.levels], "<i8")
            row = [sizes.tobytes(), b"".join(x.tobytes() for x in mph.levels), *(x.tobytes() for x in arrays)]
            return pa.RecordBatch.from_arrays(
                [pa.array([which], pa.int32()), pa.array([int(n.sum())]), *(pa.array([x], pa.binary()) for x in row)],
                names=["shard", "probes", "sizes", "bits", "prints", "counts", "owners"],
            )

        last, held = None, []
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(columns[0]):
                continue
            cut = np.flatnonzero(columns[0][1:] != columns[0][:-1]) + 1
            for part in zip(*(np.split(c, cut) for c in columns)):
                if last is not None and part[0][0] != last:
                    yield shard(last, held)
                    held = []
                last = int(part[0][0])
                held.append([x.copy() for x in part[1:]])
        if held:
            yield shard(last, held)

    rows = counted.select(
        F.pmod(F.col("a"), F.lit(shards)).cast("int").alias("shard"), "a", "b", "n", F.coalesce("owner", F.lit(0)).alias("owner")
    )
    n = min(shards, partitions(counted.sparkSession))
    rows = rows.repartition(n, "shard").sortWithinPartitions("shard")
    return rows.mapInArrow(run, f"shard int, probes long, {PAYLOAD}")


def probe(found: DataFrame, arrays: DataFrame, shards: int, share: int, min_docs: int) -> DataFrame:
    """(__id, a, b) of the keys that documents lose. share: probing rows that one copy serves."""
    copies = arrays.select("shard", F.ceil(F.col("probes") / F.lit(share)).cast("int").alias("copies"))
    # At most rows / share shards have more than one copy, and share is rows / partitions.
    several = F.broadcast(copies.where("copies > 1"))
    kind = found.schema["__id"].dataType.simpleString()
    null = lambda sql: [F.lit(None).cast(t.split()[1]).alias(t.split()[0]) for t in sql.split(", ")]
    asking = (
        found.withColumn("shard", F.pmod(F.col("a"), F.lit(shards)).cast("int"))
        .join(several, "shard", "left")
        .select("shard", F.pmod(F.xxhash64("__id"), F.coalesce("copies", F.lit(1))).cast("int").alias("copy"), F.lit(1).alias("kind"), "a", "b", "__id", *null(PAYLOAD))
    )
    serving = arrays.select(
        "shard",
        F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("probes") / F.lit(share)).cast("int"), F.lit(1)) - 1)).alias("copy"),
        F.lit(0).alias("kind"),
        *null(f"a long, b long, __id {kind}"),
        *[p.split()[0] for p in PAYLOAD.split(", ")],
    )
    rows = (
        serving.union(asking)
        .repartition(partitions(found.sparkSession), "shard", "copy")
        .sortWithinPartitions("shard", "copy", "kind")
    )

    def run(batches):
        import numpy as np
        import pyarrow as pa

        mph = prints = counts = owners = None
        for batch in batches:
            kinds = batch.column(2).to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(kinds == 0)), len(kinds)]
            for lo, hi in zip(starts, starts[1:]):
                if lo == hi:
                    continue
                if kinds[lo] == 0:
                    sizes, bits, prints, counts, owners = (
                        np.frombuffer(batch.column(i)[int(lo)].as_py(), t) for i, t in zip(range(6, 11), ("<i8", "<u8", "<u4", "<u2", "<i8"))
                    )
                    mph = PerfectHash(np.split(bits, np.cumsum(sizes)[:-1]))
                    lo += 1
                part = batch.slice(int(lo), int(hi - lo))
                if not part.num_rows:
                    continue
                a, b = (part.column(i).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for i in (3, 4))
                at = mph.slots(a, b)
                own = part.column(5)
                mine = own.fill_null(0).to_numpy(zero_copy_only=False) == owners[at]
                mine &= own.is_valid().to_numpy(zero_copy_only=False)
                lost = (at >= 0) & (prints[at] == (b & np.uint64(0xFFFFFFFF))) & (counts[at] >= min_docs) & ~mine
                if lost.any():
                    yield part.filter(pa.array(lost)).select([5, 3, 4])

    return rows.mapInArrow(run, f"__id {kind}, a long, b long")


def rewrite(docs: DataFrame, lost: DataFrame, id_column: str, text: str, min_chars: int) -> DataFrame:
    lost = lost.groupBy(F.col("__id").alias("__owner")).agg(F.collect_list(F.struct("a", "b")).alias("__lost"))
    joined = docs.join(lost, docs[id_column].eqNullSafe(lost["__owner"]), "left").drop("__owner")

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_128_digest as digest

        for batch in batches:
            for part, texts in byte_slices(batch, text):
                gone = part.column(part.schema.get_field_index("__lost"))
                ends = gone.offsets.to_numpy()
                pairs = np.stack([gone.values.field(i).to_numpy(zero_copy_only=False) for i in range(2)], axis=1) if len(gone.values) else np.empty((0, 2), np.int64)
                kept, total, dropped = [], [], []
                for i, data in enumerate(texts):
                    lines = (data or b"").split(b"\n")
                    own = {x.tobytes() for x in pairs[ends[i] : ends[i + 1]].astype("<i8")}
                    left = [x for x in lines if (k := line_key(x, min_chars)) is None or digest(k) not in own] if own else lines
                    kept.append(b"\n".join(left).decode())
                    total.append(len(lines))
                    dropped.append(len(lines) - len(left))
                yield appended(
                    part.drop_columns(["__lost"]),
                    kept_text=pa.array(kept, pa.string()), n_lines=pa.array(total, pa.int64()), n_dropped=pa.array(dropped, pa.int64()),
                )

    return joined.mapInArrow(run, docs.selectExpr("*", "'' as kept_text", "0L as n_lines", "0L as n_dropped").schema)


def dedup_lines(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
    shard_keys: int = SHARD_KEYS,
) -> DataFrame:
    """The documents with kept_text, n_lines and n_dropped."""
    if min_docs > 65535:
        raise ValueError("counts saturate at 65535")
    check_whole_ids(docs, id_column)
    docs = without(docs, *OUTPUTS)
    found = keys(docs.select(F.col(id_column).alias("__id"), F.col(text).alias("__text")), min_chars).distinct()
    found = materialize(found, "line-keys")
    rows = found.count()
    counted = found.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("__id").alias("owner"))
    shards = max(1, -(-rows // shard_keys))
    arrays = materialize(index(counted, shards), "line-index")
    share = max(1, -(-rows // partitions(docs.sparkSession)))
    return rewrite(docs, probe(found, arrays, shards, share, min_docs), id_column, text, min_chars)


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"))


#: Lines and keys as in the contract; DuckDB's lower() would also fold other letters.
OP3_SQL = r"""
WITH doc AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT doc_id, pos, lines[pos] AS line FROM doc, unnest(range(1, len(lines) + 1)) AS u(pos)),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line),
gone AS (SELECT k, max(doc_id) AS owner FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(owner) FILTER (doc_id <> owner) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (owner IS NULL OR doc_id = owner), '')) AS kept_sha256
FROM keyed LEFT JOIN gone USING (k) GROUP BY doc_id
"""
