"""Exact substring deduplication by fixed-block anchors.

A window of 20 words always holds a whole block of 10 words that starts at a multiple of 10 in its
document. So the reference index holds the hashes of those non-overlapping blocks only, one for every
ten words, and every rolling window of 10 words probes it: of two equal 20-word windows each holds an
anchor that the other hits.

1. A slice of documents settles the blocks that repeat inside it: where one of them is an anchor, all are hits and
   none needs a probe, and every distinct anchor is sent once. So a passage in a third of all documents sends a row a
   slice to its shard, not a row a document. The other anchors and probes go to shards as packed arrays (four bytes of
   hash and two of position a probe), many to a row; a shard answers with the positions that hit an anchor other than
   their own. There are as many shards as keep their anchors below ``SHARD_ANCHORS``, so that chance hits of the four
   bytes stay below one in 250 probes at any size.
2. Hits are extended: all 20-word windows around a hit get a 128-bit hash, two polynomials of the 64-bit hashes of
   their words; equal hashes count as equal words and are not compared again. Of equal windows the first
   (smaller doc_id, then earlier start) stays; the others are lost. A batch of documents settles its own
   repeats first and sends each window once, so a passage in a third of all documents stays small.
3. Lost windows, joined up to maximal repeats, return to their documents and their words are removed.

Defined results: ids are whole numbers (others raise TypeError); null or wordless text has 0 words and the digest of the empty text; texts of fewer than
20 words lose nothing; rows that repeat a doc_id and its text get the same result, and of rows that share
a doc_id windows are ordered by start; a null doc_id comes after all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import appended, byte_slices, check_whole_ids, materialize, partitions, table, without

WINDOW = 20
BLOCK = WINDOW // 2
P = 0x9E3779B97F4A7C15
Q = 0xC2B2AE3D27D4EB4F
#: Words of a batch of documents at least, and probes of a row on average.
SLICE_WORDS = 1 << 17
ROW_PROBES = 256
MOST_SLICE_WORDS = 1 << 21
#: Anchors of a shard, and bytes of text that make one (ten words).
SHARD_ANCHORS = 1 << 24
ANCHOR_BYTES = 50
REMEMBERED = 200_000
LAST = (1 << 63) - 1
OUTPUTS = ("kept_text", "n_words", "n_removed")


class Hashes(dict):
    """Word to its 64-bit hash; a full memory starts anew."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxh3_64_intdigest(word)
        return h


def mixed(x):
    import numpy as np

    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rolling(h, size: int, factor: int):
    """Polynomial of each run of ``size`` word hashes, modulo 2**64."""
    import numpy as np

    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, size):
        out *= np.uint64(factor)
        out += h[j : n + j]
    return out


class Slice:
    """Some documents laid end to end: word hashes, document starts, and each word's place."""

    def __init__(self, texts, known: Hashes):
        import numpy as np

        words = [(t or b"").split() for t in texts]
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.cumsum(self.size) - self.size
        n = int(self.size.sum())
        self.hash = np.fromiter((known[w] for own in words for w in own), np.uint64, n)
        self.doc = np.repeat(np.arange(len(words)), self.size)
        self.place = np.arange(n) - self.start[self.doc]
        self.left = self.size[self.doc] - self.place

    def tens(self):
        """(index, hash, is an anchor) of the rolling blocks in documents that have a window."""
        import numpy as np

        r = mixed(rolling(self.hash, BLOCK, P))
        n = len(r)
        at = np.flatnonzero((self.left[:n] >= BLOCK) & (self.size[self.doc[:n]] >= WINDOW))
        return at, r[at], self.place[at] % BLOCK == 0


def slices(batches, words: int, column: str = "__text"):
    """(rows, texts) with about as many words together, in the order that they come."""
    import pyarrow as pa

    rows, texts, size = [], [], 0
    for batch in batches:
        for part, own in byte_slices(batch, column, 64):
            rows.append(part)
            texts += own
            size += sum(len(t or b"") for t in own)
            if size >= 6 * words:
                yield pa.Table.from_batches(rows).combine_chunks(), texts
                rows, texts, size = [], [], 0
    if rows:
        yield pa.Table.from_batches(rows).combine_chunks(), texts


def packed_places(at):
    """Ascending positions as counts for each 65536 and their low halves."""
    import numpy as np

    counts = np.bincount(at >> 16).astype("<u4")
    return np.array([len(counts)], "<u4").tobytes() + counts.tobytes() + (at & 65535).astype("<u2").tobytes()


def unpacked_places(data: bytes):
    import numpy as np

    n = int(np.frombuffer(data, "<u4", 1)[0])
    counts = np.frombuffer(data, "<u4", n, 4)
    return (np.repeat(np.arange(n), counts) << 16) + np.frombuffer(data, "<u2", -1, 4 + 4 * n)


ROW = "shard int, kind int, slice binary, a binary, b binary"
ANCHORS, PROBES, DOCS, LOCAL = range(4)


def own_repeats(r, anchor):
    """Indices of the blocks that must probe, of those that hit an anchor in their own slice, and of an anchor of each hash.

    r, anchor: hash of each block and whether it is an anchor.
    """
    import numpy as np

    if not len(r):
        return (np.empty(0, np.int64),) * 3
    order = np.lexsort((~anchor, r))  # an anchor comes first among its equals
    new = np.ones(len(r), bool)
    new[1:] = r[order][1:] != r[order][:-1]
    first = np.flatnonzero(new)
    size = np.diff([*first, len(r)])
    settled = np.repeat((size > 1) & anchor[order[first]], size)
    return np.sort(order[~settled]), np.sort(order[settled]), np.sort(order[first][anchor[order[first]]])


def by_shard(r, shards: int):
    """(shard, indices in ascending order) of hashes."""
    import numpy as np

    shard = ((r >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)
    order = np.argsort(shard, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
        if len(own):
            yield int(shard[own[0]]), own


def sent(docs: DataFrame, shards: int) -> DataFrame:
    """Anchors, probes and the documents of each slice. docs: __doc, __key, __text."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        known = Hashes()
        with np.errstate(over="ignore"):
            for rows, texts in slices(batches, min(MOST_SLICE_WORDS, max(SLICE_WORDS, ROW_PROBES * shards))):
                some = Slice(texts, known)
                ids = np.stack([rows.column(i).to_numpy() for i in range(2)], axis=1).astype("<i8")
                name = xxh3_128_digest(ids.tobytes() + some.hash.tobytes())
                at, r, anchor = some.tens()
                home = int.from_bytes(name[:4], "little") % shards
                out = [(home, DOCS, name, ids.tobytes(), some.size.astype("<i8").tobytes())]
                sole, settled, anchors = own_repeats(r, anchor)
                if len(settled):
                    out.append((home, LOCAL, name, at[settled].astype("<u4").tobytes(), b""))
                for s, own in by_shard(r[anchors], shards):
                    out.append((s, ANCHORS, name, r[anchors][own].astype("<u4").tobytes(), b""))
                at, anchor, r = at[sole], anchor[sole], r[sole]
                for s, own in by_shard(r, shards):
                    out.append((s, PROBES, name, r[own].astype("<u4").tobytes(), np.packbits(anchor[own]).tobytes() + packed_places(at[own])))
                kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["shard", "kind", "slice", "a", "b"]
                )

    return docs.mapInArrow(run, ROW)


def answered(rows: DataFrame) -> DataFrame:
    """(slice, kind, a, b): hit positions of each slice, and its documents."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        shard, held, index, several, bitmap = None, [], None, None, np.zeros(1 << 24, bool)
        for batch in batches:
            out = []
            for s, kind, name, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if s != shard:
                    shard, held, index = s, [], None
                if kind >= DOCS:
                    out.append((name, kind - DOCS, a, b))
                    continue
                low = np.frombuffer(a, "<u4")
                if kind == ANCHORS:
                    held.append(low)
                    continue
                if index is None:
                    index, count = np.unique(np.concatenate(held) if held else low[:0], return_counts=True)
                    held, several = [], count > 1
                    bitmap[:] = False
                    bitmap[index >> 8] = True
                may = np.flatnonzero(bitmap[low >> 8])
                if not len(may):
                    continue
                at = np.minimum(np.searchsorted(index, low[may]), len(index) - 1)
                n = -(-len(low) // 8)
                own = np.unpackbits(np.frombuffer(b, np.uint8, n), count=len(low)).astype(bool)[may]
                hit = may[(index[at] == low[may]) & (~own | several[at])]
                if len(hit):
                    out.append((name, 1, unpacked_places(b[n:])[hit].astype("<u4").tobytes(), b""))
            if out:
                kinds = (pa.binary(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["slice", "kind", "a", "b"])

    return rows.mapInArrow(run, "slice binary, kind int, a binary, b binary")


def grouped(doc, key, at):
    """Rows (doc, key, positions) of an Arrow batch from arrays sorted by doc and key."""
    import numpy as np
    import pyarrow as pa

    cut = np.flatnonzero((doc[1:] != doc[:-1]) | (key[1:] != key[:-1])) + 1
    lo = np.concatenate([[0], cut]).astype(np.int64) if len(doc) else np.empty(0, np.int64)
    ends = pa.array(np.concatenate([lo, [len(doc)]]).astype(np.int32))
    lists = pa.ListArray.from_arrays(ends, pa.array(at.astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(doc[lo]), pa.array(key[lo]), lists], names=["__doc", "__key", "at"])


def by_document(answers: DataFrame) -> DataFrame:
    """(__doc, __key, at): hit positions within each document."""

    def run(batches):
        import numpy as np

        name, ids, start = None, None, None
        for batch in batches:
            docs, keys, places = [], [], []
            for s, kind, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    name, ids = s, np.frombuffer(a, "<i8").reshape(-1, 2)
                    size = np.frombuffer(b, "<i8")
                    start = np.cumsum(size) - size
                    continue
                assert s == name, "hits of a slice without its documents"
                at = np.sort(np.frombuffer(a, "<u4").astype(np.int64))
                doc = np.searchsorted(start, at, "right") - 1
                docs.append(ids[doc, 0])
                keys.append(ids[doc, 1])
                places.append(at - start[doc])
            if docs:
                doc, key, at = (np.concatenate(x) for x in (docs, keys, places))
                order = np.lexsort((at, key, doc))
                yield grouped(doc[order], key[order], at[order])

    return answers.mapInArrow(run, "__doc long, __key long, at array<int>")


#: A window (at), or all windows of a document that its batch has before (many, packed).
WINDOWS = "h long, g long, __doc long, __key long, at int, many binary"


def windows(docs: DataFrame) -> DataFrame:
    """Windows around hits: those that this batch has before are lost; of the others one each. docs: + hits."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        known = Hashes()
        with np.errstate(over="ignore"):
            for rows, texts in slices(batches, SLICE_WORDS):
                some = Slice(texts, known)
                lists = rows.column("hits")
                lists = lists.chunk(0) if lists.num_chunks else None
                if lists is None or not len(some.hash):
                    continue
                inner = lists.flatten()
                count = np.diff(lists.offsets.to_numpy())
                places = inner.flatten().to_numpy().astype(np.int64)
                each = np.diff(inner.offsets.to_numpy())[: len(inner)]
                doc = np.repeat(np.repeat(np.arange(len(count)), count), each)
                hit = places + some.start[doc]
                # Starts p - 10 .. p of each hit p, as far as they lie in its document.
                n = len(some.hash)
                mark = np.zeros(n + 1, np.int64)
                np.add.at(mark, np.maximum(hit - BLOCK, some.start[doc]), 1)
                np.add.at(mark, hit + 1, -1)
                at = np.flatnonzero((np.cumsum(mark)[:n] > 0) & (some.left >= WINDOW))
                if not len(at):
                    continue
                both = []
                for factor in (P, Q):
                    r = rolling(some.hash, BLOCK, factor)
                    power = np.uint64(pow(factor, BLOCK, 1 << 64))
                    both.append(mixed(r[at] * power + r[at + BLOCK]))
                h, g = both
                owner, key = (rows.column(i).to_numpy()[some.doc[at]] for i in (0, 1))
                place = some.place[at]
                order = np.lexsort((place, owner, g, h))
                h, g, owner, key, place = (x[order] for x in (h, g, owner, key, place))
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
                first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
                lost = (owner != owner[first]) | (place != place[first])
                stays = new & ~lost
                columns = [x[stays] for x in (h.view(np.int64), g.view(np.int64), owner, key, place.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, columns), pa.nulls(int(stays.sum()), pa.binary())], names=["h", "g", "__doc", "__key", "at", "many"]
                )
                if lost.any():
                    owner, key, place = owner[lost], key[lost], place[lost]
                    order = np.lexsort((place, key, owner))
                    owner, key, place = owner[order], key[order], place[order].astype("<i4")
                    cut = np.flatnonzero((owner[1:] != owner[:-1]) | (key[1:] != key[:-1])) + 1
                    lo = np.concatenate([[0], cut])
                    # They need no partner: a hash of their own spreads them.
                    own = mixed(key[lo].view(np.uint64) + np.arange(len(lo), dtype=np.uint64)).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(own), pa.array(own ^ owner[lo]), pa.array(owner[lo]), pa.array(key[lo]), pa.array(np.zeros(len(lo), np.int32)),
                            pa.array([x.tobytes() for x in np.split(place, cut)], pa.binary()),
                        ],
                        names=["h", "g", "__doc", "__key", "at", "many"],
                    )

    return docs.mapInArrow(run, WINDOWS)


def losers(found: DataFrame) -> DataFrame:
    """(__doc, __key, many) of lost windows. found: sorted by h, g, __doc, at within partitions."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            h, g, doc, key, at = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:5])
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
            if last is not None and (h[0], g[0]) == last[:2]:
                new[0] = False
            first = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
            own_doc, own_at = doc[first], at[first].astype(np.int64)
            if last is not None:
                own_doc, own_at = np.where(first < 0, last[2], own_doc), np.where(first < 0, last[3], own_at)
            gone = (doc != own_doc) | (at != own_at)
            last = (h[-1], g[-1], own_doc[-1], own_at[-1])
            many = batch.column(5)
            packed = batch.filter(many.is_valid()).select([2, 3, 5])
            if packed.num_rows:
                yield packed
            if gone.any():
                n, data = int(gone.sum()), at[gone].astype("<i4")
                ends = pa.py_buffer(np.arange(0, 4 * n + 1, 4, dtype=np.int32))
                each = pa.Array.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([pa.array(doc[gone]), pa.array(key[gone]), each], names=["__doc", "__key", "many"])

    return found.mapInArrow(run, "__doc long, __key long, many binary")


def without_windows(docs: DataFrame, lost: DataFrame, text: str) -> DataFrame:
    """docs (+ __doc, __key) with kept_text, n_words, n_removed."""
    lost = lost.groupBy("__doc", "__key").agg(F.collect_list("many").alias("__lost"))
    joined = docs.join(lost, ["__doc", "__key"], "left").select(*docs.columns, "__lost")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part, texts in byte_slices(batch, text):
                gone = part.column(part.schema.get_field_index("__lost"))
                kept, total, removed = [], [], []
                for i, data in enumerate(texts):
                    words = (data or b"").split()
                    packed = gone[i].as_py()
                    cut = 0
                    if packed and words:
                        at = np.frombuffer(b"".join(packed), "<i4")
                        mark = np.zeros(len(words) + 1, np.int64)
                        np.add.at(mark, at, 1)
                        np.add.at(mark, at + WINDOW, -1)
                        stays = np.cumsum(mark)[:-1] == 0
                        cut = len(words) - int(stays.sum())
                        total.append(len(words))
                        words = [words[k] for k in np.flatnonzero(stays)]
                    else:
                        total.append(len(words))
                    removed.append(cut)
                    kept.append(b" ".join(words).decode())
                yield appended(
                    part.drop_columns(["__doc", "__key", "__lost"]),
                    kept_text=pa.array(kept, pa.string()), n_words=pa.array(total, pa.int64()), n_removed=pa.array(removed, pa.int64()),
                )

    schema = docs.drop("__doc", "__key").selectExpr("*", "'' as kept_text", "0L as n_words", "0L as n_removed").schema
    return joined.mapInArrow(run, schema)


def dedup_substrings(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with kept_text, n_words and n_removed. Reads docs three times, in a fixed order."""
    spark = docs.sparkSession
    check_whole_ids(docs, id_column)
    docs = without(docs, *OUTPUTS, "__doc", "__key", "__lost")
    docs = docs.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(LAST)).alias("__doc"), F.xxhash64(text).alias("__key"), *docs.columns
    )
    slim = docs.select("__doc", "__key", F.col(text).alias("__text")).where("__text is not null")
    parts = partitions(spark)
    text_bytes = slim.agg(F.coalesce(F.sum(F.octet_length("__text")), F.lit(0))).first()[0]
    shards = parts * max(1, -(-text_bytes // (ANCHOR_BYTES * SHARD_ANCHORS * parts)))
    deal = getattr(DataFrame, "repartitionById", None)
    rows = sent(slim, shards)
    rows = rows.repartitionById(shards, "shard") if deal else rows.repartition(shards, "shard")
    answers = answered(rows.sortWithinPartitions("shard", "kind"))
    answers = answers.repartition(parts, "slice").sortWithinPartitions("slice", "kind")
    hits = materialize(by_document(answers), "substring-hits")
    hits = hits.groupBy("__doc", "__key").agg(F.collect_list("at").alias("hits"))
    near = slim.join(hits, ["__doc", "__key"]).select("__doc", "__key", "__text", "hits")
    found = windows(near).repartition(parts, "h", "g").sortWithinPartitions("h", "g", "__doc", "at")
    lost = materialize(losers(found), "substring-lost")
    return without_windows(docs, lost, text)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, i, sha256(array_to_string(list_slice(w, i, i + 19), ' ')) AS h FROM d, unnest(range(1, len(w) - 18)) AS u(i)),
lost AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM win) AS x WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM lost, unnest(range(0, 20)) AS u(o)),
word AS (SELECT doc_id, i, w[i] AS x FROM d, unnest(range(1, len(w) + 1)) AS u(i)),
kept AS (SELECT word.doc_id, count(gone.i) AS removed, string_agg(x, ' ' ORDER BY word.i) FILTER (gone.i IS NULL) AS t
  FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.i = gone.i GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
