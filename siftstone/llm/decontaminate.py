"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared after folding: Unicode lower case, runs of white space as one space. An item of m
folded code points may differ in k = m // ``CHARS_PER_ERROR`` edits (insert, delete, replace one). Cut
into k + 1 pieces, some piece stands unchanged in every passage within k edits. The pieces are indexed by a 64-bit
polynomial hash, a sorted array for each length (pieces have few lengths, as they are cut as equal as can be), behind a
bitmap. A document is read once: its rolling hashes of every length grow from one another, one array operation a
length, and probe the index; a bit-parallel column update (Myers, in Sellers' search form) then measures the smallest
distance between the item and any passage around each place that hits.

The index takes some 16 bytes a piece besides the items' texts, and the cost of a probe hardly depends on its size, so
one broadcast holds ``BLOCK_CHARS`` folded code points of items. A larger benchmark is sent in several of them.

Defined results: null or blank texts and items match nothing; an item of fewer than ``border_chars`` code points (a
parameter, CHARS_PER_ERROR by default: the items that allow no edit) must stand within word borders, longer ones may
start and end anywhere; repeated rows give repeated hits, repeated items are searched once per item row; a null id is
carried as it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import table

CHARS_PER_ERROR = 12
BLOCK_CHARS = 1 << 25
#: Code points that are hashed at once, and items whose masks a worker remembers.
CHUNK = 1 << 20
REMEMBERED = 5000
P = 0x9E3779B97F4A7C15
OUTPUTS = ("item_id", "distance", "found_end")


def folded(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def cut(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces with their offsets, as equal as can be."""
    n = len(item)
    edge = [n * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(edge, edge[1:])]


def nearest(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Smallest edit distance of a pattern to any substring of text, and the end of the first such.

    masks: for each character the positions of the pattern that hold it, as bits.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for at, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | (full & ~(xh | up))
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score < best:
            best, end = score, at
        ph = ph << 1 & full
        mh = mh << 1 & full
        up = mh | (full & ~(xv | ph))
        down = ph & xv
    return best, end


def mixed(x):
    """Spreads polynomial hashes over all bits."""
    import numpy as np

    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def code_points(text: str):
    import numpy as np

    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def rolling(codes, lengths):
    """(length, hash of every run of that many code points), shortest first."""
    import numpy as np

    h = np.zeros(len(codes), np.uint64)
    for n in range(1, max(lengths, default=0) + 1):
        if len(codes) < n:
            return
        with np.errstate(over="ignore"):
            h = h[: len(codes) - n + 1] * np.uint64(P) + codes[n - 1 :]
            if n in lengths:
                yield n, mixed(h)


class Pieces:
    """The index of a block of items [(item_id, folded text)]; plain arrays, made once and sent to the executors."""

    def __init__(self, items, chars_per_error: int = CHARS_PER_ERROR, border_chars: int | None = None):
        import numpy as np

        self.items = items
        self.errors = [len(text) // chars_per_error for _, text in items]
        self.border_chars = chars_per_error if border_chars is None else border_chars
        places: dict[int, list] = {}
        for i, (_, text) in enumerate(items):
            for offset, piece in cut(text, self.errors[i]):
                places.setdefault(len(piece), []).append((piece, i, offset))
        #: length: sorted hashes, and the item and offset of each.
        self.index = {}
        for n, own in places.items():
            joined = code_points("".join(x for x, _, _ in own))
            h = next(hashes for _, hashes in rolling(joined, {n}))[::n]
            order = np.argsort(h, kind="stable")
            self.index[n] = h[order], np.array([x for _, x, _ in own], np.int32)[order], np.array([x for _, _, x in own], np.int32)[order]
        self.bits = min(30, max(16, (64 * sum(len(h) for h, _, _ in self.index.values())).bit_length()))
        self.bitmap = np.zeros(1 << self.bits - 3, np.uint8)
        for h, _, _ in self.index.values():
            at = h >> np.uint64(64 - self.bits)
            np.bitwise_or.at(self.bitmap, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def places(self, codes):
        """(position, length, item, offset) of every piece that stands in codes, as arrays, by length."""
        import numpy as np

        for n, hashes in rolling(codes, self.index.keys()):
            at = hashes >> np.uint64(64 - self.bits)
            may = np.flatnonzero(self.bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
            known, item, offset = self.index[n]
            low, high = (np.searchsorted(known, hashes[may], side) for side in ("left", "right"))
            count = high - low
            where = np.repeat(may, count)
            entry = np.repeat(low - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
            yield where, item[entry], offset[entry]


class Matcher:
    """Searches texts for the items of an index."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.masks = pieces, {}

    def mask(self, i: int) -> dict[str, int]:
        """For each character of an item its positions, as bits."""
        if (own := self.masks.get(i)) is None:
            if len(self.masks) >= REMEMBERED:
                self.masks.clear()
            own = self.masks[i] = {}
            for at, c in enumerate(self.pieces.items[i][1]):
                own[c] = own.get(c, 0) | 1 << at
        return own

    def windows(self, joined: str, starts, ends):
        """(text, item, low, high) sorted: where an item may stand. Texts are parts of joined, a sign between them."""
        import numpy as np

        codes = code_points(joined)
        found, longest = [], max(self.pieces.index, default=1)
        for begin in range(0, len(codes), CHUNK):
            some = codes[begin : begin + CHUNK + longest - 1]
            for where, item, offset in self.pieces.places(some):
                if len(where):
                    found.append((where + begin, item, offset))
        if not found:
            return []
        where, item, offset = (np.concatenate(x).astype(np.int64) for x in zip(*found))
        text = np.searchsorted(starts, where, "right") - 1
        size, errors = (np.array(x, np.int64) for x in ([len(t) for _, t in self.pieces.items], self.pieces.errors))
        low = np.maximum(starts[text], where - offset - errors[item])
        high = np.minimum(ends[text], where - offset + size[item] + errors[item])
        order = np.lexsort((high, low, item, text))
        text, item, low, high = (x[order] for x in (text, item, low, high))
        # Windows of one text and item that touch are one, up to the largest end so far.
        group = np.concatenate([[0], np.cumsum((text[1:] != text[:-1]) | (item[1:] != item[:-1]))])
        reach = np.maximum.accumulate(high + group * (len(codes) + 1)) - group * (len(codes) + 1)
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (low[1:] > reach[:-1])])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(new)]]) - 1
        return np.stack([text[first], item[first], low[first], reach[last]], axis=1).tolist()

    def hits(self, texts: list[str], one_each: bool = False):
        """(text, item, distance, end) of every text and item with a passage within its errors; of the nearest the first.

        one_each: only the first item that is found in a text.
        """
        import numpy as np

        joined = "\n".join(texts)  # folded texts and items hold no line break
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(size + 1) - size - 1
        held, best = None, (0, 0)

        def result():
            if held is not None and best[0] <= self.pieces.errors[held[1]]:
                yield (*held, best[0], best[1] - int(starts[held[0]]))

        done = -1
        for text, i, low, high in self.windows(joined, starts, starts + size):
            if (text, i) != held:
                for hit in result():
                    yield hit
                    done = hit[0]
                held, best = (text, i), (self.pieces.errors[i] + 1, 0)
            if not best[0] or one_each and done == text:
                continue
            item = self.pieces.items[i][1]
            if self.pieces.errors[i]:
                d, end = nearest(self.mask(i), len(item), joined[low:high])
                best = min(best, (d, low + end))
            elif at := self.alone(joined, item, low, high):
                best = min(best, (0, at))
        if not (one_each and held is not None and done == held[0]):
            yield from result()

    def alone(self, text: str, item: str, low: int, high: int) -> int:
        """End of the first unchanged occurrence, within word borders if the item is short; 0 if there is none."""
        at = text.find(item, low, high)
        while at >= 0:
            end = at + len(item)
            if len(item) >= self.pieces.border_chars or (not at or not text[at - 1].isalnum()) and (end == len(text) or not text[end].isalnum()):
                return end
            at = text.find(item, at + 1, high)
        return 0


def slices(texts):
    """(first, texts folded) with about CHUNK code points together; a longer text alone."""
    held, size, first = [], 0, 0
    for i in range(len(texts)):
        one = folded(texts[i].as_py())
        if held and size + len(one) > CHUNK:
            yield first, held
            held, size, first = [], 0, i
        held.append(one)
        size += len(one)
    if held:
        yield first, held


def blocks(benchmark: DataFrame, item_id: str, text: str, block_chars: int):
    """The items in blocks of bounded size, streamed through the driver one block at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).toLocalIterator():
        item = folded(row.t)
        if not item:
            continue
        if block and size + len(item) > block_chars:
            yield block
            block, size = [], 0
        block.append((row.i, item))
        size += len(item)
    if block:
        yield block


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    chars_per_error: int = CHARS_PER_ERROR,
    block_chars: int = BLOCK_CHARS,
    border_chars: int | None = None,
) -> DataFrame:
    """(id, item_id, distance, found_end): documents that hold a passage of an item within its errors.

    found_end is the end of the best passage in the folded document.
    """
    spark = docs.sparkSession
    kind, item_kind = (dict(d.dtypes)[c] for d, c in ((docs, id_column), (benchmark, item_id)))
    rows = docs.select(F.col(id_column).alias("__id"), F.col(text).alias("__text")).where("__text is not null")
    schema = f"__id {kind}, __item {item_kind}, distance int, found_end long"
    found = [spark.createDataFrame([], schema)]
    for block in blocks(benchmark, item_id, item_text, block_chars):
        sent = spark.sparkContext.broadcast(Pieces(block, chars_per_error, border_chars))  # block_chars bound it

        def run(batches, sent=sent):
            import pyarrow as pa

            matcher, items = Matcher(sent.value), sent.value.items
            out_type = pa.array([x for x, _ in items]).type
            for batch in batches:
                for first, texts in slices(batch.column(1)):
                    got = list(matcher.hits(texts))
                    if not got:
                        continue
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array([first + at for at, _, _, _ in got])),
                            pa.array([items[i][0] for _, i, _, _ in got], out_type),
                            pa.array([d for _, _, d, _ in got], pa.int32()),
                            pa.array([e for _, _, _, e in got], pa.int64()),
                        ],
                        names=["__id", "__item", "distance", "found_end"],
                    )

        found.append(rows.mapInArrow(run, schema))
    out = reduce(DataFrame.union, found)
    return out.withColumnsRenamed({"__id": id_column, "__item": item_id})


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", chars_per_error: int = CHARS_PER_ERROR, block_chars: int = BLOCK_CHARS, border_chars: int | None = None) -> DataFrame:
    """The documents without those that hold a passage of an item; one pass per block, no shuffle."""
    at = docs.columns.index(text)
    for block in blocks(benchmark, item_id, item_text, block_chars):
        sent = docs.sparkSession.sparkContext.broadcast(Pieces(block, chars_per_error, border_chars))  # block_chars bound it

        def run(batches, sent=sent):
            import numpy as np
            import pyarrow as pa

            matcher = Matcher(sent.value)
            for batch in batches:
                stays = np.ones(batch.num_rows, bool)
                for first, texts in slices(batch.column(at)):
                    stays[[first + hit[0] for hit in matcher.hits(texts, one_each=True)]] = False
                yield batch.filter(pa.array(stays))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
