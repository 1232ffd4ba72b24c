"""Toxicity by noisy-channel deobfuscation.

1. Language model: four-grams of characters of all texts (letters folded to a-z, other letters to one
   sign, all else to a border), counted per task and summed in Spark; the table has 28**4 cells at most.
2. Channel: a written sign may stand for its letter, a look-alike digit or sign for one of several letters,
   a sign between letters for nothing, a run of one letter for one or two of it; in a run of pieces of one
   or two signs a space is nothing or a border. Viterbi search over this lattice under the language model
   restores a word, with every context of three letters kept.
   A plain word has one path only and needs no search; restored words are remembered.
3. Score: each distinct restored word gives hashed features (itself, and its beginnings of three to seven
   bytes); a logistic regression learned by follow-the-regularised-leader adds up their weights.

Words are read and weighed a slice of documents at a time: plain ones all at once, the others by search.

The classifier learns from about ``SAMPLE_ROWS`` labelled documents and ``learning.SAMPLE_BYTES`` of examples at most; the
language model covers every text and all documents are scored whole. Rates and epochs were chosen on the rows of
remainder 1 after learning from remainders 2 to 4.

Defined results: null or wordless text scores the constant; a null doc_id counts as held out; without any
labelled row every score is 0.5; repeated rows are scored each.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache
from itertools import compress
from math import fsum
from operator import not_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import appended, byte_slices, table, without
from siftstone.llm.learning import fit, held_out, labelled_sample

SAMPLE_ROWS = 10000
SIZE = 1 << 18
EPOCHS = 8
THRESHOLD = 0.5
REMEMBERED = 150_000
SYMBOLS = 28
OTHER = 27
#: Look-alikes and the letters that they may stand for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "tl", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "¢": "c",
}
#: Costs in nats: reading a look-alike, dropping a sign, reading a run as one letter or as two.
LOOK_COST, DROP_COST, RUN_COST = 1.0, 1.5, 0.5
#: Dropping a sign that looks like a letter.
DROP_LOOK_COST = 6.0
#: Dropping a look-alike at a word's edge: one that is a punctuation mark, or another sign.
END_COST, EDGE_COST = 0.5, 3.0
#: A space between short pieces: nothing, or a border.
SPACE = [("", 1.0), (" ", 0.0)]
#: The longest piece in which a word may be spelled out, and the fewest signs of a run of pieces.
SHORT, MIN_SPELLED = 2, 3
BEGINNINGS = range(3, 8)
CONSTANT = 0
OUTPUTS = ("held_out", "score", "predicted")
EDGE = " \t\n\r\x0b\x0c.,;:?\"'`)[]{}*#%&~^_-=/\\>…“”‘’«»¿"
#: Look-alikes that are no digits, and those of them that are punctuation marks.
SIGNS, MARKS = "".join(c for c in LOOKS if not c.isdigit()), "!(<¡"
RUNS = re.compile(r"(.)\1*", re.S).finditer
THRICE = re.compile(r"(.)\1\1").search
TWICE = re.compile(r"(.)\1+", re.S)
#: The running hash, and the longest word in bytes that is hashed together with others.
SEED, PRIME, GOLDEN, MASK, WIDE = 0xCBF29CE484222325, 0x100000001B3, 0x9E3779B97F4A7C15, (1 << 64) - 1, 64


def codes():
    """Byte to symbol: 1-26 letters, 27 any byte of another letter, 0 border."""
    import numpy as np

    out = np.zeros(256, np.uint8)
    for i in range(26):
        out[97 + i] = out[65 + i] = i + 1
    out[128:] = OTHER
    return out


def grams(data: bytes, of):
    """Indices of the four-grams of a text, with borders at both ends; runs of borders and the bytes
    of one letter outside ASCII count once."""
    import numpy as np

    s = of[np.frombuffer(b" " + data + b" ", np.uint8)]
    again = np.zeros(len(s), bool)
    np.equal(s[1:], s[:-1], out=again[1:])
    again &= (s == 0) | (s == OTHER)
    s = s[~again].astype(np.int32)
    two = s[:-1] * SYMBOLS + s[1:]
    return two[:-2] * SYMBOLS**2 + two[2:]


def count_grams(docs: DataFrame, text: str) -> DataFrame:
    """(gram, n) over all texts."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        of, total = codes(), np.zeros(SYMBOLS**4, np.int64)
        for batch in batches:
            for _, texts in byte_slices(batch, "__text"):
                joined = b" ".join(t for t in texts if t)
                if joined:
                    total += np.bincount(grams(joined, of), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])

    rows = docs.select(F.col(text).alias("__text"))
    return rows.mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def costs(counted: list) -> bytes:
    """-log p(d | a b c), mixed over shorter contexts, as float32 for each four-gram."""
    import numpy as np

    four = np.zeros(SYMBOLS**4)
    for gram, n in counted:
        four[gram] = n
    four = four.reshape((SYMBOLS,) * 4)
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for axes in ((0, 1, 2), (0, 1), (0,), ()):
        n = four.sum(axis=axes) if axes else four
        p = (n + 8.0 * p) / (n.sum(axis=-1, keepdims=True) + 8.0)
    return (-np.log(p)).astype("<f4").tobytes()


def folded(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


@cache
def combining():
    """For each code point whether it is a combining mark."""
    import numpy as np

    return np.fromiter((unicodedata.combining(chr(i)) > 0 for i in range(0x110000)), bool, 0x110000)


def folded_lines(lines: list[str]) -> tuple[list[str], list[str]]:
    """Many words folded at once, and the same with each run of a sign written once."""
    import numpy as np

    text = "\n".join(lines).lower()
    if not text.isascii():
        text = unicodedata.normalize("NFD", text)
    signs_ = np.frombuffer(text.encode("utf-32-le"), "<u4")
    if not text.isascii():
        signs_ = signs_[~combining()[signs_]]
        text = signs_.tobytes().decode("utf-32-le")
    new = np.ones(len(signs_), bool)
    np.not_equal(signs_[1:], signs_[:-1], out=new[1:])
    once = signs_[new | (signs_ == 10)].tobytes().decode("utf-32-le")
    return text.split("\n"), once.split("\n")


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else OTHER


class Symbols(dict):
    """Letter to symbol; a space is a border."""

    def __missing__(self, c: str) -> int:
        return symbol(c)


SYMBOL = Symbols({" ": 0} | {chr(97 + i): 1 + i for i in range(26)})


def plain(word: str) -> bool:
    """A word with one path: letters only, none three times in a row."""
    return word.isalpha() and not THRICE(word)


def signs(word: str):
    """The readings of each run of a folded word: (letters, cost)."""
    ahead = len(word) - len(word.lstrip(SIGNS))
    behind = len(word.rstrip(SIGNS))
    for m in RUNS(word):
        c, n = m.group(1), m.end() - m.start()
        if c.isalpha():
            yield [(c, 0.0)] if n == 1 else [(c, 0.0 if n > 2 else RUN_COST), (c * 2, 0.0 if n == 2 else RUN_COST)]
            continue
        readings = [(x * k, LOOK_COST + (RUN_COST if n > 2 or k != n else 0.0)) for x in LOOKS.get(c, "") for k in {1, min(n, 2)}]
        if m.end() <= ahead or m.start() >= behind:
            readings.append(("", END_COST if c in MARKS else EDGE_COST))
        else:
            readings.append(("", DROP_LOOK_COST if c in LOOKS or c.isdigit() else DROP_COST))
        yield readings


def cheapest(lattice, cost) -> str:
    """The cheapest path; every context of three letters is kept. A space is a border."""
    paths, of = {(0, 0, 0): (0.0, None)}, SYMBOL
    for readings in lattice:
        new: dict = {}
        for (a, b, d), (so_far, read) in paths.items():
            for letters, extra in readings:
                total, x, y, z = so_far + extra, a, b, d
                for letter in letters:
                    s = of[letter]
                    total += cost[x][y][z][s]
                    x, y, z = y, z, s
                at = x, y, z
                if at not in new or total < new[at][0]:
                    new[at] = (total, (read, letters) if letters else read)
        paths = new
    _, read = min(((total + cost[a][b][d][0], read) for (a, b, d), (total, read) in paths.items()), key=lambda p: p[0])
    out = []
    while read:
        read, letters = read
        out.append(letters)
    return "".join(reversed(out))


def decode(word: str, cost) -> str:
    """The cheapest reading of a word. cost: table of four-grams."""
    word = folded(word)
    if plain(word) or not any(c.isalpha() or c in LOOKS for c in word):
        return word
    return cheapest(signs(word), cost)


def decode_run(run: str, cost) -> list[str]:
    """The words of short pieces, where a space is nothing or a border."""
    lattice = []
    for piece in folded(run).split():
        lattice += [SPACE, *signs(piece)] if lattice else signs(piece)
    return cheapest(lattice, cost).split()


def piece(raw: str) -> str:
    """The signs of a word without those of its edges if they are few enough to be a piece, else nothing."""
    core = raw.strip(EDGE)
    return core if len(core) <= SHORT and any(c.isalnum() or c in LOOKS for c in core) else ""


class Reader(dict):
    """Raw word, or pieces joined by spaces, to restored words, each run of a letter written once.

    pieces: the raw words that may be pieces of a spelled word, and their signs; alone: those of one sign.
    """

    def __init__(self, cost):
        self.cost, self.pieces, self.alone = cost, {}, set()

    def learn(self, raws: set[str]) -> None:
        """Reads all words that are not known yet, plain ones at once."""
        new = raws - self.keys()
        if len(self) + len(new) > REMEMBERED:
            for known in (self, self.pieces, self.alone):
                known.clear()
            new = raws
        new = list(new)
        cores = [w.strip(EDGE) for w in new]
        low, once = folded_lines(cores)
        easy = [c.isalpha() and (len(o) == len(c) or not THRICE(c)) for c, o in zip(low, once)]
        self.update(compress(zip(new, once), easy))
        for raw, core in compress(zip(new, cores), map(not_, easy)):
            self[raw] = TWICE.sub(r"\1", decode(core, self.cost).lower()) if core else ""
        for raw in compress(new, [len(c) <= SHORT for c in cores]):
            if short := piece(raw):
                self.pieces[raw] = short
                if len(short) == 1:
                    self.alone.add(raw)

    def __missing__(self, raw: str) -> str:
        if " " in raw:
            if len(self) >= REMEMBERED:
                return self.run(raw)
            self[raw] = out = self.run(raw)
            return out
        self.learn({raw})
        return self[raw]

    def run(self, raw: str) -> str:
        return " ".join(TWICE.sub(r"\1", w) for w in decode_run(raw, self.cost))


def spelled(words: list[str], alone: set[str], pieces: dict[str, str]):
    """Runs of short pieces that may spell words, joined by spaces."""
    upto = 0
    for i in [i for i, w in enumerate(words) if w in alone]:
        if i < upto:
            continue
        start = upto = i
        while start and words[start - 1] in pieces:
            start -= 1
        while upto < len(words) and words[upto] in pieces:
            upto += 1
        run = [pieces[w] for w in words[start:upto]]
        if len(run) > 1 and sum(map(len, run)) >= MIN_SPELLED:
            yield " ".join(run)


def restored_words(texts: list[str], read: Reader):
    """For each text the set of its distinct words, restored."""
    split = [t.split() for t in texts]
    distinct = [set(w) for w in split]
    read.learn(set().union(*distinct))
    for words, own in zip(split, distinct):
        found = set(map(read.__getitem__, own))
        alone = own & read.alone
        if alone:
            for run in spelled(words, alone, read.pieces):
                if any(map(str.isalpha, run)):
                    found.update(read[run].split())
        found.discard("")
        yield found


def restored(text: str, read: Reader) -> set[str]:
    return next(restored_words([text], read))


def features(word: str) -> list[int]:
    """Coordinates of the word and of its beginnings, from a running hash of its bytes."""
    data, h, own = word.encode(), SEED, []
    for n, byte in enumerate(data, 1):
        h = (h ^ byte) * PRIME & MASK
        if n in BEGINNINGS:
            own.append(h)
    own.append((h ^ 32) * PRIME & MASK)
    return [1 + (h * GOLDEN & MASK) // 2**40 % (SIZE - 1) for h in own]


def coordinates(words: list[str]):
    """The same for many words: a row each, the word's own last; 0 where there is no such beginning."""
    import numpy as np

    data = [w.encode() for w in words]
    out = np.zeros((len(data), len(BEGINNINGS) + 1), np.int64)
    size = np.fromiter(map(len, data), np.int64, len(data))
    for i in np.flatnonzero(size > WIDE).tolist():
        out[i, : len(BEGINNINGS)], out[i, -1] = (own := features(words[i]))[:-1], own[-1]
    short = np.flatnonzero((size <= WIDE) & (size > 0))
    if not len(short):
        return out
    signs_ = np.array([data[i] for i in short.tolist()], f"S{int(size[short].max())}").view(np.uint8).reshape(len(short), -1)
    size, h = size[short], np.full(len(short), SEED, np.uint64)
    place = lambda h: 1 + ((h * np.uint64(GOLDEN)) >> np.uint64(40)).astype(np.int64) % (SIZE - 1)
    with np.errstate(over="ignore"):
        for n in range(signs_.shape[1] + 1):
            whole = np.flatnonzero(size == n)
            out[short[whole], -1] = place((h[whole] ^ np.uint64(32)) * np.uint64(PRIME))
            if n in BEGINNINGS:
                longer = np.flatnonzero(size >= n)
                out[short[longer], n - BEGINNINGS.start] = place(h[longer])
            if n < signs_.shape[1]:
                h = (h ^ signs_[:, n]) * np.uint64(PRIME)
    return out


def example(words: set[str]):
    """Distinct coordinates and how many of the distinct words have each."""
    import numpy as np

    at = coordinates(sorted(words)).ravel()
    at, n = np.unique(np.concatenate([[CONSTANT], at[at > 0]]), return_counts=True)
    return at.astype("<i4"), n.astype("<f4")


class Weights(dict):
    """Restored word to the sum of its features' weights."""

    def __init__(self, weights):
        import numpy as np

        self.weights = np.array(weights, float)
        self.weights[CONSTANT] = 0.0  # the coordinate of beginnings that are not there

    def learn(self, words: set[str]) -> None:
        new = words - self.keys()
        if len(self) + len(new) > REMEMBERED:
            self.clear()
            new = words
        if new:
            new = list(new)
            self.update(zip(new, self.weights[coordinates(new)].sum(axis=1).tolist()))


def ready(cost: bytes) -> Reader:
    import numpy as np

    return Reader(np.frombuffer(cost, "<f4").reshape((SYMBOLS,) * 4).tolist())


def train(docs: DataFrame, labels: DataFrame, cost, label: str, id_column: str, text: str, rows: int) -> bytes:
    sample = F.broadcast(labelled_sample(labels, label, rows, id_column))  # about ``rows`` rows at most
    chosen = docs.select(F.col(id_column).alias("__id"), F.col(text).alias("__text")).join(sample, "__id")

    def run(batches):
        import pyarrow as pa

        read = ready(cost.value)
        for batch in batches:
            for part, texts in byte_slices(batch, "__text"):
                found = [example(w) for w in restored_words([(t or b"").decode() for t in texts], read)]
                yield appended(
                    part.select(["__id", "label"]),
                    at=pa.array([a.tobytes() for a, _ in found], pa.binary()), x=pa.array([x.tobytes() for _, x in found], pa.binary()),
                )

    kind = dict(docs.dtypes)[id_column]
    examples = chosen.mapInArrow(run, f"__id {kind}, label int, at binary, x binary")
    return fit(examples, SIZE, EPOCHS, alpha=0.3, beta=1.0, l1=3.0, l2=0.01, again_l1=0.1)


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_column: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with held_out, score and predicted."""
    docs = without(docs, *OUTPUTS)
    context = docs.sparkSession.sparkContext
    cost = context.broadcast(costs(count_grams(docs, text).collect()))  # 28**4 cells at most
    weights = context.broadcast(train(docs, labels, cost, label, id_column, text, rows))  # 4 * SIZE bytes

    def run(batches):
        import numpy as np
        import pyarrow as pa

        w, read = np.frombuffer(weights.value, "<f4"), ready(cost.value)
        worth, constant = Weights(w), float(w[CONSTANT])
        for batch in batches:
            for part, texts in byte_slices(batch, text):
                found = list(restored_words([(t or b"").decode() for t in texts], read))
                worth.learn(set().union(*found))
                total = [constant + fsum(map(worth.__getitem__, own)) for own in found]
                yield appended(part, score=pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))), pa.float64()))

    scored = docs.withColumn("held_out", held_out(id_column))
    scored = scored.mapInArrow(run, scored.selectExpr("*", "0D as score").schema)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", *OUTPUTS)
