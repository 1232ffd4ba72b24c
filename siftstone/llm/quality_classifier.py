"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Features are hashed n-grams of words (one and two) and of word shapes (one to three): a shape writes
capital and small letters and digits by one sign each, other signs as they are, and joins runs, and a word that repeats the
one before it is a shape of its own. Every family of n-grams is divided by its number in the text, so
that a score is the mean weight of the families' n-grams: a sparse dot product, summed by gathering.

The classifier learns from about ``SAMPLE_ROWS`` labelled documents and ``learning.SAMPLE_BYTES`` of examples at most and
scores all documents. Rates and epochs were chosen on the rows of remainder 1 after learning from remainders 2 to 4.

Defined results: null or wordless text has only the feature of an empty text and the constant; a null doc_id counts as
held out; without any labelled row every score is 0.5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import appended, byte_slices, table, without
from siftstone.llm.learning import fit, held_out, labelled_sample

SAMPLE_ROWS = 8000
SIZE = 1 << 18
EPOCHS = 6
#: A score of this and above predicts 1.
THRESHOLD = 0.3
REMEMBERED = 200_000
#: (family, length of its n-grams): words and shapes.
FAMILIES = (("words", 1), ("words", 2), ("shapes", 1), ("shapes", 2), ("shapes", 3))
CONSTANT, EMPTY = 0, 1
SCALE = 8.0
OUTPUTS = ("held_out", "score", "predicted")


def shape(word: str) -> str:
    out = []
    for c in word:
        s = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "a" if c.isalpha() else c
        if not out or out[-1] != s:
            out.append(s)
    return "".join(out)


class Words(dict):
    """Word to (hash of the word, hash of its shape) as one number."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest as digest

        if len(self) >= REMEMBERED:
            self.clear()
        text = word.decode()
        self[word] = both = (digest(text.lower()) >> 32) << 32 | digest(shape(text)) >> 32
        return both


def gathered(text: bytes | None, known: Words):
    """Coordinates by family; None for a text without words."""
    import numpy as np

    found = (text or b"").split()
    if not found:
        return None
    both = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    low = np.uint64(0xFFFFFFFF)
    streams = {"words": both >> np.uint64(32), "shapes": both & low}
    streams["shapes"][1:][both[1:] == both[:-1]] = np.uint64(12345)
    out = []
    with np.errstate(over="ignore"):
        for k, (name, n) in enumerate(FAMILIES):
            s = streams[name]
            if len(s) < n:
                continue
            h = np.full(len(s) - n + 1, k + 1, np.uint64)
            for j in range(n):
                h = (h ^ s[j : len(s) - n + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            out.append((2 + (h >> np.uint64(20)) % np.uint64(SIZE - 2)).astype(np.int64))
    return out


def example(text: bytes | None, known: Words):
    """Distinct coordinates and values."""
    import numpy as np

    families = gathered(text, known)
    at, x = [np.array([CONSTANT])], [np.ones(1)]
    if families is None:
        at.append(np.array([EMPTY]))
        x.append(np.ones(1))
    for own in families or ():
        at.append(own)
        x.append(np.full(len(own), SCALE / len(own)))
    at, x = np.concatenate(at), np.concatenate(x)
    at, inverse = np.unique(at, return_inverse=True)
    return at.astype("<i4"), np.bincount(inverse, x).astype("<f4")


def score(text: bytes | None, weights, known: Words) -> float:
    import numpy as np

    families = gathered(text, known)
    total = float(weights[CONSTANT]) + (float(weights[EMPTY]) if families is None else 0.0)
    for own in families or ():
        total += SCALE * float(weights[own].mean(dtype=np.float64))
    return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def train(docs: DataFrame, labels: DataFrame, label: str, id_column: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS) -> bytes:
    sample = F.broadcast(labelled_sample(labels, label, rows, id_column))  # about ``rows`` rows at most
    chosen = docs.select(F.col(id_column).alias("__id"), F.col(text).alias("__text")).join(sample, "__id")

    def run(batches):
        import pyarrow as pa

        known = Words()
        for batch in batches:
            for part, texts in byte_slices(batch, "__text"):
                found = [example(t, known) for t in texts]
                yield appended(
                    part.select(["__id", "label"]),
                    at=pa.array([a.tobytes() for a, _ in found], pa.binary()), x=pa.array([x.tobytes() for _, x in found], pa.binary()),
                )

    kind = dict(docs.dtypes)[id_column]
    examples = chosen.mapInArrow(run, f"__id {kind}, label int, at binary, x binary")
    return fit(examples, SIZE, EPOCHS, alpha=0.1, beta=1.0, l1=0.03, l2=0.01)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", id_column: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with held_out, score and predicted."""
    docs = without(docs, *OUTPUTS)
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, id_column, text, rows))  # 4 * SIZE bytes

    def run(batches):
        import numpy as np
        import pyarrow as pa

        w, known = np.frombuffer(weights.value, "<f4"), Words()
        for batch in batches:
            for part, texts in byte_slices(batch, text):
                yield appended(part, score=pa.array([score(t, w, known) for t in texts], pa.float64()))

    scored = docs.withColumn("held_out", held_out(id_column))
    scored = scored.mapInArrow(run, scored.selectExpr("*", "0D as score").schema)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, table(spark, sf_dir, "labels")).select("doc_id", *OUTPUTS)
