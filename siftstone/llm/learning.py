"""Labelled samples and follow-the-regularised-leader logistic regression for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_column: str) -> Column:
    """Rows kept from learning: crc32 of the id's text divisible by five. A null id is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


#: Bytes of examples that the fit holds at most.
SAMPLE_BYTES = 256 << 20


def labelled_sample(labels: DataFrame, label: str, rows: int, id_column: str = "doc_id") -> DataFrame:
    """(__id, label): about ``rows`` labelled ids at most, chosen by hash; all if there are fewer.

    An id with several labels takes the largest.
    """
    known = (
        labels.where(F.col(id_column).isNotNull() & F.col(label).isNotNull() & ~held_out(id_column))
        .groupBy(F.col(id_column).alias("__id"))
        .agg(F.max(F.col(label).cast("int")).alias("label"))
    )
    n = known.count()
    if n <= rows:
        return known
    return known.where(F.pmod(F.xxhash64("__id", F.lit("sample")), F.lit(1 << 62)) < (1 << 62) * rows // n)


class Ftrl:
    """FTRL-proximal with per-coordinate rates; weights come from z and n."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float):
        import numpy as np

        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)):
        import numpy as np

        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at, x, y: int, weight: float = 1.0) -> None:
        """One example: distinct coordinates, their values, the label."""
        import numpy as np

        w = self.weights(at)
        g = weight * (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
        n = self.n[at]
        rate = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - rate * w
        self.n[at] = n + g * g


def fit(examples: DataFrame, size: int, epochs: int, l1: float, again_l1: float | None = None, sample_bytes: int = SAMPLE_BYTES, **rates) -> bytes:
    """Weights (float32) learned in one task from a bounded sample (__id, label, at, x as binary).

    Examples come in the order of a hash of their id, so reruns agree, and the sample ends where the next example
    would bring it above ``sample_bytes`` (one example is always taken). With again_l1, a first
    round under l1 only chooses the coordinates, and a second round under again_l1 learns their weights.
    """
    examples = examples.repartition(1).sortWithinPartitions(F.xxhash64("__id", F.lit("order")), "__id", "at")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        rows, held = [], 0
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("label", "at", "x")]
            for i in range(batch.num_rows):
                y, at, x = (c[i].as_py() for c in columns)
                held += len(at) + len(x)
                if held <= sample_bytes or not rows:
                    rows.append((y, np.frombuffer(at, "<i4"), np.frombuffer(x, "<f4")))
            if held > sample_bytes:
                break

        def learned(rows, l1):
            model = Ftrl(size, l1=l1, **rates)
            for _ in range(epochs):
                for y, at, x in rows:
                    model.learn(at, x.astype(float), y)
            return model.weights()

        w = learned(rows, l1)
        if again_l1 is not None:
            kept = w != 0
            w = learned([(y, at[kept[at]], x[kept[at]]) for y, at, x in rows], again_l1)
        yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f4").tobytes()], pa.binary())], names=["w"])

    found = examples.mapInArrow(run, "w binary").first()  # no row at all where nothing is labelled
    return found[0] if found else bytes(4 * size)
