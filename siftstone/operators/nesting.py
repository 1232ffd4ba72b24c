"""Folds along ordered rows as streams: open ancestors and greedy pieces.

Rows of a key lie together in order, as they do behind a window over that key; a task reads them batch by batch with a
state of one key, so neither depth nor the length of a group is bounded, and nothing is shuffled again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame


def streamed(rows: DataFrame, key: list[str], order: list[str], inputs: list[str], out: str, kind: str, fold: Callable[[], Iterator]) -> DataFrame:
    """rows with a column of what fold() makes of the inputs of each row; every key starts a new fold.

    fold gives a generator to which each row's inputs are sent. rows must be dealt by the key already, as a window
    over it or a repartition leaves them.
    """
    names = rows.columns

    def run(batches):
        import pyarrow as pa

        last, state = None, None
        for batch in batches:
            columns = [batch.column(names.index(c)).to_pylist() for c in (*key, *inputs)]
            made = []
            for row in zip(*columns):
                if state is None or row[: len(key)] != last:
                    last, state = row[: len(key)], fold()
                    next(state)
                made.append(state.send(row[len(key) :]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, arrow)], names=[*names, out])

    schema = rows.drop(out).selectExpr("*", f"cast(null as {kind}) as `{out}`").schema
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(schema[out].dataType)
    return rows.sortWithinPartitions(*key, *order).mapInArrow(run, schema)


def open_ancestors():
    """(level, closes, value) to the values of the open rows above.

    A row of a level ends those of its level and deeper ones and is open itself; one without a level is inside all
    that are open, or ends them all if it closes.
    """
    levels, values, out = [], [], None
    while True:
        level, closes, value = yield out
        if level is None:
            if closes:
                levels, values = [], []
            out = list(values)
            continue
        while levels and levels[-1] >= level:
            levels.pop()
            values.pop()
        out = list(values)
        levels.append(level)
        values.append(value)


def pieces(limit: int):
    """Sizes to piece numbers: a piece ends where the next size would bring it above the limit."""

    def fold():
        held, piece, out = 0, 0, None
        first = True
        while True:
            (size,) = yield out
            if not first and held + size > limit:
                held, piece = 0, piece + 1
            first = False
            held += size
            out = piece

    return fold
