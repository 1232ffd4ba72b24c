import itertools
import random

import numpy as np
import pytest

from siftstone.llm import toxicity as t

PROSE = "you are a stupid idiot and a moron the man is an idiot you had a class of idiots I said so it was a great day "


@pytest.fixture(scope="module")
def cost():
    r, words = random.Random(6), PROSE.split()
    text = " ".join(r.choices(words, k=20000)).encode()
    total = np.bincount(t.grams(text, t.codes()), minlength=t.SYMBOLS**4)
    return t.costs([(i, total[i]) for i in np.flatnonzero(total)])


@pytest.mark.parametrize(
    "text, word",
    [("you a s t u p i d man", "stupid"), ("so I s t u p i d man", "stupid"), ("you i d i ó t man", "idiot"), ("the id io t man", "idiot"), ("the i d i o t, man", "idiot"), ("was m a n there", "man")],
)
def test_spaced_words(cost, text, word):
    assert word in t.restored(text, t.ready(cost))


@pytest.mark.parametrize("raw, word", [("idio+", "idiot"), ("cla$$", "clas"), ("(lass", "clas"), ("great!", "great"), ("(great!!", "great"), ("great", "great")])
def test_look_alikes_at_the_edge(cost, raw, word):
    assert t.ready(cost)[raw] == word


def test_long_words_and_all_contexts(cost):
    assert t.ready(cost)["1d1" + "0" * 40 + "t"] == "idiot"
    assert t.ready(cost)[".".join(["1d10t"] * 12)] == "idiot" * 12
    table = np.frombuffer(cost, "<f4").reshape((t.SYMBOLS,) * 4)

    def price(choice):
        total, context = sum(extra for _, extra in choice), [0, 0, 0]
        for s in [t.symbol(c) for letters, _ in choice for c in letters] + [0]:
            total += float(table[(*context, s)])
            context = [*context[1:], s]
        return total

    cells = table.tolist()
    for raw in ("161767", "7161716", "x6171!6", "1!6|76", "6!6!6!6"):
        read = t.cheapest(t.signs(raw), cells)
        choices = list(itertools.product(*t.signs(raw)))
        got = [c for c in choices if "".join(x for x, _ in c) == read]
        assert min(map(price, got)) == pytest.approx(min(map(price, choices)))
