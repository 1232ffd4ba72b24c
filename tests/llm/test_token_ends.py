import os
import random
import string

import pytest

from siftstone.llm import token_counts as t


def greedy(known, longest, word):
    """Longest piece first over byte + 256 at the word's end; 1 if it gets stuck."""
    symbols, at, n = (*word[:-1], word[-1] + 256), 0, 0
    while at < len(symbols):
        size = next((k for k in range(min(longest, len(symbols) - at), 0, -1) if symbols[at : at + k] in known), 0)
        if not size:
            return 1
        at, n = at + size, n + 1
    return n


def test_words_end_in_final_pieces():
    final = lambda x: (*x.encode(), t.END)
    counts = t.Counts(t.Automaton(map(t.marked, [(*b"thre",), (*b"th",), (*b"at",), final("re"), final("e"), (*b"a",)])))
    assert [counts[x] for x in (b"thre", b"atthre", b"the", b"re", b"a", b"zz")] == [2, 3, 2, 1, 1, 1]


@pytest.mark.skipif(not os.path.exists(t.VOCABULARY), reason="needs the vocabulary file")
def test_published_vocabulary():
    vocabulary = t.pieces()
    counts, r = t.counts_for(vocabulary), random.Random(2)
    assert counts[b"thre"] > 1 and counts[b"attribu"] == 3
    words = ["".join(r.choices(string.ascii_lowercase, k=r.randint(1, 12))) for _ in range(2000)]
    words += ["x" * 30_000, "".join(r.choices(string.ascii_lowercase, k=30_000)) + "attribu"]
    known, longest = set(map(t.marked, vocabulary)), max(map(len, vocabulary))
    for w in words:
        assert counts[w.encode()] == greedy(known, longest, w.encode()), w[:50]
