import os
import random
import unicodedata

import pytest
import regex

from siftstone.llm import token_counts as t


def greedy(known, longest, symbols):
    """Longest piece first, built piece by piece; 1 if it gets stuck."""
    at, n = 0, 0
    while at < len(symbols):
        size = next((k for k in range(min(longest, len(symbols) - at), 0, -1) if symbols[at : at + k] in known), 0)
        if not size:
            return 1
        at, n = at + size, n + 1
    return n


def test_counts_equal_greedy_pieces():
    r = random.Random(0)
    for _ in range(60):
        vocabulary = list({tuple(r.choices([97, 98, 99], k=r.randint(1, 5))) + ((t.END,) if r.random() < 0.5 else ()) for _ in range(r.randint(1, 25))})
        a = t.Automaton(vocabulary)
        for _ in range(60):
            word = bytes(r.choices([97, 98, 99, 100], [9, 9, 9, 1], k=r.randint(1, 14)))
            assert a.count(word) == greedy(set(vocabulary), 6, (*word, t.END)), (vocabulary, word)


@pytest.mark.skipif(not os.path.exists(t.VOCABULARY), reason="needs the vocabulary file")
def test_documents(spark):
    known = {t.marked(p) for p in t.pieces()}  # a word's last byte and its end are one symbol
    longest = max(map(len, known))
    split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    r = random.Random(1)
    texts = ["The unaffordable cats' 1234 prices — naïve ÉCOLE é\n\tdon't", None, "", " \n", "x" * 30_000, "日本語 text 😀", "a\x1cb"]
    texts += [" ".join("".join(r.choices("etaoinshrdlußéñ.,'", k=r.randint(1, 12))) for _ in range(50)) for _ in range(20)]
    rows = [(i, x, 7) for i, x in enumerate(texts)] + [(0, texts[0], 7), (None, texts[0], 7)]
    got = t.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")).collect()
    assert len(got) == len(rows)
    for x in got:
        words = split.findall(unicodedata.normalize("NFC", x.text or "").lower())
        assert x.n_tokens == sum(greedy(known, longest, t.marked((*w.encode(), t.END))) for w in words), x.text
        assert (x.n_bytes, x.n_words) == (len((x.text or "").encode()), len((x.text or "").encode().split()))
    assert t.count_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0
