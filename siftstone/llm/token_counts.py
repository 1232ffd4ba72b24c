"""Token counts of greedy longest-match word pieces, counted without building the pieces.

A trie of the vocabulary gets failure links as in the linear-time longest-match algorithm (LinMaxMatch):
the link of a node is where matching goes on after the longest pieces of its string are taken off the
front, and with each link stands only how many pieces that pops. A word is then read once, character by
character, adding up popped counts. The vocabulary is a published tokenizer file whose path is a
parameter; pieces at a word's end carry its end mark, and a word's last byte and that mark are one symbol,
so the end of a word is matched by final pieces only. Lower case, normal form and the split into words
follow that file.

Defined results: null or empty text has 0 of everything; a word that the vocabulary can't spell counts
as one unknown piece; repeated rows are counted each.
"""

from __future__ import annotations

import json
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import appended, byte_slices, table, without

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
END = 256
#: Raw words whose counts a Python worker remembers; a full memory starts anew.
REMEMBERED = 200_000
OUTPUTS = ("n_bytes", "n_words", "n_tokens")


def byte_symbols() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a visible character: itself, or one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def pieces(path: str = VOCABULARY) -> list[tuple[int, ...]]:
    """The vocabulary as symbol sequences: bytes, and END where a piece ends a word."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    suffix, symbol = model["end_of_word_suffix"], byte_symbols()
    out = []
    for piece in model["vocab"]:
        ends = bool(suffix) and piece.endswith(suffix) and piece != suffix
        body = piece.removesuffix(suffix) if ends else piece
        if all(c in symbol for c in body):
            out.append((*(symbol[c] for c in body), *([END] if ends else [])))
    return out


def marked(symbols: tuple[int, ...]) -> tuple[int, ...]:
    """A piece or word with its last byte and END as one symbol, byte + 256."""
    return (*symbols[:-2], symbols[-2] + 256) if len(symbols) > 1 and symbols[-1] == END else symbols


class Automaton:
    """next: (node, symbol) to node in one dictionary; fail: node to node, -1 for none; popped: counts."""

    def __init__(self, vocabulary):
        self.next: dict[int, int] = {}
        whole, order = [False], []
        for piece in vocabulary:
            node = 0
            for c in piece:
                key = node << 9 | c
                node = self.next.get(key) or self.next.setdefault(key, len(whole))
                if node == len(whole):
                    whole.append(False)
                    order.append((len(piece), key))
            whole[node] = True
        depth = [0] * len(whole)
        parent = [(0, 0)] * len(whole)
        for key, node in self.next.items():
            parent[node] = (key >> 9, key & 511)
        for node in range(1, len(whole)):  # parents come before their children
            depth[node] = depth[parent[node][0]] + 1
        self.fail, self.popped = [-1] * len(whole), [0] * len(whole)
        for node in sorted(range(1, len(whole)), key=depth.__getitem__):
            if whole[node]:
                self.fail[node], self.popped[node] = 0, 1
                continue
            up, c = parent[node]
            count, at = self.popped[up], self.fail[up]
            while at >= 0 and (to := self.next.get(at << 9 | c)) is None:
                count += self.popped[at]
                at = self.fail[at]
            if at >= 0:
                self.fail[node], self.popped[node] = to, count

    def count(self, word: bytes) -> int:
        """Pieces of one word whose END is a symbol of its own; 1 if it can't be spelled."""
        return self.matched((*word, END))

    def matched(self, symbols) -> int:
        """Pieces of a sequence of symbols; 1 if it can't be spelled."""
        nxt, fail, popped = self.next, self.fail, self.popped
        node = total = 0
        for c in symbols:
            while (to := nxt.get(node << 9 | c)) is None:
                if fail[node] < 0:
                    return 1
                total += popped[node]
                node = fail[node]
            node = to
        while node:
            if fail[node] < 0:
                return 1
            total += popped[node]
            node = fail[node]
        return total


class Counts(dict):
    """Raw word to its number of pieces, worked out at first sight."""

    def __init__(self, automaton: Automaton):
        import regex

        self.automaton = automaton
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall

    def __missing__(self, raw: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        text = unicodedata.normalize("NFC", raw.decode()).lower()
        self[raw] = n = sum(self.automaton.matched(marked((*w.encode(), END))) for w in self.split(text))
        return n


_ready: dict[int, Counts] = {}


def counts_for(vocabulary) -> Counts:
    """One automaton for each vocabulary in a worker."""
    key = hash(tuple(vocabulary))
    if key not in _ready:
        _ready.clear()
        _ready[key] = Counts(Automaton(map(marked, vocabulary)))
    return _ready[key]


def count_tokens(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The documents with n_bytes, n_words and n_tokens."""
    docs = without(docs, *OUTPUTS)
    shared = docs.sparkSession.sparkContext.broadcast(pieces(vocabulary))  # as large as the file

    def run(batches):
        import pyarrow as pa

        from siftstone.llm import token_counts

        counts = token_counts.counts_for(shared.value)
        for batch in batches:
            for part, texts in byte_slices(batch, text):
                words = [(x or b"").split() for x in texts]
                yield appended(
                    part,
                    n_bytes=pa.array([len(x or b"") for x in texts], pa.int64()),
                    n_words=pa.array(map(len, words), pa.int64()),
                    n_tokens=pa.array([sum(map(counts.__getitem__, w)) for w in words], pa.int64()),
                )

    return docs.mapInArrow(run, docs.selectExpr("*", *(f"0L as {x}" for x in OUTPUTS)).schema)


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    out = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *map(F.col, OUTPUTS))
