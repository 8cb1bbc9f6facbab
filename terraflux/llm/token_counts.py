"""Token counts by a linear longest-match automaton.

A trie of the vocabulary gets a failure link and a count of popped tokens for
each node: where the text at hand can't go on from a node, its longest-match
tokens so far are settled, their number is added, and the walk goes on from the
link, which holds the rest. So greedy longest-match lengths come in one pass
over a word's characters, however long, with no piece built. A word that can't
be covered counts as one unknown token.
"""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .common import bounded_batches, map_rows, table, texts
from .sentencepiece_codec import MARK, Codec, default_model

#: Words that a worker keeps.
_CACHE = 1_000_000
_WORKER: dict[bytes, _Counts] = {}


class LongestMatch:
    """Greedy longest-match lengths over a vocabulary of strings."""

    def __init__(self, vocabulary: list[str]):
        child: dict[tuple[int, str], int] = {}
        ends, parents = [False], [(0, "")]
        for piece in vocabulary:
            node = 0
            for ch in piece:
                nxt = child.get((node, ch))
                if nxt is None:
                    nxt = child[node, ch] = len(ends)
                    ends.append(False)
                    parents.append((node, ch))
                node = nxt
            ends[node] = node > 0
        link, pops = [-1] * len(ends), [0] * len(ends)
        depth = [0] * len(ends)
        for v in range(1, len(ends)):  # a parent comes before its children
            depth[v] = depth[parents[v][0]] + 1
        for v in sorted(range(1, len(ends)), key=depth.__getitem__):
            if ends[v]:
                link[v], pops[v] = 0, 1
                continue
            u, ch = parents[v]
            z, n = link[u], pops[u]
            while z >= 0 and (z, ch) not in child:
                n += pops[z]
                z = link[z]
            if z >= 0:
                link[v], pops[v] = child[z, ch], n
        self.child, self.link, self.pops = child, link, pops

    def count(self, word: str) -> int:
        """Number of tokens of a word; -1 if longest match can't cover it."""
        child, link, pops = self.child, self.link, self.pops
        node = n = 0
        for ch in word:
            while (nxt := child.get((node, ch))) is None:
                if link[node] < 0:
                    return -1
                n += pops[node]
                node = link[node]
            node = nxt
        while node:
            if link[node] < 0:
                return -1
            n += pops[node]
            node = link[node]
        return n


class _Counts(dict):
    """word (bytes) -> tokens, plus 2**32 if it is unknown."""

    def __init__(self, match: LongestMatch, initial: str):
        self.match, self.initial = match, initial

    def __missing__(self, word: bytes) -> int:
        n = self.match.count(self.initial + word.decode("utf-8", "replace"))
        n = n if n >= 0 else (1 << 32) + 1
        if len(word) < 64:
            if len(self) >= _CACHE:
                self.clear()
            self[word] = n
        return n


def vocabulary_of(model_path: str | None = None) -> list[str]:
    """The ordinary pieces of a SentencePiece vocabulary; those with a space mark begin a word."""
    return list(Codec.load(Path(model_path or default_model()).read_bytes()).ids)


def token_counts(docs: DataFrame, *, vocabulary: list[str] | None = None, initial: str = MARK) -> DataFrame:
    """Longest-match token counts of every row of docs (doc_id, text).

    Words are runs without space or U+0009..U+000D, each looked up with ``initial``
    before it. Returns doc_id, n_words, n_tokens, n_unknown (words that can't be
    covered; each is one token). Null and empty texts count nothing, repeated rows
    are each returned, an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    pieces = vocabulary_of() if vocabulary is None else list(vocabulary)
    key = hashlib.sha256("\0".join([initial, *pieces]).encode("utf-8", "surrogatepass")).digest()

    def make():
        if key not in _WORKER:  # a worker process keeps the last automaton and its counts from task to task
            _WORKER.clear()
            _WORKER[key] = _Counts(LongestMatch(pieces), initial)
        known = _WORKER[key]

        def step(cols: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"doc_id": cols["doc_id"], "n_words": [], "n_tokens": [], "n_unknown": []}
            for t in cols["text"]:
                words = (t or "").encode("utf-8", "surrogatepass").split()
                n = sum(map(known.__getitem__, words))
                out["n_words"].append(len(words))
                out["n_tokens"].append(n & 0xFFFFFFFF)
                out["n_unknown"].append(n >> 32)
            return out

        return step

    return map_rows(docs.select("doc_id", "text"), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long, n_unknown long", make)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(texts(table(spark, sf_dir, "documents")))
