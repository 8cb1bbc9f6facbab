"""Benchmark decontamination by edit distance.

A window of a document as long as a benchmark item (in words) is embedded by a
random walk (CGK): at step j the walk emits the word it stands on and moves on or
stays, by a random bit of (j, word). Two sequences within d edits then agree at
most steps, so edit distance becomes Hamming distance, and sampling a few steps
of the embedding gives a locality-sensitive key. Several walks, each sampled many
times, are compared by key; samples, then walks are added until simulated items of
every length, with exactly the largest allowed number of edits, are found at the
target recall, and it is an error if that can't be reached. Items that share a key with a window are verified by exact edit distance, and only
verified ones count. Items of under five words allow no edit; they are looked up as
they are.

Windows start at every word of every text. Those that can't be within the allowed
distance of any item are passed over first, by counts that no true match fails: if
item and passage differ by at most d edits, the item-long window at the passage's
start has at least L - d words and L - 1 - 2d word pairs of the benchmark (each edit
spoils two pairs at most), and some short block of it has its share of the pairs.

The benchmark is the query set, taken in blocks of bounded size (items and words)
that are broadcast in turn; the random bits of a walk come from a product, not from a
table that grows with the vocabulary; documents are read once for each block and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, map_rows, table, texts, words_of

U = np.uint64
LEAST_WORDS = 5
#: Simulated items of each length, and the walks beyond which recall counts as out of reach.
TRIALS, LIMIT_WALKS = 40, 64


def allowed(n_words: int, similarity: float = 0.8) -> int:
    """Edits that leave the similarity 1 - edits / item words at its bound or over."""
    return int((1 - similarity) * n_words + 1e-9)


def passage_distance(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """Least edit distance between the item and any passage of ``words``, and that passage's end."""
    steps = np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1, np.int64)
    for i, w in enumerate(item.tolist(), 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (words != w), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


class Index:
    """Keys of a block of benchmark items: (item ids, words) with distinct words."""

    def __init__(self, items: list[tuple[list, list[bytes]]], *, similarity: float = 0.8, walks: int = 4, sample: int = 2, recall: float = 0.95, most_samples: int = 24, seed: int = 11):
        items = sorted(items, key=lambda x: len(x[1]) < LEAST_WORDS)  # the short ones last
        self.ids = [x[0] for x in items]
        self.vocabulary: dict[bytes, int] = {}
        found = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words], np.int32) for _, words in items]
        self.sizes = np.array([len(x) for x in found], np.int64)
        self.items = [x for x in found if len(x) >= LEAST_WORDS]
        self.short: dict[int, dict[tuple[int, ...], int]] = {}
        for k, x in enumerate(found[len(self.items) :], len(self.items)):
            self.short.setdefault(len(x), {})[tuple(x.tolist())] = k
        self.short_first = {n: np.unique([x[0] for x in of]) for n, of in self.short.items()}
        self.similarity, self.walks, self.sample = similarity, walks, sample
        self.lengths = sorted({len(x) for x in self.items})
        self.limit = {n: allowed(n, similarity) for n in self.lengths}
        self.pairs = np.zeros(1 << 22, bool)  # hashed word pairs of the items
        for x in self.items:
            self.pairs[self._pair(x[:-1], x[1:])] = True
        # of the pairs of a match some block of this many has at least so many of an item's
        self.block = min(12, self.lengths[0] - 1) if self.items else 1
        self.share = min((self.block - 2 * self.limit[n] // ((n - 1) // self.block) for n in self.lengths), default=0)
        rng = np.random.default_rng(seed)
        # ids: 0 past the end, 1 a word of no item; the bit of a step and a word is the top bit of a product
        self.salt = rng.integers(0, 1 << 63, len(self.vocabulary) + 2, U) << U(1) | U(1)
        self._draw(rng, most_samples)
        self.samples = self._enough(rng, recall, most_samples) if self.items else 1
        self.marks = np.zeros(len(self.vocabulary) + 2, bool)
        keys, owner = self._item_keys(self.items)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], owner[order]

    def _draw(self, rng: np.random.Generator, samples: int) -> None:
        self.turns = rng.integers(0, 1 << 63, (self.walks, 2 * max(self.lengths, default=0)), U) << U(1) | U(1)
        self.at = rng.random((self.walks, samples, self.sample))  # as a share of the walk

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = a.astype(U) * U(0x9E3779B97F4A7C15) + b.astype(U)
        return ((h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)) >> U(42)

    def _keys(self, ids: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """(walks * samples, windows) keys of the windows, which must come with falling lengths.
        ids must go on past every start with zeros, for the longest walk."""
        out = np.empty((self.walks * self.samples, len(start)), U)
        steps = int(1.7 * length.max(initial=0)) + 1
        # a walk moves at half its steps; sampling ends before walks begin to run past the end
        places = (self.at[:, : self.samples, :, None] * (1.7 * np.array(self.lengths))).astype(np.int64)
        which = np.searchsorted(self.lengths, length)
        for w in range(self.walks):
            emitted = np.zeros((steps, len(start)), np.int32)
            offset = np.zeros(len(start), np.int64)
            for j in range(steps):
                n = int(np.searchsorted(-length, -int(j / 1.7), "right"))  # windows with 1.7 * length > j, and a few
                o = offset[:n]
                word = np.where(o < length[:n], ids[start[:n] + o], 0)
                emitted[j, :n] = word
                offset[:n] += (self.salt[word] * self.turns[w, j] >> U(63)).astype(np.int64)
            column = np.arange(len(start))
            for s in range(self.samples):
                h = length.astype(U) * U(0x9E3779B97F4A7C15) + U(w * 1000 + s)
                for k in range(self.sample):
                    h = (h ^ emitted[places[w, s, k][which], column].astype(U)) * U(0xFF51AFD7ED558CCD)
                    h ^= h >> U(29)
                out[w * self.samples + s] = h
        return out

    def _laid_out(self, items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        order = np.array(sorted(range(len(items)), key=lambda i: -len(items[i])), np.int64)
        length = np.array([len(items[i]) for i in order], np.int64)
        start = np.append(0, np.cumsum(length)[:-1])
        ids = np.concatenate([*(items[i] for i in order), np.zeros(max(self.lengths) + 1, np.int32)])
        return order, ids, start, length

    def _item_keys(self, items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        if not items:
            return np.zeros(0, U), np.zeros(0, np.int64)
        order, ids, start, length = self._laid_out(items)
        keys = self._keys(ids, start, length)
        return keys.ravel(), np.tile(order, len(keys))

    def _edited(self, rng: np.random.Generator, x: np.ndarray) -> np.ndarray:
        """The item with exactly the allowed number of edits, at distinct words."""
        d = self.limit[len(x)]
        for attempt in range(20):
            y: list[int] = []
            kinds = dict(zip(rng.permutation(len(x))[:d].tolist(), rng.integers(0, 3, d).tolist() if attempt < 19 else [2] * d, strict=True))
            for i, w in enumerate(x.tolist()):
                what = kinds.get(i)
                y += [w] if what is None else [1, w] if what == 0 else [] if what == 1 else [1]
            got = np.array(y, np.int32)
            if passage_distance(x, got)[0] == d:  # not fewer, as where a word goes beside one that comes
                break
        return got

    def _enough(self, rng: np.random.Generator, recall: float, most: int) -> int:
        """Samples of each walk that find items of every length with the largest allowed number of
        edits at the target recall. Where ``most`` do not, there are twice as many walks."""
        by_length: dict[int, list[np.ndarray]] = {}
        for x in self.items:
            by_length.setdefault(len(x), []).append(x)
        chosen = [of[k * len(of) // TRIALS if len(of) >= TRIALS else k % len(of)] for of in by_length.values() for k in range(TRIALS)]
        edited = [np.append(self._edited(rng, x), np.ones(len(x), np.int32))[: len(x)] for x in chosen]
        order, ids, start, length = self._laid_out(chosen)
        other = np.concatenate([*(edited[i] for i in order), np.zeros(max(self.lengths) + 1, np.int32)])
        edges = np.flatnonzero(np.append(True, length[1:] != length[:-1]))
        while True:
            self.samples = self.at.shape[1]
            same = (self._keys(ids, start, length) == self._keys(other, start, length)).reshape(self.walks, self.samples, -1).any(0)  # by sample and item
            found = np.add.reduceat(np.maximum.accumulate(same, axis=0).astype(np.int64), edges, axis=1) / TRIALS
            reached = np.flatnonzero(found.min(1) >= recall)
            if len(reached):
                return int(reached[0]) + 1
            if self.walks * 2 > LIMIT_WALKS:
                raise ValueError(f"{self.walks} walks find only {found[-1].min():.3f} of the items of some length, not {recall}")
            self.walks *= 2
            self._draw(rng, most)

    def search(self, docs: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
        """For each document (item, distance, end word) of the items that are in it."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
        if not self.ids:
            return out
        pad = int(self.sizes.max()) + 1
        lens = np.array([len(d) for d in docs], np.int64)
        first = np.append(0, np.cumsum(lens + pad)[:-1])
        ids = np.zeros(int((lens + pad).sum()), np.int32)
        for d, a in zip(docs, first.tolist(), strict=True):
            ids[a : a + len(d)] = np.fromiter(map(self.vocabulary.get, d, repeat(1)), np.int32, len(d))
        for n, of in self.short.items():
            held: set[tuple[int, int]] = set()
            for p in np.flatnonzero(np.isin(ids, self.short_first[n])).tolist():
                item = of.get(tuple(ids[p : p + n].tolist()))
                if item is not None and (doc := int(np.searchsorted(first, p, "right")) - 1, item) not in held:
                    held.add((doc, item))
                    out[doc].append((item, 0, p + n - int(first[doc])))
        if not self.items:
            return out
        top = len(ids) - pad
        both = (ids[:-1] > 1) & (ids[1:] > 1)
        at = np.flatnonzero(both)
        both[at] = self.pairs[self._pair(ids[at], ids[at + 1])]
        pairs = np.append(0, np.cumsum(both, dtype=np.int32))
        place = np.arange(top)
        if self.share > 0:
            dense = np.flatnonzero(pairs[self.block :] - pairs[: -self.block] >= self.share)
            near = np.zeros(len(ids) + 1, np.int32)  # a match that has the block starts at most an item before it
            np.add.at(near, np.maximum(0, dense - pad), 1)
            np.add.at(near, dense + 1, -1)
            place = np.flatnonzero(np.cumsum(near[:top]) > 0)
        known = np.append(0, np.cumsum(ids > 1, dtype=np.int32)) if len(place) else pairs
        starts, lengths = [], []
        for n in self.lengths[::-1]:
            d = self.limit[n]
            at = place[pairs[place + n - 1] - pairs[place] >= n - 1 - 2 * d]
            at = at[known[at + n] - known[at] >= n - d]
            starts.append(at)
            lengths.append(np.full(len(at), n))
        start, length = np.concatenate(starts), np.concatenate(lengths)
        done: set[tuple[int, int]] = set()
        for a in range(0, len(start), 20_000):
            s, n = start[a : a + 20_000], length[a : a + 20_000]
            keys = self._keys(ids, s, n)
            low = np.searchsorted(self.keys, keys)
            hit = self.keys[np.minimum(low, len(self.keys) - 1)] == keys
            high = np.searchsorted(self.keys, keys[hit], "right")
            where, low = np.nonzero(hit)[1], low[hit]
            count = high - low
            owner = self.owner[np.repeat(low, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)]
            if not len(owner):
                continue
            p, item = np.unique(np.stack([owner, s[np.repeat(where, count)]]), axis=1)[::-1]
            doc = np.searchsorted(first, p, "right") - 1
            # windows of an item less than its length apart are verified together
            apart = (np.diff(item) > 0) | (np.diff(doc) > 0) | (np.diff(p) > self.sizes[item[1:]])
            cut = np.flatnonzero(np.concatenate([[True], apart, [True]]))
            for item, doc, begin, end in zip(item[cut[:-1]].tolist(), doc[cut[:-1]].tolist(), p[cut[:-1]].tolist(), p[cut[1:] - 1].tolist(), strict=True):
                if (doc, item) in done:
                    continue
                x, limit = self.items[item], self.limit[int(self.sizes[item])]
                lo = max(int(first[doc]), begin - limit)
                hi = min(int(first[doc] + lens[doc]), end + len(x) + limit)
                region = ids[lo:hi]
                self.marks[region] = True
                shared = np.count_nonzero(self.marks[x])
                self.marks[region] = False
                if shared < len(x) - limit:
                    continue
                distance, end = passage_distance(x, region)
                if distance <= limit:
                    done.add((doc, item))
                    out[doc].append((item, distance, lo + end - int(first[doc])))
        return out


def benchmark_items(benchmark: DataFrame) -> list[tuple[list, list[bytes]]]:
    """(ids, words) of the distinct items that have words; the benchmark is the small query set."""
    grouped: dict[tuple[bytes, ...], list] = {}
    for r in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        w = tuple(words_of(r.text.encode("utf-8", "surrogatepass")))
        if w:
            grouped.setdefault(w, []).append(r.item_id)
    return sorted(((sorted(ids, key=lambda x: (x is None, x)), list(w)) for w, ids in grouped.items()), key=lambda x: x[1])


def indexes(benchmark: DataFrame, similarity: float, block: int, block_words: int) -> Iterator[Broadcast]:
    """Broadcast indexes of the items, by blocks of at most ``block`` items and about block_words
    words; one of no items where there are none."""
    held, words = [], 0
    for x in benchmark_items(benchmark):
        if held and (len(held) == block or words + len(x[1]) > block_words):
            yield benchmark.sparkSession.sparkContext.broadcast(Index(held, similarity=similarity))
            held, words = [], 0
        held.append(x)
        words += len(x[1])
    yield benchmark.sparkSession.sparkContext.broadcast(Index(held, similarity=similarity))


def contaminated(docs: DataFrame, benchmark: DataFrame, want: bool = True, *, similarity: float = 0.8, block: int = 20_000, block_words: int = 1_000_000) -> DataFrame:
    """The rows of docs, with all their columns, in which ``contamination`` finds an item, or
    (``want`` false) the rest. Cases as there; a null text holds none, and columns of any
    other name play no part."""
    bounded_batches(docs.sparkSession)
    text_at, mark = docs.columns.index("text"), "found"
    out = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    kept = list(out.schema)
    for sent in indexes(benchmark, similarity, block, block_words):

        def run(batches, sent=sent):
            index = sent.value
            for b in batches:
                split = [words_of((t or "").encode("utf-8", "surrogatepass")) for t in b.column(text_at).to_pylist()]
                found = np.array([bool(x) for x in index.search(split)], bool)
                if mark in b.schema.names:
                    found |= b.column(b.schema.get_field_index(mark)).to_numpy(zero_copy_only=False)
                    b = b.drop_columns([mark])
                yield b.append_column(mark, pa.array(found))

        out = out.mapInArrow(run, T.StructType([*kept, T.StructField(mark, T.BooleanType())]))
    return out.where(F.col(mark) == want).drop(mark).toDF(*docs.columns)


def contamination(docs: DataFrame, benchmark: DataFrame, *, similarity: float = 0.8, block: int = 20_000, block_words: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, distance, item_words, end_word) for each row of docs (doc_id, text) and
    each item of benchmark (item_id, text) that some passage of it matches.

    A match has a similarity, 1 - distance / words of the item, of 0.8 or more;
    distances are in lower-cased words. So items of under five words match only as they
    are; null items and those without words match nothing; items with equal words are all
    reported. Null and empty documents match nothing, repeated rows are each searched,
    empty tables give no rows, texts of any length are searched whole. distance is the
    least of the passages found beside each other, at most the limit; of several such
    places the first counts.
    """
    bounded_batches(docs.sparkSession)
    kind = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {kind}, distance int, item_words int, end_word int"
    parts = []
    for sent in indexes(benchmark, similarity, block, block_words):

        def make(sent=sent):
            index = sent.value

            def step(cols: dict[str, list]) -> dict[str, list]:
                out: dict[str, list] = {k: [] for k in ("doc_id", "item_id", "distance", "item_words", "end_word")}
                split = [words_of((t or "").encode("utf-8", "surrogatepass")) for t in cols["text"]]
                for doc_id, got in zip(cols["doc_id"], index.search(split), strict=True):
                    for item, distance, end in sorted(got):
                        for item_id in index.ids[item]:
                            for k, v in (("doc_id", doc_id), ("item_id", item_id), ("distance", distance), ("item_words", int(index.sizes[item])), ("end_word", end)):
                                out[k].append(v)
                return out

            return step

        parts.append(map_rows(docs.select("doc_id", "text"), schema, make))
    return reduce(DataFrame.unionByName, parts)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = contamination(texts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "item_id", "distance", F.round(1 - F.col("distance") / F.col("item_words"), 6).alias("similarity"))
