"""Language-model scoring with a log-frequency Bloom filter.

An n-gram seen c times has the level q(c) = 1 + floor(log_b c). The filter holds
the events (n-gram, 1) .. (n-gram, q); a reader probes (n-gram, 1), (n-gram, 2)
and so on until a probe misses, and takes the mean count of the last level that
hit. An n-gram that was seen is never missed.

Construction is distributed. Map tasks count n-grams by a 64-bit hash, and deal
the sorted hashes out by hash range as binary blocks; a reducer merges one range
and sets the bits of its own segment of the filter. A segment gets its size from
the events it has counted, so all words and all word pairs of a corpus of any size
are held, and a probe of an event that is not there hits at the rate FALSE_HITS.
Ranges are so many that none has more than SEGMENT_TOKENS n-grams on average.

The segments are written to the shared folder. The driver reads some of them at a
time and sends them out as one broadcast of about ``filter_bits``, and drops them;
readers map the broadcasts' files and probe one after another.

p(w | v) = s * c(vw) / c(v) + (1 - s) * p(w) where the pair is in the filter,
(1 - s) * p(w) where v is known but the pair is not, p(w) after an unknown v;
p(w) = (c(w) + 1) / (N + V + 1).
"""

from __future__ import annotations

import math
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, bounded_batches, bucket_of, map_rows, materialise, shuffle_partitions, table, texts, words_of

#: The end token; a word cannot be white space.
END = b"\n"
SEED = 42
U = np.uint64
LEVELS = 96
#: How often a probe hits an event that is not in the filter.
FALSE_HITS = 0.01
#: N-grams that one segment is built of, on average at most.
SEGMENT_TOKENS = 4_000_000
#: Starts the bytes of a broadcast block.
MARK = b"terraflux-filter"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: A random number for each byte, 0 for white space, and the multiplier of a byte's place in its word.
_BYTES = np.random.default_rng(SEED).integers(1, 1 << 63, 256, U) * U(2) + U(1)
_BYTES[list(SPACES.encode())] = 0
_INSIDE = _BYTES != 0
_PLACE = U(0x9FB21C651E98DF25)
END_HASH = U(0x2545F4914F6CDD1D)
#: Bytes that are hashed at a time.
HASHED_BYTES = 1 << 20


class Words:
    """The words of lower-cased texts in one buffer, by start and end, and the number of each text's.
    No word is an object of its own."""

    def __init__(self, texts: list[bytes]):
        self.buffer = b" ".join(texts).lower() + b" "
        self.data = np.frombuffer(self.buffer, np.uint8)
        inside = np.append(False, _INSIDE[self.data])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        cut = np.cumsum([len(x) + 1 for x in texts], dtype=np.int64)
        self.counts = np.diff(np.searchsorted(self.starts, cut), prepend=0)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: the sum of its bytes' numbers, each times a power by its place."""
        out = np.zeros(len(self.starts), U)
        powers = np.cumprod(np.full(int((self.ends - self.starts).max(initial=0)), _PLACE, U))
        a = 0
        while a < len(out):
            begin = self.starts[a]
            b = max(a + 1, int(np.searchsorted(self.starts, begin + HASHED_BYTES)))
            part = self.starts[a:b] - begin
            end = int(self.ends[b - 1] - begin)
            place = np.arange(end) - np.repeat(part, np.diff(part, append=end))
            np.minimum(place, len(powers) - 1, out=place)  # white space after a word counts 0 anyway
            out[a:b] = np.add.reduceat(_BYTES[self.data[begin : begin + end]] * powers[place], part)
            a = b
        return mix(out + (self.ends - self.starts).astype(U))

    def with_ends(self) -> tuple[np.ndarray, np.ndarray]:
        """The hashes with END_HASH after each text's, and the index of each text's first token."""
        first = np.append(0, np.cumsum(self.counts + 1)[:-1])
        h = np.empty(len(self.starts) + len(self.counts), U)
        last = first + self.counts
        h[last] = END_HASH
        h[np.delete(np.arange(len(h)), last)] = self.hashes()
        return h, first


def hashes_of(words: list[bytes]) -> np.ndarray:
    """Hashes of single words, END among them."""
    h, _ = Words([b"" if w == END else w for w in words]).with_ends()
    counts = np.array([w != END for w in words], np.int64)
    return h[np.cumsum(counts + 1) - counts - 1] if len(words) else np.zeros(0, U)


def pair_hashes(h: np.ndarray, before: np.ndarray) -> np.ndarray:
    return mix(before * U(0x9E3779B97F4A7C15) + h + U(1))


def segment_of(h: np.ndarray, segments: int) -> np.ndarray:
    return ((h >> U(32)) * U(segments)) >> U(32)


def levels_of(counts: np.ndarray, base: float) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(base) + 1e-9).astype(np.int64)


def bit_key(h: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """First place and distance of an event's bits, from the n-gram's mixed hash and a factor of the level."""
    key = (h ^ (h >> U(31))) * U((level * 0xD1342543DE82EF95 | 1) & 0xFFFFFFFFFFFFFFFF)
    return key >> U(32), (key * U(0x94D049BB133111EB) >> U(32)) | U(1)


def bit_position(a: np.ndarray, b: np.ndarray, i: int, bits: int) -> np.ndarray:
    """Place of the i-th bit of an event within a segment."""
    return (((a + U(i) * b) & U(0xFFFFFFFF)) * U(bits)) >> U(32)


class FrequencyFilter:
    """Reader of a finished filter. data: the segments, one after another; segment_bits: of all
    segments or of each, with the bits before each in starts."""

    def __init__(self, data: bytes | np.ndarray, segments: int, segment_bits: int | np.ndarray, hashes: int, starts: np.ndarray | None = None):
        self.bits, self.segments, self.hashes = np.frombuffer(data, np.uint8), segments, hashes
        self.sizes = np.broadcast_to(np.asarray(segment_bits, U), segments)
        self.starts = np.arange(segments, dtype=U) * self.sizes if starts is None else starts

    def levels(self, h: np.ndarray) -> np.ndarray:
        """For each n-gram hash the last level that hits, 0 for none."""
        found, live = np.zeros(len(h), np.int64), np.arange(len(h))
        segment = segment_of(h, self.segments)
        start, size = self.starts[segment], self.sizes[segment]
        for level in range(1, LEVELS):
            at, n = start[live], size[live]
            a, b = bit_key(h[live], level)
            for i in range(self.hashes):  # most that miss do so at the first bits
                p = bit_position(a, b, i, n) + at
                hit = np.flatnonzero(self.bits[p >> U(3)] >> (p & U(7)).astype(np.uint8) & np.uint8(1))
                if len(hit) < len(p):
                    live, at, n, a, b = live[hit], at[hit], n[hit], a[hit], b[hit]
            if not len(live):
                break
            found[live] = level
        return found


class BlockFilter:
    """Reader of a filter in several blocks. block_of, sizes and starts: of each segment."""

    def __init__(self, blocks: list[np.ndarray], block_of: np.ndarray, sizes: np.ndarray, starts: np.ndarray, hashes: int):
        self.block_of = block_of
        self.parts = [FrequencyFilter(x, len(sizes), sizes, hashes, starts) for x in blocks]

    def levels(self, h: np.ndarray) -> np.ndarray:
        if len(self.parts) == 1:
            return self.parts[0].levels(h)
        block = self.block_of[segment_of(h, len(self.block_of))]
        order = np.argsort(block, kind="stable")
        cut = np.searchsorted(block[order], np.arange(len(self.parts) + 1))
        found = np.zeros(len(h), np.int64)
        for k, part in enumerate(self.parts):
            if cut[k] < cut[k + 1]:
                of = order[cut[k] : cut[k + 1]]
                found[of] = part.levels(h[of])
        return found


def _mapped(sent: Broadcast) -> np.ndarray:
    """The bytes of a block after MARK. A worker maps the broadcast's local file, which all workers
    of a machine share, and does not load it."""
    path = getattr(sent, "_path", None)
    if path and os.path.isfile(path):
        with open(path, "rb") as f:
            at = f.read(256).find(MARK)
        if at >= 0:
            size = int.from_bytes(np.memmap(path, np.uint8, "r", at + len(MARK), 8).tobytes(), "little")
            return np.memmap(path, np.uint8, "r", at + len(MARK) + 8, size)
    return np.frombuffer(sent.value, np.uint8)[len(MARK) + 8 :]


def _blocks(h: np.ndarray, counts: np.ndarray, kind: int, segments: int) -> dict[str, list]:
    """Sorted hashes with counts as a row for each segment: hashes of count one apart from the rest."""
    cut = np.searchsorted(segment_of(h, segments), np.arange(segments + 1, dtype=U))
    out: dict[str, list] = {"segment": [], "kind": [], "ones": [], "more": [], "counts": []}
    for s in range(segments):
        x, c = h[cut[s] : cut[s + 1]], counts[cut[s] : cut[s + 1]]
        if len(x):
            for k, v in (("segment", s), ("kind", kind), ("ones", x[c == 1].tobytes()), ("more", x[c > 1].tobytes()), ("counts", c[c > 1].astype(np.int64).tobytes())):
                out[k].append(v)
    return out


_BLOCK = pa.schema([("segment", pa.int32()), ("kind", pa.int32()), ("ones", pa.binary()), ("more", pa.binary()), ("counts", pa.binary())])


def _batch(rows: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, n_train, n_all) over documents (text, train); the end token is a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            train, other = sides
            both = list(train.keys() | other.keys())
            t = [train[w] for w in both]
            b = pa.RecordBatch.from_arrays([pa.array(both, pa.binary()), pa.array(t, pa.int64()), pa.array([n + other[w] for n, w in zip(t, both, strict=True)], pa.int64())], ["word", "n_train", "n_all"])
            train.clear()
            other.clear()
            return b

        for b in batches:
            for text, train in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("train").to_pylist(), strict=True):
                c = sides[0 if train else 1]
                c.update(words_of(text))
                c[END] += 1
            if len(sides[0]) + len(sides[1]) > 250_000:
                yield flush()
        yield flush()

    parts = docs.select("text", "train").mapInArrow(run, "word binary, n_train long, n_all long")
    return parts.groupBy("word").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all"))


def pair_blocks(docs: DataFrame, segments: int) -> DataFrame:
    """Counts of adjacent word pairs of the training documents, as blocks by hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return _batch(_blocks(h, c, 2, segments), _BLOCK)

        for b in batches:
            h, first = Words(b.column("text").cast(pa.binary()).to_pylist()).with_ends()
            before = np.append(END_HASH, h[:-1])
            before[first] = END_HASH
            held.append(pair_hashes(h, before))
            size += len(h)
            if size > 3_000_000:
                yield flush()
                size = 0
        if held:
            yield flush()

    return docs.where("train").select("text").mapInArrow(run, "segment int, kind int, ones binary, more binary, counts binary")


def word_blocks(counts: DataFrame, segments: int) -> DataFrame:
    """The words' own counts as blocks by hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            h, c = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            held.clear()
            order = np.argsort(h)
            return _batch(_blocks(h[order], c[order], 1, segments), _BLOCK)

        for b in batches:
            w = b.column("word").to_pylist()
            held.append((hashes_of(w), b.column("n_train").to_numpy()))
            if sum(len(x[0]) for x in held) > 1_000_000:
                yield flush()
        if held:
            yield flush()

    return counts.where("n_train > 0").select("word", "n_train").mapInArrow(run, "segment int, kind int, ones binary, more binary, counts binary")


def _merged(blocks: list[tuple[bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of many blocks."""
    if not blocks:
        return np.zeros(0, U), np.zeros(0, np.int64)
    h = np.concatenate([np.frombuffer(x, U) for one, more, _ in blocks for x in (one, more)])
    c = np.concatenate([x for one, _, n in blocks for x in (np.ones(len(one) // 8, np.int64), np.frombuffer(n, np.int64))])
    order = np.argsort(h)
    h, c = h[order], c[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    return h[first], np.add.reduceat(c, first)


def bits_for(events: int, hashes: int, false_hits: float = FALSE_HITS) -> int:
    """Bits, in whole bytes, in which an event that is not there hits at the rate false_hits."""
    return max(64, math.ceil(events * -hashes / math.log(1 - false_hits ** (1 / hashes)) / 8) * 8)


def filter_segments(blocks: DataFrame, segments: int, hashes: int, base: float) -> DataFrame:
    """(segment, bits, n_events, per level: n and sum of counts for words and for pairs)."""

    def build(segment: int, held: dict[int, list]) -> tuple:
        grams = [_merged(held.pop(kind, [])) for kind in (1, 2)]
        levels = [levels_of(c, base) if len(c) else np.zeros(0, np.int64) for _, c in grams]
        events, sums = int(sum(q.sum() for q in levels)), []
        segment_bits = bits_for(events, hashes)
        bits = np.zeros(segment_bits, bool)
        for (h, c), q in zip(grams, levels, strict=True):
            for level in range(1, int(q.max(initial=0)) + 1):
                a, b = bit_key(h[q >= level], level)
                for i in range(hashes):
                    bits[bit_position(a, b, i, segment_bits)] = True
            sums += [np.bincount(q, minlength=LEVELS).astype(np.int64).tolist(), np.bincount(q, c, minlength=LEVELS).astype(np.int64).tolist()]
        return segment, np.packbits(bits, bitorder="little").tobytes(), events, *sums

    names = ["segment", "bits", "n_events", "word_n", "word_sum", "pair_n", "pair_sum"]
    kinds = [pa.int32(), pa.binary(), pa.int64(), *[pa.list_(pa.int64())] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(build(now, held), kinds, strict=True)], names)

        for b in batches:  # sorted by segment
            for s, kind, *x in zip(*(b.column(n).to_pylist() for n in _BLOCK.names), strict=True):
                if s != now:
                    if now is not None:
                        yield row()
                    now, held = s, {}
                held.setdefault(kind, []).append(tuple(x))
        if now is not None:
            yield row()

    schema = "segment int, bits binary, n_events long, " + ", ".join(f"{n} array<long>" for n in names[3:])
    return blocks.repartition(segments, "segment").sortWithinPartitions("segment").mapInArrow(run, schema)


def frequent_words(counts: DataFrame, most: int) -> DataFrame:
    """The words at or above the least frequency level that has ``most`` words or fewer: a bounded
    table, found from the sizes of the levels."""
    level = F.floor(F.log(F.col("n_all").cast("double")) / math.log(1.05) + 1e-9)
    sizes = sorted(((r[0], r[1]) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, total = None, 0
    for at, n in sizes:
        if total + n > most:
            break
        least, total = at, total + n
    return counts.withColumn("frequent", F.lit(False) if least is None else level >= least)


def score(docs: DataFrame, *, filter_bits: int = 1 << 28, hashes: int = 4, base: float = 1.5, pair_weight: float = 0.2, frequent: int = 1 << 18) -> DataFrame:
    """Score documents (doc_id, text, train boolean) with a model of the training ones.

    Returns, a row for each input row: doc_id, train, n_tokens, n_known,
    train_tokens, base_score, score. filter_bits is the size at which a broadcast
    block of the filter is full (the filter has as many blocks as it needs),
    frequent bounds the broadcast table of exact counts of common words; exact counts
    of all other words come by a join. Null texts are empty: one end token. A
    null id is a row like any other, repeated rows are scored each, an empty
    table gives no rows. Without training rows all counts are 0 and N = V = 0.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    counts = materialise(frequent_words(materialise(word_counts(docs), "words"), frequent), "counts")
    n_all, n_distinct = counts.where("n_train > 0").agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.where("frequent").select("word", "n_train").toArrow()
    top_h = hashes_of(top.column("word").to_pylist())
    order = np.argsort(top_h)

    segments = max(shuffle_partitions(spark), -(-n_all // SEGMENT_TOKENS))
    made = materialise(filter_segments(pair_blocks(docs, segments).unionByName(word_blocks(counts, segments)), segments, hashes, base), "filter")
    mean = {}
    stats = made.select("word_n", "word_sum", "pair_n", "pair_sum").collect()
    for kind in ("word", "pair"):
        n = np.array([r[f"{kind}_n"] for r in stats], np.int64).reshape(-1, LEVELS).sum(0)
        total = np.array([r[f"{kind}_sum"] for r in stats], np.int64).reshape(-1, LEVELS).sum(0)
        mean[kind] = np.where(n > 0, total / np.maximum(n, 1), base ** np.maximum(0, np.arange(LEVELS) - 1.0))
        mean[kind][0] = 0
    blocks, held = [], bytearray(8)  # a segment without n-grams is the first 64 bits, which are 0
    block_of, sizes, starts = np.zeros(segments, np.int64), np.full(segments, 64, U), np.zeros(segments, U)

    def send() -> None:
        blocks.append(spark.sparkContext.broadcast(MARK + len(held).to_bytes(8, "little") + bytes(held)))
        held.clear()

    for r in made.select("segment", "bits").toLocalIterator():
        if held and (len(held) + len(r.bits)) * 8 > filter_bits:
            send()
        block_of[r.segment], sizes[r.segment], starts[r.segment] = len(blocks), len(r.bits) * 8, len(held) * 8
        held += r.bits
    send()
    sent = spark.sparkContext.broadcast((top_h[order], top.column("n_train").to_numpy()[order]))
    denominator = n_all + n_distinct + 1

    def make():
        known_h, known_n = sent.value
        model = BlockFilter([_mapped(x) for x in blocks], block_of, sizes, starts, hashes)
        task, serial = TaskContext.get().partitionId() << 36, [0]

        def step(cols: dict[str, list]) -> dict[str, list]:
            words = Words([t.encode("utf-8", "surrogatepass") for t in cols["text"]])
            h, first = words.with_ends()
            lens = (words.counts + 1).tolist()
            uniq, inv = np.unique(h, return_inverse=True)
            # exact counts of frequent words
            at = np.minimum(np.searchsorted(known_h, uniq), max(0, len(known_h) - 1))
            exact = known_h[at] == uniq if len(known_h) else np.zeros(len(uniq), bool)
            n = np.where(exact, known_n[at] if len(known_h) else 0, 0)
            base_sum = np.add.reduceat(np.where(exact, np.log10(n + 1.0), 0.0)[inv], first).tolist()
            known_sum = np.add.reduceat((exact & (n > 0))[inv].astype(np.int64), first).tolist()
            # the model
            c1_uniq = mean["word"][model.levels(uniq)]
            c1 = c1_uniq[inv]
            before = np.append(END_HASH, h[:-1])
            before[first] = END_HASH
            c_before = np.append(0.0, c1[:-1])
            c_before[first] = c1_uniq[np.searchsorted(uniq, END_HASH)]
            seen = np.flatnonzero((c_before > 0) & (c1 > 0))  # a pair of the corpus has two of its words
            c2 = np.zeros(len(h))
            pairs, at_pair = np.unique(pair_hashes(h[seen], before[seen]), return_inverse=True)
            c2[seen] = mean["pair"][model.levels(pairs)][at_pair]
            p = (c1 + 1) / denominator
            p = np.where(c_before > 0, pair_weight * np.minimum(1, c2 / np.maximum(c_before, 1)) + (1 - pair_weight) * p, p)
            total = np.add.reduceat(np.log10(p), first).tolist()
            # the rest of the words go to the join, once for each document
            rare = np.flatnonzero(~exact[inv])
            cut = np.searchsorted(rare, np.append(first, len(h))).tolist()
            doc = np.repeat(np.arange(len(lens)), np.diff(cut))
            at = np.minimum(rare - doc, max(0, len(words.starts) - 1))  # among words; END is one too where even it is rare
            is_end = h[rare] == END_HASH
            rare_words = [END if e else words.buffer[a:b] for e, a, b in zip(is_end.tolist(), words.starts[at].tolist(), words.ends[at].tolist())] if len(words.starts) else [END] * len(rare)
            out: dict[str, list] = {k: [] for k in ("row", "doc_id", "train", "word", "tf", "n_tokens", "n_known", "base", "score")}
            for i, size in enumerate(lens):
                serial[0] += 1
                row = task + serial[0]
                tail = Counter(rare_words[cut[i] : cut[i + 1]]) if cut[i] < cut[i + 1] else {b" %d" % row: 0}  # with a space: no word
                k = len(tail)
                out["row"] += [row] * k
                out["word"] += tail.keys()
                out["tf"] += tail.values()
                for name, v in (("doc_id", cols["doc_id"][i]), ("train", cols["train"][i]), ("n_tokens", size), ("n_known", known_sum[i]), ("base", base_sum[i]), ("score", total[i])):
                    out[name].append(v)
                    if k > 1:
                        out[name] += [None] * (k - 1)
            return out

        return step

    id_type = docs.schema["doc_id"].dataType.simpleString()
    parts = map_rows(docs.select("doc_id", "text", "train"), f"row long, doc_id {id_type}, train boolean, word binary, tf int, n_tokens long, n_known long, base double, score double", make)
    rare = counts.where("not frequent and n_train > 0").select(F.col("word").alias("rare_word"), "n_train")
    joined = parts.join(rare, parts.word == rare.rare_word, "left")
    some = lambda c: F.max(c).alias(c)  # noqa: E731  one of the row's parts has it
    rows = joined.groupBy("row").agg(
        some("doc_id"), some("train"), some("n_tokens"), some("score"),
        (F.max("n_known") + F.coalesce(F.sum(F.when(F.col("n_train") > 0, F.col("tf"))), F.lit(0))).cast("long").alias("n_known"),
        (F.max("base") + F.coalesce(F.sum(F.col("tf") * F.log10(F.col("n_train") + 1.0)), F.lit(0.0))).alias("base"),
    )
    return rows.select("doc_id", "train", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * math.log10(denominator)).alias("base_score"), "score")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(table(spark, sf_dir, "documents")).withColumn("train", bucket_of(F.col("doc_id"), 7) != 2)
    return score(docs).select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
