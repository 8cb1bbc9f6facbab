"""SimHash fingerprints, and links between all that differ in three bits or fewer.

Links are found by meeting in the middle. Two fingerprints at distance d meet at
a value that is reached from one by flipping some of the d bits and from the
other by flipping the rest. Every fingerprint emits itself and its 64 variants
with one flipped bit, which finds the distances 0 to 2. At distance 3 the two
have opposite parity, and of the three bits at least two lie in the same half of
the word; so those of odd parity also emit the variants with two flipped bits in
one half (2 * 496), and meet the other's variant with one flipped bit. Nothing
within the radius is missed, and nothing else can meet but by two flips on both
sides, which makes no link.

Variants travel as binary blocks, eight bytes and a two-byte code of the flipped
bits each, dealt out by the leading bits of a mixed hash. Where many meet, each
is linked to one of them with at most one flip, so a group of any size gives a
number of links in proportion to its variants, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, connected_components, map_rows, materialise, shuffle_partitions, table, texts, words_of

U = np.uint64
SEED = 42
RADIUS = 3
#: Variants that meet in one bucket, on average at most, and of one fingerprint.
BUCKET_VARIANTS, MEAN_VARIANTS = 4_000_000, 561


def fingerprint(text: str | bytes, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of one text; 0 without words."""
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    w = words_of(data)
    if not w:
        return 0
    parts = map(b" ".join, zip(*(w[i:] for i in range(shingle)))) if len(w) >= shingle else [b" ".join(w)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), U)
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 16):
        part = h[a : a + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(U)[0])


def fingerprints(docs: DataFrame, *, shingle: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp long: the fingerprint's bits) for each row of (doc_id, text)."""
    bounded_batches(docs.sparkSession)

    def make():
        def step(cols: dict[str, list]) -> dict[str, list]:
            fp = np.array([fingerprint(t, shingle) for t in cols["text"]], U).view(np.int64)
            return {"doc_id": cols["doc_id"], "text_hash": cols["text_hash"], "fp": fp.tolist()}

        return step

    hashed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    return map_rows(hashed, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long", make)


def _masks() -> tuple[np.ndarray, np.ndarray]:
    """XOR masks of the variants and their codes: the number of flips * 4096 + bit * 64 + bit.
    The first 65 have at most one flip."""
    flips = [(0, 0, 0)] + [(1, a, a) for a in range(64)] + [(2, a, b) for half in (0, 32) for a in range(half, half + 32) for b in range(a + 1, half + 32)]
    mask = [(1 << a | 1 << b) if n else 0 for n, a, b in flips]
    return np.array(mask, U), np.array([n << 12 | a << 6 | b for n, a, b in flips], np.uint16)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    return x ^ (x >> U(33))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (fp) within the radius: each link
    joins two at distance 1 to 3, and any two at such a distance are joined by some path of links.
    prints is read twice: its count says how many buckets there must be for one to stay small."""
    spark = prints.sparkSession
    parts = shuffle_partitions(spark)
    buckets = max(32 * parts, -(-prints.count() * MEAN_VARIANTS // BUCKET_VARIANTS))
    together = 4096 if buckets <= 1 << 16 else 16384  # fingerprints whose variants are dealt at a time

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, code = _masks()

        def blocks(fp: np.ndarray) -> pa.RecordBatch:
            odd = _popcount(fp) % 2 == 1
            keys = np.concatenate([(fp[:, None] ^ mask[None, :65]).ravel(), (fp[odd, None] ^ mask[None, 65:]).ravel()])
            codes = np.concatenate([np.tile(code[:65], len(fp)), np.tile(code[65:], int(odd.sum()))])
            at = ((_mixed(keys) >> U(24)) % U(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
            order = np.argsort(at, kind="stable")
            keys, codes, at = keys[order], codes[order], at[order]
            cut = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            pairs = list(zip(cut.tolist(), np.append(cut[1:], len(at)).tolist()))
            return pa.RecordBatch.from_arrays(
                [pa.array(at[cut].astype(np.int64)), pa.array([keys[a:b].tobytes() for a, b in pairs], pa.binary()), pa.array([codes[a:b].tobytes() for a, b in pairs], pa.binary())],
                ["bucket", "keys", "codes"],
            )

        held: list[np.ndarray] = []
        for b in batches:
            held.append(b.column("fp").to_numpy().view(U))
            if sum(map(len, held)) >= together:
                yield blocks(np.concatenate(held))
                held = []
        if held:
            yield blocks(np.concatenate(held))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def found() -> pa.RecordBatch:
            keys, codes = np.frombuffer(b"".join(k for k, _ in held), U), np.frombuffer(b"".join(c for _, c in held), np.uint16)
            order = np.lexsort((codes >> 12, keys)) if len(keys) < 1 << 16 else np.argsort(keys, kind="stable")
            keys, codes = keys[order], codes[order]
            same = keys[1:] == keys[:-1]
            shared = np.append(False, same) | np.append(same, False)
            keys, codes = keys[shared], codes[shared]
            order = np.lexsort((codes >> 12, keys))  # of a key, the variant with the fewest flips comes first
            keys, codes = keys[order], codes[order].astype(U)
            n, x, y = codes >> U(12), (codes >> U(6)) & U(63), codes & U(63)
            fp = keys ^ np.where(n > 0, U(1) << x, U(0)) ^ np.where(n > 1, U(1) << y, U(0))
            start = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
            first = np.flatnonzero(start)[np.cumsum(start) - 1] if len(keys) else np.zeros(0, np.int64)
            ok = (n[first] <= 1) & (fp != fp[first])
            a, b = fp[ok], fp[first][ok]
            near = _popcount(a ^ b) <= RADIUS
            pairs = np.unique(np.stack([np.maximum(a, b)[near], np.minimum(a, b)[near]], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i]).view(np.int64), pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:  # sorted by bucket
            for s, k, c in zip(*(batch.column(n).to_pylist() for n in ("bucket", "keys", "codes")), strict=True):
                if s != now:
                    if now is not None:
                        yield found()
                    now, held = s, []
                held.append((k, c))
        if now is not None:
            yield found()

    variants = prints.select("fp").mapInArrow(emit, "bucket long, keys binary, codes binary")
    return variants.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, shingle: int = 3) -> DataFrame:
    """Fingerprint and class of every row of docs (doc_id, text).

    Returns doc_id, fp (long) and component_id: the smallest doc_id reachable over
    links, its own included. Null and empty texts have the fingerprint 0 and link
    like any other. Repeated rows are each returned; rows with a null doc_id get a
    component_id too, null where no row of the class has an id. An empty table
    gives no rows. Exact copies collapse to one fingerprint before anything is linked.
    """
    fp, named = _classes(docs, shingle)
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = named.select(F.col("fp").alias("class_fp"), "root").join(lows, "root").select("class_fp", "component_id")
    return fp.join(by_fp, fp.fp == by_fp.class_fp).select("doc_id", "fp", "component_id")


def _classes(docs: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and (fp, low: its smallest doc_id, root: its class)."""
    fp = materialise(fingerprints(docs, shingle=shingle), "fingerprints")
    classes = materialise(fp.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    roots = connected_components(links(classes))
    return fp, materialise(classes.join(roots, classes.fp == roots.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("root")), "named")


def first_of_each_class(docs: DataFrame, *, shingle: int = 3) -> DataFrame:
    """One row of each class of near-duplicates, with all its columns: that of the smallest
    doc_id (a null one only where the class has no other), of its rows the one whose text's
    hash is the least. Nulls, empty texts and tables as in near_duplicates; columns of any
    name pass through."""
    fp, named = _classes(docs, shingle)
    rooted = fp.join(named.select(F.col("fp").alias("class_fp"), "root"), fp.fp == F.col("class_fp"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    first = rooted.groupBy("root").agg(F.min(rank).alias("r")).select(F.col("r.id").alias("__first_id"), F.col("r.hash").alias("__first_hash"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    own_id, own_text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    hashed = docs.toDF(*names).withColumn("hash", F.xxhash64(F.coalesce(own_text, F.lit(""))))
    left = hashed.join(first, own_id.eqNullSafe(F.col("__first_id")) & (F.col("hash") == F.col("__first_hash")), "left_semi")
    same = Window.partitionBy(own_id, "hash").orderBy(own_id)
    return left.withColumn("n", F.row_number().over(same)).where("n = 1").select(*names).toDF(*docs.columns)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(texts(table(spark, sf_dir, "documents")))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
