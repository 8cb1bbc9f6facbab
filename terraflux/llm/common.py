"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import discard, materialise

__all__ = ["discard", "materialise"]

#: A word is a run of characters other than space and U+0009..U+000D; bytes.split()
#: breaks at exactly these, and bytes.lower() folds exactly A-Z.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"


def words_of(data: bytes) -> list[bytes]:
    """Lower-cased words of a UTF-8 text."""
    return data.lower().split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bounded_batches(spark: SparkSession, rows: int = 256) -> None:
    """Let Arrow batches hold few rows and few bytes, since one text may have megabytes; a session
    that allows less keeps its setting."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", 16 << 20)):
        name = f"spark.sql.execution.arrow.{name}"
        now = int(spark.conf.get(name).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(name, str(most))


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text``; whatever other columns there are play no part."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def bucket_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[dict[str, list]], dict[str, list] | None]]) -> DataFrame:
    """mapInArrow over columns as Python lists; ``make`` builds a task's state once."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for b in batches:
            got = step({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)})
            if got is not None:
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def connected_components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component: the least node.

    Alternates large-star and small-star steps. Each step is one aggregation
    (least neighbour, combined before the shuffle) and one join, so a node with
    very many neighbours is never gathered. The edges are written to the shared
    folder after each round and stay on the executors. Ends when a round changes
    nothing. Nulls are no nodes; an empty table gives an empty result.
    """
    spark = edges.sparkSession
    cur = materialise(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        small_low = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = large.join(small_low, F.col("a") == F.col("n")).select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")
        )
        before, cur = cur, materialise(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        discard(before)
        state = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    nodes = cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
