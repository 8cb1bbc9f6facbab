"""A live table of the latest state of each id, from a stream of changes.

Messages have an id, an operation (change, delete, clear), an event time, a sequence
number and attributes. The batch form and the streaming form give the same result:
a change is taken if its time isn't older than what is held; a delete removes an
id; a clear removes all that came before it.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ecql import Layout, ecql


@dataclass(frozen=True)
class Names:
    id: str = "id"
    op: str = "op"
    time: str = "ts"
    seq: str = "seq"


def latest_state(messages: DataFrame, names: Names = Names(), *, now: Column | None = None, ttl: Column | None = None, since: str | None = None, expired: bool = False) -> DataFrame:
    """The live rows after all messages. ttl: milliseconds of a row's life (null: for ever) from its
    event time, or from the time in the column ``since``, such as that of its ingest, judged at
    ``now``. With expired, the rows whose life has ended instead, to be stored elsewhere."""
    n = names
    cleared = messages.agg(F.max(F.when(F.col(n.op) == "clear", F.col(n.seq))).alias("__cleared"))
    after = messages.crossJoin(F.broadcast(cleared))  # an aggregate of one row
    after = after.where((F.col(n.op) != "clear") & (F.col("__cleared").isNull() | (F.col(n.seq) > F.col("__cleared")))).drop("__cleared")
    gone = after.where(F.col(n.op) == "delete").groupBy(n.id).agg(F.max(n.seq).alias("__gone"))
    rest = [c for c in messages.columns if c != n.id]
    changes = after.where(F.col(n.op) == "change").join(gone, n.id, "left").where("__gone is null or " + f"{n.seq} > __gone").drop("__gone")
    best = changes.groupBy(n.id).agg(F.max_by(F.struct(*rest), F.struct(n.time, n.seq)).alias("r"))
    out = best.select(*[F.col(n.id) if c == n.id else F.col(f"r.{c}").alias(c) for c in messages.columns])
    alive = F.lit(True) if ttl is None else ttl.isNull() | (F.unix_millis(F.col(since or n.time)) + ttl > F.unix_millis(now))
    return out.where(~alive if expired else alive).drop(n.op)


def filtered_ttl(rules: list[tuple[str, int | None]], layout: Layout) -> Column:
    """Time to live by the first filter that holds; the last filter must be INCLUDE."""
    if not rules or rules[-1][0].strip().upper() != "INCLUDE":
        raise ValueError("the last rule must be INCLUDE")
    out = F.lit(rules[-1][1]).cast("long")
    for text, ms in reversed(rules[:-1]):
        out = F.when(ecql(text, layout), F.lit(ms).cast("long")).otherwise(out)
    return out


class LiveTable:
    """The state kept as a table that each micro-batch replaces; queries read the last one."""

    def __init__(self, spark: SparkSession, path: str, names: Names = Names(), *, ttl: Callable[[], Column] | None = None, since: str | None = None, immediate: bool = False, persist: Callable[[DataFrame], None] | None = None, listeners: list[Callable[[str, DataFrame], None]] | None = None):
        """immediate: rows expire as they come, so listeners are told and nothing is held. persist: gets
        the rows that expire with a batch."""
        self.spark, self.path, self.names, self.ttl, self.listeners = spark, path.rstrip("/"), names, ttl, listeners or []
        self.since, self.immediate, self.persist = since, immediate, persist
        self.current: str | None = None

    def apply(self, batch: DataFrame, epoch: int) -> None:
        """Merge a batch; a repeated one changes nothing."""
        n = self.names
        batch.persist()
        try:
            old = self.spark.read.parquet(self.current).withColumn(n.op, F.lit("change")) if self.current else None
            both = batch if old is None else old.select(*batch.columns).unionByName(batch)
            now = F.lit(batch.agg(F.max(n.time)).first()[0]).cast("timestamp")
            if self.immediate:
                state, gone = both.drop(n.op).limit(0), batch.where(F.col(n.op) == "change").drop(n.op)
            else:
                life = {"now": now, "ttl": self.ttl() if self.ttl else None, "since": self.since}
                state, gone = latest_state(both, n, **life), latest_state(both, n, **life, expired=True)
            if self.persist:
                self.persist(gone)
            where = f"{self.path}/state-{epoch}-{uuid.uuid4().hex}"
            state.write.parquet(where)
            self.current = where
            for tell in self.listeners:
                for op in ("change", "delete", "clear"):
                    tell(op, batch.where(F.col(n.op) == op))
        finally:
            batch.unpersist()

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def query(self, text: str = "INCLUDE", layout: Layout | None = None) -> DataFrame:
        if self.current is None:
            raise LookupError("nothing has come yet")
        df = self.spark.read.parquet(self.current)
        return df.where(ecql(text, layout or Layout(df.schema)))


def merged_latest(hot: DataFrame, cold: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """Live and stored rows as one table: the latest of each id; of equal times the live one."""
    both = hot.withColumn("__rank", F.lit(1)).unionByName(cold.withColumn("__rank", F.lit(0)))
    rest = [c for c in both.columns if c != key]
    best = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(time, "__rank", tie)).alias("r"))
    return best.select(*[F.col(key) if c == key else F.col(f"r.{c}").alias(c) for c in hot.columns])


def windowed_counts(stream: DataFrame, time: str, key: str, size: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts by key and event-time window; rows later than ``late`` are dropped."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def sessions(df: DataFrame, time: str, key: str, gap: str) -> DataFrame:
    """Sessions of a key: runs of rows at most ``gap`` apart; for streams give a watermark first."""
    w = F.session_window(time, gap)
    return df.groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def playback(df: DataFrame, time: str, start: str, end: str, step_s: float) -> list[DataFrame]:
    """An interval's rows as batches of ``step_s`` seconds in order of event time."""
    from datetime import datetime, timedelta

    a, b = (datetime.fromisoformat(x.replace("Z", "+00:00")) for x in (start, end))
    out = []
    while a < b:
        nxt = min(b, a + timedelta(seconds=step_s))
        out.append(df.where((F.col(time) >= F.lit(a)) & (F.col(time) < F.lit(nxt))).orderBy(time))
        a = nxt
    return out


COMMIT, CONTINUE, PAUSE = "commit", "continue", "pause"


def process(stream: DataFrame, handler: Callable[[DataFrame], str], path: str, *, pause_s: float = 1.0, most_pauses: int = 1000, **trigger):
    """Hand rows to a handler in batches. It says COMMIT when it is done with them, CONTINUE to get
    them again with those of the next batch, PAUSE to get them again after a while. What it
    has not committed is kept under ``path``, with the stream's progress."""
    spark, path = stream.sparkSession, path.rstrip("/")
    held: list[str] = []

    def take(batch: DataFrame, epoch: int) -> None:
        where = f"{path}/held/{epoch}-{uuid.uuid4().hex}"
        batch.write.parquet(where)
        held.append(where)
        for _ in range(most_pauses):
            said = handler(spark.read.schema(batch.schema).parquet(*held))
            if said == COMMIT:
                held.clear()
            if said != PAUSE:
                return
            time.sleep(pause_s)
        raise TimeoutError("the handler has paused too often")

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{path}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def stream_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, *, within: str, late: str) -> DataFrame:
    """Rows of two streams with equal keys where left's time is at or up to ``within`` after right's;
    their columns but for the key must differ. State is kept no longer than ``late`` and ``within`` ask for."""
    a = left.withWatermark(left_time, late)
    b = right.withColumnRenamed(key, "__key").withWatermark(right_time, late)
    near = (F.col(key) == F.col("__key")) & (F.col(left_time) >= F.col(right_time)) & (F.col(left_time) <= F.col(right_time) + F.expr(f"interval {within}"))
    return a.join(b, near).drop("__key")
