"""Streams of samples: bounded queues, version staleness, count windows, token buckets and turn machines.

Time here is logical - positions and parameter versions - so watermarks don't apply; state is kept by key or by dense
position.  Sources are file streams, replayed with the available-now trigger; sinks go through ``foreachBatch`` or to
Parquet with a checkpoint, so a restart goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_path, written


def source(spark: SparkSession, path: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    """A file stream; the number of files a trigger is its back-pressure."""
    head, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{head}/[{name[0]}]{name[1:]}")


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run all that is available to Parquet, exactly once under a checkpoint, and read it back."""
    spark = stream.sparkSession
    out = shared_path(spark, name)
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def each_batch(stream: DataFrame, name: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Drive ``handle`` with every micro-batch that is available."""
    at = shared_path(stream.sparkSession, name)
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()


class VersionClock:
    """The parameter version that samples are stamped with, and the staleness budget that goes with it."""

    def __init__(self, required: int, staleness: float = 0.0, sync_every: int = 1):
        self.version, self.required, self.staleness, self.sync_every = 0, required, staleness, sync_every
        self.in_flight = 0

    @property
    def limit(self) -> int:
        """How many samples may be made between synchronizations."""
        return int(self.required * (self.staleness + 1) * self.sync_every)

    def produced(self, n: int) -> None:
        self.in_flight += n

    def advance(self, queued: int, active: int = 0) -> int:
        """A new version: what is queued or still being made counts against its budget."""
        self.version += 1
        self.in_flight = queued + active
        return self.version

    def should_pause(self, queued: int, capacity: int) -> bool:
        return queued >= capacity or self.in_flight >= self.limit


class BoundedQueue:
    """First in, first out, over a table of numbered rows; when full, the oldest rows go.

    Rows are appended as Parquet with dense sequence numbers, a folder for each ``BLOCK`` of them, and folders that lie
    wholly below the head are deleted.  The queue itself is a few numbers, which are written beside the rows after every
    step, so a queue that is opened at the same path goes on where it stopped.
    """

    BLOCK = 100_000

    def __init__(self, spark: SparkSession, capacity: int, schema, name: str = "queue", path: str | None = None):
        self.spark, self.capacity, self.path, self.schema = spark, capacity, path or shared_path(spark, name), schema
        self.head = self.tail = self.dropped = self.produced = self.consumed = self.version = self._step = 0
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._at = lambda part="": jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        self._fs = self._at().getFileSystem(conf)
        if path and self._fs.exists(self._at("state")):
            names = [s.getPath().getName() for s in self._fs.listStatus(self._at("state"))]
            self._step = max(int(n) for n in names if self._fs.exists(self._at(f"state/{n}/_SUCCESS")))
            kept = spark.read.schema(self._numbers).json(f"{self.path}/state/{self._step}").first()
            for k, v in kept.asDict().items():
                setattr(self, k, v)

    _numbers = "head long, tail long, dropped long, produced long, consumed long, version long"

    def _save(self) -> None:
        """The numbers as one more state; the one before goes when this one is there.  Dropped blocks go, too."""
        names = [c.split()[0] for c in self._numbers.split(", ")]
        self._step += 1
        self.spark.createDataFrame([tuple(getattr(self, k) for k in names)], self._numbers).coalesce(1).write.json(f"{self.path}/state/{self._step}")
        self._fs.delete(self._at(f"state/{self._step - 1}"), True)
        if self.tail:
            for s in self._fs.listStatus(self._at("rows")):
                name = s.getPath().getName()
                if name.startswith("_block=") and (int(name[7:]) + 1) * self.BLOCK <= self.head:
                    self._fs.delete(s.getPath(), True)

    def put(self, batch: DataFrame, order: list[str]) -> bool:
        """Append the rows in ``order``; False if older rows had to go."""
        from ..operators.frame import with_row_id

        n = batch.count()
        if not n:
            return True
        numbered = with_row_id(batch, order, "_seq").withColumn("_seq", F.col("_seq") + F.lit(self.tail).cast("long"))
        kept = numbered.filter(F.col("_seq") >= self.tail + n - self.capacity)  # what the batch itself pushes out is not written
        kept.select("_seq", *batch.columns, F.expr(f"_seq div {self.BLOCK}").alias("_block")).write.mode("append").partitionBy("_block").parquet(f"{self.path}/rows")
        self.tail += n
        self.produced += n
        over = max(0, self.tail - self.head - self.capacity)
        self.head += over
        self.dropped += over
        self._save()
        return not over

    def get(self, n: int) -> DataFrame:
        """Take the next ``n`` rows (or what there is), with their numbers."""
        take = min(n, len(self))
        lo, self.head = self.head, self.head + take
        self.consumed += take
        if not self.tail:
            return self.spark.createDataFrame([], self.schema).withColumn("_seq", F.lit(0).cast("long"))
        rows = self.spark.read.schema(f"_seq long, {self._ddl()}, _block long").parquet(f"{self.path}/rows")
        out = rows.filter(F.col("_block").between(lo // self.BLOCK, self.head // self.BLOCK) & F.col("_seq").between(lo, self.head - 1)).drop("_block")
        out = written(out, "taken")  # before blocks below the head go
        self._save()
        return out

    def _ddl(self) -> str:
        from pyspark.sql.types import StructType

        fields = self.schema.fields if isinstance(self.schema, StructType) else StructType.fromDDL(self.schema).fields
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def clear(self) -> None:
        self.head = self.tail
        self._save()

    def advance(self, version: int) -> None:
        """The parameter version that the statistics tell."""
        self.version = version
        self._save()

    def __len__(self) -> int:
        return self.tail - self.head

    def statistics(self) -> dict[str, int]:
        return {"size": len(self), "produced": self.produced, "consumed": self.consumed, "dropped": self.dropped, "version": self.version}

    def memory(self) -> dict[str, int]:
        """Bytes of the rows' files, and of a row by their number."""
        total = sum(s.getLen() for s in self._files()) if self.tail else 0
        return {"bytes": total, "bytes_per_row": total // max(1, len(self))}

    def _files(self):
        found = self._fs.listFiles(self._at("rows"), True)
        while found.hasNext():
            yield found.next()


def bucket_step(level: float, now: float, cost: float, at: float, rate: float, capacity: float) -> tuple[float, float]:
    """When a request may go, and the level behind it."""
    level = min(capacity, level + max(0.0, at - now) * rate)
    now = max(now, at)
    need = min(cost, capacity)
    if level < need:
        now += (need - level) / rate
        level = need
    return now, level - cost


def token_bucket(costs: list[float], times: list[float], rate: float, capacity: float) -> list[float]:
    """When each request may go, in order: fractional refill up to capacity; one above capacity waits for a full bucket and
    leaves a debt."""
    level, now, out = capacity, times[0] if times else 0.0, []
    for cost, at in zip(costs, times, strict=True):
        now, level = bucket_step(level, now, cost, at, rate, capacity)
        out.append(now)
    return out


def rate_limited(df: DataFrame, key: str, order: str, cost: str, time: str, rate: float, capacity: float) -> DataFrame:
    """Token buckets by key: (key, ord, at).  A key's requests pass in order, a batch at a time; only its level and its
    clock are held."""
    use = df.select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("ord"), F.col(cost).cast("double").alias("cost"), F.col(time).cast("double").alias("time"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple = (None, 0.0, 0.0)  # the key that may go on, its level and its clock
        for f in frames:
            out = []
            for k, c, t in zip(f["key"].tolist(), f["cost"].tolist(), f["time"].tolist(), strict=True):
                _, level, now = held if held[0] == (k,) else (None, capacity, t)
                at, level = bucket_step(level, now, c, t, rate, capacity)
                held = ((k,), level, at)
                out.append(at)
            yield pd.DataFrame({"key": f["key"], "ord": f["ord"], "at": out})

    return use.repartition("key").sortWithinPartitions("key", "time", "ord").mapInPandas(run, "key string, ord long, at double")


def resumed_first(df: DataFrame, resumed: str, order: list[str]) -> DataFrame:
    """Rows numbered for work: samples that were cancelled and resumed come first, each kind in its order."""
    from ..operators.frame import with_row_id

    return with_row_id(df.withColumn("_late", (~F.coalesce(F.col(resumed), F.lit(False))).cast("int")), ["_late", *order], "turn").drop("_late")


def stamped(df: DataFrame, clock: VersionClock) -> DataFrame:
    """Rows with the parameter version that they are made under."""
    return df.withColumn("param_version", F.lit(clock.version).cast("long"))


def versioned(df: DataFrame, row: str, batch: int, clock: VersionClock) -> DataFrame:
    """Rows numbered by ``row`` with the version under which a caller makes them who takes batches of ``batch`` rows and
    advances the clock when it says to pause."""
    per_version = -(-clock.limit // batch)
    return df.withColumn("param_version", (F.lit(clock.version) + F.expr(f"{row} div {batch} div {per_version}")).cast("long"))


#: Turn machine of an agent: (state, event) -> state.  Anything else leaves the state as it is.
TURNS = {("PENDING", "prompt"): "GENERATING", ("GENERATING", "tool_call"): "PROCESSING_TOOLS", ("GENERATING", "answer"): "INTERACTING", ("GENERATING", "stop"): "TERMINATED", ("PROCESSING_TOOLS", "tool_result"): "GENERATING", ("INTERACTING", "user"): "GENERATING", ("INTERACTING", "stop"): "TERMINATED"}


def turn_states(df: DataFrame, key: str, order: str, event: str) -> DataFrame:
    """The last state, and the number of generations, of each key after its events in order (a fold over its array)."""
    g = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(event).alias("e")))).alias("_l"))
    zero = F.struct(F.lit("PENDING").alias("s"), F.lit(0).alias("n"))

    def step(a, x):
        to = a["s"]
        for (s, e), t in TURNS.items():
            to = F.when((a["s"] == s) & (x["e"] == e), t).otherwise(to)
        return F.struct(to.alias("s"), (a["n"] + ((to == "GENERATING") & (a["s"] != "GENERATING")).cast("int")).alias("n"))

    return g.select(key, F.aggregate("_l", zero, step).alias("_s")).select(key, F.col("_s.s").alias("state"), F.col("_s.n").alias("generations"))


def improvement_penalty(df: DataFrame, key: str, order: str, reward: str, penalty: float = -0.05) -> DataFrame:
    """0 where a reward beats all before it, else the penalty."""
    before = F.max(reward).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("penalty", F.when(F.col(reward) > F.coalesce(before, F.lit(0.0)), 0.0).otherwise(penalty))


def step_windows(df: DataFrame, step: str, k: int) -> DataFrame:
    """Tumbling windows of k steps."""
    return df.withColumn("window", F.expr(f"{step} div {k}"))


# --- queries ---
def _events(spark, sf_dir) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    return source(spark, path, spark.read.parquet(path).schema)


def m10_step_windows(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return step_windows(e.withColumn("step", F.col("event_id")), "step", 250).groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.max("user_id").alias("top"))


def m12_stream_aggregate(spark, sf_dir):
    """A restartable aggregate of a stream, drained: counts by type."""
    e = _events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))
    return drained_complete(e, "counts")


def drained_complete(stream: DataFrame, name: str) -> DataFrame:
    """As ``drained`` for an aggregate: every batch replaces the result."""
    spark, out = stream.sparkSession, shared_path(stream.sparkSession, name)
    q = stream.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def m01_bounded_queue(spark, sf_dir):
    """All events in two halves through a queue of 500: the oldest are pushed out; then 300 are taken."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    half = e.agg(F.max("event_id")).first()[0] // 2
    q = BoundedQueue(spark, 500, e.schema)
    q.put(e.filter(F.col("event_id") < half), ["event_id"])
    q.put(e.filter(F.col("event_id") >= half), ["event_id"])
    return q.get(300).select(F.col("_seq").alias("seq"), "event_id", "user_id")


def m03_statistics(spark, sf_dir):
    """What a queue tells after puts, gets, a new version and a restart at the same path."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    n = e.count()
    q = BoundedQueue(spark, 2 * n, e.schema)
    q.put(e, ["event_id"])
    q.get(n // 4)
    again = BoundedQueue(spark, 2 * n, e.schema, path=q.path)
    again.advance(3)
    again.put(e, ["event_id"])
    rest = again.get(n)  # it goes on behind what the first one has given
    told = {**again.statistics(), "next": rest.agg(F.min("_seq")).first()[0], "full": int(again.memory()["bytes"] > 0)}
    return spark.createDataFrame(sorted(told.items()), "name string, value long")


def m07_resumed_first(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("user_id") % 13 == 0).alias("resumed"))
    return resumed_first(e, "resumed", ["event_id"]).select("event_id", "turn")


def m24_restarted(spark, sf_dir):
    """A stream that is stopped after its first files and started again under its checkpoint sees every row once."""
    root = shared_path(spark, "restart")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    schema = e.schema
    for part in range(2):
        e.filter(F.col("event_id") % 2 == part).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(schema).parquet(f"{root}/in")
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(f"{root}/out")
        q.awaitTermination()
        q.stop()
    return spark.read.schema(schema).parquet(f"{root}/out").groupBy("user_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("events"))


def m21_side_channel(spark, sf_dir):
    """One stream, two sinks of a micro-batch: validation rows go beside the others."""
    root = shared_path(spark, "sides")

    def handle(batch: DataFrame, number: int) -> None:
        for name, part in (("train", batch.filter("user_id % 5 <> 0")), ("valid", batch.filter("user_id % 5 = 0"))):
            part.select("event_id").write.mode("overwrite").parquet(f"{root}/{name}/{number}")

    each_batch(_events(spark, sf_dir), "side-checkpoint", handle)
    read = lambda n: spark.read.schema("event_id long").option("recursiveFileLookup", "true").parquet(f"{root}/{n}").agg(F.lit(n).alias("sink"), F.count("*").alias("n"), F.sum("event_id").alias("events"))
    return read("train").unionByName(read("valid"))


def m06_versions(spark, sf_dir):
    """Batches of 1,000 events, each stamped with the version under which it is made, as the staleness budget allows."""
    from ..operators.frame import with_row_id

    e = with_row_id(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id"), ["event_id"])
    done = versioned(e, "row_id", 1000, VersionClock(1000, staleness=0.5))
    return done.groupBy("param_version").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


def m14_rate_limited(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "event_id", (F.col("user_id") % 7 + 1).alias("cost"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return rate_limited(e, "event_type", "event_id", "cost", "t", 0.5, 10.0).withColumn("at", F.round("at", 3))


def m15_turn_states(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    kind = F.when(F.col("turn") == 0, "prompt").when(F.col("role") == "assistant", "answer").otherwise("user")
    return turn_states(c.withColumn("event", kind), "conv_id", "turn", "event")


def m17_improvement(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value")
    return improvement_penalty(e, "user_id", "event_id", "value").select("event_id", "penalty")


QUERIES = {f.__name__: f for f in (m03_statistics, m06_versions, m07_resumed_first, m21_side_channel, m24_restarted, m01_bounded_queue, m10_step_windows, m12_stream_aggregate, m14_rate_limited, m15_turn_states, m17_improvement)}
ORACLES = {
    "m01_bounded_queue": "SELECT i AS seq, event_id, user_id FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events) WHERE i BETWEEN n - 500 AND n - 201",
    "m03_statistics": "SELECT unnest(['size', 'produced', 'consumed', 'dropped', 'version', 'next', 'full']) AS name, unnest([2 * n - n // 4 - n, 2 * n, n // 4 + n, 0, 3, n // 4, 1]) AS value FROM (SELECT count(*) AS n FROM events)",
    "m06_versions": "SELECT r // 1000 // 2 AS param_version, count(*) AS n, min(event_id) AS first FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS r FROM events) GROUP BY 1",
    "m07_resumed_first": "SELECT event_id, row_number() OVER (ORDER BY user_id % 13 <> 0, event_id) - 1 AS turn FROM events",
    "m14_rate_limited": "WITH e AS (SELECT event_type, event_id, (user_id % 7 + 1)::DOUBLE AS c, epoch_us(ts) / 1e6 AS t FROM events), l AS (SELECT event_type, list({'id': event_id, 'c': c, 't': t, 'now': t, 'lvl': 10.0::DOUBLE, 'out': [t]} ORDER BY t, event_id) AS l FROM e GROUP BY 1), f AS (SELECT event_type, list_transform(l, lambda x: x.id) AS ids, list_reduce(list_concat([{'id': -1::BIGINT, 'c': 0.0::DOUBLE, 't': l[1].t, 'now': l[1].t, 'lvl': 10.0::DOUBLE, 'out': []::DOUBLE[]}], l), lambda a, x: {'id': x.id, 'c': x.c, 't': x.t, 'now': greatest(a.now, x.t) + greatest(least(x.c, 10.0) - least(10.0, a.lvl + greatest(0.0, x.t - a.now) * 0.5), 0.0) / 0.5, 'lvl': greatest(least(x.c, 10.0), least(10.0, a.lvl + greatest(0.0, x.t - a.now) * 0.5)) - x.c, 'out': list_append(a.out, greatest(a.now, x.t) + greatest(least(x.c, 10.0) - least(10.0, a.lvl + greatest(0.0, x.t - a.now) * 0.5), 0.0) / 0.5)}) AS r FROM l) SELECT event_type AS key, unnest(ids) AS ord, round(unnest(r.out), 3) AS at FROM f",
    "m21_side_channel": "SELECT CASE WHEN user_id % 5 = 0 THEN 'valid' ELSE 'train' END AS sink, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS events FROM events GROUP BY 1",
    "m24_restarted": "SELECT user_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS events FROM events GROUP BY 1",
    "m10_step_windows": "SELECT event_id // 250 AS window, count(*) AS n, max(user_id) AS top FROM events GROUP BY 1",
    "m12_stream_aggregate": "SELECT event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1",
    "m15_turn_states": "WITH t AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'prompt' WHEN role = 'assistant' THEN 'answer' ELSE 'user' END AS e FROM conversations) SELECT conv_id, CASE WHEN arg_max(e, turn) = 'answer' THEN 'INTERACTING' ELSE 'GENERATING' END AS state, count(*) FILTER (e <> 'answer' AND (turn = 0 OR b = 'answer'))::INT AS generations FROM (SELECT *, lag(e) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM t) GROUP BY 1",
    "m17_improvement": "SELECT event_id, CASE WHEN value > coalesce(max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) THEN 0.0 ELSE -0.05 END::DOUBLE AS penalty FROM events",
}
