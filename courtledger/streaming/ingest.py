"""The ingestion job: journal stream to the four stored tables.

Each micro-batch is decoded, stripped of bad events and numbered per home team in
journal order, then written four times. The numbered batch is in the shared
folder, so the writes share it and survive lost executors.

With the batch that reached it the state is stored: each team's last number, and
the set of journal numbers consumed from each team's journal, as intervals. A
batch that is run again starts from the same state, so its rows equal their first
copies. Rows whose journal number is in the set are passed over, whichever stream
consumed them; what arrives late, below numbers already read, is not in it and is
stored by any stream that meets it. Without a stored state the set is that of the
stored results' journal numbers. Rows are versioned by their journal number,
which no restart changes: the later event of a game wins.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from courtledger import schemas
from courtledger.functions.calendar import Markers, calendar_frame
from courtledger.league import TIME_ZONE
from courtledger.operators import events as maps
from courtledger.operators.numbers import complete_up_to, merged, runs, without
from courtledger.operators.sequence import numbered, resume_positions
from courtledger.operators.upsert import append_batch, compact, install_tables, read_latest, read_table
from courtledger.session import delete_folder, files, fresh_folder
from courtledger.sources import journal_source
from courtledger.sources.journal import PARTITION_SIZE, decode, unfinished, valid_events

# Fixed value: seconds between micro-batches.
BATCH_INTERVAL = "15 seconds"

# Bytes of journal files taken into one batch; what is more waits for the next.
BATCH_BYTES = 64 << 20

# Journal numbers taken into one batch of the journal source.
BATCH_ROWS = 500_000

# A batch stores its step of the state in a slot of its own: every team's position,
# and (team, lo, hi) of the numbers it consumed itself. Every MERGED-th step also
# holds what the steps before it held, back to its ``since`` (none: to the beginning),
# and so do MERGED such steps in turn: numbers are rewritten seldom, and a state is
# a chain of few steps. Steps that neither this state nor the one before it, which a
# batch run again starts from, still needs are deleted, so nothing piles up.
MERGED = 8
STATE = schemas.struct(
    "team string, position bigint, lo bigint, hi bigint, query string, batch_id bigint, step bigint, since bigint, slot int"
)


@dataclass(frozen=True)
class State:
    """What is known before a batch: positions (team, position), read (team, lo, hi), which may overlap, and its number.

    ``chain`` are the (step, since) that hold it, the newest first; ``spent`` are the
    slots of earlier steps that it does not need.
    """

    positions: DataFrame
    read: DataFrame
    step: int
    chain: tuple[tuple[int, int], ...] = ()
    spent: tuple[int, ...] = ()

    @property
    def consumed(self) -> DataFrame:
        """The numbers read, as the fewest intervals (team, lo, hi)."""
        return merged(self.read, "team")


def _merged_since(step: int) -> int:
    """The first step that ``step`` holds: itself, or as many as the power of MERGED that divides it."""
    width = 1
    while step % (width * MERGED) == 0:
        width *= MERGED
    return step - width + 1


@dataclass(frozen=True)
class Ingestion:
    """Where the job reads and writes.

    ``compact_every`` rewrites the periods written since to their latest rows
    after that many batches. ``partitions`` is the number of
    range partitions a batch is numbered in, by default
    ``spark.sql.shuffle.partitions``. ``checkpoint`` is the stream's own folder,
    by default beside the tables.
    """

    root: str
    markers: Markers
    payload_format: str = "json"
    zone: str = TIME_ZONE
    compact_every: int | None = None
    partitions: int | None = None
    checkpoint: str | None = None

    @property
    def state_path(self) -> str:
        return f"{self.root.rstrip('/')}/state"

    @property
    def checkpoint_path(self) -> str:
        return self.checkpoint or f"{self.root.rstrip('/')}/stream-checkpoint"

    def install(self, spark: SparkSession) -> None:
        install_tables(spark, self.root)
        spark.createDataFrame([], STATE).write.mode("ignore").partitionBy("slot").parquet(self.state_path)

    def state_before(self, spark: SparkSession, batch_id: int, query: str = "") -> State:
        """The newest state that another batch stored; at first, that of the stored results."""
        stored = spark.read.schema(STATE).parquet(self.state_path)
        steps = stored.select("step", F.coalesce("since", F.lit(0)).alias("since"), "slot", "query", "batch_id").distinct().collect()
        others = {r.step: r for r in steps if not (r["query"] == query and r.batch_id >= batch_id)}
        if others:
            step = max(others)
            held = {r.step: r for r in steps if r.step <= step}
            chain = [held[step]]
            while chain[-1].since > 1:
                chain.append(held[chain[-1].since - 1])
            newest = stored.where((F.col("step") == step) & (F.col("slot") == held[step].slot))
            known = stored.where(F.col("slot").isin([r.slot for r in chain]) & F.col("step").isin([r.step for r in chain]))
            return State(
                newest.where(F.col("position").isNotNull()).select("team", "position"),
                known.where(F.col("lo").isNotNull()).select("team", "lo", "hi", "step"), step,
                tuple((r.step, r.since) for r in chain),
                tuple(r.slot for r in held.values() if r not in chain),
            )
        results = read_latest(spark, schemas.RESULTS, self.root)
        periods = calendar_frame(spark, self.markers, self.zone)
        positions = resume_positions(results, results.select("team").distinct(), periods)
        return State(positions, runs(read_table(spark, schemas.RESULTS, self.root), "team", "event_seq").select("team", "lo", "hi", F.lit(0).cast("bigint").alias("step")), 0)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch; running it again changes no latest view."""
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or ""
        before = self.state_before(spark, batch_id, query)
        consumed = before.read.withColumnRenamed("team", "persistence_id")
        fresh = without(batch, consumed, "persistence_id", "sequence_nr")
        result = F.col("event.result")
        events = valid_events(decode(fresh, payload_format=self.payload_format)).select(
            result["homeTeam"].alias("home_team"),
            "sequence_nr",
            # No table keeps the team totals.
            F.struct(result.dropFields("homeTotal", "awayTotal").alias("result")).alias("event"),
        )
        folder = fresh_folder(spark, "batch")
        try:
            rows, reached = numbered(
                events, "home_team", ["sequence_nr"],
                positions=before.positions, costly_input=True, partitions=self.partitions, folder=folder,
            )
            # The state is written aside meanwhile and counts once the rows are stored.
            write_state = inheritable_thread_target(spark)(self._write_state)
            with ThreadPoolExecutor(1) as pool:
                aside = pool.submit(write_state, before, batch, reached.withColumnRenamed("home_team", "team"), batch_id, query)
                self._append(rows, batch_id, query)
            self._commit_state(spark, before, aside.result())
        finally:
            delete_folder(spark, folder)
        if self.compact_every and (batch_id + 1) % self.compact_every == 0:
            for table in schemas.TABLES:
                compact(spark, table, self.root)

    def _append(self, numbered_events: DataFrame, batch_id: int, query: str) -> None:
        """The numbered events of a batch, written to the four tables."""
        spark = numbered_events.sparkSession
        rows = maps.event_frame(numbered_events, self.markers, self.zone).withColumn(
            "event_seq", F.col("sequence_nr")
        )
        outputs = (
            (schemas.RESULTS, maps.to_results(rows, "event_seq")),
            (schemas.LEADERS, maps.to_box_lines(rows, "event_seq", numbered=True)),
            (schemas.PLAYERS, maps.to_player_lines(rows, "event_seq", numbered=True)),
            (schemas.DAILY, maps.to_daily(rows, "event_seq", zone=self.zone)),
        )
        # Side by side: a write of few tasks leaves the rest of the cluster free.
        append = inheritable_thread_target(spark)(append_batch)
        with ThreadPoolExecutor(len(outputs)) as pool:
            writes = [
                pool.submit(append, output, table, self.root, batch_id, query)
                for table, output in outputs
            ]
        for write in writes:
            write.result()

    def _write_state(
        self, before: State, batch: DataFrame, reached: DataFrame, batch_id: int, query: str
    ) -> str:
        """The state after the batch, in a folder that no reader of states looks into."""
        step = before.step + 1
        positions = before.positions.unionByName(reached).groupBy("team").agg(F.max("position").alias("position"))
        read = runs(batch, "persistence_id", "sequence_nr").withColumnRenamed("persistence_id", "team")
        since = _merged_since(step)
        earlier = [s for s in before.chain if s[0] >= since]
        if earlier or not before.step:
            since = min([since, *(s for _, s in earlier)])
            read = merged(before.read.where(F.col("step") >= (since if before.step else 0)).select("team", "lo", "hi").unionByName(read), "team")
        nothing = F.lit(None).cast("bigint")
        stored = positions.withColumns({"lo": nothing, "hi": nothing}).unionByName(
            read.withColumn("position", nothing)
        ).withColumns({
            "query": F.lit(query), "batch_id": F.lit(batch_id).cast("bigint"),
            "step": F.lit(step).cast("bigint"), "since": F.lit(since).cast("bigint"),
        })
        aside = f"{self.state_path}/_aside-{uuid.uuid4().hex}"
        stored.hint("rebalance").write.parquet(aside)
        return aside

    def _commit_state(self, spark: SparkSession, before: State, aside: str) -> None:
        """Put the state in its slot, in place of that of an earlier try, and delete what is needed no more."""
        slot = f"{self.state_path}/slot={before.step + 1}"
        delete_folder(spark, slot)
        if spark.read.parquet(aside).isEmpty():
            delete_folder(spark, aside)
        else:
            system, place = files(spark, aside)
            if not system.rename(place, files(spark, slot)[1]):
                raise OSError(f"could not rename {aside} to {slot}")
        for spent in before.spent:
            delete_folder(spark, f"{self.state_path}/slot={spent}")

    def unread(self, journal: DataFrame) -> DataFrame:
        """A journal, or a stream of it, without the partitions that are wholly consumed."""
        spark = journal.sparkSession
        self.install(spark)
        consumed = self.state_before(spark, 0).consumed
        return unfinished(journal, complete_up_to(consumed, "team"))

    def start(
        self, journal: DataFrame, available_now: bool = False, interval: str = BATCH_INTERVAL
    ) -> StreamingQuery:
        """Run the job on a streaming journal; ``available_now`` stops when caught up."""
        self.install(journal.sparkSession)
        writer = journal.writeStream.foreachBatch(self.process).option(
            "checkpointLocation", self.checkpoint_path
        )
        trigger = {"availableNow": True} if available_now else {"processingTime": interval}
        return writer.trigger(**trigger).start()


def read_journal_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType = schemas.JOURNAL,
    max_files: int | None = None,
    max_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """A folder of Parquet journal files as a stream, all teams in one source.

    A batch takes about ``max_bytes`` of files, or ``max_files`` if that is given;
    the rest waits, nothing is left out. A team's rows come in journal order from
    batch to batch.
    """
    reader = spark.readStream.schema(schema)
    bound = {"maxBytesPerTrigger": max_bytes} if max_files is None else {"maxFilesPerTrigger": max_files}
    return reader.options(**bound).parquet(path)


def read_journal_source(
    spark: SparkSession,
    path: str,
    partition_size: int = PARTITION_SIZE,
    max_rows: int = BATCH_ROWS,
    progress: str | None = None,
    gaps: str = "wait",
) -> DataFrame:
    """A journal laid out by team and partition as a stream with offsets per team.

    Every team comes in the order of its numbers, and finished partitions are
    neither listed nor read. With ``progress``, a folder of the query's own, a batch
    takes at most ``max_rows`` numbers; without it, all that are there.
    """
    journal_source.register(spark)
    reader = spark.readStream.format(journal_source.NAME).option("partitionSize", partition_size).option("gaps", gaps)
    if progress is not None:
        reader = reader.option("progress", progress).option("maxRowsPerTrigger", max_rows)
    return reader.load(path)
