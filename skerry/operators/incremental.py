"""Problem 6: each run takes exactly the entries no successful run has taken, by a ledger of work items.

A work item is ``pending``, ``leased`` (with an expiry and a fencing token) or ``done``. The
ledger of a consumer holds two kinds of items in a shared folder:

- the runs of a journal it takes over (``Ledger.adopt``): such an item covers the rows of its log that had arrived when the run
  started, up to the run's number; done ones have processed them, leased ones hold them, pending ones have given them back;
- the items of its own plans (``Ledger.plan``): each open entry is put into one item for good, so an entry
  that arrives late never falls into an item that is done.

``Ledger.open`` gives the entries that no item holds, planned into pending items: the next run.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..files import create_exclusive, names, read_bytes
from ..functions import change_records as cr
from ..session import scratch_path

PENDING, LEASED, DONE = "pending", "leased", "done"
#: Names under which the ledger keeps the lists of its plans and of the journals it has taken over; no item's name has a blank.
PLANS, JOURNALS = "plans made", "journals taken over"
#: A run that has said nothing for so long has lost its lease.
LEASE_SECONDS = 3600
#: Length of the time slices into which a log is cut for the look-up of covering runs, so that a log with a large share of all rows is many tasks' work.
SLICE_SECONDS = 6 * 3600
#: Large slices up to which their list is broadcast (a few MB); beyond, it is joined by shuffle.
BROADCAST_ROWS = 50_000
#: Rows of a slice that one task looks up; a slice with more is spread over several, each with the slice's runs.
SLICE_ROWS = 2_000_000
#: Slices of rows without arrival, which no run covers: below any time, and many, so that they spread.
NO_TIME, NO_TIME_SLICES = -(2**40), 1009
#: Reach of a live lease without a number: it holds every entry that had arrived.
EVERYTHING = 2**63 - 1


class StaleToken(RuntimeError):
    """The writer's lease has expired and another holds the item, or it is done."""


@dataclass(frozen=True)
class Lease:
    item: str
    token: int
    expires: float


class Ledger:
    """Items of work in a shared folder: ``events/<item>/<number>.json``, the highest number being the state.

    An event is created exclusively, so of two workers that take one step of an item one
    fails and reads again. The number of a lease's event is its fencing token: ``complete``
    is refused unless the item's newest event is that lease. An item's output path follows
    from the item alone, so a retry overwrites what a failed attempt left.
    """

    def __init__(self, spark: SparkSession, path: str, lease_seconds: float = LEASE_SECONDS):
        self.spark, self.path, self.lease_seconds = spark, path.rstrip("/"), lease_seconds

    def _create(self, item: str, number: int, event: dict) -> bool:
        return create_exclusive(self.spark, f"{self.path}/events/{item}/{number:08d}.json", json.dumps(event | {"item": item, "number": number}).encode())

    def _events(self, item: str) -> list[tuple[int, dict]]:
        folder = f"{self.path}/events/{item}"
        return [(int(n[:-5]), json.loads(read_bytes(self.spark, f"{folder}/{n}"))) for n in names(self.spark, folder) if n.endswith(".json") and not n.startswith(".")]

    def _note(self, name: str, make) -> None:
        """Adds the folder ``make(folders so far)`` to a list; of two writers at a time one makes its part again."""
        while True:
            known = self._events(name)
            if self._create(name, len(known) + 1, {"folder": make([e["folder"] for _, e in known])}):
                return

    def _folders(self, name: str) -> list[str]:
        return [e["folder"] for _, e in self._events(name)]

    # -- runs of a journal ------------------------------------------------------------------

    def adopt(self, journal: DataFrame) -> None:
        """Takes over a journal: each of its runs becomes an item with the state and token of its newest event.

        Taking a journal over again, with more rows, replaces the states of the runs it has.
        """
        folder = f"{self.path}/journals/{uuid.uuid4().hex}"
        run_states(journal).write.parquet(folder)
        self._note(JOURNALS, lambda _: folder)

    def covering(self, now: Column | None = None) -> DataFrame:
        """(index_name, generation, started_at, state, last_sequence_number) of the journal items that hold entries: done ones, and those leased at ``now``."""
        states = None
        for k, folder in enumerate(self._folders(JOURNALS)):
            part = self.spark.read.parquet(folder).withColumn("journal", F.lit(k))
            states = part if states is None else states.unionByName(part)
        if states is None:
            return self.spark.createDataFrame([], "index_name string, generation bigint, started_at timestamp_ntz, state string, last_sequence_number bigint")
        if len(self._folders(JOURNALS)) > 1:
            newest = Window.partitionBy("run_id").orderBy(F.desc("journal"))
            states = states.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1")
        live = F.lit(False) if now is None else (F.col("state") == LEASED) & (F.col("expires").cast("timestamp") > now)
        reach = F.when(F.col("state") == DONE, F.col("last_sequence_number")).when(live, F.coalesce("last_sequence_number", F.lit(EVERYTHING)))
        return states.where((F.col("state") == DONE) | live).select("index_name", "generation", "started_at", "state", reach.alias("last_sequence_number"))

    # -- plans ------------------------------------------------------------------------------

    def planned(self) -> DataFrame:
        """(index_name, sequence_number, item): every entry that any plan has put into an item."""
        return self._planned(self._folders(PLANS))

    def _planned(self, folders: list[str]) -> DataFrame:
        schema = "index_name string, sequence_number bigint, item string"
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def plan(self, entries: DataFrame, item_entries: int = 10_000, now: float | None = None) -> DataFrame:
        """``entries`` (index_name, sequence_number, …; one row each) with their ``item``, without those of items that are done or leased at ``now``.

        An entry that an earlier plan put into an item stays there; only the others make new
        items, which are kept before they are given out. So no entry is ever in two items, and
        what arrives after its neighbours were done is in an item of its own. Of two planners
        at a time one is refused its plan and plans again. Without ``now`` every lease counts as expired.
        """
        made: list[str] = []

        def make(folders: list[str]) -> str:
            folder = f"{self.path}/plans/{uuid.uuid4().hex}"
            new = entries.join(self._planned(folders), ["index_name", "sequence_number"], "left_anti") if folders else entries
            named_items(new, item_entries).write.parquet(folder)
            made[:] = [*folders, folder]
            return folder

        self._note(PLANS, make)
        if len(made) == 1:
            found = self.spark.read.parquet(made[0])
        else:
            found = entries.join(self._planned(made), ["index_name", "sequence_number"])
        states = self.states(now)
        return found if states is None else found.join(states.where(F.col("state") != PENDING).select("item"), "item", "left_anti")

    def open(self, wal: DataFrame, now: Column | None = None, item_entries: int = 10_000) -> DataFrame:
        """The entries that no item holds, with ``item``, ``generation``, ``rows`` and ``stretch``, as a plan of pending items.

        A journal item holds an entry if it covers a row of it (see ``unprocessed``), a planned
        item if it is done, or leased at ``now``. Without ``now`` every lease counts as expired.
        """
        entries = with_stretch(unprocessed(wal, self.covering(now)), item_entries)
        seconds = None if now is None else self.spark.range(1).select(now.cast("timestamp").cast("double")).first()[0]
        return self.plan(entries, item_entries, seconds)

    def states(self, now: float | None = None) -> DataFrame | None:
        """(item, state, token) of all items of plans, by their newest event; an expired lease is pending. None where no event is."""
        if not any(n not in (PLANS, JOURNALS) for n in names(self.spark, f"{self.path}/events")):
            return None
        rows = self.spark.read.schema("item string, number bigint, state string, expires double").option("recursiveFileLookup", "true").json(f"{self.path}/events")
        newest = rows.where(F.col("state").isNotNull()).groupBy("item").agg(F.max_by(F.struct("state", "expires", "number"), "number").alias("e"))
        over = F.lit(True) if now is None else F.col("e.expires") <= now
        state = F.when((F.col("e.state") == LEASED) & over, PENDING).otherwise(F.col("e.state"))
        return newest.select("item", state.alias("state"), F.col("e.number").alias("token"))

    # -- work -------------------------------------------------------------------------------

    def add(self, items: list[str]) -> int:
        """Registers items that aren't known yet; adding one again changes nothing."""
        return sum(self._create(i, 0, {"state": PENDING}) for i in items)

    def state(self, item: str, now: float) -> tuple[str, int]:
        """State and number of the newest event; an expired lease is pending again."""
        events = self._events(item)
        if not events:
            raise KeyError(item)
        number, event = events[-1]
        if event["state"] == LEASED and event["expires"] <= now:
            return PENDING, number
        return event["state"], number

    def lease(self, item: str, owner: str, now: float) -> Lease | None:
        """A lease, or None where the item is done or held, or another worker was faster."""
        state, number = self.state(item, now)
        if state != PENDING:
            return None
        expires = now + self.lease_seconds
        ok = self._create(item, number + 1, {"state": LEASED, "owner": owner, "expires": expires})
        return Lease(item, number + 1, expires) if ok else None

    def complete(self, lease: Lease) -> None:
        """Marks the item done, once; a stale token raises."""
        events = self._events(lease.item)
        number, event = events[-1]
        if event["state"] == DONE and event["token"] == lease.token:
            return
        if number != lease.token or not self._create(lease.item, number + 1, {"state": DONE, "token": lease.token}):
            raise StaleToken(f"{lease.item}: token {lease.token}, newest event {number}")

    def release(self, lease: Lease) -> None:
        """Gives a failed item back at once."""
        self._create(lease.item, lease.token + 1, {"state": PENDING})

    def output_path(self, item: str) -> str:
        return f"{self.path}/out/{item}"

    def run(self, items: list[str], work, owner: str, now) -> list[str]:
        """Leases and works on each pending item; ``work(item, path)`` writes to the item's path. Returns those done here."""
        self.add(items)
        did = []
        for item in items:
            lease = self.lease(item, owner, now())
            if lease is None:
                continue
            try:
                work(item, self.output_path(item))
            except Exception:
                self.release(lease)
                raise
            self.complete(lease)
            did.append(item)
        return did


def run_states(runs: DataFrame, now: Column | None = None, lease_seconds: int = LEASE_SECONDS) -> DataFrame:
    """One row per run of a journal: (run_id, index_name, generation, started_at, state, token, expires, last_sequence_number).

    The journal's rows are the item's events: a run takes its lease by starting (until
    ``expires``; at ``now``, where it is given, an expired one is pending), ``committed`` completes it, ``rolled_back`` (both in any letter case) gives it back for good, whatever
    else is said, and any other ending gives it back too. Its number is the highest of its committed rows. The token is
    the run's id: each run is an item of its own, so no other writer's token can be newer and no
    commit is stale. Rows of null run are left out.
    """
    status = F.lower("status")
    states = runs.where("run_id is not null").groupBy("run_id").agg(
        F.first("index_name", True).alias("index_name"),
        F.first("generation", True).alias("generation"),
        F.min("started_at").alias("started_at"),
        F.max(status == "committed").alias("committed"),
        F.max(status == "rolled_back").alias("undone"),
        F.min(F.coalesce(status == "running", F.lit(False))).alias("open"),
        F.max(F.when(status == "committed", F.col("last_sequence_number"))).alias("last_sequence_number"),
    )
    done = F.coalesce("committed", F.lit(False)) & ~F.coalesce("undone", F.lit(False))
    until = F.col("started_at") + F.make_interval(secs=F.lit(lease_seconds))
    state = F.when(done, DONE).when(F.col("open") if now is None else F.col("open") & (until > now), LEASED).otherwise(PENDING)
    expires = F.when(state == LEASED, until)
    return states.select("run_id", "index_name", "generation", "started_at", state.alias("state"), F.col("run_id").alias("token"), expires.alias("expires"), "last_sequence_number")


def readable_entries(wal: DataFrame) -> DataFrame:
    """Rows whose record is one complete JSON object, mapping announcements included."""
    wal = wal.select("index_name", "generation", "sequence_number", "received_at", "record")
    return cr.parsed(wal, "record", "_parsed").where("_parsed is not null").drop("_parsed")


def unprocessed(wal: DataFrame, states: DataFrame, slice_seconds: int = SLICE_SECONDS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(index_name, sequence_number, generation, rows) of the entries of which no row is covered; generation is the last one seen.

    ``states`` (index_name, generation, started_at, state, last_sequence_number) are runs; those done have processed and those
    leased hold what they cover. A row is covered by a run of its log that started at or after the row arrived and
    reached its number: that is, if the highest number among the log's later runs is at least
    its own. That running maximum is taken in two steps: by time slice over the runs alone, then within
    each slice over its rows and runs, with the later slices' maximum carried in as one more
    run. A log of any size is thus spread over its slices, and a slice of more than ``slice_rows`` rows over parts that each have all its runs. A row of null arrival is covered
    by no run, nor is one whose generation is null; null log names or numbers name no entry and are left out.
    """
    slice_of = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / slice_seconds)
    done = states.where(F.col("state").isin(DONE, LEASED)).where("last_sequence_number is not null and started_at is not null and index_name is not null and generation is not null")
    runs = done.select("index_name", "generation", slice_of(F.col("started_at")).alias("slice"), F.col("started_at").alias("at"), F.col("last_sequence_number").alias("reach"))
    named = wal.where("index_name is not null and sequence_number is not null")
    path = scratch_path(wal.sparkSession, "slices")
    named.where("received_at is not null").groupBy("index_name", "generation", slice_of(F.col("received_at")).alias("slice")).agg(F.count(F.lit(1)).alias("rows")).write.parquet(path)
    slices = wal.sparkSession.read.parquet(path)
    by_slice = runs.groupBy("index_name", "generation", "slice").agg(F.max("reach").alias("reach"))
    nothing = F.lit(None).cast("bigint")
    steps = by_slice.unionByName(slices.drop("rows").withColumn("reach", nothing)).groupBy("index_name", "generation", "slice").agg(F.max("reach").alias("reach"))
    later = Window.partitionBy("index_name", "generation").orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.select("index_name", "generation", "slice", F.max("reach").over(later).alias("reach")).where("reach is not null and slice is not null")
    # kind 0 comes first at equal times: a run that started just then counts
    points = carried.select("index_name", "generation", "slice", F.lit(None).cast("timestamp_ntz").alias("at"), "reach", F.lit(0).alias("kind"), nothing.alias("seq"))
    points = points.unionByName(runs.select("index_name", "generation", "slice", F.col("at").cast("timestamp_ntz").alias("at"), "reach", F.lit(0).alias("kind"), nothing.alias("seq")))
    untimed = F.lit(NO_TIME) - F.pmod(F.hash("sequence_number"), F.lit(NO_TIME_SLICES))
    rows = readable_entries(named).select(
        "index_name", "generation", F.coalesce(slice_of(F.col("received_at")), untimed).alias("slice"), F.col("received_at").cast("timestamp_ntz").alias("at"), nothing.alias("reach"), F.lit(1).alias("kind"), F.col("sequence_number").alias("seq")
    )
    points, rows = _spread(points, rows, slices.where(F.col("rows") > slice_rows).withColumn("parts", F.ceil(F.col("rows") / slice_rows)).drop("rows"))
    before = Window.partitionBy("index_name", "generation", "slice", "part").orderBy(F.desc_nulls_first("at"), "kind").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.unionByName(points).withColumn("reach", F.max("reach").over(before)).where("kind = 1")
    processed = F.coalesce((F.col("reach") >= F.col("seq")) & F.col("at").isNotNull(), F.lit(False))
    entries = seen.groupBy("index_name", F.col("seq").alias("sequence_number")).agg(F.max(processed).alias("processed"), F.max("generation").alias("generation"), F.count(F.lit(1)).alias("rows"))
    return entries.where("not processed").drop("processed")


def _spread(points: DataFrame, rows: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with ``part``: the rows of ``large`` slices (index_name, generation, slice, parts) drawn into one of the parts, the points repeated in each."""
    n = large.limit(BROADCAST_ROWS + 1).count()
    if not n:
        return points.withColumn("part", F.lit(0)), rows.withColumn("part", F.lit(0))
    large = large.select(F.col("index_name").alias("_i"), F.col("generation").alias("_g"), F.col("slice").alias("_s"), "parts")
    large = F.broadcast(large) if n <= BROADCAST_ROWS else large
    same = lambda df: df.join(large, F.expr("index_name = _i and generation <=> _g and slice = _s"), "left").drop("_i", "_g", "_s")
    each = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts").cast("int"), F.lit(1)) - 1)).alias("part")
    drawn = F.coalesce(F.pmod(F.hash("seq", "at"), F.col("parts")).cast("int"), F.lit(0))
    return same(points).select(*points.columns, each), same(rows).withColumn("part", drawn).drop("parts")


def named_items(entries: DataFrame, item_entries: int = 10_000) -> DataFrame:
    """``entries`` (index_name, sequence_number, …; distinct) with ``item``, named by exactly the entries it holds.

    An item is the entries of one stretch of numbers; its name has the log, the first and the last number and a
    hash of all numbers, so other entries make another name. Generations have no part in it: late copies change them.
    A stretch bounds the rows gathered at once.
    """
    others = [c for c in entries.columns if c not in ("index_name", "sequence_number")]
    stretch = F.floor(F.col("sequence_number") / item_entries).alias("_stretch")
    held = F.sort_array(F.collect_list(F.struct("sequence_number", *[F.col(f"`{c}`") for c in others])))
    whole = entries.groupBy("index_name", stretch).agg(held.alias("_held"))
    number = lambda i: F.format_string("%012d", F.element_at("_held", i)["sequence_number"])
    digest = F.substring(F.sha2(F.array_join(F.col("_held.sequence_number"), ","), 256), 1, 32)
    item = F.concat_ws("_", F.url_encode("index_name"), number(1), number(-1), digest)
    # named before the entries are unfolded: once an item, not once an entry
    return whole.select("index_name", "_held", item.alias("item")).select("index_name", F.explode("_held").alias("_e"), "item").select("index_name", "_e.*", "item")


def with_stretch(entries: DataFrame, item_entries: int = 10_000) -> DataFrame:
    """Adds ``stretch`` (log, newest generation, stretch of numbers). It only groups entries for reports: what it holds changes with every arrival."""
    return entries.withColumn("stretch", F.concat_ws("_", "index_name", F.coalesce(F.col("generation").cast("string"), F.lit("none")), F.format_string("%012d", F.floor(F.col("sequence_number") / item_entries))))


def next_run(wal: DataFrame, journal: DataFrame, now: Column | None = None, item_entries: int = 10_000, ledger: Ledger | None = None) -> DataFrame:
    """The entries the next run must take, each with the pending work item it belongs to, by ``ledger`` (or a new one) once it has taken over the journal."""
    spark = wal.sparkSession
    ledger = ledger or Ledger(spark, scratch_path(spark, "ledger"))
    ledger.adopt(journal)
    return ledger.open(wal, now, item_entries)
