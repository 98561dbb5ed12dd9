"""User-level restart calls applied to every asset the user holds in custody.

A lock episode runs from its lock movement to the next movement of the asset. A call updates the
assets of its caller that are in an episode, provided its time is not before the lock and is later
than the last activity. Pairing calls with assets would multiply the calls of a busy user by its
assets, so the pairs are never built for orderly data:

* Starts, ends and calls of a user are put in one sequence and walked with prefix aggregates.
  Where call times do not fall back, every call strictly later than all before it updates each
  open episode, and a call with the same time as its predecessor updates only the episodes that
  began in between. Both counts come from prefix sums and key lookups.
* A call is out of order when it is earlier than an earlier call, lock or prior activity of its
  user. Episodes that contain such a call are resolved on their own, again without pairs: inside an
  episode the updating calls are the running maxima of time from its first sufficient call on, so
  each is the next later-timed call after the one before. These links form a forest over the user's
  calls. An episode is a path in it, from its first sufficient call up to its latest-timed one; the
  ends are found by searches along the calls (``functions.nearest``). Its length is a difference of
  depths, and how many paths run through a call is a sum over the calls under it, which are an
  interval; both are prefix sums. Where the pairs are no more than a few for each call and episode,
  as their counted number shows, they are joined instead: that is linear as well, with fewer steps.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions.nearest import Blocks
from ledgerweave.functions.ordered import CHUNK, exclusive_prefix
from ledgerweave.operators.custody import LOCK, TRANSFER
from ledgerweave.session import settled

EPISODE = ["asset", "start_seq", "start_tx"]
FOREVER = (1 << 63) - 1
BEFORE_ALL = -1


def lock_episodes(applied: DataFrame, base: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """Episodes opened by matched locks, and by assets already locked in ``base``.

    ``end_seq`` and ``end_tx`` belong to the next applied movement of the asset.
    """
    locked = (F.col("class") == TRANSFER) & F.coalesce(F.col("matched") == LOCK, F.lit(False))
    rows = applied.select(
        "asset",
        F.when(locked, F.col("caller")).alias("user"),
        "seq",
        "tx",
        F.col("ts").alias("lock_ts"),
        F.lit(None).cast(applied.schema["ts"].dataType).alias("prior_ts"),
        locked.alias("opens"),
    )
    if base is not None:
        open_now = base.filter((F.col("locked") == 1) & F.col("lock_user").isNotNull() & F.col("lock_ts").isNotNull())
        rows = rows.unionByName(
            open_now.select(
                "asset",
                F.col("lock_user").alias("user"),
                F.lit(BEFORE_ALL).cast("bigint").alias("seq"),
                F.lit(None).cast(applied.schema["tx"].dataType).alias("tx"),
                "lock_ts",
                F.col("activity_ts").alias("prior_ts"),
                F.lit(True).alias("opens"),
            )
        )
    placed = exclusive_prefix(
        rows,
        ["asset"],
        ["seq", "tx"],
        F.expr(f"seq div {chunk}"),
        maxima={"_next": F.struct("seq", "tx")},
        backwards=True,
    )
    return placed.filter("opens").select(
        "asset",
        "user",
        F.col("seq").alias("start_seq"),
        F.col("tx").alias("start_tx"),
        F.coalesce(F.col("_next.seq"), F.lit(FOREVER)).alias("end_seq"),
        F.col("_next.tx").alias("end_tx"),
        "lock_ts",
        "prior_ts",
    )


def _sequence(episodes: DataFrame, calls: DataFrame) -> DataFrame:
    """Starts, ends and calls of each user in one order (seq, tx, phase)."""
    ts_type = calls.schema["ts"].dataType
    none_ts = F.lit(None).cast(ts_type)
    starts = episodes.select(
        "user", F.col("start_seq").alias("seq"), F.col("start_tx").alias("tx"), F.lit(0).alias("phase"),
        F.lit("S").alias("kind"), none_ts.alias("t"), *EPISODE, "lock_ts", "prior_ts",
    )
    ends = episodes.select(
        "user", F.col("end_seq").alias("seq"), F.col("end_tx").alias("tx"), F.lit(0).alias("phase"),
        F.lit("E").alias("kind"), none_ts.alias("t"), *EPISODE, none_ts.alias("lock_ts"), none_ts.alias("prior_ts"),
    )
    asked = calls.select(
        F.col("caller").alias("user"), "seq", "tx", F.lit(1).alias("phase"), F.lit("C").alias("kind"),
        F.col("ts").alias("t"),
        *[F.lit(None).cast(episodes.schema[c].dataType).alias(c) for c in EPISODE],
        none_ts.alias("lock_ts"), none_ts.alias("prior_ts"),
    )
    return starts.unionByName(ends).unionByName(asked)


ORDER = ["seq", "tx", "phase"]


def walk(episodes: DataFrame, calls: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Annotate calls and episodes with prefix figures; returns (calls, episodes).

    Calls: ``k`` calls before it, ``step`` later than all before it, ``stray`` out of order.
    Episodes: calls and strays inside, and the first call inside.
    """
    piece = F.expr(f"seq div {chunk}")
    seen = exclusive_prefix(
        settled(_sequence(episodes, calls)),
        ["user"],
        ORDER,
        piece,
        maxima={"_t": F.col("t"), "_lock": F.col("lock_ts"), "_prior": F.col("prior_ts")},
    )
    is_call = F.col("kind") == "C"
    never = F.lit(False)
    step = is_call & (F.col("_t").isNull() | (F.col("t") > F.col("_t")))
    stray = is_call & (
        F.coalesce(F.col("t") < F.col("_t"), never)
        | F.coalesce(F.col("t") < F.col("_lock"), never)
        | F.coalesce(F.col("t") <= F.col("_prior"), never)
    )
    flagged = seen.withColumns({"step": step, "stray": stray}).drop("_t", "_lock", "_prior")
    counted = settled(
        exclusive_prefix(
            flagged,
            ["user"],
            ORDER,
            piece,
            sums={
                "k": F.when(is_call, 1).otherwise(0),
                "steps": F.when(F.col("step"), 1).otherwise(0),
                "strays": F.when(F.col("stray"), 1).otherwise(0),
            },
            maxima={
                "last_step": F.when(F.col("step"), F.struct("seq", "tx", "t")),
                "last_call": F.when(is_call, F.struct("seq", "tx", "t")),
            },
        )
    )
    asked = counted.filter(is_call).select("user", "seq", "tx", "t", "k", "step", "stray")
    begin = counted.filter(F.col("kind") == "S").select(
        "user", *EPISODE, "lock_ts", "prior_ts",
        F.col("k").alias("k0"), F.col("steps").alias("steps0"), F.col("strays").alias("strays0"),
    )
    finish = counted.filter(F.col("kind") == "E").select(
        *[F.col(c).alias(f"_{c}") for c in EPISODE], F.col("seq").alias("end_seq"), F.col("tx").alias("end_tx"),
        F.col("k").alias("k1"), F.col("steps").alias("steps1"), F.col("strays").alias("strays1"),
        "last_step", "last_call",
    )
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in EPISODE]
    spans = begin.join(finish, same).drop(*[f"_{c}" for c in EPISODE])
    return asked, spans.select(
        "user", *EPISODE, "end_seq", "end_tx", "lock_ts", "prior_ts", "k0",
        (F.col("k1") - F.col("k0")).alias("inside"),
        (F.col("steps1") - F.col("steps0")).alias("steps_in"),
        (F.col("strays1") - F.col("strays0")).alias("strays_in"),
        "last_step", "last_call",
    )


CALLS = 256  # calls of a user in one block of the searches, or in one key of the pair join
PAIRS = 4  # pairs for each call and episode up to which they are joined


def from_ticks(value: Column, kind: str) -> Column:
    """A long of ``ticks`` as a time of type ``kind`` again."""
    if kind == "timestamp_ntz":
        return F.timestamp_add("MICROSECOND", value, F.lit("1970-01-01").cast(kind))
    return F.timestamp_micros(value) if kind == "timestamp" else value.cast(kind)


@dataclass
class StrayUpdates:
    """Updates in the episodes that contain an out-of-order call: one row for each episode, and a count for each call."""

    episodes: DataFrame
    calls: DataFrame


def ticks(df: DataFrame, column: str) -> Column:
    """A time as a long of the same order."""
    kind = df.schema[column].dataType.simpleString()
    if kind == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast(kind), F.col(column))
    return F.unix_micros(column) if kind == "timestamp" else F.col(column).cast("bigint")


def stray_updates(asked: DataFrame, spans: DataFrame, chunk: int = CHUNK, calls: int = CALLS) -> StrayUpdates:
    """Resolve the episodes that contain an out-of-order call; rows stay a few for each call and episode."""
    odd = spans.filter((F.col("strays_in") > 0) & F.col("lock_ts").isNotNull())
    floor = F.greatest(ticks(odd, "lock_ts"), ticks(odd, "prior_ts") + 1)  # the later of both; a NULL is passed over
    stray = settled(
        odd.select(
            F.monotonically_increasing_id().alias("id"), "user", *EPISODE, "end_seq", "k0", (F.col("k0") + F.col("inside")).alias("k1"), floor.alias("floor")
        )
    )
    numbered = asked.select("user", "seq", "tx", F.col("t").alias("ts"), "k", ticks(asked, "t").alias("t"))
    pairs, episodes = stray.agg(F.coalesce(F.sum(F.col("k1") - F.col("k0")), F.lit(0)), F.count(F.lit(1))).first()
    few = pairs <= PAIRS * (episodes + asked.count())
    return (_by_pairs if few else _by_paths)(numbered, stray, chunk, calls)


def _by_pairs(numbered: DataFrame, stray: DataFrame, chunk: int, calls: int) -> StrayUpdates:
    """Join calls and episodes by buckets of call numbers, so that a busy user is spread over many keys."""
    spread = stray.withColumn("_bucket", F.explode(F.expr(f"sequence(k0 div {calls}, (k1 - 1) div {calls})")))
    inside = (
        numbered.withColumn("_bucket", F.expr(f"k div {calls}"))
        .join(spread, ["user", "_bucket"])
        .filter((F.col("k") >= F.col("k0")) & (F.col("k") < F.col("k1")) & (F.col("t") >= F.col("floor")))
    )
    ranked = exclusive_prefix(inside, ["id"], ["k"], F.expr(f"k div {chunk}"), maxima={"_best": F.col("t")})
    updates = settled(ranked.filter(F.col("_best").isNull() | (F.col("t") > F.col("_best"))))
    last = updates.groupBy("user", *EPISODE, "end_seq").agg(F.count(F.lit(1)).alias("updates"), F.max(F.struct("t", "ts", "tx")).alias("_l"))
    episodes = last.select("user", *EPISODE, "end_seq", "updates", F.col("_l.ts").alias("activity_ts"), F.col("_l.tx").alias("activity_tx"))
    return StrayUpdates(episodes, updates.groupBy("user", "seq", "tx").agg(F.count(F.lit(1)).alias("_rough")))


def _by_paths(asked: DataFrame, stray: DataFrame, chunk: int, calls: int) -> StrayUpdates:
    piece = F.expr(f"k div {chunk}")
    ours = asked.join(stray.select("user").distinct(), "user", "left_semi")
    numbered = settled(ours)
    blocks = Blocks(numbered, "user", "k", "t", calls)

    # The last earlier call that is not earlier in time: the calls after it, up to this one, are those under it.
    linked = blocks.last_at_least(numbered, F.col("k") - 1, F.col("t"), "under")
    linked = settled(linked.withColumn("under", F.coalesce("under", F.lit(-1))))
    begun = linked.groupBy("user", (F.col("under") + 1).alias("k")).agg(F.count(F.lit(1)).alias("_begun"))
    change = linked.join(begun, ["user", "k"], "left").withColumn("_change", F.coalesce("_begun", F.lit(0)) - 1).drop("_begun")
    sums = exclusive_prefix(change, ["user"], ["k"], piece, sums={"_depth": F.col("_change")})
    deep = settled(sums.select("user", "seq", "tx", "ts", "k", "t", "under", (F.col("_depth") + F.col("_change")).alias("depth")))

    named = lambda prefix, *names: deep.select("user", F.col("k").alias(prefix), *[F.col(c).alias(f"{prefix}_{c}") for c in names])
    first = blocks.first_at_least(stray, F.col("k0"), F.col("floor"), "first").filter(F.col("first") < F.col("k1"))
    ends = blocks.first_highest(first, ["id"], F.col("first"), F.col("k1"), "last")
    paths = ends.join(named("first", "depth"), ["user", "first"]).join(named("last", "depth", "t", "ts", "tx"), ["user", "last"])
    beyond = settled(blocks.first_at_least(paths, F.col("last") + 1, F.col("last_t") + 1, "beyond"))
    episodes = beyond.select(
        "user", *EPISODE, "end_seq",
        (F.col("first_depth") - F.col("last_depth") + 1).alias("updates"),
        F.col("last_ts").alias("activity_ts"),
        F.col("last_tx").alias("activity_tx"),
    )

    marks = beyond.select("user", F.col("first").alias("k"), F.lit(1).alias("_w")).unionByName(
        beyond.filter(F.col("beyond").isNotNull()).select("user", F.col("beyond").alias("k"), F.lit(-1).alias("_w"))
    )
    weighed = deep.join(marks.groupBy("user", "k").agg(F.sum("_w").alias("_w")), ["user", "k"], "left").withColumn("_w", F.coalesce("_w", F.lit(0)))
    upto = exclusive_prefix(weighed, ["user"], ["k"], piece, sums={"_s": F.col("_w")})
    upto = settled(upto.select("user", "seq", "tx", "k", "under", (F.col("_s") + F.col("_w")).alias("_s")))
    before = upto.select("user", F.col("k").alias("under"), F.col("_s").alias("_b"))
    through = upto.join(before, ["user", "under"], "left").select("user", "seq", "tx", (F.col("_s") - F.coalesce("_b", F.lit(0))).alias("_rough"))
    return StrayUpdates(episodes, through.filter("_rough > 0"))


def restart_fanout(asked: DataFrame, spans: DataFrame, odd: StrayUpdates) -> DataFrame:
    """Episodes with at least one update: number of updates, last activity and its transaction."""
    plain = spans.filter((F.col("strays_in") == 0) & (F.col("inside") > 0))
    first = asked.select("user", F.col("k").alias("k0"), F.col("step").alias("_first_step"), F.col("tx").alias("_first_tx"))
    calm = plain.join(first, ["user", "k0"]).select(
        "user", *EPISODE, "end_seq",
        (F.col("steps_in") + F.when(F.col("_first_step"), 0).otherwise(1)).alias("updates"),
        F.col("last_call.t").alias("activity_ts"),
        F.when(F.col("steps_in") > 0, F.col("last_step.tx")).otherwise(F.col("_first_tx")).alias("activity_tx"),
    )
    return calm.unionByName(odd.episodes)


def restart_effects(asked: DataFrame, spans: DataFrame, odd: StrayUpdates, chunk: int = CHUNK) -> DataFrame:
    """Assets changed by each call."""
    plain = spans.filter((F.col("strays_in") == 0) & (F.col("inside") > 0))
    edge = lambda seq, tx, n: plain.select(
        "user", F.col(seq).alias("seq"), F.col(tx).alias("tx"), F.lit(0).alias("phase"), F.lit(n).alias("_n")
    )
    line = (
        edge("start_seq", "start_tx", 1)
        .unionByName(edge("end_seq", "end_tx", -1))
        .unionByName(asked.select("user", "seq", "tx", F.lit(1).alias("phase"), F.lit(0).alias("_n")))
    )
    opened = exclusive_prefix(line, ["user"], ORDER, F.expr(f"seq div {chunk}"), sums={"open": F.col("_n")})
    standing = opened.filter(F.col("phase") == 1).select("user", "seq", "tx", "open")
    begun = plain.groupBy("user", F.col("k0").alias("k")).agg(F.count(F.lit(1)).alias("_begun"))
    calm = (
        F.when(F.col("stray"), F.lit(0))
        .when(F.col("step"), F.col("open"))
        .otherwise(F.coalesce(F.col("_begun"), F.lit(0)))
    )
    return (
        asked.join(standing, ["user", "seq", "tx"])
        .join(begun, ["user", "k"], "left")
        .join(odd.calls, ["user", "seq", "tx"], "left")
        .select(
            "user", "seq", "tx", F.col("t").alias("ts"),
            (calm + F.coalesce(F.col("_rough"), F.lit(0))).cast("bigint").alias("assets_changed"),
        )
    )


def apply_restarts(state: DataFrame, updates: DataFrame, source: str, depth: str) -> DataFrame:
    """Write the last activity of each still open episode into the state table."""
    open_now = updates.filter(F.col("end_seq") == FOREVER).select(
        "asset", F.col("activity_ts").alias("_ts"), F.col("activity_tx").alias("_tx")
    )
    hit = F.col("_ts").isNotNull()
    return (
        state.join(open_now, "asset", "left")
        .withColumns(
            {
                "activity_ts": F.when(hit, F.col("_ts")).otherwise(F.col("activity_ts")),
                "activity_tx": F.when(hit, F.col("_tx")).otherwise(F.col("activity_tx")),
                "activity_source": F.when(hit, F.lit(source)).otherwise(F.col("activity_source")),
                "activity_depth": F.when(hit, F.lit(depth)).otherwise(F.col("activity_depth")),
            }
        )
        .select(*state.columns)
    )
