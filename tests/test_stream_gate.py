"""The cursor gate in a stream against a fold, for any slicing, over restarts and conflicts."""

import datetime as dt
import random
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerweave.operators.state import latest_state
from ledgerweave.session import shared_dir
from ledgerweave.sources.tables import read_appended
from ledgerweave.streaming.batches import finish, stream_id
from ledgerweave.streaming.gate import HELD, PROVIDER, STATUSES, commit_gated, gate_rows, gated_stream

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
MOVES = "asset string, seq bigint, tx string, ts timestamp, class string, to_owner string, matched string, caller string, wallet string"
ACTIVATION = T0 + dt.timedelta(minutes=10)


def make_moves(rng):
    out = []
    for asset in "abcdefgh":
        for seq in rng.sample(range(60), 12):
            ts = T0 + dt.timedelta(minutes=rng.randint(0, 30))
            kind = rng.choice(["move", "move", "lock", "burn"])
            what = ("TRANSFER", f"w{seq}", "LOCK", "u", f"w{seq}") if kind == "lock" else ("TRANSFER", f"o{seq}", None, None, None) if kind == "move" else ("BURN_OR_SEND_TO_ZERO", None, None, None, None)
            out.append((asset, seq, f"tx-{rng.randint(0, 9)}-{seq}", ts, *what))
    return out


def fold(slices, cursors):
    counts, cursors, last, burned = [], dict(cursors), {}, set()
    for rows in slices:
        n = Counter()
        for m in sorted(rows, key=lambda m: (m[1], m[2])):
            held = cursors.get(m[0])
            if held is None:
                status = "COVERED_PRE_ACTIVATION" if m[3] <= ACTIVATION else "APPLY"
            elif m[1] < held[0]:
                status = "STALE"
            elif m[1] == held[0]:
                assert m[2] == held[1]
                status = "DUPLICATE"
            else:
                status = "APPLY"
            n[status] += 1
            if status == "APPLY":
                cursors[m[0]], last[m[0]] = (m[1], m[2]), m
                if m[4] != "TRANSFER":
                    burned.add(m[0])
        counts.append(n)
    return counts, last, burned


class Stream:
    def __init__(self, spark, start=None):
        self.own = spark.newSession()
        self.own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
        self.own.conf.set("spark.sql.shuffle.partitions", "2")
        self.home = f"{shared_dir(spark)}/gate-{uuid.uuid4().hex}"
        self.start, self.sent = start, 0

    def run(self, slices):
        for rows in slices:
            # Modification time orders the files of a source.
            self.own.createDataFrame(rows, MOVES).coalesce(1).write.mode("append").parquet(f"{self.home}/in/part={self.sent}")
            self.sent += 1
            moves = self.own.readStream.schema(MOVES + ", part int").option("maxFilesPerTrigger", 1).parquet(f"{self.home}/in")
            rows = gate_rows(moves, F.lit(ACTIVATION))
            checkpoint = f"{self.home}/checkpoint"
            land = lambda df, batch: commit_gated(df, f"{self.home}/tables", stream_id(df.sparkSession, checkpoint), batch)
            query = gated_stream(rows, self.start).writeStream.foreachBatch(land).outputMode("update")
            finish(query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start())

    def states(self, spark):
        rows = read_appended(spark, f"{self.home}/tables", "updates")
        last = rows.groupBy("asset").agg(F.max(F.struct("last_seq", "last_tx", *HELD)).alias("s"))
        return {r["asset"]: r["s"].asDict() for r in last.collect()}

    def counts(self, spark):
        out = {}
        for r in read_appended(spark, f"{self.home}/tables", "statuses").collect():
            out.setdefault(r["batch"], Counter())[r["status"]] = r["n"]
        return [out[b] for b in sorted(out)]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_slicing_and_restarts(spark, seed):
    rng = random.Random(seed)
    moves = make_moves(rng)
    rng.shuffle(moves)
    if seed == 2:
        moves.sort(key=lambda m: (m[1], m[2]))  # in order: equal to one batch
    slices = [moves[i::3] for i in range(3)] if seed == 1 else [moves[:20], moves[20:70], moves[70:]]
    slices[1] = slices[1] + slices[1][:7]  # delivered twice in one micro-batch
    slices.append(slices[0][-5:])  # and once more later
    stream = Stream(spark)
    stream.run(slices)  # each slice is a start of its own over the same checkpoint
    counts, last, burned = fold(slices, {})
    assert stream.counts(spark) == counts and set(STATUSES) >= set().union(*counts)
    got = stream.states(spark)
    assert {a: (s["last_seq"], s["last_tx"], s["raw_owner"], s["locked"], s["burned"]) for a, s in got.items()} == {
        a: (m[1], m[2], m[5], int(m[6] == "LOCK"), int(a in burned)) for a, m in last.items()
    }
    if seed == 2:
        once = spark.createDataFrame([m for a in last for m in moves if m[0] == a and (m[3] > ACTIVATION or m[1] >= min(x[1] for x in moves if x[0] == a and x[3] > ACTIVATION))], MOVES)
        for r in latest_state(once).collect():
            assert {c: got[r["asset"]][c] for c in HELD} == {c: r[c] for c in HELD}


def test_starts_from_committed_tables(spark):
    rng = random.Random(4)
    moves = make_moves(rng)
    cursors = {"a": (25, "tx-old"), "b": (59, "tx-old")}
    moves = [m for m in moves if m[0] not in cursors or m[1] != cursors[m[0]][0]]
    held = latest_state(spark.createDataFrame([("a", 25, "tx-old", T0, "BURN_OR_SEND_TO_ZERO", None, None, None, None), ("b", 59, "tx-old", T0, "TRANSFER", "keeper", None, None, None)], MOVES))
    start = held.join(spark.createDataFrame([(a, *c) for a, c in cursors.items()], "asset string, last_seq bigint, last_tx string"), "asset")
    stream = Stream(spark, start)
    slices = [moves[::2], moves[1::2], [("a", 25, "tx-old", T0, "TRANSFER", "x", None, None, None), ("b", 59, "tx-old", T0, "TRANSFER", "x", None, None, None)]]
    stream.run(slices)
    counts, last, burned = fold(slices, cursors)
    assert stream.counts(spark) == counts and counts[2]["DUPLICATE"] + counts[2]["STALE"] == 2
    got = stream.states(spark)
    assert set(got) == set(last) and "b" not in got
    assert got["a"]["burned"] == 1 and got["a"]["last_seq"] == last["a"][1]


def test_conflicts_stop_at_any_number(spark):
    at = lambda seq, tx, asset="z": (asset, seq, tx, T0 + dt.timedelta(hours=1), "TRANSFER", tx, None, None, None)
    stream = Stream(spark)
    stream.run([[at(3, "first")]])
    with pytest.raises(Exception, match="z at 5"):
        stream.run([[at(5, "ten"), at(5, "eleven"), at(6, "twelve"), at(1, "other", "y")]])
    assert set(stream.states(spark)) == {"z"} and stream.states(spark)["z"]["last_seq"] == 3, "nothing of the micro-batch is committed"
    with pytest.raises(Exception, match="z at 5"):
        stream.run([[at(7, "later")]])  # the next start meets it again
    against = Stream(spark)
    against.run([[at(3, "first")]])
    with pytest.raises(Exception, match="z at 3"):
        against.run([[at(3, "second")]])
