"""Streaming entity state: what each country, ASN, subnet and device saw before, by event time.

Runs beside the user state on the same stream, not behind it: it needs a row's user, entities and success
only. Every row is dealt to its four entities, those of one piece of the input together,
``groupBy(kind, entity).transformWithState``. An entity's state is counters, a map (in slots) from each user to the time of the last row and whether a row failed, and the
users of the last hour with their last times; a batch reads and writes the slots of its own users only, so
the work of a batch follows its rows and the last hour, not all users ever seen.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left, insort
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.infra import derived_counts
from ..session import ship_package
from .event_time import ONE_HOUR_US, PIECES, TEN_MIN_US, EventTimeProcessor, Slots, pack, pieces, unfolded, unpacked, use_state_store
from .user_state import KINDS


class EntityHistory(EventTimeProcessor):
    FIELDS = "login_us long, event_id long, member string, fail int"
    OUTPUT = ("kind string, event_id long, login_us long, late int, users long, events long, fails long, failed_users long, "
              "users_10min long, users_1hour long")

    def __init__(self, ttl_us: int | None = None):
        self.ttl_us = ttl_us

    def open(self, handle):
        self.users = Slots(handle, "users", "member string", "last_us long, failed int")
        self.recent = handle.getListState("recent", PIECES)

    def rows_of(self, rows):
        return [row for r in rows for row in pickle.loads(r["packed"])]

    def load(self, kept):
        self.was = kept or (0, 0, 0, 0, 1, 0, 0)  # users, events, fails, failed users, slots, entries, users of the last hour
        self.now = self.was[:4]
        self.hour = unpacked(self.recent.get()) if self.was[6] else []  # ascending, one entry per user
        self.users.begin(*self.was[4:6])

    def through(self, key, rows, late):
        return (self._late if late else self._in_order)(key, rows)

    def _in_order(self, key, rows):
        """The users of a window are counted as they come and leave: a user's entry behind a later one of the same user is void."""
        users, events, fails, failed = self.now
        kind, slots = key[0], self.users
        last_of = {member: t for t, member in self.hour}
        recent, ten = deque(self.hour), deque(self.hour)
        n_hour = n_ten = len(self.hour)
        out = []
        for t, eid, member, fail in rows:
            while ten and ten[0][0] < t - TEN_MIN_US:
                e = ten.popleft()
                n_ten -= last_of.get(e[1]) == e[0]
            while recent and recent[0][0] < t - ONE_HOUR_US:
                e = recent.popleft()
                if last_of.get(e[1]) == e[0]:
                    n_hour -= 1
                    del last_of[e[1]]
            out.append((kind, eid, t, 0, users, events, fails, failed, n_ten, n_hour))
            was = last_of.get(member)
            if was is None:
                n_hour += 1
            if was is None or was < t - TEN_MIN_US:
                n_ten += 1
            if was != t:
                last_of[member] = t
                recent.append((t, member))
                ten.append((t, member))
            key_of = (member,)
            entries = slots.open(key_of)
            before = entries.get(key_of)
            events, fails = events + 1, fails + fail
            if before is None:
                users += 1
                slots.entries += 1
                failed += fail
                entries[key_of] = (t, fail)
            else:
                failed += fail and not before[1]
                entries[key_of] = (max(before[0], t), 1 if fail or before[1] else 0)
        self.hour = sorted(e for e in recent if last_of.get(e[1]) == e[0])
        self.now = (int(users), int(events), int(fails), int(failed))
        return out

    def _late(self, key, rows):
        users, events, fails, failed = self.now
        recent = self.hour
        out = []
        for t, eid, member, fail in rows:
            upto = bisect_left(recent, (t + 1,))
            ten, hour = (max(0, upto - bisect_left(recent, (t - w,))) for w in (TEN_MIN_US, ONE_HOUR_US))
            out.append((key[0], eid, t, 1, users, events, fails, failed, ten, hour))
            before = self.users.get((member,))
            last = t if before is None else max(before[0], t)
            if before is not None:
                i = bisect_left(recent, (before[0], member))
                if i < len(recent) and recent[i] == (before[0], member):
                    del recent[i]
            insort(recent, (last, member))
            users, events, fails = users + (before is None), events + 1, fails + fail
            failed += fail and not (before is not None and before[1])
            self.users.put((member,), (last, int(bool(fail or (before is not None and before[1])))))
        self.now = (int(users), int(events), int(fails), int(failed))
        return out

    def evict(self, watermark_us):
        if self.ttl_us is not None:
            self.users.forget(lambda v: v[0] < watermark_us - max(self.ttl_us, ONE_HOUR_US))
        left = self.hour[bisect_left(self.hour, (watermark_us - ONE_HOUR_US,)):]
        if self.now[1] != self.was[1] or len(left) < self.was[6]:
            if left:
                self.recent.put(pieces(left))
            elif self.was[6]:
                self.recent.clear()
        return left[0][0] + ONE_HOUR_US if left else None, (*self.now, *self.users.end(), len(left))


def _dealt(batches):
    """Every login to its four entities; what a piece of the input has of one is one row, so that few rows cross to the state."""
    for b in batches:
        c = {n: b.column(n).to_pylist() for n in ("login_us", "event_id", "member", "fail", *(col for _, col in KINDS))}
        rows = list(zip(c["login_us"], c["event_id"], c["member"], c["fail"], strict=True))
        kinds, entities, packed = [], [], []
        for kind, col in KINDS:
            of: dict[str, list] = {}
            for entity, row in zip(c[col], rows, strict=True):
                of.setdefault(entity, []).append(row)
            kinds += [kind] * len(of)
            entities += of
            packed += map(pack, of.values())
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(entities, pa.string()), pa.array(packed, pa.binary())],
                                         ["kind", "entity", "packed"])


def entity_state(prepared: DataFrame, ttl_us: int | None = None) -> DataFrame:
    """Watermarked prepared logins -> four rows for each login (kind, event_id, late, raw prior counts), a stream.

    ``ttl_us`` (off by default, so that stream = batch) forgets users not seen at an entity for that long."""
    use_state_store(prepared.sparkSession)
    ship_package(prepared.sparkSession)
    x = prepared.select("login_us", "event_id", F.coalesce(F.col("user_id").cast("string"), F.lit("null")).alias("member"),
                        F.col("fail").cast("int").alias("fail"), *[col for _, col in KINDS])
    out = x.mapInArrow(_dealt, "kind string, entity string, packed binary").groupBy("kind", "entity").transformWithState(
        EntityHistory(ttl_us), EntityHistory.FOLDED, "append", "EventTime")
    return unfolded(out, EntityHistory.OUTPUT)


def features(rows: DataFrame) -> DataFrame:
    """One row per login with all graph features, from what :func:`entity_state` wrote."""
    measures = ("users", "events", "fails", "failed_users", "users_10min", "users_1hour")
    wide = rows.groupBy("event_id").agg(F.max("late").alias("late"), *[
        F.max(F.when(F.col("kind") == kind, F.col(m))).alias(f"{kind}_{m}") for kind, _ in KINDS for m in measures])
    return derived_counts(wide, "late")
