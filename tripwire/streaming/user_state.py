"""Streaming per-user history: the helper columns of the batch windows, kept in state by event time.

``groupBy(user_id).transformWithState``. A user's state is counters, a map (in slots) from each (kind, entity or
pair) to the time it was last seen, and the events of the last hour. Rows pass in event-time order
(:mod:`.event_time`); the 71 behaviour features are then derived from the helper columns by the very expressions of the
batch plan (:func:`tripwire.operators.history.derive`). A late row's trailing windows end at its own time and a negative gap
counts as 0. A timer per user drops the events that left the last hour, whether or not new rows come.
"""

from __future__ import annotations

from itertools import accumulate
from operator import itemgetter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.history import ENTITIES, PAIRS, derive
from ..session import ship_package
from .event_time import ONE_HOUR_US, PIECES, TEN_MIN_US, EventTimeProcessor, Slots, pieces, unfolded, unpacked, use_state_store

KINDS = ENTITIES
_PASS = ("event_id long, login_us long, success int, fail int, hour int, dow int, is_weekend int, missing_country int, missing_asn int, "
         "missing_device_info int, country_key string, asn_key string, subnet string, device string")
#: Those of them that are strings, and the numbers beside ids and time, in the order of ``FIELDS``.
_WORDS = [f.split()[0] for f in _PASS.split(", ") if f.endswith(" string")]
_NUMBERS = [f.split()[0] for f in _PASS.split(", ")[2:] if not f.endswith(" string")]


class UserHistory(EventTimeProcessor):
    FIELDS = "login_us long, event_id long, " + ", ".join(f for f in _PASS.split(", ") if f.split()[0] not in ("event_id", "login_us"))
    OUTPUT = ("user_id long, " + FIELDS + ", late int, h_n long, h_prev_us long, h_first_us long, h_weekend_prior long, h_hour_sum long, "
              "user_fail_count_prior long, user_success_count_prior long, consecutive_failures_prior long, "
              "fail_count_10min long, fail_count_1hour long, success_count_10min long, new_entities_10min long, "
              "new_entities_1hour long, new_subnets_1hour long, new_device_combos_1hour long, "
              + ", ".join(f"first_time_{'device_combo' if n == 'device' else n} int, h_last_{n}_us long, h_cnt_{n} long" for n, _ in ENTITIES)
              + ", " + ", ".join(f"h_ft_{n} int" + ("" if n == "country_asn" else f", h_last_{n}_us long") for n, _ in PAIRS))

    def __init__(self, ttl_us: int | None = None):
        self.ttl_us = ttl_us

    def open(self, handle):
        self.seen = Slots(handle, "seen", "kind string, value string", "last_us long")
        self.recent = handle.getListState("recent", PIECES)
        at = {n: i for i, n in enumerate(f.split()[0] for f in self.FIELDS.split(", "))}
        self.fail, self.weekend, self.hour_of = at["fail"], at["is_weekend"], at["hour"]
        self.single = [(name, at[col]) for name, col in ENTITIES]
        self.pairs = [(name, [at[c] for c in cols]) for name, cols in PAIRS]

    def rows_of(self, rows):
        rows = list(rows)
        take = itemgetter(*[rows[0].__fields__.index(n) for n in ("numbers", "event_id", *_WORDS)])
        out = []
        for r in rows:
            numbers, eid, *words = take(r)
            us, *numbers = map(int, numbers.split(","))
            out.append((us, eid, *numbers, *words))
        return out

    def load(self, kept):
        # n, fails, successes, run, first_us, prev_us, weekend, hours; country, asn, subnet, device; slots, entries; events of the last hour
        self.was = kept or (0, 0, 0, 0, None, None, 0, 0, 0, 0, 0, 0, 1, 0, 0)
        self.now = self.was[:12]
        self.hour = unpacked(self.recent.get()) if self.was[14] else []  # us, fail, new, new_subnet, new_device
        self.seen.begin(*self.was[12:14])

    def through(self, key, rows, late):
        n, fails, good, run, first, prev, weekend, hours, *distinct = self.now
        seen = self.seen
        recent = self.hour if late else sorted(self.hour, key=itemgetter(0))
        # sums up to each event of the last hour; the windows of rows in order begin where those before began, or later
        sums = [*accumulate(recent, lambda a, e: (a[0] + e[1], a[1] + e[2], a[2] + e[3], a[3] + e[4]), initial=(0, 0, 0, 0))]
        h = m = 0
        out = []
        for r in rows:
            t, fail = r[0], r[self.fail]
            if late:
                hour = [e for e in recent if 0 <= t - e[0] <= ONE_HOUR_US]
                ten = [e for e in hour if t - e[0] <= TEN_MIN_US]
                windows = (sum(e[1] for e in ten), sum(e[1] for e in hour), sum(1 - e[1] for e in ten),
                           sum(e[2] for e in ten), sum(e[2] for e in hour), sum(e[3] for e in hour), sum(e[4] for e in hour))
            else:
                while h < len(recent) and t - recent[h][0] > ONE_HOUR_US:
                    h += 1
                while m < len(recent) and t - recent[m][0] > TEN_MIN_US:
                    m += 1
                now, hour, ten = sums[-1], sums[h], sums[m]
                windows = (now[0] - ten[0], now[0] - hour[0], len(recent) - m - (now[0] - ten[0]),
                           now[1] - ten[1], now[1] - hour[1], now[2] - hour[2], now[3] - hour[3])
            keys = [(name, r[i]) for name, i in self.single] + [(name, "\x01".join([r[i] for i in at])) for name, at in self.pairs]
            slots = [seen.open(k) for k in keys]
            times = [s[k][0] if k in s else None for s, k in zip(slots, keys)]
            new = [int(x is None) for x in times[:4]]
            row = [key[0], *r, int(late), n, prev if prev is None else min(prev, t), first if first is None else min(first, t), weekend, hours,
                   fails, good, run, *windows]
            for i, x in enumerate(times):
                if i < 4:
                    row += (new[i], x if x is None else min(x, t), distinct[i])
                elif keys[i][0] == "country_asn":
                    row.append(int(x is None))
                else:
                    row += (int(x is None), x if x is None else min(x, t))
            out.append(row)
            for s, k, x in zip(slots, keys, times):
                s[k] = (t if x is None else max(x, t),)
                seen.entries += x is None
            distinct = [d + x for d, x in zip(distinct, new, strict=True)]
            n, fails, good = n + 1, fails + fail, good + 1 - fail
            weekend, hours = weekend + r[self.weekend], hours + r[self.hour_of]
            event = (t, fail, sum(new), new[2], new[3])
            recent.append(event)
            sums.append(tuple(a + e for a, e in zip(sums[-1], event[1:])))
            if not late:
                run = run + 1 if fail else 0
                first, prev = t if first is None else first, t
        self.now = tuple(x if x is None else int(x) for x in (n, fails, good, run, first, prev, weekend, hours, *distinct))
        self.hour = recent[h:]
        return out

    def evict(self, watermark_us):
        if self.ttl_us is not None:
            self.seen.forget(lambda v: v[0] < watermark_us - self.ttl_us)
        left = [e for e in self.hour if e[0] >= watermark_us - ONE_HOUR_US]
        if self.now[0] != self.was[0] or len(left) < self.was[14]:
            if left:
                self.recent.put(pieces(left))
            elif self.was[14]:
                self.recent.clear()
        return min(e[0] for e in left) + ONE_HOUR_US if left else None, (*self.now, *self.seen.end(), len(left))


def user_state(prepared: DataFrame, ttl_us: int | None = None) -> DataFrame:
    """Watermarked prepared logins -> (user_id, own columns, late, helper columns), a stream.

    ``ttl_us`` (off by default, so that stream = batch) forgets entities not used for that long of event time."""
    use_state_store(prepared.sparkSession)
    ship_package(prepared.sparkSession)
    # one string for the numbers, none of which is null: each cell of a row costs a call in Python
    x = prepared.select("user_id", F.col("event_id").cast("long"), F.concat_ws(",", F.col("login_us").cast("long"), *[F.col(c).cast("int") for c in _NUMBERS])
                        .alias("numbers"), *_WORDS)
    out = x.groupBy("user_id").transformWithState(UserHistory(ttl_us), UserHistory.FOLDED, "append", "EventTime")
    return unfolded(out, UserHistory.OUTPUT)


def features(rows: DataFrame) -> DataFrame:
    """The 71 behaviour features from what :func:`user_state` put out (projections only)."""
    return derive(rows)
