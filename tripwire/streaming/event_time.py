"""What the stateful operators share: waiting for the watermark, lateness, timers.

A row waits in its key's state until the watermark has passed its time; then the key's waiting rows go through
in the order ``(login_us, event_id)``. So the result does not depend on how the input is cut into
batches, as long as no row comes later than the watermark's delay. A row that stands before one its
key has already let through is *late*: it comes out at once, marked, with the features that the
state as it stands gives it, and enters the counters.

The event-time column is dropped behind ``withWatermark``: the watermark moves with it, yet Spark does not discard
rows older than it, so that late rows reach the operator and are counted in its state.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from operator import itemgetter
from zlib import crc32

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

TEN_MIN_US = 600 * 1_000_000
ONE_HOUR_US = 3600 * 1_000_000
#: Event time at which an input that ended is closed.
END_OF_TIME = "9999-01-01 00:00:00"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """``transformWithState`` needs the RocksDB store (in memory of the executor, kept in the checkpoint folder)."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def watermarked(prepared: DataFrame, delay: str, end: DataFrame | None = None) -> DataFrame:
    """Prepared logins under a watermark. ``end`` is a stream of rows (event_time) that close the input."""
    x = prepared.withColumn("event_time", F.timestamp_micros("login_us"))
    if end is not None:
        x = x.unionByName(end.select("event_time"), allowMissingColumns=True)
    x = x.withWatermark("event_time", delay)
    # the condition names the event time, so that it is not moved below the watermark and away from the closing row
    return x.where(F.col("login_us").isNotNull() | F.col("event_time").isNull()).drop("event_time")


def in_order(r: tuple) -> tuple:
    """Sort key of (login_us, event_id, ...); a missing id comes first, as in the batch windows."""
    return r[0], float("-inf") if r[1] is None else r[1]


#: A key's rows in the state or on their way to it are packed (pickled tuples) in pieces of so many: each value that crosses between
#: Python and the store costs a parse of its schema, however small it is.
PIECE = 4096
#: Waiting rows that are kept with the key's counters, in one value.
FEW = 64
PIECES = "n int, packed binary"


def pack(rows: list[tuple]) -> bytes:
    return pickle.dumps(rows, pickle.HIGHEST_PROTOCOL)


def pieces(rows: list[tuple]) -> list[tuple]:
    return [(len(x), pack(x)) for x in (rows[i:i + PIECE] for i in range(0, len(rows), PIECE))]


def unpacked(held: Iterable) -> list[tuple]:
    return [row for x in held for row in pickle.loads(x[1])]


def _fields(schema: str) -> list[tuple[str, str]]:
    return [tuple(f.split()) for f in schema.split(", ")]


def unfolded(out: DataFrame, schema: str) -> DataFrame:
    """The rows of ``schema`` that a processor put out, many in one (:meth:`EventTimeProcessor.put_out`)."""
    fields = _fields(schema)
    words = [n for n, t in fields if t == "string"]
    numbers = [n for n, t in fields if t != "string"]
    x = out.select("numbers", "words", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("_i"))
    at = lambda col, names, n: F.get(F.col(col), F.col("_i") * len(names) + names.index(n))
    return x.select(*[at("words", words, n).alias(n) if t == "string" else at("numbers", numbers, n).cast(t).alias(n) for n, t in fields])


class Slots:
    """A map of any size in the state, kept as slots of up to ``FULL`` entries on average.

    Each call to the state is a round trip between Python and the store, so a pass reads and writes the slots that
    its rows touch, once each, not single entries. The slots double in number as the entries do."""

    FULL = 256

    #: A slot's value: its entries packed, and their number (by the first part of the key, where it has several).
    VALUE = "part array<string>, n array<long>, packed binary"

    def __init__(self, handle, name: str, keys: str, values: str):
        self.grouped = len(_fields(keys)) > 1
        self.state = handle.getMapState(name, "slot int", self.VALUE)

    def begin(self, slots: int, entries: int) -> None:
        """``slots`` and ``entries`` as :meth:`end` gave them last (1 and 0 at first)."""
        self.held: dict[int, dict] = {}
        self.changed: set[int] = set()
        self.slots, self.entries = slots, entries

    def _slot(self, key: tuple) -> int:
        return 0 if self.slots == 1 else crc32("\x01".join(key).encode("utf-8", "surrogatepass")) % self.slots

    def _load(self, i: int) -> dict:
        if i not in self.held:
            v = self.state.getValue((i,))
            self.held[i] = {} if v is None else pickle.loads(v[2])
        return self.held[i]

    def get(self, key: tuple) -> tuple | None:
        return self._load(self._slot(key)).get(key)

    def put(self, key: tuple, value: tuple) -> None:
        entries = self.open(key)
        self.entries += key not in entries
        entries[key] = value

    def open(self, key: tuple) -> dict:
        """The slot of a key, to be changed; who adds an entry to it counts it in ``entries``."""
        i = self._slot(key)
        self.changed.add(i)
        return self._load(i)

    def forget(self, old: Callable[[tuple], bool]) -> None:
        for i in range(self.slots):
            entries = self._load(i)
            gone = [k for k, v in entries.items() if old(v)]
            for k in gone:
                del entries[k]
            if gone:
                self.entries -= len(gone)
                self.changed.add(i)

    def end(self) -> tuple[int, int]:
        if self.entries > self.slots * self.FULL:
            every = [e for i in range(self.slots) for e in self._load(i).items()]
            while self.entries > self.slots * self.FULL:
                self.slots *= 2
            self.held, self.changed = {i: {} for i in range(self.slots)}, set(range(self.slots))
            for k, v in every:
                self.held[self._slot(k)][k] = v
        for i in self.changed:
            if self.held[i]:
                n = Counter(k[0] if self.grouped else "" for k in self.held[i])
                self.state.updateValue((i,), ([*n], [*n.values()], pickle.dumps(self.held[i], pickle.HIGHEST_PROTOCOL)))
            else:
                self.state.removeKey((i,))
        return self.slots, self.entries


class EventTimeProcessor(StatefulProcessor):
    """A key's rows in event-time order. Subclasses give ``FIELDS`` (of a waiting row, login_us and event_id first), ``OUTPUT`` (numbers and
    strings) and four hooks.

    A pass reads each state once and writes it once: every call is a round trip between Python and the store. What is small and read in
    every pass is one value, ``totals``; ``waiting`` holds rows only where they are more than ``FEW``."""

    FIELDS: str
    OUTPUT: str
    #: Schema of what :meth:`put_out` puts out.
    FOLDED = "n int, numbers array<long>, words array<string>"
    ttl_us: int | None = None

    def open(self, handle):
        """Make the states."""

    def load(self, kept: tuple | None) -> None:
        """Read what :meth:`through` and :meth:`evict` need; ``kept`` is what :meth:`evict` gave last."""

    def through(self, key, rows: list[tuple], late: bool) -> list[tuple]:
        """Let rows pass in order; their output."""

    def evict(self, watermark_us: int) -> tuple[int | None, tuple]:
        """Forget what no row from ``watermark_us`` on can need, and write what changed; the time at which there is more to forget, and what
        to keep with the key for the next :meth:`load`."""

    def init(self, handle):
        self.handle = handle
        # waiting rows (their number is told), and packed: the last row let through, late rows, the timer that is set, when there is
        # something to forget, the time of the first waiting row, waiting rows if few, whether there are more, what evict() kept
        self.totals = handle.getValueState("totals", "waiting long, packed binary")
        self.waiting = handle.getListState("waiting", PIECES)
        self.place = handle.getValueState("place", "late long")  # of a key that had late rows
        self.names = [n for n, _ in _fields(self.FIELDS)]
        kinds = [t for _, t in _fields(self.OUTPUT)]
        some = lambda at: itemgetter(*at) if len(at) > 1 else (lambda r: tuple(r[i] for i in at))
        self.numbers = some([i for i, t in enumerate(kinds) if t != "string"])
        self.words = some([i for i, t in enumerate(kinds) if t == "string"])
        self.open(handle)

    def rows_of(self, rows: Iterator[Row]) -> list[tuple]:
        """A key's new rows as tuples of ``FIELDS``."""
        rows = list(rows)
        take = itemgetter(*[rows[0].__fields__.index(n) for n in self.names])
        return [take(r) for r in rows]

    def put_out(self, out: list[tuple]) -> Iterator[Row]:
        """Rows of ``OUTPUT``, many in one (see :func:`unfolded`)."""
        folded = Row("n", "numbers", "words")
        for i in range(0, len(out), PIECE):
            some = out[i:i + PIECE]
            yield folded(len(some), tuple(chain.from_iterable(map(self.numbers, some))), tuple(chain.from_iterable(map(self.words, some))))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        yield from self._pass(key, self.rows_of(rows), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._pass(key, [], timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())

    def _pass(self, key, new, watermark_ms, fired: int | None = None) -> Iterator[Row]:
        at = self.totals.get()
        last, n_late, timer, due, first, few, more, kept = (None, 0, None, None, None, [], 0, None) if at is None else pickle.loads(at[1])
        late = []
        if last is not None:
            edge_row = in_order(last)
            late = sorted((r for r in new if in_order(r) <= edge_row), key=in_order)
            if late:
                new = [r for r in new if in_order(r) > edge_row]
        edge = watermark_ms * 1000
        first = min([r[0] for r in new] + ([] if first is None else [first]), default=None)
        ready = []
        if first is not None and first < edge:
            rows = few + (unpacked(self.waiting.get()) if more else []) + new
            ready = sorted((r for r in rows if r[0] < edge), key=in_order)
            rows = [r for r in rows if r[0] >= edge]
            first = min((r[0] for r in rows), default=None)
            if len(rows) > FEW:
                self.waiting.put(pieces(rows))
                few, more = [], len(rows)
            else:
                if more:
                    self.waiting.clear()
                few, more = rows, 0
        elif more or len(few) + len(new) > FEW:
            if few or new:
                self.waiting.appendList(pieces(few + new))
            few, more = [], more + len(few) + len(new)
        else:
            few = few + new
        out = []
        if late or ready or (due is not None and due < edge) or self.ttl_us is not None:
            self.load(kept)
            if late:
                out += self.through(key, late, True)
                n_late += len(late)
                self.place.update((n_late,))
            if ready:
                out += self.through(key, ready, False)
                last = ready[-1][:2]
            due, kept = self.evict(edge)
        times = [t for t in (first, due) if t is not None]
        before, timer = timer if timer != fired else None, max(min(times) // 1000 + 1, watermark_ms + 1) if times else None
        if timer != before:  # a key has one timer at a time
            if before is not None:
                self.handle.deleteTimer(before)
            if timer is not None:
                self.handle.registerTimer(timer)
        self.totals.update((len(few) + more, pack((last, n_late, timer, due, first, few, more, kept))))
        yield from self.put_out(out)

    def close(self):
        pass
