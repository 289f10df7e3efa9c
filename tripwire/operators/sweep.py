"""Skew-safe running sums over a key, and the delta sweep built on them.

Spark has no ``count(DISTINCT) OVER (RANGE ...)`` and a plain window partitioned by a
hot key (one country, the 'Unknown' subnet, a big ASN) puts all its rows in one task.
Both problems are solved with one primitive:

``running_prior_sums``: for each event, the sum of value columns over the events of the
same key that come strictly earlier in a given order. The key's timeline is cut into
time buckets; inside a (key, bucket) a window gives the local prefix, and the totals of
all earlier buckets of the key (a window over the small per-bucket aggregate) are added.
A hot key is thus spread over as many tasks as it has buckets.

``entity_sweep``: prior sums and trailing-window distinct counts for several entity kinds
in one shuffle. Each row emits, per kind, one "own" event and, per window, one closing
event: -1 at whichever comes first of the next row of the same member on this key
(ordered just after that row) or expiry at ``t + w`` (a later phase, so the window bound
is inclusive). The running sum at a row's own position counts the distinct members with
a prior row within the window. Own events are then pivoted back to one row per event.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import parts_for

ORDER = ["_t", "_ph", "_tie", "_kind"]
DEFAULT_BUCKET_US = 3600 * 1_000_000
#: Rows that come in one time bucket on average, whatever their keys; events of a task.
MAX_BUCKET_ROWS = 200_000
EVENTS_OF_A_TASK = 500_000
#: Rows that one task puts together again from their events, and joins.
WIDE_ROWS_OF_A_TASK = 150_000


def running_prior_sums(ev: DataFrame, key: str, order: list[str], values: list, time_col: str,
                       bucket_us: float = DEFAULT_BUCKET_US, prefix: str = "S_", parts: int | None = None) -> DataFrame:
    """Add ``prefix + v`` = aggregate of ``v`` over strictly earlier rows (by ``order``) of the same ``key``.

    ``values``: column names (summed) or (column, "sum" | "max" | "min") pairs. Sums start at 0;
    max / min are null when there is no earlier row. ``parts``: partitions of the windows (default: the session's).
    """
    specs = [(v, "sum") if isinstance(v, str) else tuple(v) for v in values]
    ev = ev.selectExpr("*", f"CAST(floor({time_col} / {bucket_us!r}) AS BIGINT) AS _bkt")
    ordr = ", ".join(order)
    tot = ev.groupBy(key, "_bkt").agg(*[getattr(F, a)(v).alias(f"_tot_{v}") for v, a in specs])
    pre = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

    def z(a, e):
        return f"coalesce({e}, 0)" if a == "sum" else e

    carry = tot.selectExpr(key, "_bkt", *[
        f"{z(a, f'{a}(_tot_{v}) OVER (PARTITION BY {key} ORDER BY _bkt {pre})')} AS _c_{v}" for v, a in specs])
    local = (ev.repartition(parts, key, "_bkt") if parts else ev).selectExpr("*", *[
        f"{z(a, f'{a}({v}) OVER (PARTITION BY {key}, _bkt ORDER BY {ordr} {pre})')} AS _w_{v}" for v, a in specs])
    out = local.join(carry, [key, "_bkt"], "left")
    keep = [f"`{c}`" for c in ev.columns if c != "_bkt"]

    def comb(v, a):
        if a == "sum":
            return f"_w_{v} + coalesce(_c_{v}, 0)"
        # greatest / least skip nulls
        return f"{'greatest' if a == 'max' else 'least'}(_w_{v}, _c_{v})"

    return out.selectExpr(*keep, *[f"{comb(v, a)} AS {prefix}{v}" for v, a in specs])


@dataclass
class Kind:
    """One entity kind of the sweep.

    ``key``: SQL expression of the entity; ``sums``: name -> SQL value summed over prior rows;
    ``windows``: name -> width in microseconds (trailing distinct members, inclusive bound);
    ``next_us`` / ``next_eid``: the member's next row on this key (None: each row is its own
    member, giving trailing counts).
    """
    name: str
    key: str
    sums: dict[str, str] = field(default_factory=dict)
    windows: dict[str, int] = field(default_factory=dict)
    next_us: str | None = None
    next_eid: str | None = None


def entity_sweep(df: DataFrame, kinds: list[Kind], bucket_us: int = DEFAULT_BUCKET_US) -> DataFrame:
    """One row per ``event_id`` with ``{kind}_{name}`` for every sum and window of every kind."""
    vals = sorted({n for k in kinds for n in list(k.sums) + list(k.windows)})

    def struct(kind: Kind, t, ph, tie, flag, v: dict[str, str]):
        fields = [f"'{kind.name}' AS _en", f"CAST({kind.key} AS STRING) AS _key", f"CAST({t} AS BIGINT) AS _t",
                  f"CAST({ph} AS INT) AS _ph", f"CAST({tie} AS BIGINT) AS _tie", f"{flag} AS _kind"]
        fields += [f"CAST({v.get(n, '0')} AS BIGINT) AS {n}" for n in vals]
        return "named_struct(" + ", ".join(f"'{f.split(' AS ')[-1]}', {f.rsplit(' AS ', 1)[0]}" for f in fields) + ")"

    items = []
    for k in kinds:
        own = {**k.sums, **{n: "1" for n in k.windows}}
        items.append(struct(k, "login_us", 0, "event_id", 0, own))
        for wn, w in k.windows.items():
            close = {wn: "-1"}
            if k.next_us:
                use = f"({k.next_us} IS NOT NULL AND {k.next_us} <= login_us + {w})"
                items.append(struct(k, f"CASE WHEN {use} THEN {k.next_us} ELSE login_us + {w} END",
                                    f"CASE WHEN {use} THEN 0 ELSE 1 END",
                                    f"CASE WHEN {use} THEN {k.next_eid} ELSE event_id END", 1, close))
            else:
                items.append(struct(k, f"login_us + {w}", 1, "event_id", 1, close))
    x = df.selectExpr("event_id", f"explode(array({', '.join(items)})) AS _e")
    x = x.selectExpr("event_id", "_e._en AS _en", "concat(_e._en, '\u0001', _e._key) AS _k",
                     *[f"_e.{c} AS {c}" for c in ORDER], *[f"_e.{n} AS {n}" for n in vals])
    rows, lo, hi = df.agg(F.count(F.lit(1)), F.min("login_us"), F.max("login_us")).first()
    # a bucket of the busiest entity (which may have all rows) holds no more rows than a task; a narrower one changes no result
    if rows > MAX_BUCKET_ROWS and hi > lo:
        bucket_us = max(1, min(bucket_us, (hi - lo + 1) * MAX_BUCKET_ROWS // rows))
    events = rows * len(items)
    r = running_prior_sums(x, "_k", ORDER, vals, "_t", bucket_us, prefix="S_", parts=parts_for(df.sparkSession, events, EVENTS_OF_A_TASK))
    own = r.where("_kind = 0")
    aggs = [F.max(F.when(F.col("_en") == k.name, F.col(f"S_{n}"))).alias(f"{k.name}_{n}")
            for k in kinds for n in list(k.sums) + list(k.windows)]
    # dealt by rows: a row's events come from as many tasks as it has kinds, so there is nothing to combine before
    return own.repartition(parts_for(df.sparkSession, rows, WIDE_ROWS_OF_A_TASK), "event_id").groupBy("event_id").agg(*aggs)
