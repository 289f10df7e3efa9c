"""Plain-Python state walk over logins in time order (tests only).

Written from the feature definitions, independently of the Spark windows: dicts of sets,
last-seen times and deques, updated after each row, like a streaming engine would.
"""

from __future__ import annotations

import math
from collections import defaultdict, deque

W10, W1H = 600_000_000, 3_600_000_000


def walk(rows):
    """rows: dicts with event_id, user_id, login_us, success, country_key, asn_key, subnet, device."""
    rows = sorted(rows, key=lambda r: (r["login_us"], r["event_id"]))
    seen = defaultdict(set)  # (user, kind) -> values
    last = {}  # (user, kind, value) -> us
    n = defaultdict(int)
    fails = defaultdict(int)
    consec = defaultdict(int)
    ev = defaultdict(deque)  # user -> (us, fail)
    ents = defaultdict(deque)  # user -> (us, kind)
    ent_users = defaultdict(set)  # (kind, value) -> users
    ent_fail_users = defaultdict(set)
    ent_cnt = defaultdict(int)
    ent_fail = defaultdict(int)
    ent_win = defaultdict(deque)  # (kind, value, w) -> (us, user)
    out = {}
    for r in rows:
        u, t, ok = r["user_id"], r["login_us"], r["success"]
        vals = {"country": r["country_key"], "asn": r["asn_key"], "subnet": r["subnet"], "device": r["device"]}
        f = {}
        f["h_n"] = n[u]
        ft = {k: int(v not in seen[(u, k)]) for k, v in vals.items()}
        f.update({f"ft_{k}": x for k, x in ft.items()})
        f.update({f"cnt_{k}": len(seen[(u, k)]) for k in vals})
        for k, v in vals.items():
            lt = last.get((u, k, v))
            f[f"secs_{k}"] = 0.0 if lt is None else (t - lt) / 1e6
        f["user_fail_count_prior"] = fails[u]
        f["consecutive_failures_prior"] = consec[u]
        f10 = sum(1 for (tt, ff) in ev[u] if ff and t - tt <= W10)
        f1h = sum(1 for (tt, ff) in ev[u] if ff and t - tt <= W1H)
        s10 = sum(1 for (tt, ff) in ev[u] if not ff and t - tt <= W10)
        f.update(fail_count_10min=f10, fail_count_1hour=f1h, success_count_10min=s10)
        f["new_entities_10min"] = sum(1 for (tt, _) in ents[u] if t - tt <= W10)
        f["new_entities_1hour"] = sum(1 for (tt, _) in ents[u] if t - tt <= W1H)
        for k in ("subnet", "asn", "country", "device"):
            key = (k, vals[k])
            f[f"gf_{k}_users"] = len(ent_users[key])
            f[f"gf_{k}_failed_users"] = len(ent_fail_users[key])
            f[f"gf_{k}_rate"] = ent_fail[key] / ent_cnt[key] if ent_cnt[key] else 0.0
            for w in (W10, W1H):
                f[f"gf_{k}_users_{w}"] = len({uu for (tt, uu) in ent_win[key + (w,)] if t - tt <= w})
        out[r["event_id"]] = f
        # update state after the row
        for k, v in vals.items():
            if ft[k]:
                ents[u].append((t, k))
            seen[(u, k)].add(v)
            last[(u, k, v)] = t
        n[u] += 1
        fail = 1 - ok
        fails[u] += fail
        consec[u] = consec[u] + 1 if fail else 0
        ev[u].append((t, fail))
        for k in ("subnet", "asn", "country", "device"):
            key = (k, vals[k])
            ent_users[key].add(u)
            ent_cnt[key] += 1
            ent_fail[key] += fail
            if fail:
                ent_fail_users[key].add(u)
            for w in (W10, W1H):
                ent_win[key + (w,)].append((t, u))
    return out


def log1p(x):
    return math.log1p(x)
