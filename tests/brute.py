"""Slow, plain versions of the stateful features and metrics, to test the Spark ones against."""

import numpy as np

DAY = 86_400_000
HOUR = 3_600_000


def replay(rows, devices_cap=50, merchants_cap=300, users_cap=200, recent_cap=500):
    """State before every event, by walking all earlier events of its key."""
    rows = sorted(rows, key=lambda r: (r["ts_ms"], r["txn_id"]))
    out = {}
    past = {}
    sets = {}
    for r in rows:
        mine = past.setdefault(r["user_id"], [])
        amounts = [p["amount"] for p in mine]
        recent = mine[-recent_cap:]
        day = [p for p in recent if r["ts_ms"] - DAY < p["ts_ms"]]
        hour = [p for p in recent if r["ts_ms"] - HOUR < p["ts_ms"]]
        o = {
            "row_no": len(mine) + 1,
            "mean_prior": float(np.mean(amounts)) if amounts else None,
            "std_prior": float(np.std(amounts, ddof=1)) if len(amounts) > 1 else None,
            "count_1h": len(hour),
            "count_24h": len(day),
            "sum_24h": sum(p["amount"] for p in day),
            "small_1h": sum(p["amount"] < 100 for p in hour),
            "prev_ms": mine[-1]["ts_ms"] if mine else None,
            "first_ms": mine[0]["ts_ms"] if mine else None,
            "n_before": sum(p["ts_ms"] < r["ts_ms"] for p in mine),
        }
        for key, member, cap, first, count in (
            ("user_id", "device_id", devices_cap, "user_device_first_ms", "user_devices"),
            ("user_id", "merchant_id", merchants_cap, "user_merchant_first_ms", "user_merchants"),
            ("device_id", "user_id", users_cap, "device_user_first_ms", "device_users"),
        ):
            known = sets.setdefault((key, r[key], member), [])
            hit = [t for m, t in known if m == r[member]]
            o[first] = hit[0] if hit else None
            o[count] = len(known) + (not hit)
            if not hit:
                known.append((r[member], r["ts_ms"]))
                del known[:-cap]
        mine.append(r)
        out[r["txn_id"]] = o
    return out


def threshold(y, s, fpr):
    neg = np.sort(s[y == 0])
    k = int(np.floor(fpr * len(neg)))
    if len(neg) == 0:
        return 0.5
    return neg[-k] if k > 0 else np.nextafter(neg[-1], np.inf)


def auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    wins = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
    return wins / (len(pos) * len(neg))


def average_precision(y, s):
    total = 0.0
    for t in np.unique(s):
        at = s >= t
        total += (y[s == t] == 1).sum() / y.sum() * (y[at] == 1).mean()
    return total
