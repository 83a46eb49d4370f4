"""The same queries as DuckDB SQL over the given tables, for cross-checking.

A query is a chain of named common table expressions; ``sql`` pulls in what a final select
needs. Doubles are compared at six decimals after a small shift that keeps decimal ties off
the rounding boundary.
"""

from __future__ import annotations

import re
from string import Formatter

from fraudspark.operators import decide as D
from fraudspark.operators.scoring import LinearModel
from fraudspark.plans.models import CHALLENGER, CHAMPION
from fraudspark.schemas import (
    CATEGORIES,
    CATEGORY_RISK,
    FEATURES,
)

DAY = 86400000
SHIFT = 0.5137
DIGITS = 6


def hu(x: str, d: int) -> str:
    return f"(floor(({x}) * 1e{d} + 0.5) / 1e{d})"


def fx(x: str, d: int) -> str:
    if d == 0:
        return f"(floor(({x}) + 0.5)::bigint)::varchar"
    n = 10**d
    u = f"floor(abs({x}) * 1e{d} + 0.5)::bigint"
    return (
        f"(CASE WHEN ({x}) < 0 AND {u} > 0 THEN '-' ELSE '' END || (({u}) // {n})::varchar"
        f" || '.' || lpad((({u}) % {n})::varchar, {d}, '0'))"
    )


def grp(x: str) -> str:
    return f"format('{{:,}}', floor(({x}) + 0.5)::bigint)"


def pct(x: str) -> str:
    return f"({fx(f'({x}) * 1e2', 0)} || '%')"


def ist(x: str) -> str:
    return f"strftime(epoch_ms(({x}) + 19800000), '%Y-%m-%d %H:%M IST')"


def name_list(values: list) -> str:
    return "[" + ", ".join(repr(v) for v in values) + "]"


CATS = name_list(CATEGORIES)
RISKS = "[" + ", ".join(f"{v}::double" for v in CATEGORY_RISK.values()) + "]"


def age(col: str) -> str:
    return f"coalesce(greatest(0e0, (ts_ms - {col}) / {DAY}e0), 0e0)"


def flag(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1e0 ELSE 0e0 END"


HIST = "ORDER BY ts_ms, txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
SOFAR = "ORDER BY ts_ms, txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
OWN = (
    "(PARTITION BY user_id, ts_ms ORDER BY txn_id "
    "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
)


def rng(ms: int) -> str:
    return (
        f"(PARTITION BY user_id ORDER BY ts_ms RANGE BETWEEN {ms - 1} PRECEDING AND CURRENT ROW)"
    )


def velocity(expr: str, ms: int) -> str:
    return f"coalesce(sum({expr}) OVER {rng(ms)}, 0) - coalesce(sum({expr}) OVER {OWN}, 0)"


FEATURE_SQL = {
    "amount": "amount",
    "amount_log": "ln(1e0 + amount)",
    "amount_z": "least(50e0, greatest(-10e0, CASE WHEN row_no - 1 >= 3 AND std_prior > 0 "
    "THEN (amount - mean_prior) / std_prior ELSE 0e0 END))",
    "amount_ratio_mean": "least(100e0, CASE WHEN mean_prior > 0 THEN amount / mean_prior "
    "ELSE 1e0 END)",
    "txn_count_1h": "least(500e0, count_1h)",
    "txn_count_24h": "least(500e0, count_24h)",
    "amount_sum_24h": "sum_24h",
    "small_txn_count_1h": "small_1h",
    "seconds_since_last": "gap",
    "is_new_device": flag("user_device_first_ms IS NULL"),
    "device_user_age_days": age("user_device_first_ms"),
    "is_new_merchant": flag("user_merchant_first_ms IS NULL"),
    "user_device_count": "user_devices",
    "device_user_count": "device_users",
    "device_age_days": age("device_first_ms"),
    "distance_from_last_km": "dist",
    "speed_kmh": "CASE WHEN dist > 0 THEN least(5000e0, dist / greatest(gap / 3600e0, 1e0/60e0)) "
    "ELSE 0e0 END",
    "hour_local": "hour_local",
    "is_night": flag("hour_local < 5.5"),
    "is_weekend": flag("weekday >= 5"),
    "is_online": flag("online"),
    "is_international": flag("country <> 'IN'"),
    "is_home_city": flag("city = coalesce(home_city, prev_city, city)"),
    "account_age_days": age("coalesce(account_created_ms, first_ms)"),
    "txn_count_total": "(row_no - 1)::double",
    "category_risk": "coalesce(merchant_risk, 0.1::double)",
    "merchant_age_days": age("merchant_created_ms"),
    "channel_card": flag("channel = 'CARD'"),
    "channel_netbanking": flag("channel = 'NETBANKING'"),
    **{f"cat_{c}": flag(f"merchant_category = '{c}'") for c in CATEGORIES},
}
assert list(FEATURE_SQL) == FEATURES


def score(m: LinearModel) -> str:
    terms = [f"{m.intercept}::double"] + [
        f"{f} * ({w}::double)" for f, w in m.weights.items()
    ]
    return hu(f"1e0 / (1e0 + exp(-({' + '.join(terms)})))", 6)


def contribution_list(m: LinearModel) -> str:
    items = [
        f"{{'feature': '{f}', 'value': {f}, 'contribution': "
        f"({f} - ({m.means.get(f, 0.0)}::double)) * ({w}::double)}}"
        for f, w in m.weights.items()
    ]
    return "[" + ", ".join(items) + "]"


RULES = [
    "amount_z > 3",
    "txn_count_1h >= 4",
    "is_new_device = 1 AND amount_ratio_mean > 2",
    "speed_kmh > 500",
    "small_txn_count_1h >= 3",
    "is_night = 1 AND category_risk >= 0.18",
    "is_international = 1",
    "device_user_count >= 3",
]
RULE_SCORE = " + ".join(f"({flag(r)})" for r in RULES)

LIVE_COLUMNS = ["txn_id", "ts_ms", "score", "flagged", "threshold", "model_version"]


def feature_long(source: str, where: str = "true") -> str:
    parts = ", ".join(f"{{'feature': '{f}', 'value': {f}}}" for f in FEATURES)
    return (
        f"SELECT r.feature AS feature, r.value AS value FROM "
        f"(SELECT unnest([{parts}]) AS r FROM {source} WHERE {where})"
    )


DOT = " + ".join(f"a.x{i} * b.x{i}" for i in range(len(FEATURES)))
NORM = "sqrt(" + " + ".join(f"z{i} * z{i}" for i in range(len(FEATURES))) + ") + 1e-9"
ZS = ", ".join(
    f"(f.{f} - s.m{i}) / s.s{i} AS z{i}" for i, f in enumerate(FEATURES)
)
XS = ", ".join(f"z{i} / ({NORM}) AS x{i}" for i in range(len(FEATURES)))

def filled(template: str, **parts: str) -> str:
    """SQL for a template whose fields are SQL expressions."""
    out = []
    for text, field, _, _ in Formatter().parse(template):
        if text:
            out.append("'" + text.replace("'", "''") + "'")
        if field:
            out.append(parts[field])
    return " || ".join(out)


def evidence(name: str, where: str, **parts: str) -> tuple[str, float, str]:
    points, template = D.EVIDENCE[name]
    return where, points, filled(template, **parts)


SCORES = {"score": fx("score", 2), "threshold": fx("threshold", 2)}
EVIDENCE = [
    evidence("score_high", "score >= 0.6", **SCORES),
    evidence("score_above", "score < 0.6 AND score >= threshold", **SCORES),
    evidence("device_shared", "new_acct AND dev_users >= 2", device="device_id", users="dev_users"),
    evidence("device_new", "new_acct AND dev_users < 2", device="device_id", age=fx("dev_age", 1)),
    evidence("device_fraud", "confirmed > 0", n="confirmed"),
    evidence("burst", "n1 >= 4", n="n1"),
    evidence("small_burst", "small >= 3", n="small"),
    evidence("amount_high", "med > 0 AND amount > 3 * med", amount=grp("amount"),
             times=fx("amount / med", 1), median=grp("med")),
    evidence("speed", "speed > 500", speed=fx("speed", 0)),
    evidence("foreign", "country <> 'IN'", city="city", country="country"),
    evidence("category", "risk >= 0.2 OR coalesce(rate > 0.05, false)",
             category="coalesce(mcat, 'None')", prior=fx("risk", 2),
             rate="coalesce(rate::varchar, 'None')"),
    evidence("similar_fraud", "coalesce(share >= 0.6, false)", share=pct("share")),
    evidence("night", "(hh < 5 OR hh >= 23) AND nights = 0", time='substr("when", 12, 5)'),
    evidence("travel", "travel_min IS NOT NULL AND (home_city IS NULL OR city <> home_city)"
             " AND country = 'IN'", days=fx("travel_min / 1440", 0), city="city"),
    evidence("upgrade", "electronics > 0 AND new_acct AND dev_users <= 1"),
    evidence("device_known", "NOT new_acct AND dev_age > 30", days=fx("dev_age", 0)),
    evidence("merchant_known", "same_merch > 0"),
    evidence("similar_legit", "coalesce(share <= 0.2, false)", share=pct("share")),
]
SUMMARY = filled(
    D.SUMMARY,
    txn="txn_id",
    amount=grp("amount"),
    category="coalesce(mcat, 'unknown')",
    score=fx("score", 2),
    points=f"CASE WHEN points >= 0 THEN '+' ELSE '-' END || {fx('abs(points)', 1)}",
    signals=f"CASE WHEN len(texts) = 0 THEN '{D.NO_SIGNAL}'"
    " ELSE array_to_string(list_slice(texts, 1, 3), '; ') END",
    verdict="verdict",
    confidence="conf_text",
    action="replace(recommended_action, '_', ' ')",
)


def scale(points: str, fraud: list, legit: list, review: str, kind: str) -> str:
    def pick(values: list, step: str) -> str:
        lit = ", ".join(f"{v!r}::{kind}" for v in values)
        return f"([{lit}])[least(floor(({step}) * 2)::bigint, {len(values) - 1}) + 1]"

    return (
        f"CASE WHEN {points} >= 3 THEN {pick(fraud, f'{points} - 3')} "
        f"WHEN {points} <= 0.5 THEN {pick(legit, f'0.5 - {points}')} ELSE {review} END"
    )


CTES: dict[str, str] = {
    "base": f"""SELECT event_id, user_id // 3 AS acct, event_type, value,
       epoch_us(ts) // 1000 AS raw_ms, CAST(props->>'$.k' AS int) AS k FROM events""",
    "x": """SELECT *, raw_ms - raw_ms % 21600000 + (raw_ms % 21600000) // 12 AS ts_ms,
       (k * 3 + event_id % 7) % 40 AS mkey FROM base""",
    "y": """SELECT *, CASE WHEN k IN (13, 14) THEN (home_idx + 7) % 25 ELSE home_idx END AS city_idx
       FROM (SELECT x.*, coalesce(c.c_nationkey, x.acct % 25) AS home_idx
       FROM x LEFT JOIN customer c ON c.c_custkey = x.acct)""",
    "txn": f"""SELECT concat('T', lpad(CAST(event_id AS varchar), 9, '0')) AS txn_id, ts_ms,
       concat('U', lpad(CAST(acct AS varchar), 6, '0')) AS user_id,
       concat('M', lpad(CAST(mkey AS varchar), 5, '0')) AS merchant_id,
       ({CATS})[mkey % 16 + 1] AS merchant_category,
       CASE WHEN k >= 97 THEN concat('DRING', CAST(event_id % 5 AS varchar))
            WHEN k % 10 = 9 THEN concat('D', CAST(acct AS varchar), 'b')
            ELSE concat('D', CAST(acct AS varchar), 'a') END AS device_id,
       CASE k % 3 WHEN 0 THEN 'UPI' WHEN 1 THEN 'CARD' ELSE 'NETBANKING' END AS channel,
       value * 6e0 AS amount, concat('CITY_', CAST(city_idx AS varchar)) AS city,
       CAST(8 + city_idx AS double) AS lat, CAST(68 + city_idx AS double) AS lon,
       CASE WHEN k = 14 THEN 'AE' ELSE 'IN' END AS country, (k % 2 = 0) AS is_online,
       (k >= 97 OR (event_type = 'error' AND value > 150)) AS is_fraud,
       CASE WHEN k = 97 THEN 'account_takeover' WHEN k = 98 THEN 'card_testing'
            WHEN k = 99 THEN 'low_and_slow'
            WHEN event_type = 'error' AND value > 150 THEN 'velocity_burst'
            ELSE 'none' END AS fraud_type,
       event_type AS context, event_id AS num FROM y""",
    "users": """SELECT concat('U', lpad(CAST(c_custkey AS varchar), 6, '0')) AS user_id,
       concat('CITY_', CAST(c_nationkey AS varchar)) AS home_city,
       CAST(8 + c_nationkey AS double) AS home_lat, CAST(68 + c_nationkey AS double) AS home_lon,
       1704067200000 - (c_custkey % 400 + 5) * 86400000 AS account_created_ms,
       CAST(1.0 AS double) AS spend_level FROM customer""",
    "merchants": f"""SELECT concat('M', lpad(CAST(s_suppkey AS varchar), 5, '0')) AS merchant_id,
       ({CATS})[s_suppkey % 16 + 1] AS category,
       concat('CITY_', CAST(s_nationkey AS varchar)) AS city, 'IN' AS country,
       (s_suppkey % 2 = 0) AS is_online,
       1704067200000 - (s_suppkey % 900 + 30) * 86400000 AS created_ms,
       ({RISKS})[s_suppkey % 16 + 1] AS category_risk
       FROM supplier""",
    "s1": f"""SELECT *, is_online AS online,
       row_number() OVER (PARTITION BY user_id ORDER BY ts_ms, txn_id) AS row_no,
       rank() OVER (PARTITION BY user_id ORDER BY ts_ms) - 1 AS n_before,
       avg(amount) OVER (PARTITION BY user_id {HIST}) AS mean_prior,
       stddev_samp(amount) OVER (PARTITION BY user_id {HIST}) AS std_prior,
       min(ts_ms) OVER (PARTITION BY user_id {HIST}) AS first_ms,
       lag(ts_ms) OVER (PARTITION BY user_id ORDER BY ts_ms, txn_id) AS prev_ms,
       lag(lat) OVER (PARTITION BY user_id ORDER BY ts_ms, txn_id) AS prev_lat,
       lag(lon) OVER (PARTITION BY user_id ORDER BY ts_ms, txn_id) AS prev_lon,
       lag(city) OVER (PARTITION BY user_id ORDER BY ts_ms, txn_id) AS prev_city,
       {velocity("1e0", 3600000)} AS count_1h, {velocity("1e0", DAY)} AS count_24h,
       {velocity("amount", DAY)} AS sum_24h,
       {velocity("CASE WHEN amount < 100 THEN 1e0 ELSE 0e0 END", 3600000)} AS small_1h,
       min(ts_ms) OVER (PARTITION BY user_id, device_id {HIST}) AS user_device_first_ms,
       min(ts_ms) OVER (PARTITION BY user_id, merchant_id {HIST}) AS user_merchant_first_ms,
       rank() OVER (PARTITION BY device_id ORDER BY ts_ms) - 1 AS device_n_before,
       min(ts_ms) OVER (PARTITION BY device_id {HIST}) AS device_first_ms,
       min(ts_ms) OVER (PARTITION BY device_id, user_id {HIST}) AS device_user_first_ms
       FROM txn""",
    "s1d": f"""SELECT *,
       sum(CASE WHEN user_device_first_ms IS NULL THEN 1e0 ELSE 0e0 END)
         OVER (PARTITION BY user_id {SOFAR}) AS user_devices,
       sum(CASE WHEN device_user_first_ms IS NULL THEN 1e0 ELSE 0e0 END)
         OVER (PARTITION BY device_id {SOFAR}) AS device_users,
       coalesce(sum(CASE WHEN device_user_first_ms IS NULL THEN 1e0 ELSE 0e0 END)
         OVER (PARTITION BY device_id ORDER BY ts_ms
               RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS device_users_before
       FROM s1""",
    "s2": f"""SELECT d.*, u.home_city, u.account_created_ms, m.created_ms AS merchant_created_ms,
       m.category_risk AS merchant_risk,
       CASE WHEN prev_ms IS NULL THEN 2592000e0
         ELSE least(2592000e0, greatest(0e0, (ts_ms - prev_ms) / 1000e0)) END AS gap,
       CASE WHEN prev_lat IS NULL THEN 0e0 ELSE 2 * 6371e0 * asin(sqrt(least(1e0,
         pow(sin(radians(lat - prev_lat) / 2), 2) + cos(radians(prev_lat)) * cos(radians(lat))
         * pow(sin(radians(lon - prev_lon) / 2), 2)))) END AS dist,
       ((ts_ms + 19800000) % {DAY}) / 3600000e0 AS hour_local,
       ((ts_ms + 19800000) // {DAY} + 3) % 7 AS weekday
       FROM s1d d LEFT JOIN users u ON u.user_id = d.user_id
       LEFT JOIN merchants m ON m.merchant_id = d.merchant_id""",
    "feats": "SELECT txn_id, ts_ms, user_id, merchant_id, merchant_category, device_id, channel,"
    " city, country, online, is_fraud, fraud_type, context, num, row_no, n_before,"
    " device_n_before, device_users_before, device_first_ms AS device_first_prior_ms, home_city,"
    " account_created_ms, "
    + ", ".join(f"{e} AS {f}" for f, e in FEATURE_SQL.items())
    + " FROM s2",
    "bounds": f"""SELECT min(ts_ms) + 7 * {DAY}e0 AS train_start,
       max(ts_ms) - 14 * {DAY}e0 AS val_start, max(ts_ms) - 7 * {DAY}e0 AS test_start,
       max(ts_ms) AS last_ms FROM txn""",
    "train": "SELECT f.* FROM feats f, bounds WHERE ts_ms >= train_start AND ts_ms < val_start",
    "val": "SELECT f.* FROM feats f, bounds WHERE ts_ms >= val_start AND ts_ms < test_start",
    "test": "SELECT f.* FROM feats f, bounds WHERE ts_ms >= test_start",
    "ruled": f"SELECT *, ({RULE_SCORE}) AS rule_score FROM feats",
    "scored": f"SELECT *, {score(CHAMPION)} AS score, {score(CHALLENGER)} AS score2, "
    f"({RULE_SCORE}) AS rule_score, "
    "((num * 37) % 1200) / 10e0 AS latency_ms FROM feats",
    "decisions": f"""SELECT s.*, s.score >= {CHAMPION.threshold} AS flagged,
       {CHAMPION.threshold}::double AS threshold, '{CHAMPION.version}' AS model_version
       FROM scored s, bounds WHERE ts_ms >= test_start""",
    "anchors": "SELECT * FROM decisions WHERE flagged",
    "contrib": f"""SELECT txn_id, r.feature AS feature, r.value AS value,
       r.contribution AS contribution FROM
       (SELECT txn_id, unnest({contribution_list(CHAMPION)}) AS r FROM anchors)""",
    "reasons": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY txn_id
       ORDER BY -abs(contribution), feature) AS place,
       CASE WHEN contribution > 0 THEN 'raises' ELSE 'lowers' END AS direction FROM contrib)
       WHERE place <= 3""",
    "hist": f"""SELECT a.txn_id AS case_txn_id, a.ts_ms AS anchor_ms,
       a.device_id AS anchor_device_id, a.merchant_id AS anchor_merchant_id, r.txn_id, r.ts_ms,
       r.merchant_id, r.merchant_category, r.device_id, r.channel, {hu('r.amount', 4)} AS amount,
       r.city, r.country, r.online AS is_online,
       CASE WHEN r.ts_ms >= test_start THEN {hu('r.score', 4)} END AS model_score,
       {ist('r.ts_ms')} AS "when",
       {hu('(a.ts_ms - r.ts_ms) / 60000e0', 1)} AS minutes_before
       FROM anchors a JOIN scored r ON r.user_id = a.user_id AND r.ts_ms < a.ts_ms
         AND r.ts_ms >= a.ts_ms - 336 * 3600000, bounds
       WHERE r.row_no > a.n_before - 60""",
    "hsum": f"""SELECT case_txn_id, count(*) AS history_count,
       {hu('list_sort(list(amount))[count(*) // 2 + 1]', 2)} AS median_amount,
       {hu('max(amount)', 2)} AS max_amount,
       count(DISTINCT device_id) AS distinct_devices,
       list_sort(list(DISTINCT city)) AS distinct_cities,
       list_sort(list(DISTINCT merchant_category)) AS categories,
       count(*) FILTER (WHERE minutes_before <= 60) AS n1,
       count(*) FILTER (WHERE minutes_before <= 60 AND amount < 100) AS small,
       count(*) FILTER (WHERE substr("when", 12, 2)::int < 5) AS nights,
       min(minutes_before) FILTER (WHERE merchant_category = 'travel') AS travel_min,
       count(*) FILTER (WHERE merchant_category = 'electronics' AND minutes_before <= 4320)
         AS electronics,
       count(*) FILTER (WHERE device_id = anchor_device_id) AS same_dev,
       count(*) FILTER (WHERE merchant_id = anchor_merchant_id) AS same_merch
       FROM hist GROUP BY case_txn_id""",
    "past_anchors": f"""SELECT s.*, least(s.ts_ms, test_start) AS known_ms FROM scored s, bounds
       WHERE ts_ms >= val_start AND score >= {CHAMPION.threshold}""",
    "mpoints": """SELECT DISTINCT p.merchant_id, p.known_ms FROM past_anchors p WHERE EXISTS
       (SELECT 1 FROM feats f, bounds WHERE f.merchant_id = p.merchant_id AND f.ts_ms < test_start)""",
    "mfacts": f"""SELECT p.merchant_id, p.known_ms, count(f.txn_id) AS resolved_txns,
       count(DISTINCT f.user_id) AS distinct_users,
       {hu('avg(f.is_fraud::int::double)', 4)} AS confirmed_fraud_rate,
       {hu('quantile_cont(f.amount, 0.5)', 4)} AS merchant_median_amount
       FROM mpoints p LEFT JOIN feats f ON f.merchant_id = p.merchant_id AND f.ts_ms < p.known_ms
       GROUP BY p.merchant_id, p.known_ms""",
    "masof": f"""SELECT a.txn_id, a.merchant_id, m.category AS merchant_profile_category,
       m.city AS merchant_city, m.country AS merchant_country,
       m.is_online AS merchant_is_online, m.category_risk AS category_risk_prior,
       CASE WHEN m.merchant_id IS NOT NULL THEN f.resolved_txns END AS resolved_txns,
       CASE WHEN m.merchant_id IS NOT NULL THEN f.distinct_users END AS distinct_users,
       CASE WHEN m.merchant_id IS NOT NULL THEN f.confirmed_fraud_rate END
         AS confirmed_fraud_rate,
       CASE WHEN m.merchant_id IS NOT NULL THEN f.merchant_median_amount END
         AS merchant_median_amount,
       {hu(f'(a.ts_ms - m.created_ms) / {DAY}e0', 1)} AS merchant_age_days
       FROM past_anchors a LEFT JOIN merchants m ON m.merchant_id = a.merchant_id
       LEFT JOIN mfacts f ON f.merchant_id = m.merchant_id AND f.known_ms = a.known_ms""",
    "dconf": """SELECT p.txn_id, count(*) AS n FROM past_anchors p JOIN feats f
       ON f.device_id = p.device_id AND f.ts_ms < p.known_ms AND f.is_fraud GROUP BY p.txn_id""",
    "dasof": f"""SELECT a.txn_id, a.device_id,
       CASE WHEN device_first_prior_ms < a.ts_ms THEN {ist('device_first_prior_ms')} END
         AS first_seen,
       coalesce(CASE WHEN device_first_prior_ms < a.ts_ms THEN
         {hu(f'(a.ts_ms - device_first_prior_ms) / {DAY}e0', 2)} END, 0e0) AS device_age_days,
       a.device_n_before AS device_txn_count,
       a.device_users_before::bigint AS device_distinct_users,
       coalesce(c.n, 0) AS confirmed_fraud_txns
       FROM past_anchors a LEFT JOIN dconf c ON c.txn_id = a.txn_id""",
    "stats": "SELECT "
    + ", ".join(
        f"avg({f}) AS m{i}, CASE WHEN stddev_samp({f}) > 0 THEN stddev_samp({f}) ELSE 1e0 END"
        f" AS s{i}"
        for i, f in enumerate(FEATURES)
    )
    + " FROM train",
    "pool": "SELECT * FROM train UNION ALL SELECT * FROM val",
    "bank": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY is_fraud
       ORDER BY md5(concat(txn_id, ':0')), txn_id) AS rn FROM pool) WHERE rn <= 4000""",
    "bankx": f"""SELECT txn_id, is_fraud, fraud_type, amount, txn_count_1h, is_new_device,
       speed_kmh, {XS} FROM (SELECT f.*, {ZS} FROM bank f, stats s)""",
    "anchorx": f"SELECT txn_id, {XS} FROM (SELECT f.txn_id, {ZS} FROM anchors f, stats s)",
    "sims": f"""SELECT a.txn_id, b.txn_id AS case_txn_id, b.is_fraud, b.fraud_type, b.amount,
       b.txn_count_1h, b.is_new_device, b.speed_kmh,
       round_even({DOT}, 9) AS similarity FROM anchorx a, bankx b""",
    "near": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY txn_id
       ORDER BY similarity DESC, case_txn_id) AS place FROM sims) WHERE place <= 7""",
    "share": f"""SELECT txn_id, {hu('avg(is_fraud::int::double)', 2)} AS fraud_share,
       count(*) AS neighbours FROM near GROUP BY txn_id""",
    "speedy": f"""SELECT txn_id, {hu('value', 3)} AS speed FROM reasons
       WHERE feature = 'speed_kmh'""",
    "dossier": f"""SELECT a.txn_id, a.ts_ms, a.user_id, a.merchant_id, a.device_id,
       {hu('a.amount', 4)} AS amount, a.city, a.country, {ist('a.ts_ms')} AS "when",
       {hu('a.score', 4)} AS score, {hu('a.threshold', 4)} AS threshold, a.home_city,
       {hu(f'(a.ts_ms - a.account_created_ms) / {DAY}e0', 1)} AS account_age_days,
       coalesce(h.history_count, 0) AS history_count, h.median_amount,
       coalesce(h.distinct_devices, 0) AS distinct_devices,
       CASE WHEN coalesce(h.median_amount, 0) <> 0 THEN h.median_amount
            ELSE {hu('a.amount', 4)} END AS med,
       coalesce(h.n1, 0) AS n1, coalesce(h.small, 0) AS small, coalesce(h.nights, 0) AS nights,
       h.travel_min, coalesce(h.electronics, 0) AS electronics,
       coalesce(h.same_dev, 0) = 0 AS new_acct, coalesce(h.same_merch, 0) AS same_merch,
       d.device_distinct_users AS dev_users, d.device_age_days AS dev_age,
       d.device_txn_count, d.confirmed_fraud_txns AS confirmed,
       m.merchant_profile_category AS mcat, m.resolved_txns,
       coalesce(m.category_risk_prior, 0e0) AS risk, m.confirmed_fraud_rate AS rate,
       s.fraud_share AS share, coalesce(v.speed, 0e0) AS speed,
       substr({ist('a.ts_ms')}, 12, 2)::int AS hh, a.is_fraud AS truth_fraud,
       a.fraud_type AS truth_type, a.num
       FROM anchors a LEFT JOIN hsum h ON h.case_txn_id = a.txn_id
       LEFT JOIN dasof d ON d.txn_id = a.txn_id LEFT JOIN masof m ON m.txn_id = a.txn_id
       LEFT JOIN share s ON s.txn_id = a.txn_id LEFT JOIN speedy v ON v.txn_id = a.txn_id""",
    "evid": "SELECT *, list_filter(["
    + ", ".join(
        f"CASE WHEN {c} THEN {{'p': {p}::double, 't': {t}}} END" for c, p, t in EVIDENCE
    )
    + "], lambda x: x IS NOT NULL) AS ev FROM dossier",
    "pointed": "SELECT *, coalesce(list_sum(list_transform(ev, lambda x: x.p)), 0e0) AS points,"
    " list_transform(ev, lambda x: x.t) AS texts FROM evid",
    "verdicts": f"""SELECT *, CASE WHEN points >= 3 THEN 'fraud' WHEN points <= 0.5 THEN 'legit'
       ELSE 'needs_review' END AS verdict,
       {scale('points', [round(v, 2) for v in D.FRAUD_SCALE],
              [round(v, 2) for v in D.LEGIT_SCALE], '0.5::double', 'double')} AS confidence,
       {scale('points', [f'{v:.0%}' for v in D.FRAUD_SCALE],
              [f'{v:.0%}' for v in D.LEGIT_SCALE], "'50%'", 'varchar')} AS conf_text
       FROM pointed""",
    "typed": """SELECT *, CASE WHEN verdict <> 'fraud' THEN 'none'
       WHEN small >= 3 THEN 'card_testing'
       WHEN speed > 500 OR country <> 'IN' THEN 'geo_jump'
       WHEN new_acct AND dev_users >= 2 THEN 'account_takeover'
       WHEN n1 >= 4 THEN 'velocity_burst'
       WHEN risk >= 0.2 AND med > 0 AND amount > 2 * med THEN 'merchant_collusion'
       WHEN new_acct AND amount <= 2 * med THEN 'low_and_slow'
       WHEN new_acct THEN 'account_takeover' ELSE 'none' END AS fraud_type,
       CASE WHEN verdict = 'fraud' AND confidence >= 0.8 THEN 'block_card_and_contact_customer'
       WHEN verdict = 'legit' THEN 'approve' ELSE 'step_up_authentication' END
         AS recommended_action,
       concat('case_', substr(md5(concat(txn_id, '|lin-v1')), 1, 10)) AS case_id FROM verdicts""",
    "told": f"""SELECT *, array_to_string(list_slice(CASE WHEN len(texts) = 0 THEN
         [{filled(D.ONLY_SCORE, score=fx('score', 2))}] ELSE texts END, 1, 8), ' | ')
         AS key_evidence, substr({SUMMARY}, 1, 1200) AS analyst_summary
       FROM typed""",
    "cases": """SELECT txn_id, is_fraud, fraud_type, context, score, amount,
       CASE WHEN is_fraud THEN fraud_type ELSE concat('legit:', context) END AS stratum
       FROM (SELECT *, row_number() OVER (PARTITION BY is_fraud ORDER BY turn, grp) AS pick FROM
         (SELECT *, CASE WHEN is_fraud THEN fraud_type ELSE context END AS grp,
            row_number() OVER (PARTITION BY is_fraud,
              CASE WHEN is_fraud THEN fraud_type ELSE context END
              ORDER BY md5(concat(txn_id, ':0')), txn_id) AS turn FROM anchors))
       WHERE pick <= 50""",
    "runs": """SELECT txn_id, 'points' AS backend, verdict, confidence,
         fraud_type AS predicted_type, num FROM typed
       UNION ALL SELECT txn_id, 'score_only',
         CASE WHEN score >= 0.6 THEN 'fraud' WHEN score < 0.35 THEN 'legit'
           ELSE 'needs_review' END,
         CASE WHEN score >= 0.6 THEN 0.9::double WHEN score < 0.35 THEN 0.7::double
           ELSE 0.5::double END,
         CASE WHEN score >= 0.6 THEN 'account_takeover' ELSE 'none' END, num FROM typed""",
    "erows": """SELECT c.txn_id, r.backend, c.stratum,
       CASE WHEN c.is_fraud THEN 'fraud' ELSE 'legit' END AS truth, r.verdict, r.confidence,
       r.verdict <> 'needs_review' AS decided,
       CASE WHEN r.verdict <> 'needs_review' THEN (r.verdict = 'fraud') = c.is_fraud END AS correct,
       r.verdict = 'fraud' AND r.confidence >= 0.8 AND NOT c.is_fraud AS false_block,
       r.verdict = 'legit' AND c.is_fraud AS missed_fraud,
       c.is_fraud AND r.verdict = 'fraud' AND r.predicted_type = c.fraud_type AS type_match,
       7 AS tool_calls, ((r.num * 37) % 1200) / 10e0 AS latency_ms,
       (r.num * 13) % 5000 + (r.num * 7) % 900 AS tokens,
       ((r.num * 13) % 5000 * 1e0 + (r.num * 7) % 900 * 5e0) / 1000000e0 AS cost_usd,
       CASE WHEN r.num % 17 = 0 THEN 'max_steps' ELSE 'submit_verdict' END AS terminated_by
       FROM cases c JOIN runs r ON r.txn_id = c.txn_id""",
    "esum": """SELECT backend, count(*) AS n, avg(decided::int) AS coverage,
       avg(correct::int) FILTER (WHERE decided) AS decided_accuracy,
       avg((verdict = 'fraud')::int) FILTER (WHERE truth = 'fraud') AS fraud_recall,
       avg((truth = 'fraud')::int) FILTER (WHERE verdict = 'fraud') AS fraud_precision,
       count(*) FILTER (WHERE false_block) AS false_blocks,
       count(*) FILTER (WHERE missed_fraud) AS missed_fraud,
       avg(type_match::int) FILTER (WHERE truth = 'fraud' AND verdict = 'fraud')
         AS fraud_type_accuracy,
       count(*) FILTER (WHERE terminated_by <> 'submit_verdict') AS incomplete_runs,
       avg(tool_calls) AS avg_tool_calls, avg(tokens) AS avg_tokens,
       avg(cost_usd) AS avg_cost_usd,
       avg(cost_usd) * 3000 AS monthly_cost_usd_at_100_alerts_per_day,
       quantile_cont(latency_ms, 0.5) AS p50_latency_ms,
       quantile_cont(latency_ms, 0.95) AS p95_latency_ms FROM erows GROUP BY backend""",
    "models": """SELECT 'rules' AS model, rule_score::double AS score, is_fraud, ts_ms, fraud_type,
         context FROM scored
       UNION ALL SELECT 'lin-v1', score, is_fraud, ts_ms, fraud_type, context FROM scored
       UNION ALL SELECT 'lin-v2', score2, is_fraud, ts_ms, fraud_type, context FROM scored""",
    "mval": "SELECT m.* FROM models m, bounds WHERE ts_ms >= val_start AND ts_ms < test_start",
    "mtest": "SELECT m.* FROM models m, bounds WHERE ts_ms >= test_start",
}


def thresholds(source: str, fpr: str, extra: str = "") -> str:
    """Threshold per model (and fpr) by sorting the negatives."""
    return f"""SELECT model, coalesce(max(CASE WHEN k > 0 AND rk = n - k THEN score
         WHEN k <= 0 AND rk = n - 1 THEN score * (1 + 2.220446049250313e-16) END), 0.5)
         AS threshold FROM (SELECT model, score,
         row_number() OVER (PARTITION BY model ORDER BY score) - 1 AS rk,
         count(*) OVER (PARTITION BY model) AS n,
         floor({fpr} * count(*) OVER (PARTITION BY model))::bigint AS k
         FROM {source} WHERE NOT is_fraud) GROUP BY model"""


CTES["thr"] = thresholds("mval", "0.01")
for _n, _f in (("thr05", "0.005"), ("thr1", "0.01"), ("thr2", "0.02")):
    CTES[_n] = thresholds("mtest", _f)


def confusion(source: str, thr: str, by: str = "model") -> str:
    return f"""SELECT t.model, any_value(t.threshold) AS threshold,
       count(*) FILTER (WHERE score >= threshold AND is_fraud) AS tp,
       count(*) FILTER (WHERE score >= threshold AND NOT is_fraud) AS fp,
       count(*) FILTER (WHERE score < threshold AND is_fraud) AS fn,
       count(*) FILTER (WHERE score < threshold AND NOT is_fraud) AS tn
       FROM {source} s JOIN {thr} t ON t.model = s.model GROUP BY t.model"""


RATES = (
    "tp / greatest(1, tp + fn)::double AS recall, tp / greatest(1, tp + fp)::double AS precision,"
    " fp / greatest(1, fp + tn)::double AS fpr, tp + fp AS alerts"
)
CTES["point"] = f"SELECT *, {RATES} FROM ({confusion('mtest', 'thr')})"
CTES["recalls"] = " UNION ALL ".join(
    f"SELECT *, {RATES}, '{label}' AS target, {value}::double AS target_fpr"
    f" FROM ({confusion('mtest', t)})"
    for label, value, t in (
        ("0.500%", "0.005", "thr05"),
        ("1.000%", "0.01", "thr1"),
        ("2.000%", "0.02", "thr2"),
    )
)
CTES["ranked"] = """SELECT model, score, count(*) FILTER (WHERE is_fraud) AS pos,
   count(*) FILTER (WHERE NOT is_fraud) AS neg FROM mtest GROUP BY model, score"""
CTES["cum"] = """SELECT *, sum(pos) OVER (PARTITION BY model) AS p,
   sum(neg) OVER (PARTITION BY model) AS n,
   coalesce(sum(neg) OVER (PARTITION BY model ORDER BY score
     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below,
   sum(pos) OVER (PARTITION BY model ORDER BY score DESC) AS tp,
   sum(neg) OVER (PARTITION BY model ORDER BY score DESC) AS fp FROM ranked"""
CTES["aucs"] = """SELECT model,
   CASE WHEN max(p) > 0 AND max(n) > 0 THEN
     sum(pos * (neg_below + neg * 0.5))::double / (max(p) * max(n))::double
     ELSE 'nan'::double END AS roc_auc,
   CASE WHEN max(p) > 0 AND max(n) > 0 THEN
     sum((pos / p::double) * (tp / (tp + fp)::double)) ELSE 'nan'::double END AS pr_auc,
   (max(p) + max(n))::bigint AS n, max(p)::bigint AS positives FROM cum GROUP BY model"""

# PSI: bins of the training window, live rows of the test window.
CTES["long_train"] = (
    feature_long("train") + " UNION ALL SELECT '__score__', score FROM scored, bounds"
    " WHERE ts_ms >= val_start AND ts_ms < test_start"
)
CTES["long_test"] = (
    feature_long("test") + " UNION ALL SELECT '__score__', score FROM decisions"
)
CTES["card"] = "SELECT feature, count(DISTINCT value) AS d FROM long_train GROUP BY feature"
CTES["cuts"] = """SELECT DISTINCT feature, e FROM (
   SELECT v.feature, (v.value + lead(v.value) OVER (PARTITION BY v.feature ORDER BY v.value)) / 2
     AS e FROM (SELECT DISTINCT feature, value FROM long_train) v
     JOIN card c ON c.feature = v.feature WHERE c.d <= 10
   UNION ALL SELECT l.feature, unnest(quantile_cont(value,
     [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) FROM long_train l
     JOIN card c ON c.feature = l.feature WHERE c.d > 10 GROUP BY l.feature)
   WHERE e IS NOT NULL"""
CTES["bins"] = """SELECT feature, row_number() OVER (PARTITION BY feature ORDER BY lo NULLS FIRST)
   - 1 AS bin, lo, lead(lo) OVER (PARTITION BY feature ORDER BY lo NULLS FIRST) AS hi
   FROM (SELECT feature, NULL::double AS lo FROM card
         UNION ALL SELECT feature, e FROM cuts)"""
for _src, _dst, _col in (("long_train", "ref", "prob"), ("long_test", "livebins", "live")):
    CTES[_dst] = f"""SELECT b.feature, b.bin, any_value(b.lo) AS lo, any_value(b.hi) AS hi,
       count(l.feature) / greatest(1, sum(count(l.feature)) OVER (PARTITION BY b.feature))::double
         AS {_col}
       FROM bins b LEFT JOIN (SELECT feature, value, 1 AS one FROM {_src}) l
         ON l.feature = b.feature AND (b.lo IS NULL OR l.value >= b.lo)
         AND (b.hi IS NULL OR l.value < b.hi)
       GROUP BY b.feature, b.bin"""
CTES["psi"] = """SELECT r.feature, sum((greatest(live, 1e-4) - greatest(prob, 1e-4))
   * ln(greatest(live, 1e-4) / greatest(prob, 1e-4))) AS psi
   FROM ref r JOIN livebins l ON l.feature = r.feature AND l.bin = r.bin GROUP BY r.feature"""
CTES["psic"] = """SELECT *, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.2 THEN 'watch'
   ELSE 'shifted' END AS status FROM psi"""
# The same for the last 24 hours, by whole hours.
CTES["last_day"] = f"""SELECT d.* FROM decisions d, bounds
   WHERE d.ts_ms // 3600000 >= (last_ms - {DAY}) // 3600000"""
CTES["long_day"] = (
    feature_long("last_day") + " UNION ALL SELECT '__score__', score FROM last_day"
)
CTES["daybins"] = CTES["livebins"].replace("long_test", "long_day")
CTES["day_psi"] = CTES["psi"].replace("livebins", "daybins")
CTES["promos"] = f"""SELECT concat('v', lpad(day::varchar, 6, '0')) AS version,
   day * {DAY} + 21600000 AS promoted_ms
   FROM (SELECT DISTINCT ts_ms // {DAY} AS day FROM txn) WHERE day % 3 = 0"""


def _uses(text: str) -> list[str]:
    words = set(re.findall(r"\b[a-z_][a-z_0-9]*\b", text))
    return [n for n in CTES if n in words]


def sql(final: str, doubles: list[str] = ()) -> str:
    """``WITH`` chain for ``final``; the listed double columns are put on the comparison grid."""
    needed: set[str] = set()
    todo = _uses(final)
    while todo:
        n = todo.pop()
        if n not in needed:
            needed.add(n)
            todo += [u for u in _uses(CTES[n]) if u != n]
    chain = ", ".join(f"{n} AS ({CTES[n]})" for n in _ordered(needed))
    out = final
    if doubles:
        grid = ", ".join(
            f"floor({c} * 1e{DIGITS} + {SHIFT}::double) / 1e{DIGITS} AS {c}" for c in doubles
        )
        out = f"SELECT * REPLACE ({grid}) FROM ({final})"
    if not chain:
        return out
    if out.startswith("WITH "):
        return f"WITH {chain}, {out[5:]}"
    return f"WITH {chain} {out}"


def _ordered(needed: set[str]) -> list[str]:
    done: list[str] = []
    open_: list[str] = []

    def visit(n: str) -> None:
        if n in done or n in open_:
            return
        open_.append(n)
        for u in _uses(CTES[n]):
            if u != n and u in needed:
                visit(u)
        done.append(n)

    for n in CTES:
        if n in needed:
            visit(n)
    return done
