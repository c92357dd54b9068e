"""DuckDB SQL that gives the rows of the queries."""

from __future__ import annotations

_E = "SELECT event_id, ts, user_id, event_type, value FROM events"
_ORDER = "(PARTITION BY user_id ORDER BY ts, event_id)"


def _scattered(n: str, most: int, turn: int = 0) -> str:
    return f"(((({n} + {turn}) % 2147483647) * 48271 + 12345) % 2147483647 % {most})"


def _ticker(n: str) -> str:
    k = _scattered(n, 100)
    return f"chr(CAST({k} // 676 % 26 + 65 AS INTEGER)) || chr(CAST({k} // 26 % 26 + 65 AS INTEGER)) || chr(CAST({k} % 26 + 65 AS INTEGER))"


def _keyed(keys: int, values: int, per_key: int) -> str:
    return f"SELECT i AS seq, CAST(i % {keys} AS INTEGER) AS key1, CAST(i % {keys} AS INTEGER) AS key2, CAST(i % {values} AS INTEGER) AS val1, CAST(i % {values} AS INTEGER) AS val2 FROM range({keys * per_key}) t(i)"


_LOAD = "SELECT event_id AS seq, CAST(user_id AS INTEGER) AS key1, CAST(user_id AS INTEGER) AS key2, CAST(event_id % 3 AS INTEGER) AS val1, CAST(event_id % 3 AS INTEGER) AS val2 FROM events"


def _multiply(rows: str, times: int) -> str:
    """Powers instead of repeated products."""
    extra = max(1, times // 64)
    return f"SELECT * REPLACE (total AS val1, -total AS val2) FROM (SELECT *, CAST(val1 + val2 AS DOUBLE) * pow(CAST(val1 AS DOUBLE), {times} + CASE WHEN seq % 17 = 0 THEN {extra} ELSE 0 END) AS total FROM ({rows}))"


def _chain(rows: str, *times: int) -> str:
    for t in times:
        rows = f"SELECT seq, key1, key2, val1, val2 FROM ({_multiply(rows, t)})"
    return rows


_TRADES = "SELECT user_id AS tickersymbol, value AS myvwap, ts AS timestamp, event_id FROM events WHERE event_type = 'purchase'"
_QUOTES = "SELECT user_id AS tickersymbol, value / 100 AS ask, ts AS timestamp FROM events WHERE event_type = 'view'"
_VWAP = f"SELECT * FROM (SELECT tickersymbol, sum(myvwap) OVER w AS svwap, count(*) OVER w AS n, row_number() OVER o AS rn, timestamp FROM ({_TRADES}) WINDOW o AS (PARTITION BY tickersymbol ORDER BY timestamp, event_id), w AS (PARTITION BY tickersymbol ORDER BY timestamp, event_id ROWS 4 PRECEDING)) WHERE rn >= 5"
_BARGAINS = "SELECT q.tickersymbol, q.timestamp, round(v.cvwap - q.ask * 100, 6) AS bargainindex FROM quotes q ASOF JOIN vals v ON q.tickersymbol = v.tickersymbol AND q.timestamp >= v.timestamp WHERE v.cvwap > q.ask * 100"
_LOGINS = (
    "SELECT CAST(i // 3 * 1000 AS BIGINT) AS ts, "
    f"'uid=' || {_scattered('i', 5, 1)} AS uid, 'euid=' || {_scattered('i', 5, 2)} AS euid, 'tty=ssh' AS tty, "
    f"'rhost=host' || {_scattered('i', 50, 3)} AS rhost, 'user=user' || {_scattered('i', 20, 4)} AS \"user\", i AS seq FROM range(3000) t(i)"
)
_WORDS = "SELECT unnest(string_split(trim(text), ' ')) AS word FROM documents"
_SENTENCES = f"SELECT i, array_to_string(list_transform(range(8), lambda j: 'w' || {_scattered('(i * 8 + j)', 500)}), ' ') AS sentence, CAST(i % 16 AS INTEGER) AS partition_index FROM range(2000) t(i)"
_SUMS = "SELECT user_id, round(max(s) * 100, 3) AS mult FROM (SELECT user_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM events WHERE event_type IN ('purchase', 'view')) GROUP BY user_id"


def _barrier(keys: bool, a: str, b: str) -> str:
    over = "PARTITION BY user_id " if keys else ""
    side = lambda k: f"SELECT user_id, event_id AS {k}_id, ts, value, row_number() OVER ({over}ORDER BY ts, event_id) AS rn FROM events WHERE event_type = '{k}'"
    on = "v.rn = c.rn" + (" AND v.user_id = c.user_id" if keys else "")
    return f"SELECT {a}.user_id, v.view_id, c.click_id, {a}.ts, {a}.value FROM ({side('view')}) v JOIN ({side('click')}) c ON {on}"


def _ema(over: str, columns: str) -> str:
    return f"SELECT {columns}, round(list_reduce(list(value) OVER ({over}ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), lambda a, x: 0.3 * x + 0.7 * a) + 1e-9, 6) AS value FROM events"


_NUMBERED = f"SELECT *, row_number() OVER {_ORDER} AS rn FROM events"
_WINDOW5 = f"SELECT user_id, CAST((rn - 1) // 5 AS INTEGER) AS \"window\", count(*) AS n, round(sum(value), 4) AS total FROM ({_NUMBERED}) GROUP BY ALL"

ORACLES: dict[str, str] = {
    "src_beacon": "SELECT i AS n, i * i AS square FROM range(5000) t(i)",
    "src_memorizing": _keyed(500, 10, 8),
    "src_trades": f"SELECT {_ticker('i')} AS tickersymbol, CAST({_scattered('i', 190, 77)} + 10 AS DOUBLE) AS myvwap, CAST(1 AS DOUBLE) AS volume, CAST(i // 10 AS BIGINT) AS timestamp, i AS seq FROM range(5000) t(i)",
    "src_quotes": f"SELECT {_ticker('i')} AS tickersymbol, CAST({_scattered('i', 190, 991)} + 10 AS DOUBLE) AS askptickersymbolprice, 1 AS asksize, CAST(i // 10 AS BIGINT) AS timestamp, i AS seq FROM range(5000) t(i)",
    "src_sentences": f"SELECT sentence, partition_index FROM ({_SENTENCES})",
    "src_logs": _LOGINS,
    "src_log_file": "SELECT 'host' || (user_id % 7) AS host, CASE WHEN event_id % 2 = 0 THEN 'sshd:' ELSE 'cron:' END AS srvc, CASE WHEN event_id % 5 = 0 THEN 'authentication failure' ELSE event_type END || ' ' || event_id AS msg FROM events WHERE event_id % 3 <> 0 AND (event_id % 5 <> 0 OR event_id % 2 <> 0)",
    "src_sentences_file": "SELECT CAST(3 + id // 40 AS INTEGER) AS words, CAST(id % 16 AS INTEGER) AS partition_index, true AS known, count(*) AS n FROM range(280) t(id) GROUP BY ALL",
    "src_rated": "SELECT CAST(CASE WHEN id < 200 THEN id * 10 ELSE 3000 + (id - 200) * 5 END // 100 AS BIGINT) AS tenth, count(*) AS n, CAST(sum(id % 10) AS BIGINT) AS keys FROM range(600) t(id) GROUP BY ALL",
    "sink_metrics": "SELECT unnest(['rows', 'least', 'most', 'users']) AS metric, unnest([count(*)::DOUBLE, min(value), max(value), max(user_id)::DOUBLE]) AS value FROM events",
    "sink_foreach": _E,
    "sink_console": "SELECT event_id, 'Tuple({event_id=' || event_id || '},{event_type=' || event_type || '},{user_id=' || user_id || '})' AS tuple FROM events",
    "map": "SELECT event_id, value * 2 AS v2, upper(event_type) AS kind FROM events",
    "filter": _E + " WHERE event_type = 'purchase' AND value > 10",
    "flat_map": "SELECT event_id, 'value' AS name, value AS number FROM events UNION ALL SELECT event_id, 'user', CAST(user_id AS DOUBLE) FROM events",
    "map_batches": "SELECT event_id, value * 2 AS value FROM events",
    "duplicate": _E + " CROSS JOIN range(4)",
    "passthrough": _E,
    "mod_filter": "SELECT event_id, ts, user_id, event_type, value FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events) WHERE (rn - 1) % 4 = 0",
    "split_words": "SELECT doc_id, unnest(string_split(trim(text), ' ')) AS word FROM documents",
    "cvwap": f"SELECT tickersymbol, round(svwap / n * 100, 6) AS cvwap, timestamp FROM ({_VWAP})",
    "multiply": _chain(_keyed(500, 10, 8), 4),
    "typed_fields": "SELECT event_id, CAST(trunc(value) AS INTEGER) AS whole, coalesce(value, 0) AS value, CAST(user_id AS INTEGER) AS \"user\", event_type IS NOT NULL AS has_type FROM events",
    "count_window": f"SELECT user_id, CAST((rn - 1) // 5 AS INTEGER) AS \"window\", count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, round(sum(value), 4) AS total FROM ({_NUMBERED}) GROUP BY user_id, (rn - 1) // 5 HAVING count(*) = 5",
    "exact_batches": _WINDOW5,
    "fold_window": f"SELECT user_id, CAST((rn - 1) // 3 AS INTEGER) AS \"window\", round(2 + sum(value), 4) AS value FROM ({_NUMBERED}) GROUP BY user_id, (rn - 1) // 3 HAVING count(*) = 3",
    "minmax_window": f"SELECT user_id, CAST((rn - 1) // 5 AS INTEGER) AS \"window\", max(event_id) AS last, min(event_id) AS first, arg_max(event_type, rn) AS kind FROM ({_NUMBERED}) GROUP BY user_id, (rn - 1) // 5 HAVING count(*) = 5",
    "sliding_count_window": f"SELECT event_id, user_id, round(total, 4) AS total FROM (SELECT event_id, user_id, row_number() OVER {_ORDER} AS rn, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING) AS total FROM events) WHERE rn >= 5 AND (rn - 5) % 2 = 0",
    "sma": "SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 9 PRECEDING), 6) AS mean FROM events",
    "ema": _ema("", "event_id"),
    "ema_keyed": _ema("PARTITION BY user_id ", "event_id, user_id"),
    "running_count": f"SELECT event_id, user_id, count(*) OVER {_ORDER} AS n FROM events",
    "running_sum": f"SELECT event_id, user_id, round(sum(value) OVER {_ORDER}, 4) AS total FROM events",
    "keyed_last": "SELECT event_id, ts, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "latest_per_key": "SELECT event_id, ts, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1",
    "max_monotone": "SELECT user_id, max(value) AS most FROM events GROUP BY user_id",
    "global_count": "SELECT count(*) AS n FROM events",
    "latency_summary": "SELECT event_type, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS stddev, round(min(value), 4) AS min, round(max(value), 4) AS max, "
    + ", ".join(f"round(quantile_cont(value, {p}), 4) AS {n}" for n, p in (("median", 0.5), ("p75", 0.75), ("p95", 0.95), ("p98", 0.98), ("p99", 0.99), ("p999", 0.999)))
    + " FROM events GROUP BY event_type",
    "interleave": _E + " WHERE event_type IN ('view', 'click')",
    "interleave_any": "SELECT event_id, user_id FROM events WHERE event_type IN ('view', 'click')",
    "merge_sorted": "SELECT event_id, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS side, row_number() OVER (ORDER BY ts, event_type = 'click', event_id) AS pos FROM events WHERE event_type IN ('view', 'click')",
    "barrier_keep": _barrier(True, "v", "c"),
    "barrier_overwrite": _barrier(True, "c", "c"),
    "barrier_global": _barrier(False, "v", "c"),
    "asof_join": "SELECT v.event_id, v.user_id, v.value, p.value AS price, p.event_id AS purchase_id FROM (SELECT * FROM events WHERE event_type = 'view') v ASOF JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON v.user_id = p.user_id AND v.ts >= p.ts",
    "bargain_index": f"WITH quotes AS ({_QUOTES}), vals AS (SELECT user_id AS tickersymbol, value AS cvwap, ts AS timestamp FROM events WHERE event_type = 'purchase') {_BARGAINS}",
    "bargain_discovery": f"WITH quotes AS ({_QUOTES}), vals AS (SELECT tickersymbol, svwap / (n * 100) * 100 AS cvwap, timestamp FROM ({_VWAP})) {_BARGAINS}",
    "auth_log_alerts": "SELECT CAST(user_id AS VARCHAR) AS rhost, CAST(max(ms) AS BIGINT) AS last, CAST((max(ms) - min(ms)) // 1000 AS BIGINT) AS diff FROM (SELECT *, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type = 'error') GROUP BY user_id, (rn - 1) // 3 HAVING count(*) = 3 AND min(ms) + 864000000 > max(ms)",
    "auth_log_alerts_made": f"SELECT rhost, max(ts) AS last, CAST((max(ts) - min(ts)) // 1000 AS BIGINT) AS diff FROM (SELECT *, row_number() OVER (PARTITION BY rhost ORDER BY ts, seq) AS rn FROM ({_LOGINS})) GROUP BY rhost, (rn - 1) // 5 HAVING count(*) = 5 AND min(ts) + 90000 > max(ts)",
    "word_count": f"SELECT word, count(*) AS count FROM ({_WORDS}) GROUP BY word",
    "word_count2": f"SELECT word, count(*) AS count FROM (SELECT unnest(string_split(sentence, ' ')) AS word FROM ({_SENTENCES})) GROUP BY word",
    "keyed_sum_x100": _SUMS,
    "keyed_sum_fanout": f"SELECT user_id, CAST(4 AS BIGINT) AS branches, mult AS least, mult AS most FROM ({_SUMS})",
    "chain_single_region": _chain(_LOAD, 3, 2),
    "chain_multi_region": _chain(_LOAD, 2, 3),
    "tree": f"SELECT *, 1 AS branch FROM ({_chain(_LOAD, 2, 2)}) UNION ALL SELECT *, 2 FROM ({_chain(_LOAD, 2, 4)})",
    "reverse_tree": f"{_chain(_LOAD, 2, 2)} UNION ALL {_chain(f'SELECT * REPLACE (val1 + 1 AS val1) FROM ({_LOAD})', 2, 2)}",
    "varying_selectivity": _chain(f"SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (ORDER BY seq) AS place FROM ({_chain(_LOAD, 2, 2)})) WHERE place % 2 = 1", 2),
    "dynamic_rate": _chain(_keyed(100, 5, 10), 2),
    "prefix_key_chain": "SELECT user_id, event_type, round(sum(value), 4) AS sum FROM events GROUP BY ALL",
    "numbered": "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS pos FROM events",
    "stream_count_window": f"SELECT user_id, \"window\", total FROM ({_WINDOW5}) WHERE n = 5",
    "stream_ema": _ema("PARTITION BY user_id ", "event_id, user_id"),
    "stream_running": f"SELECT event_id, user_id, count(*) OVER {_ORDER} AS n, round(sum(value) OVER {_ORDER}, 4) AS total FROM events",
    "stream_asof": "SELECT v.user_id, v.ts, v.value, p.value AS price FROM (SELECT * FROM events WHERE event_type = 'view') v ASOF JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON v.user_id = p.user_id AND v.ts >= p.ts",
    "stream_windowed_counts": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
