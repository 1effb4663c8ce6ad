"""DuckDB SQL for the queries of the catalogue: common table expressions that build on each other."""

from __future__ import annotations

LEVELS = "[" + ", ".join(f"{i / 10}" for i in range(1, 10)) + "]"
Z = (-1.2815515655446008, -0.8416212335729142, -0.5244005127080407, -0.2533471031357997, 0.0, 0.2533471031357997, 0.5244005127080407, 0.8416212335729144, 1.2815515655446008)
CRPS = "2 * (" + " + ".join(f"(q[{i}] - target) * ((CASE WHEN target < q[{i}] THEN 1 ELSE 0 END) - {i / 10}::DOUBLE)" for i in range(1, 10)) + ") / 9"
COMPLETE = "target IS NOT NULL AND q IS NOT NULL"

EVENT_ROWS = "src AS (SELECT event_type AS item_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS timestamp, round(sum(value), 6) AS target FROM events GROUP BY ALL)"
ORDER_ROWS = "src AS (SELECT o_orderpriority AS item_id, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS timestamp, round(sum(o_totalprice), 6) AS target FROM orders GROUP BY ALL)"
LINE_ROWS = "src AS (SELECT l_returnflag AS item_id, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS timestamp, round(sum(l_extendedprice), 6) AS target FROM lineitem GROUP BY ALL)"


def grid(step: str, out: str = "series") -> str:
    return f"""lim AS (SELECT min(timestamp) AS lo, max(timestamp) AS hi FROM src),
cells AS (SELECT item_id, timestamp FROM (SELECT DISTINCT item_id FROM src) CROSS JOIN (SELECT unnest(generate_series(lo, hi, INTERVAL 1 {step})) AS timestamp FROM lim)),
{out} AS (SELECT item_id, timestamp, target FROM cells LEFT JOIN src USING (item_id, timestamp))"""


EVENTS, ORDERS, LINES = f"{EVENT_ROWS}, {grid('HOUR')}", f"{ORDER_ROWS}, {grid('DAY')}", f"{LINE_ROWS}, {grid('DAY')}"


def rolled(n: int, src: str = "series", out: str = "state") -> str:
    return f"""{out}_known AS (SELECT item_id, timestamp, quantile_cont(target, {LEVELS}) OVER (PARTITION BY item_id ORDER BY timestamp ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS q FROM {src} WHERE target IS NOT NULL),
{out} AS (SELECT s.item_id, s.timestamp, last_value(k.q IGNORE NULLS) OVER (PARTITION BY s.item_id ORDER BY s.timestamp) AS q FROM {src} s LEFT JOIN {out}_known k USING (item_id, timestamp))"""


def led(leads, src: str = "state", out: str = "fc") -> str:
    return f"{out} AS (SELECT item_id, timestamp, CAST(lead_time AS INTEGER) AS lead_time, q FROM {src}, (SELECT unnest({list(leads)}) AS lead_time))"


def aligned(unit: str, src: str = "fc", series: str = "series", out: str = "al") -> str:
    due = f"f.timestamp + to_{unit}s(f.lead_time)"
    return f"{out} AS (SELECT f.*, {due} AS prediction_date, s.target FROM {src} f LEFT JOIN {series} s ON s.item_id = f.item_id AND s.timestamp = {due})"


def trimmed(most: int, src: str = "al", out: str = "tr", by: str = "") -> str:
    return f"""{out}_n AS (SELECT *, row_number() OVER (PARTITION BY {by}item_id, lead_time ORDER BY timestamp DESC) AS rn FROM {src}),
{out} AS (SELECT {by}item_id, timestamp, lead_time, {CRPS} AS crps FROM {out}_n WHERE rn > {most})"""


LEVEL_ROWS = "lv AS (SELECT unnest(range(1, 10)) AS i)"
EVENT_FC = f"WITH {EVENTS}, {rolled(100)}, {led((1, 6, 24))}, {aligned('hour')}"
EVENT_CRPS = f"{EVENT_FC}, {trimmed(24)}, il AS (SELECT item_id, lead_time, avg(crps) AS crps FROM tr GROUP BY ALL)"
PINBALL = "(q[i] - target) * ((CASE WHEN target < q[i] THEN 1 ELSE 0 END) - i / 10.0::DOUBLE)"


def level_table(value: str, where: str) -> str:
    return f"""{EVENT_FC}, {LEVEL_ROWS}, cell AS (SELECT item_id, lead_time, i, avg({value}) AS v FROM al, lv WHERE {where} GROUP BY ALL),
mean AS (SELECT i, lead_time, avg(v) AS v FROM cell GROUP BY ALL), tab AS (SELECT i, lead_time, v FROM mean UNION ALL SELECT i, NULL, avg(v) FROM mean GROUP BY i)"""


PIT = (
    "CASE WHEN target < q[1] THEN 0 WHEN target > q[9] THEN 1 WHEN target = q[9] THEN 0.9 "
    + " ".join(f"WHEN target >= q[{i}] AND target < q[{i + 1}] THEN {i / 10}::DOUBLE + 0.1::DOUBLE * (target - q[{i}]) / (q[{i + 1}] - q[{i}])" for i in range(1, 9))
    + " END"
)
LINE_FC = f"WITH {LINES}, {rolled(50)}, {led((1, 7))}, {aligned('day')}"
LINE_CAL = f"{LINE_FC}, cal_n AS (SELECT *, row_number() OVER (PARTITION BY item_id, lead_time ORDER BY timestamp) AS rn FROM al), cal AS (SELECT * FROM cal_n WHERE rn > 200 AND {COMPLETE})"
OFFSETS = "offs AS (SELECT item_id, lead_time, [" + ", ".join(f"quantile_cont(target - q[{i}], {i / 10})" for i in range(1, 10)) + "] AS o FROM cal GROUP BY ALL)"
SHIFTED = "list_sort([" + ", ".join(f"q[{i}] + coalesce(o[{i}], 0)" for i in range(1, 10)) + "])"
UNIT = f"""{LINE_CAL}, sc AS (SELECT item_id, lead_time, avg(target) AS y_mean, stddev_pop(target) AS y_std FROM cal GROUP BY ALL),
un AS (SELECT item_id, lead_time, timestamp, (target - y_mean) / y_std AS y, (q[5] - y_mean) / y_std AS m, (q[9] - q[1]) / y_std AS spread FROM cal JOIN sc USING (item_id, lead_time)),
sg AS (SELECT *, CASE WHEN count(*) OVER w = 20 THEN stddev_samp(y) OVER w END AS sigma FROM un WINDOW w AS (PARTITION BY item_id, lead_time ORDER BY timestamp ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING)),
ln AS (SELECT item_id, lead_time, regr_intercept(y, m) AS a, regr_slope(y, m) AS b, greatest(1e-4, regr_intercept(sigma, spread)) AS c, greatest(1e-4, regr_slope(sigma, spread)) AS d FROM sg GROUP BY ALL)"""

RW = "[" + ", ".join(f"target * exp({z!r}::DOUBLE * sigma * sqrt(lead_time))" for z in Z) + "]"
WALK = """steps AS (SELECT item_id, ln(CASE WHEN target > 0 THEN target END) - lag(ln(CASE WHEN target > 0 THEN target END)) OVER (PARTITION BY item_id ORDER BY timestamp) AS step FROM series WHERE timestamp < TIMESTAMP '1999-01-01'),
sig AS (SELECT item_id, stddev_pop(step) AS sigma FROM steps GROUP BY item_id)"""
MODELS = f"""WITH {ORDERS}, {rolled(30, out='s30')}, {led((1, 7), 's30', 'f30')}, {rolled(100, out='s100')}, {led((1, 7), 's100', 'f100')}, {WALK},
fw AS (SELECT item_id, timestamp, CAST(lead_time AS INTEGER) AS lead_time, CASE WHEN target IS NOT NULL THEN list_sort({RW}) END AS q FROM series JOIN sig USING (item_id), (SELECT unnest([1, 7]) AS lead_time)),
fc AS (SELECT 'roll30' AS model, * FROM f30 UNION ALL SELECT 'roll100', * FROM f100 UNION ALL SELECT 'walk', * FROM fw), {aligned('day')}"""
MODEL_CRPS = f"{MODELS}, {trimmed(7, by='model, ')}"
MODEL_TABLE = f"""{MODEL_CRPS}, il AS (SELECT model, item_id, lead_time, avg(crps) AS c FROM tr GROUP BY ALL), ml AS (SELECT model, lead_time, avg(c) AS c FROM il GROUP BY ALL)"""


def backtest(bounds: list[tuple[str, str, str]], source: str = "val", shown: str = "fold_id, ") -> str:
    """Rolling quantiles of 30 values with empirical offsets from a cold val year; folds are (test start, test end, val start).

    With source train, the rows before that year calibrate; with train_val, all before the test.
    """
    parts = []
    for k, (start, end, val) in enumerate(bounds):
        rows = {"val": f"timestamp >= TIMESTAMP '{val}' AND timestamp < TIMESTAMP '{start}'", "train": f"timestamp < TIMESTAMP '{val}'", "train_val": f"timestamp < TIMESTAMP '{start}'"}[source]
        parts.append(
            f"""val{k} AS (SELECT * FROM series WHERE {rows}),
{rolled(30, f'val{k}', f'vs{k}')}, {led((1, 7), f'vs{k}', f'vf{k}')}, {aligned('day', f'vf{k}', f'val{k}', f'va{k}')},
vn{k} AS (SELECT *, row_number() OVER (PARTITION BY item_id, lead_time ORDER BY timestamp) AS rn FROM va{k}),
vo{k} AS (SELECT item_id, lead_time, [{', '.join(f'quantile_cont(target - q[{i}], {i / 10})' for i in range(1, 10))}] AS o FROM vn{k} WHERE rn > 200 AND {COMPLETE} GROUP BY ALL),
upto{k} AS (SELECT * FROM series WHERE timestamp < TIMESTAMP '{end}'), {rolled(30, f'upto{k}', f'ts{k}')}, {led((1, 7), f'ts{k}', f'tf{k}')},
kept{k} AS (SELECT DISTINCT item_id FROM upto{k} WHERE timestamp >= TIMESTAMP '{start}' AND target IS NOT NULL),
raw{k} AS (SELECT t.* FROM tf{k} t JOIN kept{k} USING (item_id) WHERE timestamp >= TIMESTAMP '{start}'),
out{k} AS (SELECT {k} AS fold_id, 'raw' AS model, item_id, timestamp, lead_time, q FROM raw{k} UNION ALL
  SELECT {k}, 'eqc', item_id, timestamp, lead_time, CASE WHEN o IS NULL THEN q ELSE {SHIFTED} END FROM raw{k} LEFT JOIN vo{k} USING (item_id, lead_time))"""
        )
    union = " UNION ALL ".join(f"SELECT * FROM out{k}" for k in range(len(bounds)))
    return f"WITH {LINES}, {', '.join(parts)} SELECT {shown}model, item_id, timestamp, lead_time, round(q[1], 6) AS q10, round(q[5], 6) AS q50, round(q[9], 6) AS q90 FROM ({union})"


FOLDS = [("1999-01-01", "2000-01-01", "1998-01-01"), ("2000-01-01", "2001-01-01", "1999-01-01"), ("2001-01-01", "2002-01-01", "2000-01-01")]
PAIRED = f"{MODEL_CRPS}, pr AS (SELECT item_id, timestamp, lead_time, a.crps AS a, b.crps AS b FROM (SELECT * FROM tr WHERE model = 'roll30') a JOIN (SELECT * FROM tr WHERE model = 'walk') b USING (item_id, timestamp, lead_time))"


def part(ts: str, name: str) -> str:
    return {"dayofweek": f"isodow({ts}) - 1", "week": f"weekofyear({ts})", "month": f"month({ts})", "hour": f"hour({ts})"}[name]


def features() -> str:
    periods = {"dayofweek": 7, "week": 52, "month": 12, "hour": 24}
    out = []
    for when, ts in (("now", "timestamp"), ("then", "due")):
        for p, n in periods.items():
            for f in ("sin", "cos"):
                out.append(f"round({f}(2 * pi() * ({part(ts, p)}) / {n}), 6) AS {p}_{when}_{f}")
    for name, p, n in (("hour", "hour", 24), ("weekday", "dayofweek", 7)):
        delta = f"(({part('due', p)}) - ({part('timestamp', p)}))"
        out.append(f"{delta} AS delta_{name}")
        out += [f"round({f}(2 * pi() * {delta} / {n}), 6) AS delta_{name}_{f}" for f in ("sin", "cos")]
    return ", ".join(out)


WEEKDAYS = "cal AS (SELECT timestamp, row_number() OVER (ORDER BY timestamp) AS k FROM (SELECT unnest(generate_series(lo, hi + INTERVAL 30 DAY, INTERVAL 1 DAY)) AS timestamp FROM lim) WHERE isodow(timestamp) < 6)"
def power_rounds(rounds: int = 4, points: int = 21) -> str:
    """Grids of powers, each about the best of the last; the likelihood of the last grid's best."""
    z = "CASE WHEN abs(p) < 1e-12 THEN ln(y + 1) ELSE (pow(y + 1, p) - 1) / p END"
    parts = ["b0 AS (SELECT DISTINCT item_id, 0.5::DOUBLE AS mid, 2.5::DOUBLE AS half FROM y)"]
    for k in range(rounds):
        parts.append(f"""g{k} AS (SELECT item_id, mid, half, i, mid + half * (i / {(points - 1) / 2} - 1) AS p FROM b{k}, (SELECT unnest(range({points})) AS i)),
l{k} AS (SELECT item_id, mid, half, i, p, -count(*) / 2.0 * ln(var_pop({z})) + (p - 1) * sum(ln(1 + y)) AS l FROM g{k} JOIN y USING (item_id) GROUP BY item_id, mid, half, i, p),
b{k + 1} AS (SELECT item_id, arg_max(p, l) AS mid, max(half) / {(points - 1) / 2} AS half, max(l) AS l FROM l{k} GROUP BY item_id)""")
    return ", ".join(parts) + f" SELECT item_id, round(l, 2) AS log_likelihood FROM b{rounds}"


YJ = "CASE WHEN x >= 0 THEN (pow(x + 1, 0.25) - 1) / 0.25 WHEN x < 0 THEN -(pow(1 - x, 1.75) - 1) / 1.75 END"

SUPPLIERS = f"src AS (SELECT l_suppkey AS item_id, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS timestamp, round(sum(l_extendedprice), 6) AS target FROM lineitem GROUP BY ALL), {grid('DAY')}"
SUPPLIER_CAL = f"WITH {SUPPLIERS}, {rolled(20)}, {led((7,))}, {aligned('day')}, cal_n AS (SELECT *, row_number() OVER (PARTITION BY item_id, lead_time ORDER BY timestamp) AS rn FROM al), cal AS (SELECT * FROM cal_n WHERE rn > 200 AND {COMPLETE}), {OFFSETS}"

ORACLES = {
    "series_grid": f"WITH {EVENTS} SELECT * FROM series",
    "series_duplicates": "SELECT event_type AS item_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS timestamp, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1",
    "series_extent": f"WITH {ORDER_ROWS} SELECT item_id, min(timestamp) AS first, max(timestamp) AS last, count(*) AS n_rows FROM src GROUP BY item_id",
    "continuity_gaps": f"""WITH {ORDER_ROWS}, a AS (SELECT item_id, max(timestamp) AS context_end FROM src WHERE timestamp < TIMESTAMP '1998-01-01' GROUP BY 1),
      b AS (SELECT item_id, min(timestamp) AS data_start FROM src WHERE timestamp >= TIMESTAMP '1998-01-01' GROUP BY 1)
      SELECT * FROM a JOIN b USING (item_id) WHERE context_end + INTERVAL 1 DAY <> data_start""",
    "wide_to_long": f"WITH {LINE_ROWS} SELECT d.timestamp, i.item_id, s.target FROM (SELECT DISTINCT timestamp FROM src) d CROSS JOIN (SELECT unnest(['A', 'N', 'R']) AS item_id) i LEFT JOIN src s USING (item_id, timestamp)",
    "dedupe_first": "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, count(*) AS n_all FROM orders GROUP BY o_custkey",
    "fx_align": f"""WITH {ORDER_ROWS}, r AS (SELECT 'DEX' || substr(item_id, 3, 2) || CASE WHEN item_id < '3' THEN 'US' ELSE 'CA' END AS stem, timestamp, target FROM src WHERE isodow(timestamp) < 6),
      v AS (SELECT stem, timestamp, CASE WHEN ends_with(stem, 'US') THEN 1 / target ELSE target END AS target FROM r),
      c AS (SELECT stem, timestamp FROM (SELECT DISTINCT stem FROM v) CROSS JOIN (SELECT DISTINCT timestamp FROM v))
      SELECT CASE WHEN ends_with(stem, 'US') THEN 'US' || substr(stem, 4, 2) ELSE substr(stem, 4) END AS symbol, timestamp, round(target, 9) AS target FROM c LEFT JOIN v USING (stem, timestamp)""",
    "split_roles": f"""WITH {ORDERS} SELECT item_id, timestamp, CASE WHEN timestamp >= TIMESTAMP '1999-01-01' THEN 'test' WHEN timestamp >= TIMESTAMP '1998-01-01' THEN 'val' ELSE 'train' END AS role
      FROM series WHERE timestamp >= TIMESTAMP '1996-01-01' AND timestamp < TIMESTAMP '2000-01-01'""",
    "split_by_time": f"WITH {ORDERS} SELECT timestamp >= TIMESTAMP '1998-06-01' AS after, count(*) AS n, count(target) AS n_known FROM series GROUP BY 1",
    "drop_null_items": f"WITH {ORDERS}, t AS (SELECT item_id, timestamp, CASE WHEN NOT starts_with(item_id, '1') THEN target END AS target FROM series) SELECT * FROM t WHERE item_id IN (SELECT item_id FROM t WHERE target IS NOT NULL)",
    "context_tail": f"""WITH {ORDERS}, d AS (SELECT * FROM series WHERE timestamp >= TIMESTAMP '2001-01-01'),
      e AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY timestamp DESC) AS n FROM series WHERE timestamp < TIMESTAMP '2001-01-01' AND item_id IN (SELECT item_id FROM d))
      SELECT item_id, timestamp, target, false AS is_origin FROM e WHERE n <= 30 UNION ALL SELECT *, true FROM d""",
    "last_row": f"WITH {EVENTS} SELECT * FROM series QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY timestamp DESC) = 1",
    "common_items": "SELECT DISTINCT l_suppkey AS item_id FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-03-01' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-06-01'",
    "roll_quantile_fc": f"{EVENT_FC}, {LEVEL_ROWS} SELECT item_id, timestamp, lead_time, round(i / 10.0::DOUBLE, 1) AS quantile, round(q[i], 6) AS pred FROM fc, lv WHERE q IS NOT NULL",
    "seasonal_fc": f"""WITH {EVENTS}, known AS (SELECT *, isodow(timestamp) * 100 + hour(timestamp) AS bucket FROM series WHERE target IS NOT NULL),
      st AS (SELECT item_id, bucket, timestamp, quantile_cont(target, {LEVELS}) OVER (PARTITION BY item_id, bucket ORDER BY timestamp ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS q FROM known),
      rq AS (SELECT item_id, timestamp, CAST(lead_time AS INTEGER) AS lead_time, timestamp + to_hours(lead_time) AS due FROM series, (SELECT unnest([1, 24]) AS lead_time)),
      {LEVEL_ROWS}, got AS (SELECT rq.item_id, rq.timestamp, lead_time, q FROM rq ASOF JOIN st ON rq.item_id = st.item_id AND isodow(due) * 100 + hour(due) = st.bucket AND rq.timestamp >= st.timestamp)
      SELECT item_id, timestamp, lead_time, round(i / 10.0::DOUBLE, 1) AS quantile, round(q[i], 6) AS pred FROM got, lv""",
    "random_walk_fc": f"{MODELS}, {LEVEL_ROWS} SELECT item_id, timestamp, lead_time, round(i / 10.0::DOUBLE, 1) AS quantile, round(q[i], 2) AS pred FROM fw, lv WHERE q IS NOT NULL",
    "bday_leads": f"""WITH {ORDERS}, b AS (SELECT * FROM series WHERE isodow(timestamp) < 6), {WEEKDAYS},
      r AS (SELECT b.item_id, b.timestamp, CAST(n AS INTEGER) AS lead_time, k + n AS due FROM b JOIN cal USING (timestamp), (SELECT unnest([1, 3, 5, 12]) AS n))
      SELECT r.item_id, r.timestamp, lead_time, cal.timestamp AS prediction_date, b.target FROM r JOIN cal ON due = k LEFT JOIN b ON b.item_id = r.item_id AND b.timestamp = cal.timestamp""",
    "aligned_forecasts": f"{EVENT_FC} SELECT item_id, timestamp, lead_time, prediction_date, round(q[5], 6) AS q50, target FROM al",
    "wide_horizon": f"{EVENT_FC} SELECT item_id, timestamp, {', '.join(f'round(q[{i}], 6) AS q{i}0' for i in range(1, 10))}, prediction_date, target FROM al WHERE lead_time = 6",
    "trajectory": f"""{EVENT_FC}, o AS (SELECT item_id, timestamp AS origin FROM series QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY timestamp DESC) = 30),
      h AS (SELECT s.item_id, s.timestamp AS at, 'history' AS kind, target, NULL::DOUBLE AS low, NULL::DOUBLE AS median, NULL::DOUBLE AS high FROM series s JOIN o USING (item_id) WHERE s.timestamp <= origin QUALIFY row_number() OVER (PARTITION BY s.item_id ORDER BY s.timestamp DESC) <= 24)
      SELECT * FROM h UNION ALL SELECT al.item_id, prediction_date, 'forecast', target, round(q[1], 6), round(q[5], 6), round(q[9], 6) FROM al JOIN o ON o.item_id = al.item_id AND al.timestamp = origin""",
    "crps_rows": f"{EVENT_CRPS} SELECT item_id, timestamp, lead_time, round(crps, 6) AS crps FROM tr WHERE crps IS NOT NULL",
    "crps_item_lead": f"{EVENT_CRPS} SELECT item_id, lead_time, round(crps, 6) AS crps FROM il",
    "crps_mean": f"{EVENT_CRPS}, i AS (SELECT item_id, avg(crps) AS crps FROM il GROUP BY 1) SELECT round(avg(crps), 6) AS crps FROM i",
    "crps_by_lead": f"{EVENT_CRPS} SELECT lead_time, round(avg(crps), 6) AS crps FROM il GROUP BY 1",
    "crps_by_time": f"""{EVENT_CRPS}, i AS (SELECT item_id, timestamp, avg(crps) AS c FROM tr GROUP BY ALL), t AS (SELECT timestamp, avg(c) AS c FROM i GROUP BY ALL)
      SELECT timestamp, round(CASE WHEN count(c) OVER w = 24 THEN avg(c) OVER w END, 6) AS crps FROM t WINDOW w AS (ORDER BY timestamp ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""",
    "pinball_table": f"{level_table(PINBALL, 'true')} SELECT round(i / 10.0::DOUBLE, 1) AS quantile, lead_time, round(v, 6) AS value FROM tab UNION ALL SELECT NULL, lead_time, round(avg(v), 6) FROM tab GROUP BY lead_time",
    "coverage_table": f"{level_table('CASE WHEN q[i] >= target THEN 1.0 ELSE 0.0 END', COMPLETE)} SELECT round(i / 10.0::DOUBLE, 1) AS quantile, lead_time, round(v, 6) AS value FROM tab",
    "reliability": f"{level_table('CASE WHEN q[i] >= target THEN 1.0 ELSE 0.0 END', COMPLETE)} SELECT item_id, lead_time, round(i / 10.0::DOUBLE, 1) AS quantile, round(v, 6) AS value FROM cell",
    "pit_values": f"{EVENT_FC} SELECT item_id, timestamp, lead_time, round({PIT}, 6) AS pit FROM al WHERE {COMPLETE}",
    "pit_hist": f"""{EVENT_FC}, p AS (SELECT lead_time, {PIT} AS pit FROM al WHERE {COMPLETE}), n AS (SELECT lead_time, CAST(least(floor(pit * 8), 7) AS INTEGER) AS bin FROM p),
      g AS (SELECT lead_time, CAST(bin AS INTEGER) AS bin FROM (SELECT DISTINCT lead_time FROM n), (SELECT unnest(range(8)) AS bin)), t AS (SELECT lead_time, count(*) AS total FROM n GROUP BY 1)
      SELECT g.lead_time, g.bin, count(n.bin) AS n, any_value(total) / 8 AS uniform FROM g JOIN t USING (lead_time) LEFT JOIN n ON n.lead_time = g.lead_time AND n.bin = g.bin GROUP BY 1, 2""",
    "eqc_offsets": f"{LINE_CAL}, {OFFSETS}, {LEVEL_ROWS} SELECT item_id, lead_time, round(i / 10.0::DOUBLE, 1) AS quantile, round(o[i], 6) AS offset_value FROM offs, lv",
    "eqc_apply": f"{LINE_CAL}, {OFFSETS}, {LEVEL_ROWS} SELECT item_id, timestamp, lead_time, round(i / 10.0::DOUBLE, 1) AS quantile, round({SHIFTED}[i], 6) AS pred FROM fc LEFT JOIN offs USING (item_id, lead_time), lv WHERE q IS NOT NULL",
    "standardise_stats": f"{UNIT} SELECT item_id, lead_time, round(y_mean, 6) AS y_mean, round(y_std, 6) AS y_std FROM sc",
    "centred_std": f"{UNIT} SELECT item_id, lead_time, timestamp, round(sigma, 6) AS sigma FROM sg",
    "ols_init": f"{UNIT} SELECT item_id, lead_time, round(a, 5) AS a, round(b, 5) AS b, round(c, 5) AS c, round(d, 5) AS d FROM ln",
    "gauss_nll": f"""{UNIT} SELECT item_id, lead_time, round(sum(ln(c + d * spread) + 0.5 * pow((y - a - b * m) / (c + d * spread), 2) + 0.5 * ln(2 * pi())), 3) AS nll FROM sg JOIN ln USING (item_id, lead_time) GROUP BY ALL""",
    "transform_log": f"WITH {LINES} SELECT item_id, timestamp, round(ln(target + 1e6), 6) AS z, round(target, 3) AS back FROM series",
    "transform_asinh": f"WITH {LINES} SELECT item_id, timestamp, round(asinh(target), 6) AS z, round(target, 3) AS back FROM series",
    "yeo_johnson_fixed_lambda": f"WITH {LINES}, c AS (SELECT item_id, timestamp, (target - 100000) / 1000 AS x FROM series) SELECT item_id, timestamp, round({YJ}, 6) AS z, round(x, 6) AS back FROM c",
    "context_windows": f"""WITH {ORDERS}, p AS (SELECT unnest(range(5)) AS p), l AS (SELECT item_id, timestamp, p, lag(target, CAST(4 - p AS INTEGER)) OVER (PARTITION BY item_id, p ORDER BY timestamp) AS value FROM series, p)
      SELECT item_id, timestamp, CAST(p AS INTEGER) AS pos, value FROM l""",
    "future_windows": f"""WITH {ORDERS}, p AS (SELECT unnest(range(3)) AS p), l AS (SELECT item_id, timestamp, p, lead(target, CAST(p + 1 AS INTEGER)) OVER (PARTITION BY item_id, p ORDER BY timestamp) AS value FROM series, p)
      SELECT item_id, timestamp, CAST(p AS INTEGER) AS pos, value FROM l""",
    "sample_quantiles": f"""WITH s AS (SELECT l_returnflag AS item_id, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS timestamp, l_linenumber AS lead_time, quantile_cont(l_extendedprice, {LEVELS}) AS q FROM lineitem GROUP BY 1, 2, 3), {LEVEL_ROWS}
      SELECT item_id, timestamp, lead_time, round(i / 10.0::DOUBLE, 1) AS quantile, round(q[i], 6) AS pred FROM s, lv""",
    "calendar_features": f"WITH {EVENT_ROWS}, d AS (SELECT *, timestamp + INTERVAL 6 HOUR AS due FROM src) SELECT item_id, timestamp, target, {features()} FROM d",
    "shifted_label": f"WITH {EVENT_ROWS} SELECT a.item_id, a.timestamp, CAST(l AS INTEGER) AS lead_time, a.target, b.target AS label FROM src a CROSS JOIN (SELECT unnest([1, 6]) AS l) LEFT JOIN src b ON b.item_id = a.item_id AND b.timestamp = a.timestamp + to_hours(l)",
    "custom_model_fc": f"""WITH {EVENTS}, w AS (SELECT item_id, timestamp, quantile_cont(target, {LEVELS}) OVER (PARTITION BY item_id ORDER BY timestamp ROWS BETWEEN 47 PRECEDING AND CURRENT ROW) AS q FROM series), {LEVEL_ROWS}
      SELECT item_id, timestamp, CAST(l AS INTEGER) AS lead_time, round(i / 10.0::DOUBLE, 1) AS quantile, round(q[i], 6) AS pred FROM w, (SELECT unnest([1, 24]) AS l), lv WHERE q[i] IS NOT NULL""",
    "model_crps_table": f"""{MODEL_TABLE}, b AS (SELECT lead_time, c AS base FROM ml WHERE model = 'roll30'), r AS (SELECT model, lead_time, c / base AS c FROM ml JOIN b USING (lead_time))
      SELECT model, lead_time, round(c, 6) AS crps FROM r UNION ALL SELECT model, NULL, round(avg(c), 6) FROM r GROUP BY model""",
    "model_pinball_table": f"""{MODELS}, {LEVEL_ROWS}, cell AS (SELECT model, item_id, lead_time, i, avg({PINBALL}) AS v FROM al, lv GROUP BY ALL), m AS (SELECT model, i, lead_time, avg(v) AS v FROM cell GROUP BY ALL),
      t AS (SELECT model, i, avg(v) AS v FROM m GROUP BY ALL), u AS (SELECT * FROM t UNION ALL SELECT model, NULL, avg(v) FROM t GROUP BY model), b AS (SELECT i, v AS base FROM u WHERE model = 'roll30')
      SELECT model, round(u.i / 10.0::DOUBLE, 1) AS quantile, round(v / base, 6) AS value FROM u JOIN b ON u.i IS NOT DISTINCT FROM b.i""",
    "model_coverage_table": f"""{MODELS}, {LEVEL_ROWS}, cell AS (SELECT model, item_id, lead_time, i, avg(CASE WHEN q[i] >= target THEN 1.0 ELSE 0.0 END) AS v FROM al, lv WHERE {COMPLETE} GROUP BY ALL),
      m AS (SELECT model, i, lead_time, avg(v) AS v FROM cell GROUP BY ALL) SELECT model, round(i / 10.0::DOUBLE, 1) AS quantile, round(avg(v), 6) AS value FROM m GROUP BY model, i""",
    "model_rank": f"{MODEL_TABLE}, t AS (SELECT model, avg(c) AS c FROM ml GROUP BY 1) SELECT model, round(c, 6) AS mean, CAST(rank() OVER (ORDER BY c) AS INTEGER) AS rank FROM t",
    "model_side_by_side": f"{MODEL_TABLE} SELECT lead_time, round(max(c) FILTER (WHERE model = 'roll30'), 6) AS roll30, round(max(c) FILTER (WHERE model = 'roll100'), 6) AS roll100, round(max(c) FILTER (WHERE model = 'walk'), 6) AS walk FROM ml GROUP BY 1",
    "crps_models_over_time": f"""{MODEL_CRPS}, i AS (SELECT model, item_id, timestamp, avg(crps) AS c FROM tr GROUP BY ALL), t AS (SELECT model, timestamp, avg(c) AS c FROM i GROUP BY ALL),
      s AS (SELECT model, timestamp, CASE WHEN count(c) OVER w = 30 THEN avg(c) OVER w END AS c FROM t WINDOW w AS (PARTITION BY model ORDER BY timestamp ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)), b AS (SELECT timestamp, c AS base FROM s WHERE model = 'roll30')
      SELECT model, timestamp, round(c / nullif(base, 0), 6) AS crps FROM s LEFT JOIN b USING (timestamp)""",
    "crps_by_period": f"""{MODEL_CRPS}, e AS (SELECT min(timestamp) AS lo, max(timestamp) AS hi FROM tr), i AS (SELECT model, item_id, timestamp, avg(crps) AS c FROM tr GROUP BY ALL),
      p AS (SELECT model, c, CASE WHEN timestamp > lo AND timestamp <= TIMESTAMP '1997-01-01' THEN strftime(lo, '%d-%m-%Y') || '_to_01-01-1997' WHEN timestamp > TIMESTAMP '1997-01-01' AND timestamp <= TIMESTAMP '1999-07-01' THEN '01-01-1997_to_01-07-1999'
        WHEN timestamp > TIMESTAMP '1999-07-01' THEN '01-07-1999_to_' || strftime(hi, '%d-%m-%Y') END AS period FROM i, e)
      SELECT model, period, round(avg(c), 2) AS crps FROM p WHERE period IS NOT NULL GROUP BY ALL""",
    "paired_diff": f"{PAIRED} SELECT item_id, timestamp, lead_time, round(a, 4) AS a, round(b, 4) AS b FROM pr WHERE a IS NOT NULL AND b IS NOT NULL",
    "break_test": f"""{PAIRED}, d AS (SELECT lead_time, a - b AS d, timestamp >= TIMESTAMP '1999-01-01' AS after FROM pr),
      g AS (SELECT lead_time, count(d) FILTER (WHERE NOT after) AS n0, count(d) FILTER (WHERE after) AS n1, avg(d) FILTER (WHERE NOT after) AS m0, avg(d) FILTER (WHERE after) AS m1, var_pop(d) FILTER (WHERE NOT after) AS v0, var_pop(d) FILTER (WHERE after) AS v1 FROM d GROUP BY 1)
      SELECT lead_time, n0, n1, round(m0, 2) AS before, round(m1 - m0, 2) AS change, round(sqrt(n0 * v0 / pow(n0 - 1, 2) + n1 * v1 / pow(n1 - 1, 2)), 2) AS se, round((m1 - m0) / sqrt(n0 * v0 / pow(n0 - 1, 2) + n1 * v1 / pow(n1 - 1, 2)), 6) AS t FROM g""",
    "backtest_single": backtest(FOLDS[:1]),
    "backtest_train_window": backtest(FOLDS[:1]),
    "backtest_rolling": backtest(FOLDS),
    "backtest_on_train": backtest(FOLDS[:1], "train", ""),
    "backtest_on_train_val": backtest(FOLDS[:1], "train_val", ""),
    "factorized": f"""WITH {ORDER_ROWS}, n AS (SELECT unnest(range(5)) AS item_id, unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) AS name)
      SELECT CAST(n.item_id AS BIGINT) AS item_id, name, timestamp, target FROM src JOIN n ON src.item_id = n.name""",
    "chosen_scores": f"{EVENT_CRPS} SELECT item_id, lead_time, round(crps, 6) AS crps FROM il WHERE item_id IN ('click', 'purchase') AND lead_time IN (6, 24)",
    "lead_times": f"{EVENT_FC} SELECT DISTINCT item_id, lead_time FROM fc",
    "replaced_horizon": f"""WITH {ORDERS}, {rolled(30, out='s30')}, {led((1,), 's30', 'f30')}, {rolled(100, out='s100')}, {led((7, 14), 's100', 'f100')}, {LEVEL_ROWS}, u AS (SELECT * FROM f30 UNION ALL SELECT * FROM f100)
      SELECT item_id, timestamp, lead_time, round(i / 10.0::DOUBLE, 1) AS quantile, round(q[i], 6) AS pred FROM u, lv WHERE q IS NOT NULL""",
    "stored_forecasts": f"""WITH {LINES}, {rolled(20, out='s20')}, {led((1, 7), 's20', 'f20')}, {rolled(50, out='s50')}, {led((1, 7), 's50', 'f50')}, u AS (SELECT 'short_roll' AS key, * FROM f20 UNION ALL SELECT 'long_roll', * FROM f50)
      SELECT key, item_id, timestamp, lead_time, round(q[5], 6) AS q50 FROM u WHERE q IS NOT NULL""",
    "eqc_reapplied": f"{LINE_CAL}, {OFFSETS}, {LEVEL_ROWS} SELECT item_id, timestamp, lead_time, round(i / 10.0::DOUBLE, 1) AS quantile, round({SHIFTED}[i], 6) AS pred FROM fc LEFT JOIN offs USING (item_id, lead_time), lv WHERE q IS NOT NULL",
    "stored_report": f"{MODEL_TABLE} SELECT 'first' AS run, model, round(avg(c), 6) AS crps, '1,7' AS leads FROM ml GROUP BY model",
    "energy_files": f"""WITH {LINE_ROWS}, n AS (SELECT unnest(range(3)) AS item_id, unnest(['A', 'N', 'R']) AS name)
      SELECT CAST(n.item_id AS BIGINT) AS item_id, name, d.timestamp, s.target FROM (SELECT DISTINCT timestamp FROM src) d CROSS JOIN n LEFT JOIN src s ON s.item_id = n.name AND s.timestamp = d.timestamp""",
    "rate_files": f"""WITH {ORDER_ROWS}, raw AS (SELECT substr(item_id, 3, 2) AS code, item_id < '3' AS turned, timestamp, CASE WHEN day(timestamp) <> 13 THEN target END AS v FROM src WHERE isodow(timestamp) < 6),
      named AS (SELECT CASE WHEN turned THEN 'US' || code ELSE code || 'CA' END AS name, timestamp, CASE WHEN turned THEN CASE WHEN v <> 0 THEN 1.0 / v END ELSE v END AS target FROM raw)
      SELECT n.name, t.timestamp, round(named.target, 9) AS target FROM (SELECT DISTINCT name FROM named) n CROSS JOIN (SELECT DISTINCT timestamp FROM named) t LEFT JOIN named ON named.name = n.name AND named.timestamp = t.timestamp""",
    "random_stretch": f"""WITH {ORDERS}, n AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY timestamp) AS k, count(*) OVER (PARTITION BY item_id) AS c FROM series),
      s AS (SELECT *, ('0x' || substr(md5('11:' || item_id), 1, 8))::BIGINT % greatest(c - 39, 1) + 1 AS first FROM n) SELECT item_id, timestamp, target FROM s WHERE k >= first AND k < first + 40""",
    "transform_none": f"WITH {LINES} SELECT item_id, timestamp, round(target, 6) AS z, round(target, 3) AS back FROM series",
    "power_likelihood": f"WITH {LINE_ROWS}, y AS (SELECT item_id, target / 100000 AS y FROM src WHERE target IS NOT NULL), {power_rounds()}",
    "qr_optimality": f"{LINE_CAL}, {LEVEL_ROWS} SELECT item_id, lead_time, round(i / 10.0::DOUBLE, 1) AS quantile, count(*) AS n, true AS optimal FROM cal, lv GROUP BY ALL",
    "calendar_optimality": f"""WITH {LINES}, {LEVEL_ROWS}, tr AS (SELECT * FROM series WHERE timestamp < TIMESTAMP '2000-01-01' AND target IS NOT NULL)
      SELECT a.item_id, CAST(7 AS INTEGER) AS lead_time, round(i / 10.0::DOUBLE, 1) AS quantile, count(*) AS n, true AS optimal FROM tr a JOIN tr b ON a.item_id = b.item_id AND b.timestamp = a.timestamp + INTERVAL 7 DAY, lv GROUP BY ALL""",
    "mle_likelihood": f"{LINE_CAL} SELECT item_id, lead_time, count(*) AS n, true AS as_likely FROM cal GROUP BY ALL",
    "gb_improvement": f"""{LINE_CAL}, {LEVEL_ROWS}, ls AS (SELECT item_id, lead_time, quantile_cont(target, {LEVELS}) AS b FROM cal GROUP BY ALL), bs AS (SELECT item_id, lead_time, i, b[i] AS b FROM ls, lv)
      SELECT item_id, lead_time, round(i / 10.0::DOUBLE, 1) AS quantile, round(avg(CASE WHEN target >= b THEN (target - b) * i / 10.0::DOUBLE ELSE (b - target) * (1 - i / 10.0::DOUBLE) END), 3) AS base_loss, true AS improved FROM cal JOIN bs USING (item_id, lead_time) GROUP BY item_id, lead_time, i""",
    "supplier_crps": f"""{SUPPLIER_CAL}, both_models AS (SELECT 'raw' AS model, item_id, timestamp, lead_time, q, target FROM al UNION ALL
      SELECT 'eqc', item_id, timestamp, lead_time, CASE WHEN o IS NULL OR q IS NULL THEN q ELSE {SHIFTED} END, target FROM al LEFT JOIN offs USING (item_id, lead_time)), {trimmed(7, 'both_models', by='model, ')}
      SELECT model, item_id, lead_time, round(avg(crps), 4) AS crps FROM tr GROUP BY ALL""",
    "supplier_rolling": """WITH src AS (SELECT l_suppkey AS item_id, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS timestamp, round(sum(l_extendedprice), 6) AS target FROM lineitem GROUP BY ALL)
      SELECT item_id, timestamp, round(quantile_cont(target, 0.1) OVER w, 6) AS q10, round(quantile_cont(target, 0.5) OVER w, 6) AS q50, round(quantile_cont(target, 0.9) OVER w, 6) AS q90
      FROM src WINDOW w AS (PARTITION BY item_id ORDER BY timestamp ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
}
