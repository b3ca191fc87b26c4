"""DuckDB SQL for the registered queries: named table expressions, and the final select of each query."""

from __future__ import annotations

from watchpost.operators.alerts import CATEGORY_ACTIONS, LEVEL_ACTIONS
from watchpost.operators.detectors import HOSPITAL, SEARCH
from watchpost.operators.features import SIGNAL_TYPES
from watchpost.operators.knowledge import DISEASES
from watchpost.operators.risk import ANOMALOUS, ELEVATED, FAVOURABLE, LABELS, WEATHER_LABELS, WEIGHTS
from watchpost.sources.adapters import EVENT_SIGNALS, FLAG_SIGNALS, PRIORITY_SIGNALS, PULSE, PULSED, SEGMENT_SIGNALS


def text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def listed(xs) -> str:
    return ", ".join(text(x) for x in xs)


def case(column: str, values: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in values.items()) + " END"


def rnd(x: str, digits: int) -> str:
    s = f"{10**digits}.0"
    return f"floor(({x}) * {s} + 0.5) / {s}"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    shown = lambda v: text(v) if isinstance(v, str) else "CAST(NULL AS VARCHAR)" if v is None else f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v)
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows) + ")"


def level(x: str) -> str:
    return f"CASE WHEN {x} >= 75 THEN 'Emergency' WHEN {x} >= 55 THEN 'Alert' WHEN {x} >= 35 THEN 'Warning' WHEN {x} >= 15 THEN 'Watch' ELSE 'Normal' END"


def anomaly(z: str) -> str:
    return f"CASE WHEN {z} <= 2 THEN 0.0 ELSE least(1.0, ({z} - 2) / 4) END"


def tempered(confidence: str) -> str:
    return rnd(f"CASE WHEN down > 0 THEN up / down ELSE 0.0 END * (CAST(0.7 AS DOUBLE) + CAST(0.3 AS DOUBLE) * {confidence}) * 100", 2)


LEVEL_ORDER = "CASE level WHEN 'Watch' THEN 1 WHEN 'Warning' THEN 2 WHEN 'Alert' THEN 3 WHEN 'Emergency' THEN 4 ELSE 0 END"


def rolling_z(source: str, name: str, value: str = "value") -> str:
    w = "(PARTITION BY district_id, signal_type ORDER BY date ROWS BETWEEN 41 PRECEDING AND CURRENT ROW)"
    return f"""{name}_m AS (SELECT *, CASE WHEN count({value}) OVER {w} >= 14 THEN quantile_cont({value}, 0.5) OVER {w} END AS med, CASE WHEN count({value}) OVER {w} >= 14 THEN stddev_pop({value}) OVER {w} END AS sd FROM {source}),
{name}_d AS (SELECT *, abs({value} - med) AS dev FROM {name}_m),
{name}_s AS (SELECT *, CASE WHEN count(dev) OVER {w} >= 14 THEN quantile_cont(dev, 0.5) OVER {w} END AS mad FROM {name}_d),
{name} AS (SELECT * EXCLUDE (med, sd, dev, mad), coalesce(({value} - med) / nullif(CASE WHEN mad > 0 THEN mad / 0.6745 ELSE sd END, 0), 0.0) AS z FROM {name}_s)"""


_pulse = " OR ".join(f"(nation_key % 5 = {k} AND signal_type IN ({listed(s)}))" for k, s in PULSED.items())
_h = "CAST(floor({} * 100 + 0.5) AS BIGINT)"

#: Each expression's name: what it needs, and its SQL.
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "places": ((), "places AS (SELECT n_nationkey AS nation_key, n_name AS district_id, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey)"),
    "daily": (("places",), f"""daily AS (SELECT region, district_id, date, signal_type, sum(cents) / count(*) / 100 AS value, source_id FROM (
        SELECT region, district_id, CAST(ts AS DATE) AS date, {case('event_type', EVENT_SIGNALS)} AS signal_type, {_h.format('value')} AS cents, 'src' || (event_id % 3) AS source_id
        FROM events JOIN customer ON user_id = c_custkey JOIN places ON c_nationkey = nation_key) GROUP BY ALL)"""),
    "lines": (("places",), f"""lines AS (SELECT region, district_id, nation_key, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, {_h.format('l_quantity')} AS q, {_h.format('l_discount')} * 100 AS d, {_h.format('l_tax')} * 100 AS t, o_orderpriority, c_mktsegment, l_returnflag, 'src' || (l_orderkey % 3) AS source_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN places ON c_nationkey = nation_key)"""),
    "agg": (("lines",), f"""cells AS (SELECT region, district_id, nation_key, date, signal_type, sum(h) / count(*) / 100 AS value FROM (
        SELECT region, district_id, nation_key, date, {case('o_orderpriority', PRIORITY_SIGNALS)} AS signal_type, q AS h FROM lines
        UNION ALL SELECT region, district_id, nation_key, date, {case('c_mktsegment', SEGMENT_SIGNALS)}, q FROM lines
        UNION ALL SELECT region, district_id, nation_key, date, {case('l_returnflag', FLAG_SIGNALS)}, q FROM lines
        UNION ALL SELECT region, district_id, nation_key, date, 'weather_temp', d FROM lines
        UNION ALL SELECT region, district_id, nation_key, date, 'weather_rainfall', t FROM lines) WHERE signal_type IS NOT NULL GROUP BY ALL),
    agg AS (SELECT region, district_id, date, signal_type, value * CASE WHEN ({_pulse}) AND k >= 0 THEN 1 + {PULSE} / (1 + (k - 5) * (k - 5) / 9.0) ELSE 1.0 END AS value
        FROM (SELECT *, 11 - floor(((SELECT max(date) FROM cells) - date) / 7) AS k FROM cells))"""),
    "raw": (("lines",), f"""raw_cells AS (SELECT region, district_id, nation_key, date, signal_type, source_id, sum(h) / count(*) / 100 AS value FROM (
        SELECT region, district_id, nation_key, date, source_id, {case('o_orderpriority', PRIORITY_SIGNALS)} AS signal_type, q AS h FROM lines
        UNION ALL SELECT region, district_id, nation_key, date, source_id, {case('c_mktsegment', SEGMENT_SIGNALS)}, q FROM lines
        UNION ALL SELECT region, district_id, nation_key, date, source_id, {case('l_returnflag', FLAG_SIGNALS)}, q FROM lines
        UNION ALL SELECT region, district_id, nation_key, date, source_id, 'weather_temp', d FROM lines
        UNION ALL SELECT region, district_id, nation_key, date, source_id, 'weather_rainfall', t FROM lines) WHERE signal_type IS NOT NULL GROUP BY ALL),
    raw AS (SELECT region, district_id, date, signal_type, source_id, value * CASE WHEN ({_pulse}) AND k >= 0 THEN 1 + {PULSE} / (1 + (k - 5) * (k - 5) / 9.0) ELSE 1.0 END AS value
        FROM (SELECT *, 11 - floor(((SELECT max(date) FROM raw_cells) - date) / 7) AS k FROM raw_cells))"""),
    "districts": (("places",), """districts AS (SELECT district_id, 'District ' || nation_key AS name, region, coalesce(population, 10000) AS population, nation_key % 5 * CAST(0.7 AS DOUBLE) + 10 AS lat, floor(nation_key / 5) * CAST(0.9 AS DOUBLE) + 70 AS lon, nation_key,
        ['NATION_' || ((nation_key + 5) % 25), 'NATION_' || ((nation_key + 20) % 25)] AS neighbors
        FROM places LEFT JOIN (SELECT c_nationkey, count(*) * 10000 AS population FROM customer GROUP BY 1) ON nation_key = c_nationkey)"""),
    "z": (("agg",), rolling_z("agg", "z")),
    "trail": (("z",), f"trail AS (SELECT district_id, date, signal_type, z, {anomaly('z')} AS anomaly FROM z)"),
    "seasonal": (("agg",), """placed AS (SELECT *, count(*) OVER (PARTITION BY district_id, signal_type) AS n, (row_number() OVER (PARTITION BY district_id, signal_type ORDER BY date) - 1) % 7 AS place,
        value - avg(value) OVER (PARTITION BY district_id, signal_type ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS gap FROM agg WHERE signal_type LIKE 'search_%'),
    cycle AS (SELECT district_id, signal_type, place, quantile_cont(gap, 0.5) AS c FROM placed GROUP BY ALL),
    centred AS (SELECT district_id, signal_type, place, c - avg(c) OVER (PARTITION BY district_id, signal_type) AS c FROM cycle),
    adjusted AS (SELECT p.district_id, p.date, p.signal_type, CASE WHEN n >= 16 THEN value - c ELSE value END AS adj FROM placed p LEFT JOIN centred USING (district_id, signal_type, place)),
    """ + rolling_z("adjusted", "seasonal", "adj")),
    "search": (("seasonal",), f"search AS (SELECT district_id, date, signal_type, {anomaly('z')} AS anomaly FROM seasonal)"),
    "top2": (("search",), """top2 AS (SELECT district_id, date, sum(CASE WHEN k = 1 THEN CAST(0.6 AS DOUBLE) * anomaly ELSE CAST(0.4 AS DOUBLE) * anomaly END) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY district_id, date ORDER BY anomaly DESC, signal_type) AS k FROM search) WHERE k <= 2 GROUP BY ALL)"""),
    "context": (("trail",), f"""lengths AS (SELECT district_id, date, sqrt(sum(z * z)) AS r FROM trail WHERE signal_type IN ({listed(HOSPITAL)}) GROUP BY ALL),
    spans AS (SELECT district_id, quantile_cont(r, 0.5) AS lo, quantile_cont(r, 0.99) AS hi, count(*) AS n FROM lengths GROUP BY ALL),
    context AS (SELECT district_id, date, CASE WHEN n >= 20 AND hi > lo THEN greatest(0.0, least(1.0, (r - lo) / (hi - lo))) ELSE 0.0 END AS context FROM lengths JOIN spans USING (district_id))"""),
    "scores": (("top2", "context"), f"""hospital AS (SELECT district_id, date, least(1.0, base * (1 + CAST(0.4 AS DOUBLE) * context)) AS score FROM (SELECT district_id, date, avg(anomaly) AS base FROM trail WHERE signal_type IN ({listed(HOSPITAL)}) GROUP BY ALL) JOIN context USING (district_id, date)),
    scores AS (SELECT district_id, date, 'search' AS detector, score FROM top2 UNION ALL SELECT district_id, date, 'hospital', score FROM hospital
        UNION ALL SELECT district_id, date, 'social', anomaly FROM trail WHERE signal_type = 'social_mentions' UNION ALL SELECT district_id, date, 'wastewater', anomaly FROM trail WHERE signal_type = 'wastewater_viral_load')"""),
    "wide": (("scores",), "wide AS (SELECT district_id, date, " + ", ".join(f"max(score) FILTER (WHERE detector = '{d}') AS {d}" for d in ("search", "hospital", "social", "wastewater")) + " FROM scores GROUP BY ALL)"),
    "risk": (("wide",), "parts AS (SELECT *, 0.0 + " + " + ".join(f"CAST({w} AS DOUBLE) * greatest(0.0, least(1.0, coalesce({d}, 0.0)))" for d, w in WEIGHTS.items()) + " AS up, 0.0 + " + " + ".join(f"CASE WHEN {d} IS NOT NULL THEN CAST({w} AS DOUBLE) ELSE 0.0 END" for d, w in WEIGHTS.items()) + f" AS down FROM wide),\n    fused AS (SELECT district_id, date, {tempered('1.0')} AS risk_score FROM parts),\n    risk AS (SELECT *, {level('risk_score')} AS level FROM fused)"),
    "latest": (("risk",), "latest AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY district_id ORDER BY date DESC, risk_score DESC) AS k FROM risk) WHERE k = 1)"),
    "named": (("latest", "districts"), "named AS (SELECT l.*, coalesce(d.name, l.district_id) AS district_name, d.region FROM latest l LEFT JOIN districts d USING (district_id))"),
    "drivers": (("search", "context"), f"""drivers AS (SELECT district_id, date, signal_type, max({rnd('anomaly', 3)}) AS anomaly FROM (SELECT district_id, date, signal_type, anomaly FROM search
        UNION ALL SELECT district_id, date, signal_type, anomaly FROM trail WHERE signal_type IN ({listed(HOSPITAL + ('social_mentions', 'wastewater_viral_load'))})
        UNION ALL SELECT district_id, date, 'multivariate_context', context FROM context) WHERE anomaly > 0.01 GROUP BY ALL)"""),
    "know": ((), values("disease", "disease, ordinal, display_name, category, r0, incubation_days, infectious_days, ifr", [(d[0], i, d[1], d[2], *d[7]) for i, d in enumerate(DISEASES)]) + ",\n    " + values("profile", "disease, signal_type", [(d[0], s) for d in DISEASES for s in d[5]]) + ",\n    " + values("effects", "disease, driver, effect", [(d[0], k, v) for d in DISEASES for k, v in d[6].items()])),
    "idf": (("know",), "idf AS (SELECT signal_type, ln((1 + (SELECT count(DISTINCT disease) FROM profile)) / (1 + count(DISTINCT disease))) + 1 AS idf FROM profile GROUP BY ALL)"),
    "weather": (("agg",), """weather AS (SELECT district_id, date, regexp_replace(signal_type, '^weather_', '') AS driver, CASE WHEN value >= hi THEN 'high' WHEN value <= lo THEN 'low' ELSE 'normal' END AS state
        FROM agg JOIN (SELECT district_id, signal_type, quantile_cont(value, 0.3) AS lo, quantile_cont(value, 0.7) AS hi FROM agg GROUP BY ALL) USING (district_id, signal_type) WHERE signal_type LIKE 'weather_%')"""),
    "matches": (("drivers", "weather", "idf"), f"""matched AS (SELECT district_id, date, disease, sum(anomaly * idf) AS m FROM drivers JOIN profile USING (signal_type) JOIN idf USING (signal_type) WHERE anomaly > 0.05 AND signal_type <> 'multivariate_context' GROUP BY ALL),
    totals AS (SELECT disease, sum(idf) AS total FROM profile JOIN idf USING (signal_type) GROUP BY ALL),
    bonus AS (SELECT district_id, date, disease, sum(CASE WHEN effect = 'positive' AND state = 'high' THEN CAST(0.04 AS DOUBLE) WHEN effect = 'negative' AND state = 'low' THEN CAST(0.03 AS DOUBLE) ELSE 0.0 END) AS b FROM weather JOIN effects USING (driver) GROUP BY ALL),
    matches AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY district_id, date ORDER BY score DESC, ordinal) AS rank FROM (SELECT m.district_id, m.date, m.disease, {rnd('least(1.0, m / total + coalesce(b, 0.0))', 4)} AS score, ordinal, display_name, category FROM matched m JOIN totals USING (disease) JOIN disease USING (disease) LEFT JOIN bonus USING (district_id, date, disease))) WHERE rank <= 3)"""),
    "assessed": (("matches", "risk", "districts"), """best AS (SELECT district_id, date, string_agg(display_name, ', ' ORDER BY rank) AS likely, max(category) FILTER (WHERE rank = 1) AS category, max(score) AS best FROM matches GROUP BY ALL),
    assessed AS (SELECT r.district_id, r.date, coalesce(d.name, r.district_id) AS district_name, risk_score, level, CASE WHEN level <> 'Normal' THEN coalesce(b.category, 'Unknown') ELSE 'Unknown' END AS category,
        CASE WHEN level <> 'Normal' THEN coalesce(likely, '') ELSE '' END AS likely_diseases, CASE WHEN level <> 'Normal' THEN coalesce(best, 0.0) ELSE 0.0 END AS best_match
        FROM risk r LEFT JOIN best b USING (district_id, date) LEFT JOIN districts d USING (district_id))"""),
    "pct": (("agg",), """pct AS (SELECT *, (value - baseline) / nullif(abs(baseline), 0) * 100 AS pct FROM (SELECT *, CASE WHEN count(value) OVER w >= 10 THEN quantile_cont(value, 0.5) OVER w END AS baseline FROM agg
        WINDOW w AS (PARTITION BY district_id, signal_type ORDER BY date ROWS BETWEEN 42 PRECEDING AND 1 PRECEDING)))"""),
    "contributions": (("drivers", "pct", "weather"), f"""ranked AS (SELECT d.*, row_number() OVER (PARTITION BY district_id, date ORDER BY anomaly DESC, signal_type) AS rank FROM drivers d WHERE anomaly > 0.01),
    valued AS (SELECT r.district_id, r.date, rank, {case('r.signal_type', LABELS)} AS label, CASE WHEN pct IS NOT NULL AND r.signal_type <> 'multivariate_context' THEN {rnd('pct', 1)} ELSE {rnd('anomaly * 100', 1)} END AS value, pct IS NOT NULL AND r.signal_type <> 'multivariate_context' AS known
        FROM ranked r LEFT JOIN pct p USING (district_id, date, signal_type) WHERE rank <= 6),
    contributions AS (SELECT district_id, date, rank, label, value, CASE WHEN known THEN CASE WHEN value >= 0 THEN '+' ELSE '' END || CAST(CAST(value AS DECIMAL(18, 1)) AS VARCHAR) || '% vs baseline' ELSE {text(ANOMALOUS)} END AS detail FROM valued
        UNION ALL SELECT district_id, date, 6 + row_number() OVER (PARTITION BY district_id, date ORDER BY driver), {case('driver', WEATHER_LABELS)} || {text(FAVOURABLE)}, 0.0, {text(ELEVATED)} FROM weather WHERE state = 'high')"""),
    "actions": ((), values("level_actions", "level, action", list(LEVEL_ACTIONS.items())) + ",\n    " + values("category_actions", "category, ord, action", [(c, i, a) for c, xs in CATEGORY_ACTIONS.items() for i, a in enumerate(xs)])),
}


def build(final: str, *needs: str) -> str:
    """WITH all that `needs` stand on, then the final select (which may start with further table expressions)."""
    done: list[str] = []

    def add(name: str) -> None:
        if name not in done:
            for x in CTES[name][0]:
                add(x)
            done.append(name)

    for n in needs:
        add(n)
    head = ",\n".join(CTES[n][1] for n in done)
    if final.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n" + final.removeprefix("WITH RECURSIVE ")
    if final.lstrip().startswith("WITH "):
        return (f"WITH {head},\n" if head else "WITH ") + final.lstrip()[5:]
    return (f"WITH {head}\n" if head else "") + final


__all__ = ["CTES", "LEVEL_ORDER", "SEARCH", "SIGNAL_TYPES", "anomaly", "build", "case", "level", "listed", "rnd", "rolling_z", "tempered", "text", "values"]
