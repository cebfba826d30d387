"""The entities of sources.tables as SQL text, for the side-by-side check of every query."""

from __future__ import annotations

_NAMES = "['click','error','purchase','signup','view']"

ENTITIES: dict[str, tuple[str, tuple[str, ...]]] = {
    "readings": (
        "SELECT concat('st_', lpad(cast(3*(user_id%9) AS varchar), 2, '0')) AS station_id,"
        " event_type AS indicator, ts, value FROM events", ()),
    "hourly": (
        "SELECT station_id, indicator, date_trunc('hour', ts) AS ts, avg(value) AS value"
        " FROM readings GROUP BY ALL", ("readings",)),
    "river_hourly": (
        "SELECT 'river' AS station_id, indicator, ts, value FROM (SELECT g.indicator, g.ts, last_value(m.value IGNORE NULLS)"
        " OVER (PARTITION BY g.indicator ORDER BY g.ts) AS value FROM (SELECT indicator, ts FROM (SELECT DISTINCT indicator FROM"
        " readings), (SELECT unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL 1 HOUR)) AS ts"
        " FROM readings)) g LEFT JOIN (SELECT indicator, date_trunc('hour', ts) AS ts, avg(value) AS value FROM readings GROUP BY ALL) m"
        " ON m.indicator=g.indicator AND m.ts=g.ts) WHERE value IS NOT NULL", ("readings",)),
    "positioned": (
        "SELECT *, row_number() OVER (PARTITION BY station_id, indicator ORDER BY ts, value) - 1 AS idx,"
        " count(*) OVER (PARTITION BY station_id, indicator) AS n FROM readings", ("readings",)),
    "nodes": (
        "SELECT cast(n_nationkey AS bigint) AS id, n_name AS name,"
        " CASE WHEN n_nationkey=0 THEN 'outlet' WHEN n_nationkey>=12 THEN 'source' ELSE 'segment' END AS kind,"
        " cast(6*n_nationkey AS double) AS x, cast(4*n_regionkey-8 AS double) AS y,"
        " cast(20+5*n_regionkey AS double) AS flow, cast(0.4+0.1*(n_nationkey%3) AS double) AS velocity,"
        " cast(0.10+0.05*(n_nationkey%2) AS double) AS k FROM nation", ()),
    "edges": (
        "SELECT cast(n_nationkey AS bigint) AS from_node, cast(floor((n_nationkey-1)/2) AS bigint) AS to_node,"
        " cast(1000*(1+n_nationkey%5) AS double) AS distance_m FROM nation WHERE n_nationkey>0", ()),
    "stations": (
        "SELECT concat('st_', lpad(cast(n_nationkey AS varchar), 2, '0')) AS id,"
        " cast(n_nationkey AS bigint) AS node_id FROM nation WHERE n_nationkey%3=0", ()),
    "enterprises": (
        "SELECT s_suppkey AS id, s_name AS name, concat('ind_', cast(s_suppkey%7 AS varchar)) AS industry,"
        " cast(s_nationkey AS bigint) AS node_id, s_suppkey%2=0 AS continuous,"
        " s_suppkey%24 AS hour_from, s_suppkey*7%24 AS hour_to,"
        " cast(1+0.1*(s_suppkey%4) AS double) AS night_boost, cast(0.5+0.1*(s_suppkey%6) AS double) AS weekend_scale,"
        " cast(0.1*(s_suppkey%5) AS double) AS seasonal_amp, s_suppkey%10=9 AS event_only,"
        " 0.01::double+abs(s_acctbal)/1000000 AS q_waste, cast(0.01*(1+s_suppkey%3) AS double) AS treat_rate"
        " FROM supplier", ()),
    "peaks": (
        "SELECT s_suppkey AS enterprise_id, cast(260+s_suppkey%100 AS double) AS plex,"
        " cast(320+s_suppkey%100 AS double) AS plem, 1.0::double AS amp, cast(16+s_suppkey%10 AS double) AS sigma"
        " FROM supplier UNION ALL SELECT s_suppkey, cast(300+s_suppkey%25 AS double), 400.0::double, 0.5::double,"
        " 20.0::double FROM supplier", ()),
    "closure": (
        "SELECT id AS src, id AS dst, 0 AS hops, 0.0::double AS distance_m, 0.0::double AS travel_h, k AS k_sum"
        " FROM nodes UNION ALL"
        " SELECT c.src, e.to_node, c.hops+1, c.distance_m+e.distance_m,"
        " c.travel_h+e.distance_m/f.velocity/3600, c.k_sum+t.k"
        " FROM closure c JOIN edges e ON e.from_node=c.dst JOIN nodes f ON f.id=e.from_node"
        " JOIN nodes t ON t.id=e.to_node", ("nodes", "edges")),
    "impact": (
        "SELECT e.id AS enterprise_id, s.id AS station_id, e.name, e.industry, e.node_id,"
        " round(CASE WHEN c.hops=0 THEN 1.0 ELSE exp(-(c.k_sum/(c.hops+1))*c.travel_h/24) END"
        " * e.q_waste/(e.q_waste+t.flow), 8) AS factor"
        " FROM enterprises e JOIN closure c ON c.src=e.node_id JOIN stations s ON s.node_id=c.dst"
        " JOIN nodes t ON t.id=c.dst", ("enterprises", "closure", "stations", "nodes")),
    "outfall": (
        "SELECT industry, indicator, cast(10*(1+(3*j+i)%7) AS double) AS conc FROM"
        " (SELECT DISTINCT s_suppkey%7 AS j, concat('ind_', cast(s_suppkey%7 AS varchar)) AS industry FROM supplier),"
        " (VALUES (0,'click'),(1,'error'),(2,'purchase'),(3,'signup'),(4,'view')) t(i,indicator)"
        " WHERE (j+i)%5<>0", ()),
    "alerts": (
        "SELECT o_orderkey AS id, concat('st_', lpad(cast(3*(o_custkey%7) AS varchar), 2, '0')) AS station_id,"
        f" CASE WHEN o_orderkey%11=0 THEN [] WHEN o_orderkey%7=0 THEN [{_NAMES}[1+o_orderkey%5]]"
        f" WHEN o_orderkey%4=0 THEN [{_NAMES}[1+o_orderkey%5], {_NAMES}[1+(o_orderkey+2)%5]]"
        f" ELSE [{_NAMES}[1+o_orderkey%5]] END AS indicators,"
        " timestamp '2024-01-01' + to_days(cast(datediff('day', date '1995-01-01', cast(o_orderdate AS date))%30"
        " AS int)) AS onset_ts,"
        " CASE WHEN o_totalprice>=300000 THEN 'high' WHEN o_totalprice>=150000 THEN 'medium' ELSE 'low' END AS severity,"
        " CASE o_custkey%3 WHEN 0 THEN 'periodic' WHEN 1 THEN 'sudden' ELSE 'gradual' END AS etype,"
        " CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN 'open' ELSE 'investigating' END AS status,"
        " o_orderdate AS created_at, o_custkey AS reporter FROM orders", ()),
    "truth": (
        "SELECT event_id, truth_source FROM (SELECT l_orderkey AS event_id, l_suppkey AS truth_source,"
        " row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_suppkey) AS rn FROM lineitem)"
        " WHERE rn=1", ()),
    "library_parts": (
        "SELECT l_suppkey AS enterprise_id, concat(l_returnflag, l_linestatus) AS component,"
        " sum(l_quantity)/sum(sum(l_quantity)) OVER (PARTITION BY l_suppkey) AS share FROM lineitem"
        " GROUP BY l_suppkey, l_returnflag, l_linestatus", ()),
    "observed_parts": (
        "SELECT l_orderkey AS event_id, concat(l_returnflag, l_linestatus) AS component,"
        " sum(l_quantity)/sum(sum(l_quantity)) OVER (PARTITION BY l_orderkey) AS share FROM lineitem"
        " GROUP BY l_orderkey, l_returnflag, l_linestatus", ()),
    "vectors": (
        "SELECT vec_id, list_transform(embedding, lambda x: cast(x AS double)) AS v FROM embeddings", ()),
    "centred": (
        "SELECT vec_id, v, list_transform(v, lambda x: x - list_avg(v)) AS c FROM vectors", ("vectors",)),
    "messages": (
        "SELECT cast(conv_id AS varchar) AS inv_id, turn AS seq,"
        " CASE WHEN role='user' THEN 'step' WHEN role='assistant' AND turn%4=1 THEN 'hypothesis'"
        " WHEN role='assistant' THEN 'agent_talk' ELSE 'connected' END AS type,"
        " concat(role, '_', cast(turn%3 AS varchar)) AS item_id, length(text)/1000.0::double AS score, text"
        " FROM conversations", ()),
}


def with_entities(body: str, *names: str, extra: tuple[tuple[str, str], ...] = ()) -> str:
    """Puts the named entities (and what they need) before ``body`` as common table expressions."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in ordered:
            return
        for needed in ENTITIES[name][1]:
            add(needed)
        ordered.append(name)

    for name in names:
        add(name)
    parts = [f"{name} AS ({ENTITIES[name][0]})" for name in ordered]
    parts += [f"{name} AS ({text})" for name, text in extra]
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body
