"""Queries on the river network, its map layers and plumes."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivertrace.operators import network as N
from rivertrace.operators import plume as P
from rivertrace.operators import readmodels as M
from rivertrace.operators import spectra as X
from rivertrace.plans.common import open_river, r
from rivertrace.plans.oracle_entities import with_entities


def path_closure(spark, folder):
    return open_river(spark, folder).closure.select(
        "src", "dst", "hops", "distance_m", r("travel_h", 6).alias("travel_h"), r("k_mean", 6).alias("k_mean")
    )


def upstream_window(spark, folder):
    river = open_river(spark, folder)
    found = N.upstream_within(river.index, river.nodes.select(F.col("id").alias("node_id")), 5.0)
    return found.withColumn("travel_h", F.bround("travel_h", 2))


def downstream_hops(spark, folder):
    river = open_river(spark, folder)
    return N.downstream_of(river.index, river.nodes.select(F.col("id").alias("node_id")))


def travel_hours(spark, folder):
    river = open_river(spark, folder)
    pairs = river.table("customer").selectExpr("cast(c_nationkey AS bigint) AS src", "c_custkey % 25 AS dst")
    return N.hours_between(river.index, pairs.distinct())


def _reaches(river):
    """A long river with a reach for every customer, one or a few numbers below the next; it grows with the table."""
    customer = river.table("customer")
    nodes = customer.selectExpr("c_custkey AS id", "cast(0.5 + 0.1 * (c_nationkey % 5) AS double) AS velocity", "0.1D AS k")
    edges = customer.where("c_custkey > 1").selectExpr(
        "c_custkey AS from_node", "greatest(1, c_custkey - 1 - c_custkey % 4) AS to_node", "cast(500 + 100 * (c_custkey % 10) AS double) AS distance_m"
    )
    return nodes, edges


def reach_upstream(spark, folder):
    """What reaches the sampling point of each supplier, at the reach of its number, within three hours."""
    river = open_river(spark, folder)
    asked = river.table("supplier").select(F.col("s_suppkey").alias("node_id"))
    return N.upstream_within(N.river_index(*_reaches(river)), asked, 3.0).withColumn("travel_h", r("travel_h", 4))


def reach_hours(spark, folder):
    """Hours from the customer's reach to that of its orders' numbers, per order; null where water does not get there."""
    river = open_river(spark, folder)
    orders = river.table("orders")
    reaches = orders.agg(F.max("o_custkey").alias("top"))
    pairs = orders.join(F.broadcast(reaches)).select("o_orderkey", F.col("o_custkey").alias("src"), (F.col("o_orderkey") % F.col("top") + 1).alias("dst"))
    return N.hours_between(N.river_index(*_reaches(river)), pairs, 9).select("o_orderkey", r("travel_h", 4).alias("travel_h"))


def downstream_paths(spark, folder):
    return N.downstream_paths(open_river(spark, folder).source_closure).select(
        "src", "dst", "distance_m", r("travel_h", 6).alias("travel_h")
    )


def impact_matrix(spark, folder):
    return open_river(spark, folder).impact.select("enterprise_id", "station_id", "factor")


def upstream_sources(spark, folder):
    return open_river(spark, folder).sources.select("station_id", "enterprise_id", "name", "industry", "node_id", "atten")


def first_hit_station(spark, folder):
    return N.first_hit_station(open_river(spark, folder).impact)


def map_extent(spark, folder):
    return N.map_extent(open_river(spark, folder).nodes)


def map_edges(spark, folder):
    river = open_river(spark, folder)
    return M.map_edges(river.edges, river.nodes)


def map_stations(spark, folder):
    river = open_river(spark, folder)
    return M.station_layer(river.stations, river.nodes, river.alerts).select("id", "node_id", "x", "y", "alert")


def map_free_nodes(spark, folder):
    river = open_river(spark, folder)
    return M.nodes_without_station(river.nodes, river.stations).select("id", "name", "kind", "x", "y")


def _weights(river):
    totals = river.table("lineitem").groupBy(F.col("l_suppkey").alias("enterprise_id")).agg(
        F.sum("l_quantity").alias("total")
    )
    return X.mixing_weights(river.sources, totals, treated="ind_6")


def map_enterprises(spark, folder):
    river = open_river(spark, folder)
    locked = X.dominant_source(_weights(river)).select(F.col("dominant").alias("source_id"))
    return M.enterprise_layer(river.enterprises, river.nodes, locked).select("id", "name", "x", "y", "locked")


def station_mix(spark, folder):
    return X.dominant_source(_weights(open_river(spark, folder))).select(
        "station_id", "dominant", r("share", 4).alias("share"), "sources"
    )


def expanded_spectra(spark, folder):
    return X.expand_spectra(open_river(spark, folder).spectra).select(
        "enterprise_id", "lex", "lem", r("intensity", 4).alias("intensity")
    )


def expected_spectrum(spark, folder):
    river = open_river(spark, folder)
    return X.expected_spectrum(_weights(river), river.spectra).select(
        "station_id", "lex", "lem", r("intensity", 4).alias("intensity")
    )


def _spills(river):
    return river.enterprises.select(
        F.col("id").alias("spill_id"), "node_id", (F.lit(50.0) + 10 * F.col("id")).alias("mass_kg")
    )


def plume_grid(spark, folder):
    river = open_river(spark, folder)
    return P.simulate_puff(_spills(river), river.source_closure, river.nodes).select(
        "spill_id", "node_id", F.bround("t_h", 2).alias("t_h"), r("c_mgl", 4).alias("c_mgl")
    )


def plume_peak(spark, folder):
    river = open_river(spark, folder)
    curves = P.simulate_puff(_spills(river), river.source_closure, river.nodes)
    return P.plume_peaks(curves).select("spill_id", "node_id", r("peak_mgl", 4).alias("peak_mgl"), F.bround("peak_h", 2).alias("peak_h"))


def plume_at_station(spark, folder):
    river = open_river(spark, folder)
    requests = river.table("lineitem").selectExpr(
        "l_suppkey AS spill_id", "l_partkey % 25 AS node_id", "cast(l_linenumber AS double) AS t_h"
    ).distinct()
    found = P.puff_at(requests, _spills(river), river.source_closure, river.nodes)
    return found.select("spill_id", "node_id", "t_h", r("c_mgl", 4).alias("c_mgl"))


_WEIGHTS = (
    ("w", "SELECT i.station_id, i.enterprise_id, i.factor*q.total*CASE WHEN i.industry='ind_6' THEN 0.3 ELSE 1.0 END::double AS w"
     " FROM impact i JOIN (SELECT l_suppkey, sum(l_quantity) AS total FROM lineitem GROUP BY 1) q"
     " ON q.l_suppkey=i.enterprise_id WHERE i.factor<>0"),
    ("shares", "SELECT station_id, enterprise_id, w/sum(w) OVER (PARTITION BY station_id) AS share FROM w"),
    ("dominants", "SELECT station_id, enterprise_id AS dominant, share, count(*) OVER (PARTITION BY station_id) AS sources,"
     " row_number() OVER (PARTITION BY station_id ORDER BY share DESC, enterprise_id) AS rn FROM shares"),
)
_GRID = ("grid", "SELECT 200.0::double+5*i AS lex, 250.0::double+5*j AS lem FROM range(61) a(i), range(71) b(j)")
_PEAK = "amp*exp(-((lex-plex)*(lex-plex)+(lem-plem)*(lem-plem))/(2*sigma*sigma))"
_PUFF = (
    "greatest(0.0, mass_kg*1e6/(area*sqrt(40*pi()*s))*exp(-((d-vel*s)*(d-vel*s))/(40*s))*exp(-k*s/86400))"
)
_PATHS = (
    "paths",
    "SELECT e.id AS spill_id, c.dst AS node_id, CASE WHEN c.hops=0 THEN 100.0 ELSE c.distance_m END AS d,"
    " n.velocity AS vel, n.flow/n.velocity AS area, n.k, 50.0+10*e.id AS mass_kg"
    " FROM enterprises e JOIN closure c ON c.src=e.node_id JOIN nodes n ON n.id=e.node_id",
)
_CURVES = (
    "curves",
    f"SELECT spill_id, node_id, t_h, {_PUFF} AS c FROM (SELECT *, greatest(t_h*3600, 1.0) AS s FROM paths,"
    " (SELECT i*0.25::double AS t_h FROM range(289) t(i)))",
)

_REACHES = (
    "reaches",
    "SELECT c_custkey AS id, CASE WHEN c_custkey>1 THEN greatest(1, c_custkey-1-c_custkey%4) END AS below,"
    " cast(500+100*(c_custkey%10) AS double) AS m, cast(500+100*(c_custkey%10) AS double)/cast(0.5+0.1*(c_nationkey%5) AS double)/3600 AS h FROM customer",
)
_ABOVE = (
    "above",
    "SELECT s_suppkey AS node_id, s_suppkey AS upstream_id, 0.0::double AS distance_m, 0.0::double AS travel_h FROM supplier UNION ALL"
    " SELECT a.node_id, u.id, a.distance_m+u.m, a.travel_h+u.h FROM above a JOIN reaches u ON u.below=a.upstream_id WHERE a.travel_h+u.h<=3.0",
)

_DOWN = (
    "down",
    "SELECT id AS src, id AS dst, 0.0::double AS travel_h FROM reaches UNION ALL"
    " SELECT d.src, u.below, d.travel_h+u.h FROM down d JOIN reaches u ON u.id=d.dst WHERE u.below IS NOT NULL",
)

QUERIES = {
    "reach_upstream": (reach_upstream, with_entities(
        "SELECT node_id, upstream_id, distance_m, round(travel_h+1e-9,4) AS travel_h FROM above WHERE node_id<>upstream_id", extra=(_REACHES, _ABOVE))),
    "reach_hours": (reach_hours, with_entities(
        "SELECT o_orderkey, round(d.travel_h+1e-9,4) AS travel_h FROM orders LEFT JOIN down d ON d.src=o_custkey"
        " AND d.dst=o_orderkey%(SELECT max(o_custkey) FROM orders)+1", extra=(_REACHES, _DOWN))),
    "path_closure": (path_closure, with_entities(
        "SELECT src, dst, cast(hops AS bigint) AS hops, distance_m, round(travel_h+1e-9,6) AS travel_h,"
        " round(k_sum/(hops+1)+1e-9,6) AS k_mean FROM closure", "closure")),
    "upstream_window": (upstream_window, with_entities(
        "SELECT dst AS node_id, src AS upstream_id, distance_m, round(travel_h,2) AS travel_h FROM closure"
        " WHERE hops>0 AND travel_h<=5", "closure")),
    "downstream_hops": (downstream_hops, with_entities(
        "SELECT src AS node_id, dst AS downstream_id, cast(hops AS bigint) AS hops FROM closure WHERE hops>0", "closure")),
    "travel_hours": (travel_hours, with_entities(
        "SELECT p.src, p.dst, round(c.travel_h,2) AS travel_h FROM (SELECT DISTINCT cast(c_nationkey AS bigint) AS src,"
        " c_custkey%25 AS dst FROM customer) p LEFT JOIN closure c ON c.src=p.src AND c.dst=p.dst", "closure")),
    "downstream_paths": (downstream_paths, with_entities(
        "SELECT src, dst, CASE WHEN hops=0 THEN 100.0 ELSE distance_m END AS distance_m,"
        " round(travel_h+1e-9,6) AS travel_h FROM closure WHERE src IN (SELECT node_id FROM enterprises)",
        "closure", "enterprises")),
    "impact_matrix": (impact_matrix, with_entities(
        "SELECT enterprise_id, station_id, factor FROM impact", "impact")),
    "upstream_sources": (upstream_sources, with_entities(
        "SELECT station_id, enterprise_id, name, industry, node_id, factor AS atten FROM impact WHERE factor<>0", "impact")),
    "first_hit_station": (first_hit_station, with_entities(
        "SELECT enterprise_id, station_id, factor FROM (SELECT *, row_number() OVER (PARTITION BY enterprise_id"
        " ORDER BY factor DESC, station_id) AS rn FROM impact WHERE factor>0) WHERE rn=1", "impact")),
    "map_extent": (map_extent, with_entities(
        "SELECT min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM nodes", "nodes")),
    "map_edges": (map_edges, with_entities(
        "SELECT from_node, to_node, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM edges e"
        " JOIN nodes a ON a.id=e.from_node JOIN nodes b ON b.id=e.to_node", "edges", "nodes")),
    "map_stations": (map_stations, with_entities(
        "SELECT s.id, s.node_id, n.x, n.y, s.id IN (SELECT station_id FROM alerts WHERE status<>'resolved') AS alert"
        " FROM stations s JOIN nodes n ON n.id=s.node_id", "stations", "nodes", "alerts")),
    "map_free_nodes": (map_free_nodes, with_entities(
        "SELECT id, name, kind, x, y FROM nodes WHERE id NOT IN (SELECT node_id FROM stations)", "nodes", "stations")),
    "map_enterprises": (map_enterprises, with_entities(
        "SELECT e.id, e.name, n.x, n.y, e.id IN (SELECT dominant FROM dominants WHERE rn=1) AS locked"
        " FROM enterprises e JOIN nodes n ON n.id=e.node_id", "impact", extra=_WEIGHTS)),
    "station_mix": (station_mix, with_entities(
        "SELECT station_id, dominant, round(share+1e-9,4) AS share, sources FROM dominants WHERE rn=1", "impact", extra=_WEIGHTS)),
    "expanded_spectra": (expanded_spectra, with_entities(
        f"SELECT enterprise_id, lex, lem, round(sum({_PEAK})+1e-9,4) AS intensity FROM peaks, grid GROUP BY ALL",
        "peaks", extra=(_GRID,))),
    "expected_spectrum": (expected_spectrum, with_entities(
        "SELECT station_id, lex, lem, round(raw/max(raw) OVER (PARTITION BY station_id)+1e-9,4) AS intensity FROM"
        f" (SELECT s.station_id, lex, lem, sum(s.share*{_PEAK}) AS raw FROM shares s JOIN peaks p"
        " ON p.enterprise_id=s.enterprise_id, grid GROUP BY ALL)", "impact", "peaks", extra=(*_WEIGHTS, _GRID))),
    "plume_grid": (plume_grid, with_entities(
        "SELECT spill_id, node_id, t_h, round(c+1e-9,4) AS c_mgl FROM curves", "closure", "enterprises", extra=(_PATHS, _CURVES))),
    "plume_peak": (plume_peak, with_entities(
        "SELECT spill_id, node_id, round(c+1e-9,4) AS peak_mgl, t_h AS peak_h FROM (SELECT *, row_number() OVER"
        " (PARTITION BY spill_id, node_id ORDER BY c DESC, t_h) AS rn FROM curves) WHERE rn=1",
        "closure", "enterprises", extra=(_PATHS, _CURVES))),
    "plume_at_station": (plume_at_station, with_entities(
        f"SELECT q.spill_id, q.node_id, t_h, round(coalesce({_PUFF},0.0)+1e-9,4) AS c_mgl FROM"
        " (SELECT DISTINCT l_suppkey AS spill_id, l_partkey%25 AS node_id, cast(l_linenumber AS double) AS t_h,"
        " greatest(cast(l_linenumber AS double)*3600,1.0) AS s FROM lineitem) q"
        " LEFT JOIN paths p ON p.spill_id=q.spill_id AND p.node_id=q.node_id", "closure", "enterprises", extra=(_PATHS,))),
}
