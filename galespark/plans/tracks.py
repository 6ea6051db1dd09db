"""Links, persistence, components and track headers."""

from __future__ import annotations

from pyspark.sql import functions as F

from galespark.operators import link, regions, track
from galespark.plans import separation
from galespark.plans.base import basin_case, hav, registry
from galespark.session import cut
from galespark.sources.adapters import view, with_views
from galespark.sources.dims import basin_of

QUERIES, ORACLE, query = registry()

NODES = """, nodes as (select event_id as node_id, model_name, init_time, time_step, lat, lon, mslp, vmax from
  (select *, row_number() over (partition by model_name, init_time, time_step, lat, lon order by event_id desc) as r from track_points) t where r=1)"""
GAP = "least(abs(a.{0}-b.{0}), abs(abs(a.{0}-b.{0})-{1}))"
NEAR = lambda r: f"{GAP.format('lat', 180)}<={r} and {GAP.format('lon', 360)}<={r}"
SAME = f""", same as (select a.model_name, a.init_time, a.time_step, a.node_id as src, b.node_id as dst from nodes a join nodes b
  on a.model_name=b.model_name and a.init_time=b.init_time and a.time_step=b.time_step and a.node_id<b.node_id and {NEAR(5)})"""
NEXT = f""", steps as (select *, lead(time_step) over (partition by model_name, init_time order by time_step) as nxt
    from (select distinct model_name, init_time, time_step from nodes) t),
  links as materialized (select a.model_name, a.init_time, a.time_step, a.node_id as src, b.node_id as dst from nodes a join steps s
    on s.model_name=a.model_name and s.init_time=a.init_time and s.time_step=a.time_step and s.nxt-s.time_step=6
    join nodes b on a.model_name=b.model_name and a.init_time=b.init_time and b.time_step=a.time_step+6 and {NEAR(3)})"""
PERSIST = """, s1 as (select distinct src as id from links), s2 as (select distinct src as id from links where dst in (select id from s1)),
  s3 as (select distinct src as id from links where dst in (select id from s2)), s4 as (select distinct src as id from links where dst in (select id from s3)),
  keep as (select id from s4 union select l.dst from keep k join links l on l.src=k.id),
  kept as materialized (select n.* from nodes n where node_id in (select id from keep))"""
COMPONENTS = """, e as materialized (select src, dst from links where src in (select node_id from kept) and dst in (select node_id from kept)
    union select dst, src from links where src in (select node_id from kept) and dst in (select node_id from kept)
    union select src, dst from same where src in (select node_id from kept) and dst in (select node_id from kept)
    union select dst, src from same where src in (select node_id from kept) and dst in (select node_id from kept)),
  reach as (select node_id as id, node_id as root from kept union select e.dst, r.root from reach r join e on e.src=r.id),
  lab as (select id, min(root) as label from reach group by 1),
  starts as (select model_name, init_time, label, min(time_step) as start from kept join lab on id=node_id group by 1,2,3),
  num as (select *, row_number() over (partition by model_name, init_time order by start, label)-1 as component_id from starts),
  comp as materialized (select k.*, num.component_id from kept k join lab on lab.id=k.node_id join num using (model_name, init_time, label))"""
BASE = with_views("track_points", recursive=True) + NODES
FULL = BASE + SAME + NEXT + PERSIST + COMPONENTS
# two neighbouring storms with points between them, so that groups part and meet
PAIRS = with_views("pair_points", recursive=True) + NODES.replace("track_points", "pair_points")
PAIRS_FULL = PAIRS + SAME + NEXT + PERSIST + COMPONENTS


def graph(spark, sf_dir, points="track_points"):
    """Nodes with both kinds of links; cut, since everything reads them again."""
    nodes = cut(link.nodes(view(spark, sf_dir, points)))
    return nodes, cut(link.same_step(nodes)), cut(link.next_step(nodes))


def kept_graph(spark, sf_dir, points="track_points"):
    nodes, same, links = graph(spark, sf_dir, points)
    kept = cut(track.keep_persistent(nodes, links))
    return kept, cut(track.induced(same, kept)), cut(track.induced(links, kept))


def labelled(spark, sf_dir, points="track_points"):
    kept, same, links = kept_graph(spark, sf_dir, points)
    return track.track_components(kept, same, links, closed=True), same, links


@query("track_nodes", BASE + " select node_id, model_name, init_time, time_step, lat, lon, mslp, vmax from nodes")
def track_nodes(spark, sf_dir):
    n = link.nodes(view(spark, sf_dir, "track_points"))
    return n.select("node_id", "model_name", "init_time", "time_step", "lat", "lon", "mslp", "vmax")


@query("link_same_step", BASE + SAME + " select * from same")
def link_same_step(spark, sf_dir):
    return link.same_step(link.nodes(view(spark, sf_dir, "track_points")))


@query("link_next_step", BASE + NEXT + " select * from links")
def link_next_step(spark, sf_dir):
    return link.next_step(cut(link.nodes(view(spark, sf_dir, "track_points"))))


@query(
    "radius_bins",
    BASE + SAME + f""" select src, dst, concat_ws(',', {', '.join(f"case when {NEAR(r)} then '{r}' end" for r in (1, 3, 5))}) as radii from same
      join nodes a on a.node_id=src join nodes b on b.node_id=dst""",
)
def radius_bins(spark, sf_dir):
    bins = link.radius_bins(link.nodes(view(spark, sf_dir, "track_points")), [1, 3, 5])
    return bins.select("src", "dst", F.concat_ws(",", F.transform("radii", lambda r: r.cast("int").cast("string"))).alias("radii"))


@query("persist_24h", BASE + NEXT + PERSIST + " select node_id, model_name, init_time, time_step from kept")
def persist_24h(spark, sf_dir):
    nodes = cut(link.nodes(view(spark, sf_dir, "track_points")))
    kept = track.keep_persistent(nodes, cut(link.next_step(nodes)))
    return kept.select("node_id", "model_name", "init_time", "time_step")


@query(
    "longest_path",
    BASE + NEXT + """, walk as (select src as id, 1 as length from links union select l.src, w.length+1 from walk w join links l on l.dst=w.id)
      select id as node_id, max(length) as length from walk group by 1""",
)
def longest_path(spark, sf_dir):
    return track.longest_path(link.next_step(cut(link.nodes(view(spark, sf_dir, "track_points")))))


@query("track_components", FULL + " select node_id, model_name, init_time, time_step, component_id from comp")
def track_components(spark, sf_dir):
    comp, _, _ = labelled(spark, sf_dir)
    return comp.select("node_id", "model_name", "init_time", "time_step", "component_id")


MIN_SQL = """, low as (select * from (select *, row_number() over (partition by model_name, init_time, component_id, time_step order by mslp, node_id) as r
  from comp) t where r=1)"""


@query("track_min_pressure", FULL + MIN_SQL + " select model_name, init_time, component_id, time_step, node_id, mslp from low")
def track_min_pressure(spark, sf_dir):
    comp, _, _ = labelled(spark, sf_dir)
    return track.min_pressure(comp).select("model_name", "init_time", "component_id", "time_step", "node_id", "mslp")


HEADERS = f""" select model_name, init_time, component_id, start_time_step, init_time + interval '1' hour * start_time_step as start_valid_time,
  {basin_case('start_lat', 'start_lon')} as start_basin, start_lat, start_lon, last_time_step, last_lat, last_lon, ws_max_10m, min_mslp, n_points from
  (select model_name, init_time, component_id, min(time_step) as start_time_step, min_by(lat, time_step) as start_lat, min_by(lon, time_step) as start_lon,
    max(time_step) as last_time_step, max_by(lat, time_step) as last_lat, max_by(lon, time_step) as last_lon, max(vmax) as ws_max_10m,
    min(mslp) as min_mslp, count(*) as n_points from low group by 1,2,3) t"""


@query("track_summary", FULL + MIN_SQL + HEADERS)
def track_summary(spark, sf_dir):
    comp, _, _ = labelled(spark, sf_dir)
    return track.summary(track.min_pressure(comp))


@query(
    "track_points_nested",
    FULL + MIN_SQL + """ select model_name, init_time, component_id, time_step, node_id, lat, lon, mslp, vmax,
      row_number() over (partition by model_name, init_time, component_id order by time_step)-1 as point_index from low""",
)
def track_points_nested(spark, sf_dir):
    """The nested array, opened again by position so both engines compare rows."""
    comp, _, _ = labelled(spark, sf_dir)
    n = track.nested(track.min_pressure(comp))
    return n.select("model_name", "init_time", "component_id", F.posexplode("points").alias("point_index", "p")).select(
        "model_name", "init_time", "component_id", "point_index", "p.*"
    )


@query(
    "track_point_index",
    FULL + MIN_SQL + """ select node_id, model_name, init_time, component_id, row_number() over (partition by model_name, init_time, component_id order by time_step)-1
      as point_index from low""",
)
def track_point_index(spark, sf_dir):
    """Which track a point belongs to, and at which place."""
    comp, _, _ = labelled(spark, sf_dir)
    n = track.nested(track.min_pressure(comp))
    rows = n.select("model_name", "init_time", "component_id", F.posexplode("points").alias("point_index", "p"))
    return rows.select("p.node_id", "model_name", "init_time", "component_id", "point_index")


CLUSTERS = """, sreach as (select node_id as id, node_id as root from kept union
    select x.dst, r.root from sreach r join (select src, dst from same union select dst, src from same) x on x.src=r.id
    where x.dst in (select node_id from kept)),
  cl as (select id, min(root) as cluster from sreach group by 1),
  apart as (select model_name, init_time, component_id, time_step, count(distinct cluster)>1 as apart from comp join cl on id=node_id group by 1,2,3,4),
  seq as (select *, row_number() over (partition by model_name, init_time, component_id order by time_step) as i from apart),
  isl as (select *, i-row_number() over (partition by model_name, init_time, component_id order by time_step) as island from seq where apart)"""


@query(
    "disjoint_segments",
    PAIRS_FULL + CLUSTERS + """ select model_name, init_time, component_id, min(time_step) as first_step, max(time_step) as last_step, count(*) as n_steps
      from isl group by model_name, init_time, component_id, island having count(*)>=2""",
)
def disjoint_segments(spark, sf_dir):
    comp, same, _ = labelled(spark, sf_dir, "pair_points")
    comp = cut(comp)
    seg = track.disjoint_segments(comp, track.step_clusters(comp, same), 2)
    return seg.select("model_name", "init_time", "component_id", "first_step", "last_step", "n_steps")


# both directions of the links of one step, as the separation keeps them
START = """, n0 as materialized (select * from {nodes}), s0 as materialized (select src, dst from same where {kept} union select dst, src from same where {kept}),
  l0 as materialized (select src, dst from links where {kept})"""
KEPT = "src in (select node_id from kept) and dst in (select node_id from kept)"


@query(
    "reduce_same_step",
    PAIRS + SAME + NEXT + PERSIST + START.format(nodes="kept", kept=KEPT) + separation.reduction("0", "z")
    + " select node_id, model_name, init_time, time_step, mslp from nz",
)
def reduce_same_step(spark, sf_dir):
    kept, same, links = kept_graph(spark, sf_dir, "pair_points")
    nodes, _, _ = track.reduce_same_step(kept, same, links)
    return nodes.select("node_id", "model_name", "init_time", "time_step", "mslp")


SAME_TRACK = "s.model_name=c.model_name and s.init_time=c.init_time and s.component_id=c.component_id"


@query(
    "split_mergers",
    PAIRS_FULL + CLUSTERS + f""", seg as (select model_name, init_time, component_id, max(time_step) as last_step from isl
      group by model_name, init_time, component_id, island having count(*)>=2),
  until as (select model_name, init_time, component_id, max(time_step) as component_end from apart group by 1,2,3),
  tail as (select c.node_id, cl.cluster from comp c join seg s on {SAME_TRACK} and s.last_step=c.time_step
    join until u on u.model_name=c.model_name and u.init_time=c.init_time and u.component_id=c.component_id and c.time_step<u.component_end join cl on cl.id=c.node_id),
  succ as (select distinct t.cluster, l.dst as node_id from (select src, dst from links where {KEPT}) l join tail t on t.node_id=l.src),
  owned as (select node_id, min(cluster) as cluster from succ group by 1 having min(cluster)=max(cluster)),
  near as (select src, dst from same where {KEPT} union select dst, src from same where {KEPT})
  select distinct n.src, n.dst from near n join owned o on o.node_id=n.src
    where not exists (select 1 from succ x where x.cluster=o.cluster and x.node_id=n.dst)""",
)
def split_mergers(spark, sf_dir):
    comp, same, links = labelled(spark, sf_dir, "pair_points")
    return track.merger_cuts(cut(comp), track.both_ways(same), links, 2)


@query(
    "predecessor_fit",
    PAIRS + SAME + NEXT + f""", se as materialized (select src, dst from same union select dst, src from same),
      preach as (select dst as n, src as id, src as root from links union select r.n, se.dst, r.root from preach r join se on se.src=r.id
        join links l on l.dst=r.n and l.src=se.dst),
      pc as (select n, id, min(root) as part from preach group by 1,2),
      g as (select pc.*, abs(p.mslp-x.mslp) as dm, {hav('x.lat', 'x.lon', 'p.lat', 'p.lon')} as dd from pc join nodes x on x.node_id=pc.n join nodes p on p.node_id=pc.id),
      good as (select distinct n, part from g a where exists (select 1 from g o where o.n=a.n and o.part<>a.part)
        and not exists (select 1 from g b where b.n=a.n and b.part<>a.part and (b.dm<=a.dm or b.dd<=a.dd)))
      select g.id as src, g.n as dst from g join good on good.n=g.n and good.part<>g.part""",
)
def predecessor_fit(spark, sf_dir):
    nodes, same, links = graph(spark, sf_dir, "pair_points")
    return track.predecessor_cuts(nodes, same, links)


ROUNDS = 6  # in the SQL, which has no loop; it raises an error where they are not enough
AGAIN = """, fe as materialized (select src, dst from l union select dst, src from l union select src, dst from s union select dst, src from s),
  freach as (select node_id as id, node_id as root from n union select fe.dst, r.root from freach r join fe on fe.src=r.id),
  flab as (select id, min(root) as label from freach group by 1),
  fstart as (select model_name, init_time, label, min(time_step) as start from n join flab on id=node_id group by 1,2,3),
  fnum as (select *, row_number() over (partition by model_name, init_time order by start, label)-1 as component_id from fstart),
  fcomp as materialized (select k.* exclude (component_id), fnum.component_id from n k join flab on flab.id=k.node_id
    join fnum using (model_name, init_time, label))"""


@query(
    "simplify_tracks",
    PAIRS_FULL + START.format(nodes="comp", kept=KEPT) + separation.simplified(ROUNDS, track.MIN_SEGMENT) + AGAIN
    + MIN_SQL.replace("from comp)", "from fcomp)") + HEADERS,
)
def simplify_tracks(spark, sf_dir):
    """Headers of the tracks left after reduction, splitting and fitting."""
    comp, same, links = labelled(spark, sf_dir, "pair_points")
    nodes, same, links = track.simplify(comp, same, links)
    again = track.track_components(nodes.drop("label", "component_id"), same, links)
    return track.summary(track.min_pressure(again))


# first region of the layer that covers a point of ``at(id, lat, lon)``, by all edges of all rings
COAST = """, edge as materialized (select rank, region, lon as x1, lat as y1, coalesce(lead(lon) over w, first_value(lon) over w) as x2,
    coalesce(lead(lat) over w, first_value(lat) over w) as y2 from coast_corners window w as (partition by region order by corner)),
  covering as materialized (select a.id, e.rank, e.region from {at} a join edge e on a.lat between least(y1, y2) and greatest(y1, y2) and a.lon<=greatest(x1, x2)
    group by 1,2,3 having bool_or((x2-x1)*(a.lat-y1)=(a.lon-x1)*(y2-y1) and a.lon>=least(x1, x2)) or
      count(*) filter ((y1>a.lat)<>(y2>a.lat) and case when y2>y1 then (x2-x1)*(a.lat-y1)-(a.lon-x1)*(y2-y1)>0 else (x2-x1)*(a.lat-y1)-(a.lon-x1)*(y2-y1)<0 end)%2=1),
  first_region as (select id, min_by(region, rank) as region from covering group by 1)"""


def coast(spark, sf_dir):
    """The layer of regions as a tree of cells; rings may have millions of corners."""
    return cut(regions.leaves(regions.ring_edges(view(spark, sf_dir, "coast_corners"), ["region", "rank"], "corner")))


@query(
    "basin_point",
    with_views("track_points", "coast_corners") + COAST.format(at="(select event_id as id, lat, lon from track_points)")
    + f" select event_id, {basin_case('lat', 'lon')} as basin, region from track_points left join first_region on id=event_id",
)
def basin_point(spark, sf_dir):
    """The fixed basin, and the region of a layer."""
    points = view(spark, sf_dir, "track_points").select("event_id", "lat", "lon")
    found = regions.assign(points, coast(spark, sf_dir))
    return found.select("event_id", basin_of(F.col("lat"), F.col("lon")).alias("basin"), "region")
