"""Tracks: persistence, components, simplification, headers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galespark.functions import geo
from galespark.operators import separate
from galespark.operators.components import ONE_TASK, components, distinct, forest, least_of_each, places
from galespark.operators.link import RUN
from galespark.session import broadcast_if_small, cut
from galespark.sources.dims import basin_of

MIN_LINKS = 4
MIN_SEGMENT = 5
LARGE_RUNS = 100_000  # keys of runs too large for one task that may be broadcast


# ---------------------------------------------------------------- persistence


def persistent(links: DataFrame, min_links: int = MIN_LINKS) -> DataFrame:
    """Ids of nodes that start a path of ``min_links`` forward links, or have an
    ancestor that does.

    No closure is needed. A node with a chain of ``min_links`` links behind it
    descends from the node at the start of that chain, which qualifies by the
    chain itself; so an ancestor further back than ``min_links`` links adds
    nothing, and as many hops forward reach every descendant that counts."""
    links = links.select("src", "dst")
    starts = links.select(F.col("src").alias("id")).distinct()
    for _ in range(min_links - 1):
        starts = links.join(starts, F.col("dst") == F.col("id"), "left_semi").select(F.col("src").alias("id")).distinct()
    # the hops below read the starts again and again
    starts = cut(starts)
    kept = starts
    for _ in range(min_links):
        children = links.join(kept, F.col("src") == F.col("id"), "left_semi").select(F.col("dst").alias("id"))
        kept = starts.unionByName(children).distinct()
    return kept


def keep_persistent(nodes: DataFrame, links: DataFrame, min_links: int = MIN_LINKS) -> DataFrame:
    ids = persistent(links, min_links).withColumnRenamed("id", "node_id")
    return nodes.join(ids, "node_id", "left_semi")


def longest_path(links: DataFrame, per_round: int = 4) -> DataFrame:
    """Length of the longest forward path from each node that has a link.

    Round k keeps the nodes that start a path of k links, so the work shrinks
    with k and ends at the longest track; a few rounds share one job."""
    links = cut(links.select("src", "dst"))
    level = links.select(F.col("src").alias("id")).distinct()
    out, k = None, 1
    while True:
        block = None
        for _ in range(per_round):
            part = level.withColumn("length", F.lit(k))
            block = part if block is None else block.unionByName(part)
            level = links.join(level, F.col("dst") == F.col("id"), "left_semi").select(F.col("src").alias("id")).distinct()
            k += 1
        block = cut(block)
        out = block if out is None else out.unionByName(block)
        level = block.filter(F.col("length") == k - 1).select("id")
        if level.isEmpty():
            return out.groupBy(F.col("id").alias("node_id")).agg(F.max("length").alias("length"))
        level = links.join(level, F.col("dst") == F.col("id"), "left_semi").select(F.col("src").alias("id")).distinct()


# ---------------------------------------------------------------- components


def _labels_of_run(key: tuple, ids: pa.Table, links: pa.Table) -> pa.Table:
    """Smallest reachable id of each vertex; links to other vertices do not count."""
    values = distinct(ids["id"])
    a, b = places(values, links["src"]), places(values, links["dst"])
    inside = (a >= 0) & (b >= 0)
    label = values.take(pa.array(least_of_each(len(values), a[inside], b[inside])[places(values, ids["id"])]))
    return pa.table({"id": ids["id"], "label": label})


def components_of_runs(nodes: DataFrame, edges: DataFrame, closed: bool = False, one_task: int = ONE_TASK) -> DataFrame:
    """(id, label) like :func:`components` where no link leaves a run.

    One shuffle by run brings its links together. With ``closed`` links, whose
    ends are all among the nodes, map tasks first fold theirs to spanning
    forests. Runs of more than ``one_task`` links (counted) go through the
    contraction instead."""
    kind = nodes.schema["node_id"].dataType.simpleString()
    ids = nodes.select(*RUN, F.col("node_id").alias("id")).distinct()
    links = edges.select(*(F.col(c).alias(c) for c in (*RUN, "src", "dst")))  # columns of its own, whatever it came from
    large = links.groupBy(*RUN).count().filter(F.col("count") > one_task).select(*RUN)
    wide = None
    if not large.isEmpty():
        large = broadcast_if_small(cut(large), LARGE_RUNS)
        own = ids.join(large, RUN, "left_semi")
        ends = own.select("id")
        inside = links.join(large, RUN, "left_semi").join(ends, F.col("src") == F.col("id"), "left_semi")
        wide = components(ends, inside.join(ends, F.col("dst") == F.col("id"), "left_semi"), one_task)
        ids, links = ids.join(large, RUN, "left_anti"), links.join(large, RUN, "left_anti")
    out = ids.groupBy(*RUN).cogroup((forest(links) if closed else links).groupBy(*RUN)).applyInArrow(_labels_of_run, f"id {kind}, label {kind}")
    return out if wide is None else out.unionByName(wide)


def track_components(nodes: DataFrame, *edges: DataFrame, closed: bool = False) -> DataFrame:
    """Nodes with the component they belong to, numbered within the run by
    earliest step; equal starts go by smallest node id. ``closed`` says that
    links have both ends among the nodes."""
    per_run = all({*RUN} <= {*e.columns} for e in edges)
    columns = [*RUN, "src", "dst"] if per_run else ["src", "dst"]
    linked = edges[0].select(*columns)
    for e in edges[1:]:
        linked = linked.unionByName(e.select(*columns))
    if per_run:
        labels = components_of_runs(nodes, linked, closed)
    else:
        labels = components(nodes.select(F.col("node_id").alias("id")), linked)
    labelled = nodes.join(labels.withColumnRenamed("id", "node_id"), "node_id")
    starts = labelled.groupBy(*RUN, "label").agg(F.min("time_step").alias("start"))
    number = F.row_number().over(Window.partitionBy(*RUN).orderBy("start", "label")) - 1
    numbered = starts.select(*RUN, "label", number.alias("component_id"))
    return labelled.join(numbered, [*RUN, "label"])


def induced(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends among the kept nodes."""
    ids = kept.select(F.col("node_id").alias("k"))
    return edges.join(ids, F.col("src") == F.col("k"), "left_semi").join(ids, F.col("dst") == F.col("k"), "left_semi")


# ---------------------------------------------------------------- track shape


def min_pressure(labelled: DataFrame) -> DataFrame:
    """Per component and step the node of lowest pressure, one row each."""
    rest = [c for c in labelled.columns if c not in {*RUN, "component_id", "time_step", "mslp", "node_id"}]
    best = F.min(F.struct("mslp", "node_id", *rest)).alias("r")
    return labelled.groupBy(*RUN, "component_id", "time_step").agg(best).select(*RUN, "component_id", "time_step", "r.*")


def summary(track: DataFrame) -> DataFrame:
    """Header of each track: first and last point, start basin, strongest wind."""
    first = F.min_by(F.struct("time_step", "lat", "lon"), "time_step").alias("a")
    last = F.max_by(F.struct("time_step", "lat", "lon"), "time_step").alias("b")
    out = track.groupBy(*RUN, "component_id").agg(
        first, last, F.max("vmax").alias("ws_max_10m"), F.count(F.lit(1)).alias("n_points"), F.min("mslp").alias("min_mslp")
    )
    return out.select(
        *RUN, "component_id",
        F.col("a.time_step").alias("start_time_step"),
        F.timestamp_add("HOUR", F.col("a.time_step"), F.col("init_time")).alias("start_valid_time"),
        basin_of(F.col("a.lat"), F.col("a.lon")).alias("start_basin"),
        F.col("a.lat").alias("start_lat"), F.col("a.lon").alias("start_lon"),
        F.col("b.time_step").alias("last_time_step"), F.col("b.lat").alias("last_lat"), F.col("b.lon").alias("last_lon"),
        "ws_max_10m", "min_mslp", "n_points",
    )


def nested(track: DataFrame) -> DataFrame:
    """Ordered points array. A track holds one point per step of its run, so
    the array is as long as the forecast at most."""
    point = F.struct("time_step", "node_id", "lat", "lon", "mslp", "vmax")
    return track.groupBy(*RUN, "component_id").agg(F.sort_array(F.collect_list(point)).alias("points"))


# ---------------------------------------------------------------- separation


def step_clusters(labelled: DataFrame, same: DataFrame) -> DataFrame:
    """(node_id, cluster): groups joined by links of one step."""
    if not {*RUN} <= {*same.columns}:
        runs = labelled.select(*(F.col(c).alias(c) for c in RUN), F.col("node_id").alias("src"))
        same = same.select(F.col("src").alias("src"), "dst").join(runs, "src")
    labels = components_of_runs(labelled, same)
    return labels.select(F.col("id").alias("node_id"), F.col("label").alias("cluster"))


def disjoint_segments(labelled: DataFrame, clusters: DataFrame, min_length: int = MIN_SEGMENT) -> DataFrame:
    """Stretches of consecutive steps at which a component falls apart into
    several same-step groups. Windows run over one row per component and step."""
    key = [*RUN, "component_id"]
    steps = labelled.join(clusters, "node_id").groupBy(*key, "time_step").agg(
        (F.min("cluster") != F.max("cluster")).alias("apart")
    )
    w = Window.partitionBy(*key).orderBy("time_step")
    ranked = steps.withColumns(
        {"i": F.row_number().over(w), "last": F.max("time_step").over(Window.partitionBy(*key))}
    ).filter("apart")
    island = F.col("i") - F.row_number().over(w)
    return (
        ranked.withColumn("island", island)
        .groupBy(*key, "island")
        .agg(
            F.min("time_step").alias("first_step"), F.max("time_step").alias("last_step"),
            F.count(F.lit(1)).alias("n_steps"), F.first("last").alias("component_end"),
        )
        .filter(F.col("n_steps") >= min_length)
        .drop("island")
    )


def both_ways(same: DataFrame) -> DataFrame:
    """Same-step links as two directed edges each."""
    return same.select("src", "dst").unionByName(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def _spread(members: DataFrame, local: DataFrame) -> DataFrame:
    key = ["owner", "side"]
    reached = (
        local.join(members.filter("hit").select(*key, F.col("id").alias("src")), [*key, "src"], "left_semi")
        .select(*key, F.col("dst").alias("id")).distinct().withColumn("new", F.lit(True))
    )
    return members.join(reached, [*key, "id"], "left").select(
        *key, "id", F.col("hit").alias("old"), (F.col("hit") | F.coalesce("new", F.lit(False))).alias("hit")
    )


def _reach(members: DataFrame, local: DataFrame, per_round: int = 1) -> DataFrame:
    """Spread the ``hit`` flag over local edges until nothing changes.

    ``members``: (owner, side, id, hit); ``local``: (owner, side, src, dst).
    The last hop of a job tells whether another job is due."""
    while True:
        for _ in range(per_round):
            nxt = _spread(members, local)
            members = nxt.drop("old")
        nxt = cut(nxt)
        members = nxt.drop("old")
        if nxt.filter(F.col("hit") & ~F.col("old")).isEmpty():
            return members


def _reducible(waiting: DataFrame, around: DataFrame, local: DataFrame) -> DataFrame:
    """Owners whose lowest node alone keeps all neighbours in one piece: each
    neighbour is linked to it, or hangs on one that is."""
    key = ["owner", "side"]
    members = around.join(waiting, "owner", "left_semi")
    present = members.select(*key, "id")
    edges = local.join(waiting, "owner", "left_semi")
    edges = edges.join(present.withColumnRenamed("id", "src"), [*key, "src"], "left_semi").join(
        present.withColumnRenamed("id", "dst"), [*key, "dst"], "left_semi"
    )
    loose = _reach(members, edges).filter(~F.col("hit")).select("owner").distinct()
    return waiting.join(loose, "owner", "left_anti")


def _reduce_pass(nodes: DataFrame, same: DataFrame, links: DataFrame) -> DataFrame | None:
    """Ids of nodes removed by one pass over the steps in order of time.

    Whether a group falls depends on what the pass has left of the step before
    and on the untouched step after. All groups decide at once and decide
    again with the outcome of the groups before them until no decision
    changes. Decisions only look back in time, so this rests at the one
    outcome of a pass step by step, mostly within a few rounds."""
    clusters = cut(
        nodes.select("node_id", "mslp").join(step_clusters(nodes, same), "node_id")
    )
    size = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("mslp", "node_id")).alias("low"))
    multi = cut(size.filter("n > 1").select(F.col("cluster").alias("owner"), F.col("low.node_id").alias("low")))
    if multi.isEmpty():
        return None
    inside = cut(clusters.join(multi, clusters.cluster == multi.owner).select("node_id", "owner", "low"))

    def side(edges, here, there, name):
        e = edges.select(F.col(here).alias("node_id"), F.col(there).alias("id"))
        return inside.join(e, "node_id").groupBy("owner", "id").agg(
            F.max(F.col("node_id") == F.col("low")).alias("hit")
        ).select("owner", F.lit(name).alias("side"), "id", "hit")

    around = cut(side(links, "dst", "src", "before").unionByName(side(links, "src", "dst", "after")))
    ends = around.select("owner", "side", "id")
    local = cut(
        both_ways(same).distinct()
        .join(ends.withColumnRenamed("id", "src"), "src")
        .join(ends.withColumnRenamed("id", "dst"), ["owner", "side", "dst"], "left_semi")
        .select("owner", "side", "src", "dst")
    )
    owners = multi.select("owner")
    fit, gone = owners.limit(0), None
    while True:
        left = around
        if gone is not None:
            left = around.join(gone.select(F.col("node_id").alias("id"), F.lit("before").alias("side")), ["id", "side"], "left_anti")
        again = cut(_reducible(owners, left, local))
        changed = again.join(fit, "owner", "left_anti").unionByName(fit.join(again, "owner", "left_anti"))
        if changed.isEmpty():
            return gone if gone is not None else inside.select("node_id").limit(0)
        fit = again
        gone = cut(inside.join(fit, "owner", "left_semi").filter("node_id <> low").select("node_id"))


def without(nodes: DataFrame, same: DataFrame, links: DataFrame, gone: DataFrame):
    """Graph less some nodes."""
    ids = gone.withColumnRenamed("node_id", "gone_id")
    nodes = cut(nodes.join(gone, "node_id", "left_anti"))
    cutoff = lambda e: cut(
        e.join(ids, F.col("src") == F.col("gone_id"), "left_anti").join(ids, F.col("dst") == F.col("gone_id"), "left_anti")
    )
    return nodes, cutoff(same), cutoff(links)


def _by_run(nodes: DataFrame, same: DataFrame, links: DataFrame, work, one_task: int):
    """Nodes and links of runs that one task may hold, after ``work``, and what
    belongs to larger runs (None where there are none), by counts of rows."""
    kind = nodes.schema["node_id"].dataType.simpleString()
    point = ["time_step", "lat", "lon", "mslp"]
    component = F.col("component_id") if "component_id" in nodes.columns else F.lit(0)
    rows = nodes.select(*RUN, F.lit(separate.NODE).alias("kind"), F.col("node_id").alias("a"), F.col("node_id").alias("b"), *point, component.cast("bigint").alias("component_id"))
    runs = nodes.select(*RUN, F.col("node_id").alias("src"))
    for k, edges in ((separate.SAME, same), (separate.LINK, links)):
        if not {*RUN} <= {*edges.columns}:
            edges = edges.select("src", "dst").join(runs, "src")
        rows = rows.unionByName(edges.select(*RUN, F.lit(k).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")), allowMissingColumns=True)
    large = rows.groupBy(*RUN).count().filter(F.col("count") > one_task).select(*RUN)
    rest = None
    if not large.isEmpty():
        large = broadcast_if_small(cut(large), LARGE_RUNS)
        whole = cut(rows.join(large, RUN, "left_semi"))
        edges = lambda k: whole.filter(F.col("kind") == k).select(F.col("a").alias("src"), F.col("b").alias("dst"))
        rest = cut(nodes.join(large, RUN, "left_semi")), edges(separate.SAME), edges(separate.LINK)
        rows = rows.join(large, RUN, "left_anti")
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.select(*RUN).schema)
    done = cut(rows.groupBy(*RUN).applyInArrow(work, f"{types}, kind int, a {kind}, b {kind}"))
    left = lambda k: done.filter(F.col("kind") == k).select(*RUN, F.col("a").alias("src"), F.col("b").alias("dst"))
    stay = done.filter(F.col("kind") == separate.NODE).select(F.col("a").alias("node_id"))
    return (nodes.join(stay, "node_id", "left_semi"), left(separate.SAME), left(separate.LINK)), rest


def _with_runs(nodes: DataFrame, same: DataFrame, links: DataFrame):
    runs = nodes.select(*RUN, F.col("node_id").alias("src"))
    return nodes, *(e.select("src", "dst").join(runs, "src").select(*RUN, "src", "dst") for e in (same, links))


def _both(small, wide):
    return small if wide is None else tuple(a.unionByName(b) for a, b in zip(small, _with_runs(*wide)))


def reduce_same_step(nodes: DataFrame, same: DataFrame, links: DataFrame, one_task: int = ONE_TASK):
    """Keep only the lowest node of a same-step group wherever that leaves its
    neighbours connected; passes repeat until nothing is removed.

    A run is one group, with a worklist over its steps; runs of more than
    ``one_task`` nodes and links together go by :func:`reduce_wide`."""
    small, rest = _by_run(nodes, same, links, separate.reducer(RUN), one_task)
    return _both(small, None if rest is None else reduce_wide(*rest))


def simplify(labelled: DataFrame, same: DataFrame, links: DataFrame, min_length: int = MIN_SEGMENT, one_task: int = ONE_TASK):
    """Reduce, split mergers and fit predecessors until the graph rests; links
    come back directed. Runs of more than ``one_task`` nodes and links together
    go by :func:`simplify_wide`."""
    columns = [*RUN, "src", "dst"] if {*RUN} <= {*same.columns} else ["src", "dst"]
    turned = same.withColumns({"src": F.col("dst"), "dst": F.col("src")})
    directed = same.select(*columns).unionByName(turned.select(*columns))
    small, rest = _by_run(labelled, directed, links, separate.simplifier(RUN, min_length), one_task)
    return _both(small, None if rest is None else simplify_wide(*rest, min_length))


def reduce_wide(nodes: DataFrame, same: DataFrame, links: DataFrame):
    """:func:`reduce_same_step` for runs of any size: all groups decide at once."""
    while True:
        gone = _reduce_pass(nodes, same, links)
        if gone is None or gone.isEmpty():
            return nodes, same, links
        nodes, same, links = without(nodes, same, links, gone)


def merger_cuts(
    labelled: DataFrame, same_directed: DataFrame, links: DataFrame, min_length: int = MIN_SEGMENT, clusters: DataFrame | None = None
) -> DataFrame:
    """Directed same-step links to drop where a long disjoint stretch merges.

    At the last step of the stretch, a successor all of whose predecessors lie
    in one group belongs to that group; its links to nodes that are no
    successors of the group are bridges."""
    if clusters is None:
        clusters = step_clusters(labelled, same_directed)
    segments = disjoint_segments(labelled, clusters, min_length).filter(F.col("last_step") < F.col("component_end"))
    ends = segments.select(*RUN, "component_id", F.col("last_step").alias("time_step")).distinct()
    at_end = labelled.join(ends, [*RUN, "component_id", "time_step"], "left_semi").select("node_id")
    tail = at_end.join(clusters, "node_id")
    succ = cut(
        links.select("src", "dst").join(tail.select(F.col("node_id").alias("src"), "cluster"), "src")
        .select("cluster", F.col("dst").alias("node_id")).distinct()
    )
    owned = succ.groupBy("node_id").agg(F.min("cluster").alias("cluster"), F.max("cluster").alias("other"))
    owned = owned.filter(F.col("cluster") == F.col("other")).select(F.col("node_id").alias("src"), "cluster")
    out = same_directed.select("src", "dst").join(owned, "src")
    return out.join(succ.withColumnRenamed("node_id", "dst"), ["cluster", "dst"], "left_anti").select("src", "dst").distinct()


def predecessor_groups(same: DataFrame, links: DataFrame) -> DataFrame:
    """(dst, src, part) for nodes whose predecessors form several groups.

    Groups count only links among the predecessors themselves, so they are
    components of pairs (node, predecessor)."""
    e = links.select("src", "dst").distinct()
    many = e.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("dst")
    e = cut(e.join(many, "dst", "left_semi"))
    pair = lambda p: F.concat_ws("|", "dst", p)
    other = e.select("dst", F.col("src").alias("peer"))
    near = (
        e.join(both_ways(same).distinct().select("src", F.col("dst").alias("peer")), "src")
        .join(other, ["dst", "peer"], "left_semi")
        .select(pair("src").alias("src"), pair("peer").alias("dst"))
    )
    pairs = e.select(pair("src").alias("id"), "dst", "src")
    parts = pairs.join(components(pairs.select("id"), near), "id").select("dst", "src", F.col("label").alias("part"))
    apart = parts.groupBy("dst").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a <> b").select("dst")
    return parts.join(apart, "dst", "left_semi")


def predecessor_cuts(nodes: DataFrame, same: DataFrame, links: DataFrame) -> DataFrame:
    """Links to drop from nodes with several groups of predecessors.

    A group is kept if one of its members is closer in pressure and in
    distance than every node of the other groups. Only the group holding the
    smallest pressure gap can be that one, so per-group minima decide and no
    pairs of predecessors are formed."""
    groups = predecessor_groups(same, links)
    here = nodes.select(F.col("node_id").alias("dst"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.col("mslp").alias("mslp2"))
    there = nodes.select(F.col("node_id").alias("src"), "lat", "lon", "mslp")
    gaps = groups.join(here, "dst").join(there, "src").select(
        "dst", "src", "part", F.abs(F.col("mslp") - F.col("mslp2")).alias("dm"),
        geo.distance_m(F.col("lat2"), F.col("lon2"), F.col("lat"), F.col("lon")).alias("dd"),
    )
    gaps = cut(gaps)
    per_part = gaps.groupBy("dst", "part").agg(F.min("dm").alias("dm"), F.min("dd").alias("dd"))
    best = per_part.groupBy("dst").agg(F.min(F.struct("dm", "part")).alias("b")).select("dst", F.col("b.part").alias("best"))
    rivals = (
        per_part.join(best, "dst").filter(F.col("part") != F.col("best"))
        .groupBy("dst", "best").agg(F.min("dm").alias("rival_dm"), F.min("dd").alias("rival_dd"))
    )
    fits = (
        gaps.join(rivals, (gaps.dst == rivals.dst) & (gaps.part == rivals.best), "left_semi")
        .join(rivals, "dst").filter((F.col("dm") < F.col("rival_dm")) & (F.col("dd") < F.col("rival_dd")))
        .select("dst", "best").distinct()
    )
    return gaps.join(fits, "dst").filter(F.col("part") != F.col("best")).select("src", "dst")


def simplify_wide(labelled: DataFrame, same: DataFrame, links: DataFrame, min_length: int = MIN_SEGMENT):
    """:func:`simplify` for runs of any size.

    All components advance together; predecessors of a run are fitted once
    none of its stretches can be split further."""
    keep = [c for c in labelled.columns]
    nodes, links = cut(labelled), cut(links.select("src", "dst"))
    directed = cut(both_ways(same).distinct())
    while True:
        before = nodes.count()
        nodes, directed, links = reduce_wide(nodes, directed, links)
        changed = nodes.count() < before
        while True:
            clusters = step_clusters(nodes, directed)
            bridges = cut(merger_cuts(nodes, directed, links, min_length, clusters))
            if not bridges.isEmpty():
                directed = cut(directed.join(bridges, ["src", "dst"], "left_anti"))
                changed = True
                continue
            segments = disjoint_segments(nodes, clusters, min_length)
            runs = cut(segments.select(*RUN).distinct())
            if runs.isEmpty():
                break
            part = nodes.join(runs, RUN, "left_semi")
            drop = cut(predecessor_cuts(part, directed, induced(links, part)))
            if drop.isEmpty():
                break
            links = cut(links.join(drop, ["src", "dst"], "left_anti"))
            changed = True
        if not changed:
            return nodes.select(*keep), directed, links
