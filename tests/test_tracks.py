"""Drawn cases and brute force for links and track separation."""

import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from galespark.operators import components, link, separate, track

T0 = datetime(2024, 1, 1)
SCHEMA = "event_id long, model_name string, init_time timestamp, time_step int, lat double, lon double, mslp double, vmax double"


def points(spark, rows):
    """(step, lat, lon[, mslp]) tuples of one run."""
    data = [
        (i, "GFS", T0, r[0], float(r[1]), float(r[2]), float(r[3] if len(r) > 3 else 1000 - i), 20.0) for i, r in enumerate(rows)
    ]
    return link.nodes(spark.createDataFrame(data, SCHEMA))


def ids(df, col="node_id"):
    return {r[0] for r in df.select(col).collect()}


def test_last_of_same_position_wins(spark):
    n = points(spark, [(0, 10, 20, 1000), (0, 10, 20, 990)])
    assert [(r.node_id, r.mslp) for r in n.collect()] == [(1, 990.0)]


def test_five_in_a_line_stay_four_go(spark):
    five = points(spark, [(6 * i, 10, 2 * i) for i in range(5)])
    assert len(ids(track.keep_persistent(five, link.next_step(five)))) == 5
    four = points(spark, [(6 * i, 10, 2 * i) for i in range(4)])
    assert ids(track.keep_persistent(four, link.next_step(four))) == set()


def test_dead_end_child_of_long_track_stays(spark):
    n = points(spark, [(6 * i, 10, 2 * i) for i in range(6)] + [(6, 12, 0)])
    assert 6 in ids(track.keep_persistent(n, link.next_step(n)))


def test_links_wrap_at_the_antimeridian_and_the_poles(spark):
    n = points(spark, [(0, 5, 179.5), (0, 5, -179.5), (6, 89, 0), (6, -89, 0), (12, 0, 0), (12, 5.5, 0)])
    assert {(r.src, r.dst) for r in link.same_step(n).collect()} == {(0, 1), (2, 3)}


def test_only_neighbouring_steps_six_hours_apart_link(spark):
    n = points(spark, [(s, 10, 10) for s in (0, 3, 6)])
    assert link.next_step(n).count() == 0


def test_longest_path_counts_links(spark):
    n = points(spark, [(6 * i, 10, 2 * i) for i in range(7)] + [(6, 12, 0)])
    got = {r.node_id: r.length for r in track.longest_path(link.next_step(n)).collect()}
    assert got[0] == 6 and got[5] == 1 and 6 not in got and 7 not in got


def test_components_do_not_depend_on_row_order(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    v = spark.range(60)
    parent = list(range(60))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    want = {i: find(i) for i in range(60)}
    for _ in range(2):
        rng.shuffle(edges)
        e = spark.createDataFrame(edges, "src long, dst long").filter("src <> dst")
        assert {r.id: r.label for r in track.components(v, e).collect()} == want


@pytest.mark.parametrize("one_task", [0, 40, 1 << 20])
def test_contraction_equals_one_task(spark, one_task):
    """Long rising chains, a star, loops and single vertices, with links repeated."""
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(300)] + [(500, 501 + i) for i in range(60)] + [(700, 700)]
    edges += [(rng.randrange(800, 900), rng.randrange(800, 900)) for _ in range(70)]
    edges += [(b, a) for a, b in edges[::3]]
    rng.shuffle(edges)
    label = list(range(900))
    for _ in range(900):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    e = spark.createDataFrame(edges, "src long, dst long").repartition(5)
    got = {r.id: r.label for r in components.components(spark.range(900), e, one_task).collect()}
    assert got == dict(enumerate(label))
    folded = components.forest(e.coalesce(1)).collect()
    assert len(folded) == sum(i != x for i, x in enumerate(label))  # a forest: vertices less components
    text = e.select(*(F.lpad(F.col(c).cast("string"), 4, "0").alias(c) for c in ("src", "dst")))
    named = components.components(spark.range(900).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("id")), text, one_task)
    assert {int(r.id): int(r.label) for r in named.collect()} == got


@pytest.mark.parametrize("one_task", [50, 1 << 20])
def test_a_run_with_a_third_of_all_rows(spark, one_task):
    """Many small runs and one large one, by run and by contraction."""
    nodes = spark.range(900).selectExpr(
        "id as node_id", "if(id < 300, 'big', concat('m', cast(id % 60 as string))) as model_name", "timestamp'2024-01-01' as init_time", "cast(id as int) as time_step"
    )
    links = nodes.alias("a").join(nodes.alias("b"), F.expr("a.model_name = b.model_name and (b.node_id - a.node_id = 3 or b.node_id - a.node_id = 120)"))
    links = links.selectExpr("a.model_name", "a.init_time", "a.node_id as src", "b.node_id as dst")
    outside = links.limit(3).selectExpr("model_name", "init_time", "src", "cast(5000 as bigint) as dst")  # leads nowhere
    want = {}
    for r in nodes.collect():
        if r.model_name == "big":
            want[r.node_id] = r.node_id % 3
        else:
            want[r.node_id] = min(i for i in range(300, 900) if i % 60 == r.node_id % 60 and (i - r.node_id) % 120 == 0)
    for closed, e in ((True, links), (False, links.unionByName(outside))):
        got = {r.id: r.label for r in track.components_of_runs(nodes, e.repartition(4), closed, one_task).collect()}
        assert got == want


# ---------------------------------------------------------------- brute force


def pieces(nodes, edges):
    """Connected groups of ``nodes`` over an undirected edge set."""
    nodes, out = set(nodes), []
    while nodes:
        todo, seen = [min(nodes)], set()
        while todo:
            a = todo.pop()
            if a in seen:
                continue
            seen.add(a)
            todo += [b for b in nodes if (a, b) in edges or (b, a) in edges]
        out.append(seen)
        nodes -= seen
    return out


def brute_reduce(step, mslp, same, links):
    """One node after another in order of time, straight from the rule."""
    alive = set(step)
    while True:
        changed = False
        for s in sorted(set(step.values())):
            for group in pieces([n for n in alive if step[n] == s], same):
                if len(group) == 1:
                    continue
                low = min(group, key=lambda n: (mslp[n], n))
                near = {a for a, b in links if b in group and a in alive} | {b for a, b in links if a in group and b in alive}
                if len(pieces(near | {low}, same | links)) == 1:
                    alive -= group - {low}
                    changed = True
        if not changed:
            return alive


def random_run(seed):
    rng = random.Random(seed)
    rows, seen = [], set()
    for s in range(6):
        for _ in range(rng.randrange(2, 6)):
            p = (s * 6, round(10 + rng.random() * 4, 1), round(10 + rng.random() * 12, 1))
            if p not in seen:
                seen.add(p)
                rows.append((*p, 990 + rng.randrange(30)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 5])
def test_reduction_equals_step_by_step_order(spark, seed):
    rows = random_run(seed)
    n = points(spark, rows)
    same, links = link.same_step(n), link.next_step(n)
    s_set = {(r.src, r.dst) for r in same.collect()}
    l_set = {(r.src, r.dst) for r in links.collect()}
    want = brute_reduce({i: r[0] for i, r in enumerate(rows)}, {i: r[3] for i, r in enumerate(rows)}, s_set, l_set)
    for one_task in [1 << 20, 0][: 2 if seed == 2 else 1]:
        left, s_left, l_left = track.reduce_same_step(n, same, links, one_task)
        assert ids(left) == want
        assert {(r.src, r.dst) for r in s_left.collect()} == {(a, b) for a, b in s_set if a in want and b in want}
        assert {(r.src, r.dst) for r in l_left.collect()} == {(a, b) for a, b in l_set if a in want and b in want}
    assert len(want) < len(rows)


def random_storms(seed, steps=16):
    """Two or three storms that come near each other and part again."""
    rng = random.Random(seed)
    rows, seen = [], set()
    lons = [0.0, 6.5, 13.0][: rng.choice([2, 3])]
    for s in range(steps):
        for i, lon in enumerate(lons):
            pull = rng.choice([0, 0, 0, 2.5]) * (1 if i == 0 else -1)
            for _ in range(rng.choice([1, 1, 2])):
                p = (6 * s, round(10 + rng.random(), 1), round(lon + pull + rng.random(), 1))
                if p not in seen and rng.random() < 0.95:
                    seen.add(p)
                    rows.append((*p, 980 + rng.randrange(40)))
    return rows


def brute_simplify(step, mslp, place, component, same, links, length):
    """The whole separation straight from its rules, on sets."""
    alive, same, links = set(step), {*same, *((b, a) for a, b in same)}, set(links)

    def clusters(s, members):
        return pieces([n for n in members if n in alive and step[n] == s], same)

    def stretches():
        for c in set(component.values()):
            mine = [n for n in alive if component[n] == c]
            order = sorted({step[n] for n in mine})
            flags = [len(clusters(s, mine)) > 1 for s in order] + [False]
            i = 0
            while i < len(order):
                j = i
                while flags[j]:
                    j += 1
                if j - i >= length:
                    yield mine, order[j - 1], j < len(order)
                i = max(j, i + 1)

    while True:
        before = (len(alive), len(same), len(links))
        live = brute_reduce({n: step[n] for n in alive}, mslp, same, links)
        alive &= live
        same = {(a, b) for a, b in same if a in alive and b in alive}
        links = {(a, b) for a, b in links if a in alive and b in alive}
        while True:
            follow = []
            for mine, last, more in stretches():
                if more:
                    follow += [{b for a, b in links if a in g} for g in clusters(last, mine)]
            cut = set()
            for x in alive:
                own = [f for f in follow if x in f]
                if len(own) == 1:
                    cut |= {(a, b) for a, b in same if a == x and b not in own[0]}
            if cut:
                same -= cut
                continue
            drop = set()
            if any(True for _ in stretches()):
                for x in alive:
                    groups = pieces({a for a, b in links if b == x}, same)
                    for g in groups:
                        rest = set().union(*groups) - g
                        closer = lambda n: all(
                            abs(mslp[n] - mslp[x]) < abs(mslp[o] - mslp[x]) and far(place[n], place[x]) < far(place[o], place[x]) for o in rest
                        )
                        if rest and any(closer(n) for n in g):
                            drop |= {(o, x) for o in rest}
            if not drop:
                break
            links -= drop
        if (len(alive), len(same), len(links)) == before:
            return alive, same, links


def far(a, b):
    (la, lo), (lb, lob) = ([math.radians(c) for c in p] for p in (a, b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lob - lo) / 2) ** 2
    return math.asin(math.sqrt(h))


def test_separation_equals_its_rules(spark):
    cuts = 0
    for seed in range(60):
        rows = random_storms(seed)
        step = {i: r[0] for i, r in enumerate(rows)}
        lat, lon = [r[1] for r in rows], [r[2] for r in rows]
        near = lambda i, j, r: abs(lat[i] - lat[j]) <= r and abs(lon[i] - lon[j]) <= r  # noqa: E731, B023
        same = {(i, j) for i in step for j in step if i < j and step[i] == step[j] and near(i, j, 5)}
        links = {(i, j) for i in step for j in step if step[j] == step[i] + 6 and near(i, j, 3)}
        component = {}
        for k, group in enumerate(pieces(step, same | links)):
            component |= dict.fromkeys(group, k)
        mslp, place = [r[3] for r in rows], [(r[1], r[2]) for r in rows]
        run = separate.Run([step[i] for i in range(len(rows))], mslp, [*same, *((b, a) for a, b in same)], links, place, [component[i] for i in range(len(rows))])
        run.simplify(3)
        alive, s_left, l_left = brute_simplify(step, mslp, place, component, same, links, 3)
        assert {i for i, a in enumerate(run.alive) if a} == alive
        assert {(a, b) for a, near_ in enumerate(run.out) for b in near_} == s_left
        assert {(a, b) for a, near_ in enumerate(run.after) for b in near_} == l_left
        cuts += len(l_left) < len([e for e in links if e[0] in alive and e[1] in alive])
    assert cuts >= 3  # the cases are not idle


@pytest.mark.parametrize("seed", [4])
def test_separation_by_run_equals_the_wide_form(spark, seed):
    rows = random_storms(seed, 7)
    comp, same, links = labelled(spark, rows)
    by = []
    for one_task in (0, 1 << 20):
        nodes, s, l_ = track.simplify(comp, same, links, 3, one_task)
        by.append((ids(nodes), {(r.src, r.dst) for r in s.collect()}, {(r.src, r.dst) for r in l_.collect()}))
    assert by[0] == by[1]


def two_storms(merge_at=6, steps=9):
    """Two tracks 6 degrees apart that one point between them ties together."""
    rows = []
    for s in range(steps):
        if s < merge_at:
            rows += [(6 * s, 10, 0, 1000), (6 * s, 10, 6, 995)]
        else:
            rows += [(6 * s, 10, 3, 990)]
    return rows


def labelled(spark, rows):
    n = points(spark, rows)
    same, links = link.same_step(n), link.next_step(n)
    return track.track_components(n, same, links), same, links


def test_disjoint_stretch_of_two_storms(spark):
    comp, same, _ = labelled(spark, two_storms())
    seg = track.disjoint_segments(comp, track.step_clusters(comp, same)).collect()
    assert [(r.first_step, r.last_step, r.n_steps) for r in seg] == [(0, 30, 6)]
    short, same, _ = labelled(spark, two_storms(merge_at=4))
    assert track.disjoint_segments(short, track.step_clusters(short, same)).count() == 0


def test_better_predecessor_keeps_its_link(spark):
    # the merged point (3 degrees from both) is nearer in pressure and place to the second storm
    rows = [r if r[0] < 36 else (r[0], 10, 3.5, 994) for r in two_storms()]
    rows = [(s, la, lo if lo != 0 else 0.5, p) for s, la, lo, p in rows]
    n = points(spark, rows)
    cuts = {(r.src, r.dst) for r in track.predecessor_cuts(n, link.same_step(n), link.next_step(n)).collect()}
    assert cuts == {(10, 12)}


def test_simplify_separates_a_merger(spark):
    rows = [r if r[0] < 36 else (r[0], 10, 3.5, 994) for r in two_storms()]
    rows = [(s, la, lo if lo != 0 else 0.5, p) for s, la, lo, p in rows]
    comp, same, links = labelled(spark, rows)
    assert comp.select("component_id").distinct().count() == 1
    nodes, same, links = track.simplify(comp, same, links)
    again = track.track_components(nodes.drop("label", "component_id"), same, links)
    heads = track.summary(track.min_pressure(again)).orderBy("component_id").collect()
    assert sorted((h.start_time_step, h.last_time_step, h.n_points) for h in heads) == [(0, 30, 6), (0, 48, 9)]


def test_bridge_between_groups_is_cut(spark):
    """After a long stretch apart both storms go on within link distance of
    each other; the same-step links that join them are bridges."""
    rows = [(6 * s, 10, lon, 1000) for s in range(6) for lon in (0, 6)] + [(36, 10, 1), (36, 10, 5.5)]
    # one middle point before the stretch makes them a single component
    comp, same, links = labelled(spark, rows)
    assert comp.select("component_id").distinct().count() == 1
    cuts = {(r.src, r.dst) for r in track.merger_cuts(comp, track.both_ways(same), links).collect()}
    assert cuts == {(12, 13), (13, 12)}


def test_summary_of_a_track(spark):
    comp, _, _ = labelled(spark, [(6 * i, 10, -60 + 2 * i, 1000 - i) for i in range(5)])
    h = track.summary(track.min_pressure(comp)).first()
    assert (h.start_basin, h.start_time_step, h.last_time_step, h.n_points, h.min_mslp) == ("AL", 0, 24, 5, 996.0)
    pts = track.nested(track.min_pressure(comp)).select(F.col("points.time_step").alias("s")).first().s
    assert pts == [0, 6, 12, 18, 24]


@pytest.mark.parametrize("radius", [1.0, 3.0, 5.0])
def test_box_meets_four_cells_at_most(spark, radius):
    """At the borders of cells, the poles and the antimeridian, against every pair."""
    n_lat, n_lon = int(180 // (2 * radius)), int(360 // (2 * radius))
    lats = [-90.0, 90.0, 0.0, -radius, radius, 180 / n_lat - 90, 360 / n_lat - 90, 90 - radius]
    lons = [-180.0, 180.0, 179.5, -180 + radius, 360 / n_lon - 180, 720 / n_lon - 180, 0.1, 0.1 + radius]
    points = [(i, "M", lat, lon) for i, (lat, lon) in enumerate((a, o) for a in lats for o in lons)]
    nodes = spark.createDataFrame(points, "node_id long, model_name string, lat double, lon double")
    gap = lambda a, b, turn: min(abs(a - b), abs(abs(a - b) - turn))
    want = {(i, j) for i, _, a, o in points for j, _, b, p in points if gap(a, b, 180.0) <= radius and gap(o, p, 360.0) <= radius}
    got = [(r.src, r.dst) for r in link.box_join(nodes, nodes, ["model_name"], radius).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    _, cells = link._cells(F.col("lat"), 90.0, 180.0, radius)
    assert nodes.select(F.max(F.size(cells))).first()[0] <= 2
