"""SQL of the separation of tracks: one set of common table expressions per round.

Every round is the text of a few tables named by its number, over the nodes
``n``, directed links of one step ``s`` and links to the next step ``l`` that
the round before has left.
"""

from __future__ import annotations

from galespark.plans.base import hav

RUN = "model_name, init_time"


def groups(t: str) -> str:
    """Groups joined by links of one step: (id, cluster)."""
    return f""", u{t} as materialized (select src, dst from s{t} union select dst, src from s{t}),
  cr{t} as (select node_id as id, node_id as root from n{t} union select u.dst, r.root from cr{t} r join u{t} u on u.src=r.id),
  c{t} as materialized (select id, min(root) as cluster from cr{t} group by 1)"""


def reduction(t: str, out: str, only: str = "") -> str:
    """Passes over the steps in order of time until one changes nothing.

    A group stays whole or shrinks to its lowest node, so what a neighbouring
    group leaves is one of two things, and the condition is a table for both:
    ``whole`` and ``lone``. The recursion then takes one step of time per round
    over the states of all groups. ``only`` names runs to work on."""
    runs = f"where ({RUN}) in (select {RUN} from {only})" if only else ""
    return groups(t) + f""",
  g{t} as materialized (select cluster as g, count(*) as n, any_value(time_step)//6 as i, min_by(node_id, {{'m': mslp, 'id': node_id}}) as low
    from n{t} join c{t} on id=node_id {runs} group by 1),
  near{t} as materialized (select a.g, y, h, bool_or(x=low) as hit from (
      select cx.cluster as g, l.src as x, l.dst as y, cy.cluster as h from l{t} l join c{t} cx on cx.id=l.src join c{t} cy on cy.id=l.dst
      union all select cy.cluster, l.dst, l.src, cx.cluster from l{t} l join c{t} cx on cx.id=l.src join c{t} cy on cy.id=l.dst) a
    join g{t} b on b.g=a.g where n>1 group by a.g, y, h),
  nr{t} as (select g, y from near{t} where hit union select r.g, u.dst from nr{t} r join u{t} u on u.src=r.y join near{t} k on k.g=r.g and k.y=u.dst),
  pr{t} as materialized (select k.g, k.h, bool_and(r.y is not null) as whole, bool_and(k.y<>o.low or k.hit) as lone
    from near{t} k left join nr{t} r on r.g=k.g and r.y=k.y join (select cluster, min_by(node_id, {{'m': mslp, 'id': node_id}}) as low
      from n{t} join c{t} on id=node_id group by 1) o on o.cluster=k.h group by 1,2),
  st{t} as (select -1 as tick, -1 as changed, g, false as gone from g{t} where n>1
    union all select tick+1, max(case when now and not gone then tick+1 else changed end) over (), g, now from (
      select s.tick, s.changed, s.g, s.gone, s.gone or (b.i=(s.tick+1)%24 and coalesce(f.ok, true)) as now
      from st{t} s join g{t} b on b.g=s.g left join (select p.g, bool_and(case when coalesce(o.gone, false) then p.lone else p.whole end) as ok
        from pr{t} p left join st{t} o on o.g=p.h group by 1) f on f.g=s.g where s.tick-s.changed<24) x),
  gone{t} as materialized (select g from st{t} where gone group by 1),
  n{out} as materialized (select n{t}.* from n{t} join c{t} on id=node_id left join gone{t} z on z.g=cluster left join g{t} b on b.g=z.g
    where z.g is null or node_id=b.low),
  s{out} as materialized (select * from s{t} where src in (select node_id from n{out}) and dst in (select node_id from n{out})),
  l{out} as materialized (select * from l{t} where src in (select node_id from n{out}) and dst in (select node_id from n{out}))"""


def stretches(t: str, length: int) -> str:
    """Long stretches of consecutive steps at which a component stands in several groups."""
    key = f"{RUN}, component_id"
    return groups(t) + f""",
  ap{t} as materialized (select {key}, time_step, count(distinct cluster)>1 as apart from n{t} join c{t} on id=node_id group by {key}, time_step),
  sg{t} as materialized (select {key}, min(time_step) as first_step, max(time_step) as last_step from (
      select *, i-row_number() over (partition by {key} order by time_step) as island from (
        select *, row_number() over (partition by {key} order by time_step) as i from ap{t}) q where apart) w
    group by {key}, island having count(*)>={length})"""


def splitting(t: str, out: str, length: int) -> str:
    """Bridges between what follows a stretch's groups are cut; runs that have
    none but a stretch lose the links of misfit predecessors instead."""
    same = "s.model_name=x.model_name and s.init_time=x.init_time and s.component_id=x.component_id"
    return stretches(t, length) + f""",
  tl{t} as (select x.node_id, c.cluster from n{t} x join sg{t} s on {same} and s.last_step=x.time_step join c{t} c on c.id=x.node_id
    join (select {RUN}, component_id, max(time_step) as e from n{t} group by {RUN}, component_id) y on {same.replace('s.', 'y.')} where x.time_step<y.e),
  su{t} as materialized (select distinct t.cluster, l.dst as node_id from l{t} l join tl{t} t on t.node_id=l.src),
  ow{t} as (select node_id, min(cluster) as cluster from su{t} group by 1 having min(cluster)=max(cluster)),
  b{t} as materialized (select distinct k.src, k.dst, x.model_name, x.init_time from s{t} k join ow{t} o on o.node_id=k.src join n{t} x on x.node_id=k.src
    where not exists (select 1 from su{t} z where z.cluster=o.cluster and z.node_id=k.dst)),
  ru{t} as materialized (select distinct {RUN} from sg{t} where ({RUN}) not in (select {RUN} from b{t})),
  lr{t} as materialized (select l.* from l{t} l join n{t} x on x.node_id=l.dst where ({RUN}) in (select {RUN} from ru{t})),
  pp{t} as (select dst as n, src as id, src as root from lr{t} union select r.n, u.dst, r.root from pp{t} r join u{t} u on u.src=r.id
    join lr{t} l on l.dst=r.n and l.src=u.dst),
  pc{t} as (select n, id, min(root) as part from pp{t} group by 1,2),
  pg{t} as materialized (select p.*, abs(a.mslp-x.mslp) as dm, {hav('x.lat', 'x.lon', 'a.lat', 'a.lon')} as dd from pc{t} p join n{t} x on x.node_id=p.n join n{t} a on a.node_id=p.id),
  ok{t} as (select distinct n, part from pg{t} a where exists (select 1 from pg{t} o where o.n=a.n and o.part<>a.part)
    and not exists (select 1 from pg{t} b where b.n=a.n and b.part<>a.part and (b.dm<=a.dm or b.dd<=a.dd))),
  mf{t} as materialized (select g.id as src, g.n as dst, x.model_name, x.init_time from pg{t} g join ok{t} o on o.n=g.n and o.part<>g.part join n{t} x on x.node_id=g.n),
  re{t} as materialized (select distinct {RUN} from n{t} where ({RUN}) not in (select {RUN} from b{t} union all select {RUN} from mf{t})),
  n{out} as materialized (select * from n{t}),
  s{out} as materialized (select * from s{t} where (src, dst) not in (select src, dst from b{t})),
  l{out} as materialized (select * from l{t} where (src, dst) not in (select src, dst from mf{t}))"""


def simplified(rounds: int, length: int) -> str:
    """``n0``, ``s0``, ``l0`` reduced, split and fitted until they rest: tables
    ``n``, ``s``, ``l``. The text has a fixed number of rounds; one that still
    changes something at the end raises an error instead of a result."""
    text = reduction("0", "a0")
    for t in range(rounds):
        text += splitting(f"a{t}", f"b{t}", length) + reduction(f"b{t}", f"a{t + 1}", f"rea{t}")
    last = f"a{rounds}"
    size = lambda t: f"(select count(*) from n{t}) + (select count(*) from s{t}) + (select count(*) from l{t})"
    return text + f""",
  n as materialized (select *, case when {size(last)} <> {size(f'a{rounds - 1}')} then error('not at rest') end as rest from n{last}),
  s as materialized (select * from s{last}), l as materialized (select * from l{last})"""
