"""Separation of merged storms within one run: a worklist over its steps.

A run's points stand in arrays with the neighbours of each; steps are taken in
order of time. A decision changes what the groups of the steps beside it are
linked to and nothing else, so only those are decided again: later steps in the
same pass, earlier ones in the next. That gives what passes over all steps until
nothing changes would give.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa

from galespark.functions.geo import EARTH_RADIUS_M
from galespark.operators.components import places

NODE, SAME, LINK = 0, 1, 2  # kinds of rows that a run is handed over in


class Run:
    """Nodes 0..n-1 in the order of their identifiers, and their live neighbours."""

    def __init__(self, step: list[int], mslp: list, same: Iterable[tuple[int, int]], links: Iterable[tuple[int, int]], place: list = (), component: list = ()):
        n = len(step)
        self.mslp, self.place, self.component = mslp, place, component
        self.times = sorted(set(step))
        index = {t: i for i, t in enumerate(self.times)}
        self.step = [index[t] for t in step]
        self.alive = [True] * n
        self.beside, self.out = [set() for _ in range(n)], [set() for _ in range(n)]  # same step: either way, directed
        self.before, self.after = [set() for _ in range(n)], [set() for _ in range(n)]
        for a, b in same:
            self.out[a].add(b)
            self.beside[a].add(b)
            self.beside[b].add(a)
        for a, b in links:
            self.after[a].add(b)
            self.before[b].add(a)

    def remove(self, x: int) -> None:
        self.alive[x] = False
        for near, back in ((self.beside, self.beside), (self.before, self.after), (self.after, self.before)):
            for y in near[x]:
                back[y].discard(x)
        for y in self.beside[x]:
            self.out[y].discard(x)
        for near in (self.beside, self.out, self.before, self.after):
            near[x] = set()

    def reached(self, start: Iterable[int], inside: set[int] | None = None) -> set[int]:
        """Nodes joined to some by links of one step, among ``inside`` if given."""
        seen = set(start)
        todo = list(seen)
        while todo:
            new = self.beside[todo.pop()] - seen
            if inside is not None:
                new &= inside
            seen |= new
            todo += new
        return seen

    def groups(self, nodes: Iterable[int], inside: set[int] | None = None) -> Iterator[set[int]]:
        seen: set[int] = set()
        for x in sorted(nodes):
            if x not in seen and self.alive[x]:
                group = self.reached([x], inside)
                seen |= group
                yield group

    # ------------------------------------------------------------ reduction

    def together(self, group: set[int], low: int) -> bool:
        """All that the group is linked to stays in one piece by its lowest node alone."""
        for side in (self.before, self.after):
            near = set().union(*(side[x] for x in group))
            if self.reached(side[low], near) != near:
                return False
        return True

    def reduce(self) -> bool:
        """Keep the lowest node of a group wherever that leaves its neighbours connected."""
        removed = False
        todo = defaultdict(set)
        for x, alive in enumerate(self.alive):
            if alive and self.beside[x]:
                todo[self.step[x]].add(x)
        while todo:
            later = defaultdict(set)
            for s in range(len(self.times)):
                for group in self.groups(todo.get(s, ())):
                    low = min(group, key=lambda x: (self.mslp[x] is not None, self.mslp[x] or 0, x))
                    if len(group) == 1 or not self.together(group, low):
                        continue
                    removed = True
                    for x in group - {low}:
                        for y in self.after[x] | self.before[x]:
                            (todo if self.step[y] > s else later)[self.step[y]].add(y)
                        self.remove(x)
            todo = later
        return removed

    # ------------------------------------------------------------ mergers

    def stretches(self, length: int) -> Iterator[tuple[int, int, int, bool]]:
        """(component, first step, last step, goes on after) of long stretches of
        consecutive steps at which a component stands in several groups."""
        members: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for x, alive in enumerate(self.alive):
            if alive:
                members[self.component[x]][self.step[x]].append(x)
        for c, steps in members.items():
            order, since = sorted(steps), None
            for i, s in enumerate([*order, None]):
                apart = s is not None and len(list(self.groups(steps[s]))) > 1
                if apart and since is None:
                    since = i
                elif not apart and since is not None:
                    if i - since >= length:
                        yield c, order[since], order[i - 1], i < len(order)
                    since = None

    def bridges(self, length: int) -> set[tuple[int, int]]:
        """Directed links of one step between what follows a long stretch's
        groups: from a node that follows one group only to nodes that do not."""
        ends = {(c, last) for c, _, last, more in self.stretches(length) if more}
        follow: list[set[int]] = []
        tails = defaultdict(list)
        for x, alive in enumerate(self.alive):
            if alive and (self.component[x], self.step[x]) in ends:
                tails[self.step[x]].append(x)
        for nodes in tails.values():
            follow += [set().union(*(self.after[x] for x in group)) for group in self.groups(nodes)]
        owners = defaultdict(list)
        for i, nodes in enumerate(follow):
            for x in nodes:
                owners[x].append(i)
        return {(x, y) for x, own in owners.items() if len(own) == 1 for y in self.out[x] - follow[own[0]]}

    # ------------------------------------------------------------ predecessors

    def gaps(self, x: int, y: int) -> tuple[float | None, float]:
        dm = None if self.mslp[x] is None or self.mslp[y] is None else abs(self.mslp[x] - self.mslp[y])
        (lat1, lon1), (lat2, lon2) = (map(math.radians, self.place[i]) for i in (x, y))
        h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
        return dm, 2 * EARTH_RADIUS_M * math.asin(min(1.0, math.sqrt(h)))

    def misfits(self) -> set[tuple[int, int]]:
        """Links from all groups of predecessors but the one with a member closer
        in pressure and in distance than every node of the others."""
        out = set()
        for x, before in enumerate(self.before):
            if len(before) < 2:
                continue
            groups = list(self.groups(before, before))
            if len(groups) < 2:
                continue
            gaps = [[self.gaps(x, y) for y in sorted(g)] for g in groups]
            least = [min((m for m, _ in g if m is not None), default=None) for g in gaps]
            if None in least:
                continue
            best = least.index(min(least))
            dm = min(m for i, m in enumerate(least) if i != best)
            dd = min(d for i, g in enumerate(gaps) if i != best for _, d in g)
            if any(m is not None and m < dm and d < dd for m, d in gaps[best]):
                out |= {(y, x) for i, g in enumerate(groups) if i != best for y in g}
        return out

    def simplify(self, length: int) -> None:
        """Reduce, split mergers and fit predecessors until the run rests."""
        changed = True
        while changed:
            changed = self.reduce()
            while True:
                if bridges := self.bridges(length):
                    for x, y in bridges:
                        self.out[x].discard(y)
                        if x not in self.out[y]:
                            self.beside[x].discard(y)
                            self.beside[y].discard(x)
                elif any(True for _ in self.stretches(length)) and (misfits := self.misfits()):
                    for x, y in misfits:
                        self.after[x].discard(y)
                        self.before[y].discard(x)
                else:
                    break
                changed = True


def _run_of(table: pa.Table) -> tuple[pa.Array, Run]:
    kind = table["kind"].to_numpy()
    nodes = table.filter(pa.array(kind == NODE)).sort_by("a")
    values = nodes["a"].combine_chunks()

    def edges(k: int) -> Iterator[tuple[int, int]]:
        part = table.filter(pa.array(kind == k))
        a, b = places(values, part["a"]), places(values, part["b"])
        inside = (a >= 0) & (b >= 0)
        return zip(a[inside].tolist(), b[inside].tolist())

    column = lambda c: nodes[c].to_pylist()
    return values, Run(column("time_step"), column("mslp"), edges(SAME), edges(LINK), list(zip(column("lat"), column("lon"))), column("component_id"))


def _rows(table: pa.Table, values: pa.Array, run: Run, keys: list[str]) -> pa.Table:
    """What is left of a run, by kind."""
    kinds, a, b = [], [], []
    for x, alive in enumerate(run.alive):
        if alive:
            kinds.append(NODE)
            a.append(x)
            b.append(x)
        for kind, near in ((SAME, run.out[x]), (LINK, run.after[x])):
            kinds += [kind] * len(near)
            a += [x] * len(near)
            b += sorted(near)
    key = {k: pa.repeat(table[k][0], len(a)) for k in keys}
    return pa.table(key | {"kind": pa.array(kinds, pa.int32()), "a": values.take(pa.array(a, pa.int64())), "b": values.take(pa.array(b, pa.int64()))})


def reducer(keys: list[str]):
    def reduce(table: pa.Table) -> pa.Table:
        values, run = _run_of(table)
        run.reduce()
        return _rows(table, values, run, keys)

    return reduce


def simplifier(keys: list[str], length: int):
    def simplify(table: pa.Table) -> pa.Table:
        values, run = _run_of(table)
        run.simplify(length)
        return _rows(table, values, run, keys)

    return simplify
