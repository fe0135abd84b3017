"""Sequential graph kernels on arrays: the bodies of grouped and partitioned functions."""

from __future__ import annotations

import heapq

import numpy as np


def least_reachable(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the edges x - y lead to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for at in (x, y, label[x], label[y]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def adjacency(n: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CSR of the undirected edges: first neighbour of each node, neighbours, and the edge of each."""
    tail, head, edge = np.concatenate([x, y]), np.concatenate([y, x]), np.tile(np.arange(len(x)), 2)
    order = np.lexsort((head, tail))
    return np.searchsorted(tail[order], np.arange(n + 1)), head[order], edge[order]


#: Leaves that are worth a round on arrays.
FEW_LEAVES = 16


def _hanging(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which edges of a simple graph hang: those that go when vertices of one edge are taken away until there are none."""
    gone, degree, only = np.zeros(len(x), bool), np.bincount(x, minlength=n) + np.bincount(y, minlength=n), np.zeros(n, np.int64)
    for end in (x, y):
        np.bitwise_xor.at(only, end, np.arange(len(x)))  # a vertex of one edge has its number
    leaves = np.flatnonzero(degree == 1)
    while len(leaves) > FEW_LEAVES:
        edge = np.unique(only[leaves])
        gone[edge] = True
        for end in (x[edge], y[edge]):
            np.subtract.at(degree, end, 1)
            np.bitwise_xor.at(only, end, edge)
        leaves = np.unique(np.concatenate([x[edge], y[edge]]))
        leaves = leaves[degree[leaves] == 1]
    # the ends of long paths, one by one
    leaves = leaves.tolist()
    while leaves:
        v = leaves.pop()
        if degree[v] != 1:
            continue
        e = int(only[v])
        gone[e] = True
        for w in (int(x[e]), int(y[e])):
            degree[w] -= 1
            only[w] ^= e
            if degree[w] == 1:
                leaves.append(w)
    return gone


def blocks(n: int, x: np.ndarray, y: np.ndarray, watch=None) -> np.ndarray:
    """For each edge of a simple graph the smallest edge of its biconnected block.

    Leaves are peeled first: their edges are blocks of their own. The rest is
    searched depth-first with an explicit stack. ``watch(event, vertex, edge)``
    is told of the search: "root", "tree" (an edge to a new vertex), "back" and
    "left" (a vertex is done).
    """
    watch = watch or (lambda *_: None)
    whole, gone = np.arange(len(x)), _hanging(n, x, y)
    inner = np.flatnonzero(~gone)
    names, where = np.unique(np.concatenate([x[inner], y[inner]]), return_inverse=True)
    n, names, whole_edge = len(names), names.tolist(), inner.tolist()
    first, heads, edges = (a.tolist() for a in adjacency(n, where[: len(inner)], where[len(inner) :]))
    block = list(range(len(inner)))
    number, low, place, count = [-1] * n, [0] * n, first[:-1], 0
    place = list(place)
    for root in range(n):
        if number[root] >= 0:
            continue
        number[root] = low[root] = count
        watch("root", names[root], -1)
        count += 1
        stack, held = [(root, -1)], []
        while stack:
            v, entered = stack[-1]
            if place[v] < first[v + 1]:
                k = place[v]
                place[v] += 1
                e, w = edges[k], heads[k]
                if e == entered:
                    continue
                if number[w] < 0:
                    number[w] = low[w] = count
                    count += 1
                    held.append(e)
                    stack.append((w, e))
                    watch("tree", names[w], whole_edge[e])
                elif number[w] < number[v]:
                    held.append(e)
                    low[v] = min(low[v], number[w])
                    watch("back", names[w], whole_edge[e])
                continue
            stack.pop()
            watch("left", names[v], whole_edge[entered] if entered >= 0 else -1)
            if stack:
                u = stack[-1][0]
                low[u] = min(low[u], low[v])
                if low[v] >= number[u]:
                    members = []
                    while True:
                        members.append(held.pop())
                        if members[-1] == entered:
                            break
                    least = min(members)
                    for e in members:
                        block[e] = least
    whole[inner] = inner[np.array(block, np.int64)]
    return whole


def block_copies(n: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(block of each edge as ``blocks``, numbered from 0; block and vertex of each membership, by block; places of the edges' ends there)."""
    block = np.unique(blocks(n, x, y), return_inverse=True)[1]
    held, place = np.unique(np.concatenate([block * n + x, block * n + y]), return_inverse=True)
    return block, held // n, held % n, place


def block_scores(n: int, x: np.ndarray, y: np.ndarray, length, mult: np.ndarray, weight: np.ndarray, comp: np.ndarray) -> np.ndarray:
    """Ordered-pair betweenness of every class, per member, by the block-cut trees of many components (comp: of each vertex).

    A cut vertex is one copy per block, with the weight behind it seen from
    there; pairs in different branches are products of weights, and only blocks
    of several edges are searched.
    """
    block, of, vertex, place = block_copies(n, x, y)
    count = int(block.max()) + 1
    joint = np.bincount(vertex, minlength=n)[vertex] > 1
    # the tree's nodes are blocks and, from ``count`` on, vertices; leaves are folded into what they hang on
    below = np.concatenate([np.bincount(of, np.where(joint, 0, weight[vertex]), count), weight])
    low, high = of[joint], vertex[joint] + count
    degree, near, parent = (np.zeros(count + n, np.int64) for _ in range(3))
    parent -= 1
    for a, b in ((low, high), (high, low)):
        np.add.at(degree, a, 1)
        np.bitwise_xor.at(near, a, b)
    leaves = np.flatnonzero(degree == 1)
    while len(leaves):
        to = near[leaves]
        keep = (degree[to] > 1) | (leaves < to)
        leaves, to = leaves[keep], to[keep]
        parent[leaves], degree[leaves] = to, 0
        np.add.at(below, to, below[leaves])
        np.bitwise_xor.at(near, to, leaves)
        np.subtract.at(degree, to, 1)
        to = np.unique(to)
        leaves = to[degree[to] == 1]
    total = np.bincount(comp, weight)[comp]
    behind = np.where(parent[high] == low, below[high], total[vertex[joint]] - below[low])
    own = weight[vertex].copy()
    own[joint] = behind
    squares = np.bincount(vertex[joint], (total[vertex[joint]] - behind) ** 2, n)
    cut = np.bincount(vertex, minlength=n) > 1
    score = np.where(cut, (total - weight) ** 2 - squares, 0.0)
    wide = np.bincount(block)[block] > 1
    if wide.any():
        some = np.flatnonzero(np.bincount(block)[of] > 1)
        new = np.full(len(of), -1, np.int64)
        new[some] = np.arange(len(some))
        graph = PathGraph(len(some), new[place[: len(x)][wide]], new[place[len(x) :][wide]], length[wide], mult[vertex[some]], own[some])
        graph.parts = np.flatnonzero(np.diff(of[some], prepend=-1))
        gain = np.zeros(graph.n)
        graph.add_all(gain)
        score += np.bincount(vertex[some], gain, n)
    return score / mult


#: Sources are searched together up to this longest edge, in units; beyond, one by one.
MOST_LEVELS = 64


class PathGraph:
    """Arrays that shortest-path kernels share; lengths are whole numbers."""

    def __init__(self, n, x, y, length, mult=None, weight=None):
        self.n = n
        self.first, self.heads, edge = adjacency(n, x, y)
        # lengths beyond 64 bits are Python's numbers
        self.length = np.asarray(length, object if np.asarray(length).dtype == object else np.int64)[edge] if len(x) else np.zeros(0, np.int64)
        self.uniform = len(x) == 0 or bool((self.length == self.length[0]).all())
        self.mult = np.ones(n) if mult is None else np.asarray(mult, float)
        self.weight = self.mult.copy() if weight is None else np.asarray(weight, float)
        self.parts = np.zeros(1, np.int64)

    def _out(self, nodes):
        sizes = self.first[nodes + 1] - self.first[nodes]
        at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.first[nodes], sizes)
        return np.repeat(nodes, sizes), at

    def _scratch(self):
        """Distances, path counts and gains; every search leaves them as it found them."""
        if not hasattr(self, "_arrays"):
            self._arrays = np.full(self.n, -1, self.length.dtype), np.zeros(self.n), np.zeros(self.n)
        return self._arrays

    def _reach(self, source: int):
        """(vertices reached, steps) with distances and path counts in the scratch arrays.

        Steps are (tails, heads) of the shortest-path edges, nearest first.
        """
        distance, paths, _ = self._scratch()
        distance[source], paths[source] = 0, self.mult[source]
        reached, steps = [np.array([source])], []
        if self.uniform:
            unit = int(self.length[0]) if len(self.length) else 1
            while len(reached[-1]):
                frontier = reached[-1]
                tails, at = self._out(frontier)
                heads = self.heads[at]
                onward = distance[heads] < 0
                tails, heads = tails[onward], heads[onward]
                new = np.unique(heads)
                distance[new] = distance[frontier[0]] + unit
                np.add.at(paths, heads, paths[tails])
                paths[new] *= self.mult[new]
                if len(heads):
                    steps.append((tails, heads))
                reached.append(new)
            return np.concatenate(reached), steps
        queue, best, order = [(0, source)], {source: 0}, []
        settled: set = set()
        while queue:
            d, v = heapq.heappop(queue)
            if v in settled:
                continue
            settled.add(v)
            distance[v] = d
            order.append(v)
            for k in range(self.first[v], self.first[v + 1]):
                w, to = int(self.heads[k]), d + int(self.length[k])
                if w not in settled and to < best.get(w, to + 1):
                    best[w] = to
                    heapq.heappush(queue, (to, w))
        for v in order[1:]:
            span = slice(self.first[v], self.first[v + 1])
            near = self.heads[span]
            before = near[(distance[near] + self.length[span] == distance[v]) & (distance[near] >= 0)]
            paths[v] = paths[before].sum() * self.mult[v]
            steps.append((before, np.full(len(before), v)))
        return np.array(order), steps

    def search(self, source: int):
        """(vertices reached, their distances, their path counts)."""
        distance, paths, _ = self._scratch()
        reached, _ = self._reach(source)
        out = reached, distance[reached], paths[reached]
        distance[reached], paths[reached] = -1, 0
        return out

    def folded(self):
        """(core, tree): the graph without its hanging trees, and what the trees contribute.

        Vertices with one neighbour are folded into it, round after round, with
        their weight (members that are sources and targets). Everything that
        passes a vertex with folded parts, to or from one of them, does so
        whatever the lengths, so it is a product of weights; the core alone is
        searched. tree: the gain of every class from such pairs.
        """
        n, owner = self.n, np.repeat(np.arange(self.n), np.diff(self.first))
        own = self.weight
        weight, squares, degree, alive = own.copy(), np.zeros(n), np.diff(self.first), np.ones(n, bool)
        while True:
            leaves = np.flatnonzero(alive & (degree == 1))
            if not len(leaves):
                break
            tails, at = self._out(leaves)
            inside = alive[self.heads[at]]
            leaves, parents = tails[inside], self.heads[at][inside]
            keep = (degree[parents] > 1) | (leaves < parents)  # of two that only have each other one stays
            leaves, parents = leaves[keep], parents[keep]
            np.add.at(weight, parents, weight[leaves])
            np.add.at(squares, parents, weight[leaves] ** 2)
            np.subtract.at(degree, parents, 1)
            alive[leaves], degree[leaves] = False, 0
        label = np.arange(n)
        while True:
            new = label.copy()
            np.minimum.at(new, owner, label[self.heads])
            new = new[new]
            if (new == label).all():
                break
            label = new
        total = np.bincount(label, own, n)[label]
        tree = (total - own) ** 2 - squares - (total - weight) ** 2
        kept = np.flatnonzero(alive & (degree > 0))
        kept = kept[np.argsort(label[kept], kind="stable")]
        inside = alive[owner] & alive[self.heads] & (owner < self.heads)
        place = np.full(n, -1, np.int64)
        place[kept] = np.arange(len(kept))
        edge = np.flatnonzero(inside)
        core = PathGraph(len(kept), place[owner[edge]], place[self.heads[edge]], self.length[edge], self.mult[kept], weight[kept])
        core.parts, core.kept = np.flatnonzero(np.diff(label[kept], prepend=-1)), kept
        return core, np.where(tree > 0, tree, 0.0)

    def batches(self, cells: int = 1 << 21, most: int = 64):
        """(first, stop) runs of vertices of one component that are searched together, within a size of arrays."""
        out = []
        for low, high in zip(self.parts.tolist(), [*self.parts.tolist()[1:], self.n]):
            step = max(1, min(most, cells // (high - low)))
            out += [(low, high, at, min(at + step, high)) for at in range(low, high, step)]
        return out

    def _by_length(self):
        """Per length, in multiples of the common unit: the CSR of its edges."""
        if not hasattr(self, "_split"):
            owner, unit = np.repeat(np.arange(self.n), np.diff(self.first)), max(1, int(np.gcd.reduce(self.length)))
            self._split = []
            for length in np.unique(self.length).tolist():
                at = np.flatnonzero(self.length == length)
                self._split.append((length // unit, np.searchsorted(owner[at], np.arange(self.n + 1)), self.heads[at]))
        return self._split

    @staticmethod
    def _pull(first, heads, low: int, rows: np.ndarray, values: np.ndarray, out: np.ndarray) -> None:
        """Add the neighbours' values to out, one row for each of rows (local to the component at ``low``)."""
        sizes = first[rows + low + 1] - first[rows + low]
        some = np.flatnonzero(sizes)
        if len(some):
            sizes, starts = sizes[some], np.cumsum(sizes[some]) - sizes[some]
            at = np.arange(int(sizes.sum())) - np.repeat(starts - first[rows[some] + low], sizes)
            out[some] += np.add.reduceat(values[heads[at] - low], starts, axis=0)

    def add_batch(self, low: int, high: int, first: int, stop: int, total: np.ndarray) -> None:
        """``add_dependencies`` of the vertices first to stop of the component low to high of a core.

        All sources advance together, one unit of length per level; a vertex
        gets its path counts from the levels that its edges' lengths lie back.
        """
        sources, split = first + np.flatnonzero(self.weight[first:stop]), self._by_length()
        longest = max((length for length, *_ in split), default=1)
        if longest > MOST_LEVELS:
            for s in sources.tolist():
                self.add_dependencies(s, total)
            return
        if not len(sources):
            return
        column, mult, weight = np.arange(len(sources)), self.mult[low:high, None], self.weight[low:high, None]
        at_level = np.full((high - low, len(sources)), -1, np.int32)
        paths = np.zeros(at_level.shape)
        at_level[sources - low, column], paths[sources - low, column] = 0, self.mult[sources]
        rows_at, level, last = {0: np.unique(sources) - low}, 0, 0
        while level < last + longest:
            level += 1
            rows = np.flatnonzero((at_level < 0).any(1))
            if not len(rows):
                break
            found = np.zeros((len(rows), len(sources)))
            for length, *edges in split:
                if level - length in rows_at:
                    self._pull(*edges, low, rows, np.where(at_level == level - length, paths, 0), found)
            new = (at_level[rows] < 0) & (found > 0)
            some = new.any(1)
            if some.any():
                rows, found, new, last = rows[some], found[some], new[some], level
                at_level[rows] = np.where(new, level, at_level[rows])
                paths[rows] = np.where(new, found * mult[rows], paths[rows])
                rows_at[level] = rows
        gain, share = np.zeros(at_level.shape), np.zeros(at_level.shape)
        for level in sorted(rows_at, reverse=True)[:-1]:
            rows = rows_at[level]
            here, found = at_level[rows] == level, np.zeros((len(rows), len(sources)))
            for length, *edges in split:
                if level + length in rows_at:
                    self._pull(*edges, low, rows, np.where(at_level == level + length, share, 0), found)
            gain[rows] = np.where(here, paths[rows] * found, gain[rows])
            share[rows] = np.where(here, (weight[rows] + gain[rows]) * mult[rows] / np.where(here, paths[rows], 1), share[rows])
        total[low:high] += gain @ self.weight[sources]

    def add_dependencies(self, source: int, total: np.ndarray) -> None:
        """Add to ``total`` what each class gains from the paths of one source class to all others, by their weights.

        Only what the search reached is touched, so a source costs its own
        component, however many there are.
        """
        distance, paths, gain = self._scratch()
        reached, steps = self._reach(source)
        for tails, heads in reversed(steps):
            share = (self.weight[heads] + gain[heads]) * self.mult[heads] / paths[heads]
            np.add.at(gain, tails, paths[tails] * share)
        gain[source] = 0
        total[reached] += gain[reached] * self.weight[source]
        distance[reached], paths[reached], gain[reached] = -1, 0, 0

    def _runs(self, cells: int):
        """(first, stop) of ``parts`` that have up to ``cells`` pairs of vertices together; a larger part is on its own."""
        ends = np.append(self.parts[1:], self.n)
        pairs = np.cumsum((ends - self.parts) ** 2)
        at = 0
        while at < len(ends):
            stop = max(at + 1, int(np.searchsorted(pairs, (pairs[at - 1] if at else 0) + cells, "right")))
            yield at, stop
            at = stop

    def _together(self, at: int, stop: int, sources: np.ndarray):
        """All sources of the parts at to stop at once, levels being units of length (edges, if lengths are uniform): (source, vertex, level, paths) of all pairs and the steps of each level."""
        low, ends = self.parts[at:stop], np.append(self.parts[1:], self.n)[at:stop]
        sizes = ends - low
        starts = np.cumsum(sizes**2) - sizes**2
        own = np.repeat(np.arange(len(low)), sizes)
        nodes = np.arange(low[0], ends[-1])
        # the pair of source s and vertex v is number base[s - low[0]] + v
        base = starts[own] + (nodes - low[own]) * sizes[own] - low[own]
        source = np.repeat(nodes, sizes[own])
        vertex = np.arange(len(source)) - base[source - low[0]]
        level, paths, mark = np.full(len(source), -1, np.int32), np.zeros(len(source)), np.zeros(len(source), np.int64)
        v = nodes[sources[nodes]]
        pair = base[v - low[0]] + v
        level[pair], paths[pair] = 0, self.mult[v]
        kinds = [None] if self.uniform else np.unique(self.length).tolist()
        steps, depth, waiting = [], 0, {}
        while True:
            fan = self.first[v + 1] - self.first[v]
            edge = np.arange(int(fan.sum())) - np.repeat(np.cumsum(fan) - fan - self.first[v], fan)
            heads = self.heads[edge]
            tail = np.repeat(pair, fan)
            head = np.repeat(pair - v, fan) + heads
            new = level[head] < 0
            for kind in kinds:  # an edge arrives as many levels later as it is long
                some = new if kind is None else new & (self.length[edge] == kind)
                if some.any():
                    waiting.setdefault(depth + (kind or 1), []).append((tail[some], head[some], heads[some]))
            if not waiting:
                break
            depth = min(waiting)
            tail, head, heads = (np.concatenate(x) for x in zip(*waiting.pop(depth)))
            new = level[head] < 0
            heads, tail, head = heads[new], tail[new], head[new]
            np.add.at(paths, head, paths[tail])
            mark[head] = np.arange(len(head))
            once = mark[head] == np.arange(len(head))
            pair, v = head[once], heads[once]
            level[pair] = depth
            paths[pair] *= self.mult[v]
            if len(head):
                steps.append((tail, head))
        return source, vertex, level, paths, steps

    def add_all(self, total: np.ndarray, cells: int = 1 << 19) -> None:
        """``add_dependencies`` of all vertices, small parts together."""
        sources, few = self.weight > 0, self.uniform or int(self.length.max()) <= MOST_LEVELS
        for at, stop in self._runs(cells):
            low, high = int(self.parts[at]), int(self.parts[stop]) if stop < len(self.parts) else self.n
            if not few or (high - low) ** 2 > cells and stop == at + 1:
                for a in range(at, stop):
                    first, last = int(self.parts[a]), int(self.parts[a + 1]) if a + 1 < len(self.parts) else self.n
                    step = max(1, min(64, (1 << 21) // (last - first)))
                    for s in range(first, last, step):
                        self.add_batch(first, last, s, min(s + step, last), total)
                continue
            source, vertex, _, paths, steps = self._together(at, stop, sources)
            gain = np.zeros(len(paths))
            for tail, head in reversed(steps):
                v = vertex[head]
                np.add.at(gain, tail, paths[tail] * ((self.weight[v] + gain[head]) * self.mult[v] / paths[head]))
            gain[source == vertex] = 0
            total[low:high] += np.bincount(vertex - low, gain * self.weight[source], high - low)

    def search_all(self, cells: int = 1 << 19):
        """(sources, vertices, distances, path counts) of all pairs that are connected, in arrays of about ``cells``."""
        everyone = np.ones(self.n, bool)
        unit = int(self.length[0]) if len(self.length) else 1
        for at, stop in self._runs(cells):
            low, high = int(self.parts[at]), int(self.parts[stop]) if stop < len(self.parts) else self.n
            if not self.uniform or (high - low) ** 2 > cells and stop == at + 1:
                for s in range(low, high):
                    reached, distance, paths = self.search(s)
                    yield np.full(len(reached), s), reached, distance, paths
                continue
            source, vertex, level, paths, _ = self._together(at, stop, everyone)
            yield source, vertex, level.astype(np.int64) * unit, paths
