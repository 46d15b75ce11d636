"""The heaviest cycle of a bidirected graph: the consensus unit. One graph is one group of a grouped map.

Nodes are (name, forward); a graph is given by node lengths and coverages and by edges with overlap and coverage in both directions.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass, field

Node = tuple[str, bool]


def flip(n: Node) -> Node:
    return n[0], not n[1]


@dataclass
class Graph:
    """``length`` and ``coverage`` by name, ``out[node][next] = (overlap, coverage)`` for both readings of each edge."""

    length: dict[str, int]
    coverage: dict[str, int]
    out: dict[Node, dict[Node, tuple[int, int]]] = field(default_factory=lambda: defaultdict(dict))

    @classmethod
    def of(cls, nodes, edges) -> Graph:
        """From rows (name, length, coverage) and (src, src_fwd, dst, dst_fwd, overlap, coverage)."""
        g = cls({n: ln for n, ln, _ in nodes}, {n: cov for n, _, cov in nodes})
        for s, sf, d, df, lap, cov in edges:
            if s in g.length and d in g.length:
                g.out[s, sf][d, df] = (lap, cov)
                g.out[d, not df][s, not sf] = (lap, cov)
        return g

    def added(self, a: Node, b: Node) -> int:
        """Bases that ``b`` adds after ``a``."""
        return max(0, self.length[b[0]] - self.out[a][b][0])

    def distances(self, start: Node, allowed: set[Node] | None = None) -> dict[Node, int]:
        """Least added bases from ``start`` to each node that it reaches; its own is the shortest cycle through it."""
        best: dict[Node, int] = {}
        heap = [(self.added(start, b), b) for b in self.out.get(start, ())]
        heapq.heapify(heap)
        while heap:
            d, n = heapq.heappop(heap)
            if n in best or allowed is not None and n not in allowed:
                continue
            best[n] = d
            if n != start:
                for b in self.out.get(n, ()):
                    if b not in best:
                        heapq.heappush(heap, (d + self.added(n, b), b))
        return best

    def self_distance(self, n: Node) -> int | None:
        return self.distances(n).get(n)


def profile_key(profile: dict[int, int]) -> list[tuple[int, int]]:
    return sorted(profile.items())


def profile_less(a: dict[int, int], b: dict[int, int]) -> bool:
    """Whether coverage profile ``a`` (coverage to bases) is worse: at the lowest coverage at which they differ it has more, or at equal
    ones it ends first."""
    x, y = profile_key(a), profile_key(b)
    for (ca, na), (cb, nb) in zip(x, y, strict=False):
        if ca != cb:
            return ca < cb
        if na != nb:
            return na > nb
    return len(x) < len(y)


def _sum(a: dict[int, int], b: dict[int, int]) -> dict[int, int]:
    out = dict(a)
    for c, n in b.items():
        out[c] = out.get(c, 0) + n
    return out


def strongly_connected(nodes: list[Node], out) -> list[list[Node]]:
    """Strongly connected components in topological order (sources first), by Tarjan's algorithm without recursion."""
    index: dict[Node, int] = {}
    low: dict[Node, int] = {}
    stack, on, parts = [], set(), []
    for root in nodes:
        if root in index:
            continue
        work = [(root, iter(out(root)))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            n, rest = work[-1]
            for b in rest:
                if b not in index:
                    index[b] = low[b] = len(index)
                    stack.append(b)
                    on.add(b)
                    work.append((b, iter(out(b))))
                    break
                if b in on:
                    low[n] = min(low[n], index[b])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[n])
                if low[n] == index[n]:
                    part = []
                    while True:
                        x = stack.pop()
                        on.discard(x)
                        part.append(x)
                        if x == n:
                            break
                    parts.append(part)
    return parts[::-1]


def orientations(g: Graph, start: Node, names: set[str]) -> dict[str, bool]:
    """Orientation of each node that is reached from ``start`` over edges in either direction; the first that reaches a node counts."""
    found, todo = {start[0]: start[1]}, [start]
    while todo:
        n = todo.pop()
        near = [*g.out.get(n, ()), *(flip(b) for b in g.out.get(flip(n), ()))]
        for b in sorted(near):
            if b[0] in names and b[0] not in found:
                found[b[0]] = b[1]
                todo.append(b)
    return found


def heaviest_cycle(g: Graph, resolve_length: int = 0) -> list[Node]:
    """The cycle whose coverage profile is best, as oriented nodes beginning with the most covered one; empty if there is no cycle.

    The threshold is half the length-weighted median of self distances (of nodes with one of at least ``resolve_length``); the start is
    the best covered node whose self distance reaches it. Nodes near a shortest cycle through the start are kept and put in
    topological order of their components, with edges into the start cut; the best profile from the start to each node follows by dynamic
    programming (inside a component by best-first search over simple paths), and the edge that closes the cycle is chosen last.
    """
    selfd = {n: d for n in sorted(g.length) if (d := g.self_distance((n, True))) is not None}
    far = sorted((d, g.length[n]) for n, d in selfd.items() if d >= resolve_length)
    if not far:
        return []
    half, upto, threshold = sum(n for _, n in far), 0, 0
    for d, n in far:
        upto += n
        if 2 * upto >= half:
            threshold = d // 2
            break
    start_name = max((n for n in selfd if selfd[n] >= threshold), key=lambda n: (g.coverage[n], [-ord(c) for c in n]))
    start = (start_name, True)
    turned = orientations(g, start, set(selfd))
    ahead = g.distances(start)
    kept = {start}
    for name, fwd in turned.items():
        n = (name, fwd)
        if n != start and n in ahead and (back := g.distances(n).get(start)) is not None:
            way = ahead[n] + back
            if way <= selfd[start_name] + threshold or way <= selfd[name] + threshold:
                kept.add(n)
    inside = lambda n: [b for b in sorted(g.out.get(n, ())) if b in kept and b != start]
    cost = lambda a, b: _sum({g.out[a][b][1]: 1}, {g.coverage[b[0]]: g.added(a, b)})
    best: dict[Node, tuple[dict[int, int], Node | None]] = {start: ({g.coverage[start_name]: 0}, None)}

    def trail(n: Node) -> list[Node]:
        out = [n]
        while (n := best[n][1]) is not None:
            out.append(n)
        return out[::-1]

    for part in strongly_connected([start, *sorted(kept - {start})], inside):
        members, todo = set(part), [n for n in part if n in best]
        # within a component, labels improve until they settle; simple paths only, so the work ends
        rounds = 0
        while todo and rounds <= len(members) ** 2:
            n = todo.pop(0)
            rounds += 1
            seen = set(trail(n))
            for b in inside(n):
                if b in members and b not in seen:
                    new = _sum(best[n][0], cost(n, b))
                    if b not in best or profile_less(best[b][0], new):
                        best[b] = (new, n)
                        todo.append(b)
        for n in part:
            if n in best:
                for b in inside(n):
                    if b not in members:
                        new = _sum(best[n][0], cost(n, b))
                        if b not in best or profile_less(best[b][0], new):
                            best[b] = (new, n)
    closing: tuple[dict[int, int], Node] | None = None
    for n in sorted(best):
        if start in g.out.get(n, ()):
            full = _sum(best[n][0], {g.out[n][start][1]: 1, g.coverage[start_name]: g.added(n, start)} if g.out[n][start][1] != g.coverage[start_name] else {g.coverage[start_name]: 1 + g.added(n, start)})
            if closing is None or profile_less(closing[0], full):
                closing = (full, n)
    return trail(closing[1]) if closing else []


def path_sequence(path: list[Node], seqs: dict[str, str], g: Graph, circular: bool = True) -> str:
    """Bases of a path; a circular one loses the overlap of its closing edge at its end."""
    table = str.maketrans("ACGTacgt", "TGCATGCA")
    text = lambda n: seqs[n[0]] if n[1] else seqs[n[0]].translate(table)[::-1]
    out = [text(path[0])]
    for a, b in zip(path, path[1:], strict=False):
        out.append(text(b)[g.out[a][b][0] :])
    s = "".join(out)
    if circular and path and path[0] in g.out.get(path[-1], ()):
        lap = g.out[path[-1]][path[0]][0]
        s = s[: len(s) - lap] if lap else s
    return s


def main_cycle_nodes(g: Graph, cycle: list[Node], least_coverage: int = 5) -> set[str]:
    """Names that the cycle reaches in both orientations through nodes of enough coverage."""
    ok = lambda n: g.coverage[n[0]] >= least_coverage

    def spread(starts: list[Node]) -> set[Node]:
        seen, todo = set(starts), list(starts)
        while todo:
            for b in g.out.get(todo.pop(), ()):
                if b not in seen and ok(b):
                    seen.add(b)
                    todo.append(b)
        return seen

    ahead, behind = spread(cycle), spread([flip(n) for n in cycle])
    return {n[0] for n in ahead if flip(n) in behind}


def rotate_to_reference(consensus: str, reference: str, k: int) -> str:
    """A circular consensus turned to the reference's strand (more shared k-mers) and rotated to begin at the smallest unique reference place."""
    table = str.maketrans("ACGTacgt", "TGCATGCA")
    first: dict[str, int] = {}
    for i in range(len(reference) - k + 1):
        x = reference[i : i + k]
        first[x] = -1 if x in first else i

    def hits(s: str) -> list[tuple[int, int]]:
        ring = s + s[: k - 1]
        return [(first[x], i) for i in range(len(s)) if (x := ring[i : i + k]) in first]

    if not consensus or len(consensus) < k:
        return consensus
    back = consensus.translate(table)[::-1]
    if len(hits(back)) > len(hits(consensus)):
        consensus = back
    unique = [h for h in hits(consensus) if h[0] >= 0]
    if not unique:
        return consensus
    place, at = min(unique)
    at = (at - place) % len(consensus) if place < len(consensus) else at
    return consensus[at:] + consensus[:at]


def unitigs(counts: dict[str, int]) -> tuple[dict[str, tuple[str, int]], list[tuple[str, bool, str, bool, int, int]]]:
    """Compacted de Bruijn graph of k-mers with counts (both strands are made): nodes name -> (sequence, mean coverage), and edges with
    overlap k - 1 and the smaller coverage of the joined k-mers."""
    table = str.maketrans("ACGT", "TGCA")
    rc = lambda s: s.translate(table)[::-1]
    both: dict[str, int] = {}
    for x, n in counts.items():
        for y in {x, rc(x)}:
            both[y] = both.get(y, 0) + n
    k = len(next(iter(both), ""))
    nxt = lambda x: [y for c in "ACGT" if (y := x[1:] + c) in both]
    prv = lambda x: [y for c in "ACGT" if (y := c + x[:-1]) in both]
    inner = lambda x: len(prv(x)) == 1 and len(nxt(prv(x)[0])) == 1 and prv(x)[0] not in (x, rc(x))
    home: dict[str, Node] = {}
    nodes: dict[str, tuple[str, int]] = {}
    for seed in (*sorted(x for x in both if not inner(x)), *sorted(both)):  # the second pass finds rings
        if seed in home:
            continue
        chain, inside = [seed], {seed}
        while len(n := nxt(chain[-1])) == 1 and inner(n[0]) and n[0] not in home and n[0] != seed and rc(n[0]) not in chain[-1:] and n[0] not in map(rc, chain[-1:]) and rc(n[0]) not in home:
            if n[0] in inside or rc(n[0]) in inside:
                break
            chain.append(n[0])
            inside.add(n[0])
        name = f"u{len(nodes)}"
        nodes[name] = (chain[0] + "".join(x[-1] for x in chain[1:]), round(sum(both[x] for x in chain) / len(chain)))
        for i, x in enumerate(chain):
            home.setdefault(x, (name, True))
            home.setdefault(rc(x), (name, False))
    ends = {(n, True): s[-k:] for n, (s, _) in nodes.items()} | {(n, False): rc(s[:k]) for n, (s, _) in nodes.items()}
    starts = {s[:k]: (n, True) for n, (s, _) in nodes.items()} | {rc(s[-k:]): (n, False) for n, (s, _) in nodes.items()}
    edges = {(a, starts[y]): min(both[x], both[y]) for a, x in ends.items() for y in nxt(x) if y in starts}
    seen, out = set(), []
    for (a, b), cov in sorted(edges.items()):
        if ((a, b)) not in seen:
            seen |= {(a, b), (flip(b), flip(a))}
            out.append((a[0], a[1], b[0], b[1], k - 1, cov))
    return nodes, out
