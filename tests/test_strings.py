"""Algorithms on strings and small graphs: hand cases, brute force and properties."""

import random
from collections import Counter

from hypothesis import given, settings, strategies as st

from looploom.operators import cycles, phasing, strings

DNA = st.text("ACGT", max_size=16)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(DNA, DNA)
def test_distance(a, b):
    d = levenshtein(a, b)
    assert strings.edit_distance(a, b) == strings.edit_distance(b, a) == d
    assert strings.edit_distance(a, b, 3) == min(d, 4)
    assert strings.apply_edits(a, [e[:3] for e in strings.edit_script(a, b)]) == b


def test_compatible_distance():
    assert strings.edit_distance("A", "C") == 1 and strings.compatible_distance("A", "C") == 0
    assert strings.edit_distance("ACG", "ACGTT") == strings.compatible_distance("ACG", "ACGTT") == 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
def test_chain(points):
    chain = strings.increasing_chain(points)
    assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(chain, chain[1:], strict=False))
    best = {}
    for p in sorted(set(points)):
        best[p] = 1 + max((n for q, n in best.items() if q[0] < p[0] and q[1] < p[1]), default=0)
    assert len(chain) == max(best.values(), default=0)


def simulated(seed=2, n=1500):
    r = random.Random(seed)
    unit = "".join(r.choice("ACGT") for _ in range(n))
    other = list(unit)
    for p in (100, 350, 600, 900, 1300):
        other[p] = "ACGT"[("ACGT".index(other[p]) + 1) % 4]
    noisy = lambda s, p: "".join("" if (x := r.random()) < p / 3 else r.choice("ACGT") if x < 2 * p / 3 else c for c in s)
    return unit, "".join(other), noisy


def test_anchors_are_matches():
    unit, _, noisy = simulated()
    read = noisy(unit, 0.02)
    m = strings.match_regions(unit, read)
    assert m and all(unit[r : r + n] == read[q : q + n] for r, q, n in m)
    assert all(a[0] + a[2] <= b[0] and a[1] + a[2] <= b[1] for a, b in zip(m, m[1:], strict=False))
    assert strings.apply_edits(unit, [e[:3] for e in strings.edits_between_anchors(unit, read)]) == read


def test_polish_and_correct():
    unit, _, noisy = simulated()
    reads = [noisy(unit, 0.01) for _ in range(9)]
    assert strings.edit_distance(strings.polish(reads[0], reads), unit) <= 3
    assert sum(strings.edit_distance(s, unit) for s in strings.self_correct(reads)) < sum(strings.edit_distance(s, unit) for s in reads) / 3


def test_two_thirds_is_strict():
    assert strings.polish_by_edits("A" * 3 + "CGTACGATCGATTACAGT", ["A" * 3 + "CGTACGATCCATTACAGT"] * 2 + ["A" * 3 + "CGTACGATCGATTACAGT"]) == "AAACGTACGATCGATTACAGT"


def test_dbscan():
    near = [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5), (6, 0), (6, 3), (7, 0)]
    assert strings.dbscan(9, near, 2) == [0, 0, 0, 0, 0, 0, 0, 0, None]
    near = [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5), (6, 0)]
    assert strings.dbscan(8, near, 2) == [0, 0, 0, 3, 3, 3, 0, None]


def test_exact_break():
    assert strings.exact_break("AAAAAAAAAC", "GTTTTTTTTT", "CCAAAAAAAAACGTTTTTTTTTGG") == 12


def test_heaviest_cycle_diamond():
    g = cycles.Graph.of([("s", 1000, 30), ("a", 500, 10), ("b", 500, 3), ("t", 1000, 29)], [("s", True, "a", True, 0, 10), ("s", True, "b", True, 0, 3), ("a", True, "t", True, 0, 10), ("b", True, "t", True, 0, 3), ("t", True, "s", True, 0, 13)])
    assert cycles.heaviest_cycle(g) == [("s", True), ("a", True), ("t", True)]
    assert cycles.heaviest_cycle(cycles.Graph.of([("s", 10, 1), ("t", 10, 1)], [("s", True, "t", True, 0, 1)])) == []


def test_graph_of_a_ring():
    unit, _, _ = simulated()
    ring = unit * 3
    counts = Counter(ring[i : i + 31] for i in range(len(ring) - 30))
    nodes, edges = cycles.unitigs(counts)
    g = cycles.Graph.of([(n, len(s), c) for n, (s, c) in nodes.items()], edges)
    found = cycles.path_sequence(cycles.heaviest_cycle(g), {n: s for n, (s, _) in nodes.items()}, g)
    assert cycles.rotate_to_reference(found, unit, 21) == unit


def test_components_in_order():
    edges = {1: [2], 2: [3], 3: [2, 4], 4: [], 5: [1]}
    parts = cycles.strongly_connected([5, 1, 2, 3, 4], lambda n: edges[n])
    place = {x: i for i, p in enumerate(parts) for x in p}
    assert place[2] == place[3] and all(place[a] <= place[b] for a, bs in edges.items() for b in bs)


def test_phasing():
    unit, other, noisy = simulated()
    reads = [noisy(unit, 0.004) for _ in range(8)] + [noisy(other, 0.004) for _ in range(7)]
    assert phasing.phase(reads) == [list(range(8)), list(range(8, 15))]
    assert phasing.phase(reads[:8]) == [list(range(8))]


def test_binomial():
    assert abs(strings.binomial_tail(8, 10, 0.5) - 56 / 1024) < 1e-12
    assert strings.binomial_tail(1, 10, 0.0) == 0.0 and strings.binomial_tail(10, 10, 1.0) == 1.0


def script_cost(edits, mismatch=2, gap_open=2, gap_extend=1):
    """Least cost of edits: substitutions and one gap each."""
    return sum(mismatch * min(e - s, len(alt)) + (gap_open + gap_extend * abs(e - s - len(alt)) if e - s != len(alt) else 0) for s, e, alt, _ in edits)


def test_edit_script_of_long_stretches(monkeypatch):
    r = random.Random(8)
    a = "".join(r.choice("ACGT") for _ in range(5000))
    b = list(a)
    for p in range(100, 4900, 160):
        b[p] = {"A": "C", "C": "G", "G": "T", "T": "A"}[b[p]]
    b = "G" + "".join(b[:2400]) + "".join(b[2403:]) + "C"
    whole = strings.edit_script(a, b)
    assert strings.apply_edits(a, [e[:3] for e in whole]) == b and len(whole) >= 30
    monkeypatch.setattr(strings, "_HELD_CELLS", 40_000)  # blocks of few rows are made anew
    assert strings.edit_script(a, b) == whole
    for _ in range(30):
        x, y = ("".join(r.choice("AC") for _ in range(r.randint(1, 12))) for _ in range(2))
        got = strings.edit_script(x, y)
        assert strings.apply_edits(x, [e[:3] for e in got]) == y


def test_unmatched_stretch_is_aligned():
    r = random.Random(9)
    a = "".join(r.choice("ACGT") for _ in range(2600))
    b = "".join(c if i % 9 else {"A": "C", "C": "G", "G": "T", "T": "A"}[c] for i, c in enumerate(a))  # no anchors
    edits = strings.edits_between_anchors(a, b)
    assert len(edits) > 200 and strings.apply_edits(a, [e[:3] for e in edits]) == b


def test_linked_edits_need_as_many_reads():
    from looploom.operators import phasing

    ref = "ACGT" * 300
    edits = {(p, p + 1, "T"): frozenset({0, 1, 2}) for p in range(100, 900, 150)}
    assert phasing.by_edit_linkage(edits, ref, 15) is None  # three reads are too few
    edits = {e: frozenset({0, 1, 2, 3}) for e in edits}
    assert phasing.by_edit_linkage(edits, ref, 15) == [[0, 1, 2, 3], list(range(4, 15))]


def test_double_snps_split():
    from looploom.operators import phasing

    edits = {(p, p + 2, "TT"): frozenset({0, 1, 2}) for p in range(100, 1500, 150)}
    assert phasing.by_same_reads(edits, 12) == [[0, 1, 2], list(range(3, 12))]
