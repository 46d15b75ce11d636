"""Rolling hashes against the recurrence, consensus paths and node anchors on hand cases."""

import random

from looploom.operators import consensus, nthash

M = (1 << 64) - 1
V = [int(x) for x in nthash.wang(nthash.np.arange(4))]


def rot(x, n):
    n %= 64
    return (x << n | x >> (64 - n)) & M


def rolling(s, k):
    out = []
    for i in range(len(s) - k + 1):
        fw = bw = 0
        for c in s[i : i + k]:
            c = "ACGT".index(c)
            fw, bw = rot(fw, 1) ^ V[c], rot(bw, 63) ^ rot(V[3 - c], k - 1)
        out.append(min(fw, bw))
    return out


def test_hashes():
    r = random.Random(0)
    for k in (1, 5, 21, 64, 91):
        s = "".join(r.choice("ACGT") for _ in range(200))
        rc = s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
        h = nthash.hashes(s, k)
        assert h.tolist() == rolling(s, k) and h.tolist() == nthash.hashes(rc, k).tolist()[::-1]
    assert len(nthash.hashes("ACG", 5)) == 0 and len(nthash.hashes("", 5)) == 0


def test_syncmers():
    r = random.Random(1)
    s = "".join(r.choice("ACGT") for _ in range(300))
    h = nthash.hashes(s, 11)
    want = [p for p in range(300 - 21 + 1) if min(h[p : p + 11]) in (h[p], h[p + 10])]
    assert nthash.syncmer_places(s, 21, 11).tolist() == want and 0 < len(want) < 280


def test_consensus_paths(spark):
    loops = {1: "axb", 2: "axb", 3: "ayb", 4: "axzb"}
    rows = [(0, k, i, c) for k, s in loops.items() for i, c in enumerate(s)]
    df = spark.createDataFrame(rows, "cluster int, loop int, i int, node string")
    assert {(r["node"], r["rank"]) for r in consensus.core_nodes(df).collect()} == {("a", 1), ("b", 2)}
    assert [r["path"] for r in consensus.consensus_paths(df).collect()] == [["a", "x", "b"]]
    assert {r["node"] for r in consensus.majority_nodes(df).collect()} == {"a", "b", "x"}


def test_node_anchors(spark):
    make = lambda s: spark.createDataFrame([(0, i, c) for i, c in enumerate(s)], "pair int, i int, node string")
    got = consensus.node_anchors(make("abcdea"), make("bdcea"))
    assert {r["node"] for r in got.collect()} == {"b", "e"}
