"""Splitting a cluster of loops by variants: pure functions on small lists, for one cluster of a grouped map.

An edit is (start, end, alt); ``edits`` maps each edit to the set of reads that have it; reads are 0 … n-1. A splitter returns groups of reads, or
None where it finds no split.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import combinations

from looploom.operators.strings import Groups, binomial_tail, conserved, edit_distance, edits_between_anchors, match_regions, polish, self_correct

Edit = tuple[int, int, str]


def is_snp(e: Edit) -> bool:
    return e[1] - e[0] == 1 and len(e[2]) == 1


def is_double_snp(e: Edit) -> bool:
    return e[1] - e[0] == 2 and len(e[2]) == 2


def is_big_indel(e: Edit, least: int = 10) -> bool:
    return abs(e[1] - e[0] - len(e[2])) >= least


def is_microsatellite(e: Edit, ref: str, longest: int = 9) -> bool:
    """Whether the bases that an indel adds or removes repeat a unit that stands beside it."""
    gone, left, right = ref[e[0] : e[1]], ref[: e[0]], ref[e[1] :]
    if gone and e[2]:
        return False
    x = gone or e[2]
    return any(len(x) % n == 0 and x == x[:n] * (len(x) // n) and (left.endswith(x[:n]) or right.startswith(x[:n])) for n in range(1, min(longest, len(x)) + 1))


def gather(ref: str, reads: list[str]) -> dict[Edit, frozenset[int]]:
    """Edits of the reads against the consensus, within the span that all of them cover."""
    found: dict[Edit, set[int]] = defaultdict(set)
    spans = []
    for i, s in enumerate(reads):
        m = match_regions(ref, s)
        spans.append((m[0][0], m[-1][0] + m[-1][2]) if m else (0, len(ref)))
        for e in edits_between_anchors(ref, s):
            found[e[:3]].add(i)
    lo, hi = max(a for a, _ in spans), min(b for _, b in spans)
    return {e: frozenset(r) for e, r in found.items() if lo <= e[0] and e[1] <= hi}


def _spaced(places: list[int], gap: int) -> int:
    n, last = 0, None
    for p in sorted(places):
        if last is None or p - last > gap:
            n, last = n + 1, p
    return n


def by_same_reads(edits: dict[Edit, frozenset[int]], n: int, least_edits: int = 5, gap: int = 100, least_reads: int = 3) -> list[list[int]] | None:
    """Five or more SNPs or double SNPs, over 100 apart, that share one set of reads (or its complement), of at least three on either side; the set with
    most SNPs splits, and equal ones split together."""
    groups: dict[frozenset[int], list[int]] = defaultdict(list)
    for e, r in edits.items():
        if (is_snp(e) or is_double_snp(e)) and least_reads <= len(r) <= n - least_reads:
            groups[min(r, frozenset(range(n)) - r, key=lambda s: (len(s), sorted(s)))].append(e[0])
    score = {r: k for r, p in groups.items() if (k := _spaced(p, gap)) >= least_edits}
    if not score:
        return None
    best = [r for r, k in score.items() if k == max(score.values())]
    return _by_vector([[i in r for r in best] for i in range(n)])


def _by_vector(vectors: list[list]) -> list[list[int]] | None:
    groups: dict[tuple, list[int]] = defaultdict(list)
    for i, v in enumerate(vectors):
        groups[tuple(v)].append(i)
    return sorted(groups.values()) if len(groups) > 1 else None


def biallelic_sites(edits: dict[Edit, frozenset[int]], ref: str, n: int, least: int = 3) -> list[tuple[int, list]]:
    """Sites (place, allele of each read) of SNPs, double SNPs and large indels that no other edit overlaps, both alleles in ``least`` reads."""
    out, reach = [], -1
    order = sorted(edits)
    for i, e in enumerate(order):
        alone = e[0] > reach and (i + 1 == len(order) or order[i + 1][0] > e[1])
        reach = max(reach, e[1])
        if alone and least <= len(edits[e]) <= n - least and (is_snp(e) or is_double_snp(e) or is_big_indel(e) and not is_microsatellite(e, ref)):
            out.append((e[0], [i in edits[e] for i in range(n)]))
    return out


def base_sites(edits: dict[Edit, frozenset[int]], ref: str, n: int) -> list[tuple[int, list]]:
    """Sites of single bases: each read's base there (or a deletion), alleles in at least max(5, 10 %) reads; max(10, 10 %) by deletions."""
    at: dict[int, dict[int, str]] = defaultdict(dict)
    for e, reads in edits.items():
        if len(e[2]) == e[1] - e[0]:
            for k, x in enumerate(e[2]):
                if ref[e[0] + k] != x:
                    at[e[0] + k].update(dict.fromkeys(reads, x))
        elif not e[2]:
            for p in range(e[0], e[1]):
                at[p].update(dict.fromkeys(reads, "-"))
    gone = {p for p, a in at.items() if "-" in a.values()}
    out = []
    for p in sorted(at):
        alleles = [at[p].get(i, ref[p]) for i in range(n)]
        least = max(10 if gone & {p - 1, p, p + 1} else 5, n / 10)
        count = Counter(alleles)
        if sum(c >= least for c in count.values()) >= 2 and count.most_common(2)[1][0] != "-":
            out.append((p, alleles))
    return out


def bubble_sites(ref: str, reads: list[str]) -> list[tuple[int, list]]:
    """Stretches between conserved ones at which the reads have exactly two strings, each in at least max(5, 10 %) of them."""
    matches = [match_regions(ref, s) for s in reads]
    place = [{r + i: q + i for r, q, k in m for i in range(k)} for m in matches]
    spans = conserved(ref, reads, matches)
    out = []
    for (_, a), (b, _) in zip(spans, spans[1:], strict=False):
        alleles = [s[p[a - 1] + 1 : p[b]] for s, p in zip(reads, place, strict=True)]
        count = Counter(alleles)
        if len(count) == 2 and min(count.values()) >= max(5, len(reads) / 10):
            out.append((a, alleles))
    return out


def by_two_sites(sites: list[tuple[int, list]], n: int, gap: int = 200) -> list[list[int]] | None:
    """Two sites ``gap`` apart whose pairs of alleles, joined where they differ at one site, form exactly two components, the smaller of at least
    max(10, 10 %) reads; the pair with the largest smaller part splits."""
    best: tuple[int, list[list[int]]] | None = None
    for (p, a), (q, b) in combinations(sites, 2):
        if abs(q - p) >= gap:
            groups = _components(list(zip(a, b, strict=True)), 1)
            small = min(map(len, groups))
            if len(groups) == 2 and small >= max(10, n / 10) and (best is None or small > best[0]):
                best = (small, groups)
    return best[1] if best else None


def by_three_sites(sites: list[tuple[int, list]], n: int, gap: int = 100) -> list[list[int]] | None:
    """Three sites ``gap`` apart whose triples of alleles, joined where two of three agree, form two or more components of at least
    max(5, 5 %) reads each; the first such triple splits."""
    blocks = list({tuple(a): (p, a) for p, a in reversed(sites)}.values())[::-1]
    for (p, a), (q, b), (r, c) in combinations(sorted(blocks, key=lambda s: s[0]), 3):
        if q - p >= gap and r - q >= gap:
            groups = _components(list(zip(a, b, c, strict=True)), 1)
            if len(groups) > 1 and min(map(len, groups)) >= max(5, n / 20):
                return groups
    return None


def _components(vectors: list[tuple], differ: int) -> list[list[int]]:
    kinds = sorted(set(vectors), key=repr)
    groups = Groups(len(kinds))
    for i, j in combinations(range(len(kinds)), 2):
        if sum(x != y for x, y in zip(kinds[i], kinds[j], strict=True)) <= differ:
            groups.join(i, j)
    number = {k: groups.find(i) for i, k in enumerate(kinds)}
    out: dict[int, list[int]] = defaultdict(list)
    for i, v in enumerate(vectors):
        out[number[v]].append(i)
    return sorted(out.values())


def by_bubble_lengths(ref: str, reads: list[str]) -> list[list[int]] | None:
    """Single-linkage of the strings between conserved stretches, at max(20, 10 % of their length); all parts need min(max(5, 5 %), 20) reads."""
    matches = [match_regions(ref, s) for s in reads]
    place = [{r + i: q + i for r, q, k in m for i in range(k)} for m in matches]
    spans = conserved(ref, reads, matches)
    least = min(max(5, len(reads) / 20), 20)
    for (_, a), (b, _) in zip(spans, spans[1:], strict=False):
        alleles = [s[p[a - 1] + 1 : p[b]] for s, p in zip(reads, place, strict=True)]
        kinds = sorted(set(alleles))
        if len(kinds) < 2 or max(map(len, kinds)) < 20:
            continue
        groups = Groups(len(kinds))
        for i, j in combinations(range(len(kinds)), 2):
            most = int(max(20, max(len(kinds[i]), len(kinds[j])) / 10))
            if groups.find(i) != groups.find(j) and edit_distance(kinds[i], kinds[j], most) <= most:
                groups.join(i, j)
        number = {k: groups.find(i) for i, k in enumerate(kinds)}
        parts: dict[int, list[int]] = defaultdict(list)
        for i, x in enumerate(alleles):
            parts[number[x]].append(i)
        if len(parts) > 1 and min(map(len, parts.values())) >= least:
            return sorted(parts.values())
    return None


def by_linked_minor_alleles(edits: dict[Edit, frozenset[int]], n: int, gap: int = 100) -> list[list[int]] | None:
    """The first pair of edits ``gap`` apart, each in max(10, 10 %) reads or more on either side, of whose four combinations one or two are
    missing and the others have at least 10 reads."""
    c = max(10, n / 10)
    usable = sorted(e for e, r in edits.items() if c <= len(r) <= n - c)
    for e, f in combinations(usable, 2):
        if f[0] - e[1] >= gap:
            a, b = edits[e], edits[f]
            cells = [len(a & b), len(a - b), len(b - a), n - len(a | b)]
            if 0 in cells and min(x for x in cells if x) >= 10 and sum(x > 0 for x in cells) in (2, 3):
                return _by_vector([[i in a, i in b] for i in range(n)])
    return None


def by_correlated_snps(edits: dict[Edit, frozenset[int]], ref: str, n: int, gap: int = 100, p_most: float = 1e-6) -> list[list[int]] | None:
    """The SNP, in max(10, 20 %) reads or more on either side, that agrees best with another edit ``gap`` away: at most two reads disagree and
    the binomial tail of the agreement is under ``p_most``."""
    c = max(10, n / 5)
    usable = sorted(e for e, r in edits.items() if c <= len(r) <= n - c)
    best: tuple[float, frozenset[int]] | None = None
    for e in (x for x in usable if is_snp(x)):
        for f in usable:
            if abs(f[0] - e[0]) >= gap:
                a, b = edits[e], edits[f]
                same = len(a & b) + n - len(a | b)
                same = max(same, n - same)
                p = binomial_tail(same, n, 0.5)
                if n - same <= 2 and p < p_most and (best is None or p < best[0]):
                    best = (p, a)
    return _by_vector([[i in best[1]] for i in range(n)]) if best else None


def by_edit_linkage(edits: dict[Edit, frozenset[int]], ref: str, n: int, gap: int = 100) -> list[list[int]] | None:
    """Four (under 20 reads) or five edits at as many places ``gap`` apart that share one set of reads, of as many reads at least on either
    side, with a SNP or a large indel among them."""
    need = 4 if n < 20 else 5
    groups: dict[frozenset[int], list[Edit]] = defaultdict(list)
    for e, r in edits.items():
        if need <= len(r) <= n - need:
            groups[min(r, frozenset(range(n)) - r, key=lambda s: (len(s), sorted(s)))].append(e)
    good = [r for r, es in groups.items() if len(es) >= need and _spaced([e[0] for e in es], gap - 1) >= need and any(is_snp(e) or is_big_indel(e) and not is_microsatellite(e, ref) for e in es)]
    return _by_vector([[i in r for r in sorted(good, key=sorted)] for i in range(n)]) if good else None


def by_lengths(reads: list[str]) -> list[list[int]] | None:
    """Gaps of max(15, 5 %) in the sorted lengths with at least 10 reads on either side."""
    order = sorted(range(len(reads)), key=lambda i: (len(reads[i]), i))
    parts = [[order[0]]] if order else []
    for a, b in zip(order, order[1:], strict=False):
        if len(reads[b]) - len(reads[a]) >= max(15, len(reads[a]) / 20):
            parts.append([])
        parts[-1].append(b)
    return sorted(map(sorted, parts)) if len(parts) > 1 and min(map(len, parts)) >= 10 else None


def split(consensus: str, reads: list[str], corrected: bool = False) -> list[list[int]] | None:
    """The first split that any rule finds, in the order of the rules; rules of weaker evidence only for self-corrected reads."""
    n = len(reads)
    edits = gather(consensus, reads)
    rules = [lambda: by_same_reads(edits, n)]
    for sites in (lambda: biallelic_sites(edits, consensus, n), None, lambda: base_sites(edits, consensus, n), lambda: bubble_sites(consensus, reads)):
        if sites is None:
            rules.append(lambda: by_bubble_lengths(consensus, reads))
        else:
            rules += [lambda s=sites: by_two_sites(s(), n), lambda s=sites: by_three_sites(s(), n)]
    if corrected:
        rules += [lambda: by_linked_minor_alleles(edits, n), lambda: by_correlated_snps(edits, consensus, n), lambda: by_edit_linkage(edits, consensus, n)]
    return next((found for rule in rules if (found := rule())), None)


def phase(reads: list[str], least: int = 6) -> list[list[int]]:
    """Groups of reads, split again and again while any rule applies; groups of under ``least`` reads are left whole."""
    out, todo = [], [list(range(len(reads)))]
    while todo:
        group = todo.pop()
        parts = None
        if len(group) >= least:
            own = [reads[i] for i in group]
            consensus = polish(sorted(own, key=lambda s: (len(s), s))[len(own) // 2], own)
            parts = split(consensus, own)
            if parts is None:
                own = self_correct(own)
                parts = split(polish(consensus, own), own, corrected=True)
        if parts:
            todo += [[group[i] for i in p] for p in parts]
        else:
            out.append(group)
    return sorted(out)
