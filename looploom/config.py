"""Parameters of the pipelines, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    """``k`` of the graph; ``recruit_k``/``recruit_min`` for accurate reads and ``long_k`` for long ones; edit limits of the clustering."""

    k: int = 101
    recruit_k: int = 101
    recruit_min: int = 2000
    long_k: int = 21
    max_edits: int = 200
    min_edits: int = 5
    min_kmer: int = 2
    extra_phasing: bool = False
    approx_unit: int | None = None
    sample: str = ""
    annotation_fasta: str | None = None
    annotation_gff3: str | None = None

    def __post_init__(self):
        if self.k < 31 or self.k % 2 == 0:
            raise ValueError("k must be odd and at least 31")
        if (self.annotation_fasta is None) != (self.annotation_gff3 is None):
            raise ValueError("annotation needs both a FASTA and a GFF3 file")
        if min(self.max_edits, self.min_edits, self.recruit_min) < 0 or self.min_kmer < 1:
            raise ValueError("limits must not be negative")

    @property
    def resolve_length(self) -> int:
        """Repeats up to this length are told apart when the cycle is sought."""
        return 0 if self.approx_unit is None else 100 + self.approx_unit // 50

    @classmethod
    def human(cls, **changes) -> Params:
        """Preset for units of about 45 kilobases."""
        return replace(cls(approx_unit=45000), **changes)


def command_line(argv: list[str] | None = None):
    """Options of the three modes; see :mod:`looploom.plans.pipelines`."""
    import argparse

    p = argparse.ArgumentParser(prog="looploom")
    p.add_argument("mode", choices=("reference", "tangles"))
    p.add_argument("-i", "--in", dest="reads", nargs="+", required=True, help="accurate reads")
    p.add_argument("--nano", nargs="*", default=[], help="long reads")
    p.add_argument("-r", "--reference", nargs="+", default=[], help="sequences of the locus")
    p.add_argument("-a", "--assembly", help="assembly graph (GFA) for the mode tangles")
    p.add_argument("-c", "--tangles", nargs="*", default=[], help="node lists, one a tangle")
    p.add_argument("-o", "--out", default="./result")
    p.add_argument("-x", "--preset", choices=("human",))
    p.add_argument("-k", type=int, default=101)
    p.add_argument("--approx-morphsize", type=int)
    p.add_argument("--morph-cluster-maxedit", type=int, default=200)
    p.add_argument("--morph-recluster-minedit", type=int, default=5)
    p.add_argument("--orient-by-reference")
    p.add_argument("--sample-name", default="")
    p.add_argument("--annotation-reference-fasta")
    p.add_argument("--annotation-gff3")
    p.add_argument("--extra-phasing", action="store_true")
    p.add_argument("--verbose", action="count", default=0)
    a = p.parse_args(argv)
    params = Params(k=a.k, recruit_k=a.k, max_edits=a.morph_cluster_maxedit, min_edits=a.morph_recluster_minedit, extra_phasing=a.extra_phasing, approx_unit=45000 if a.preset == "human" and a.approx_morphsize is None else a.approx_morphsize, sample=a.sample_name, annotation_fasta=a.annotation_reference_fasta, annotation_gff3=a.annotation_gff3)
    return a, params
