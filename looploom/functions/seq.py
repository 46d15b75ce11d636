"""Column functions on sequences, node paths and variants. All are built-in expressions (no Python at run time)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Letters of either case to bases, for deriving sequences from text (fixed table).
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASES = "ACGTACGTACGTACGTACGTACGTACACGTACGTACGTACGTACGTACGTAC"


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dna(text) -> Column:
    """A sequence of A, C, G, T derived from any text, letter by letter; other characters are dropped."""
    return F.regexp_replace(F.translate(c(text), LETTERS, BASES), "[^ACGT]", "")


def revcomp(seq) -> Column:
    """Reverse complement; characters other than A, C, G, T (either case) stay as they are, at their mirrored places."""
    return F.translate(F.reverse(c(seq)), "ACGTacgt", "TGCATGCA")


def clean_bases(seq) -> Column:
    """Upper-case sequence in which anything but A, C, G, T reads as A."""
    return F.regexp_replace(F.upper(c(seq)), "[^ACGT]", "A")


def base_codes(seq) -> Column:
    """Digits 0 to 3 for A, C, G, T."""
    return F.translate(clean_bases(seq), "ACGT", "0123")


def homopolymer_compress(seq) -> Column:
    """One character for each run of equal characters."""
    return F.regexp_replace(c(seq), r"(?s)(.)\1+", "$1")


def name_without_tags(name) -> Column:
    """What stands before the first space or tab."""
    return F.regexp_extract(c(name), r"^[^ \t]*", 0)


def split_nonempty(s, sep: str) -> Column:
    """Fields between separators (a literal string); empty fields are dropped."""
    return F.filter(F.split(c(s), rf"\Q{sep}\E"), lambda x: x != "")


def node(name: Column, fwd: Column) -> Column:
    return F.struct(name.alias("id"), fwd.alias("fwd"))


def parse_path(path) -> Column:
    """``>a<b`` to an array of (``id``, ``fwd``)."""
    return F.transform(F.regexp_extract_all(c(path), F.lit("[<>][^<>]+"), F.lit(0)), lambda x: node(F.substring(x, 2, 1 << 30), F.substring(x, 1, 1) == ">"))


def parse_gapped_path(path) -> Column:
    """Like :func:`parse_path`, with gaps written in square brackets left out."""
    return parse_path(F.regexp_replace(c(path), r"\[[^\]]*\]", ""))


def flip_path(path) -> Column:
    """The path read from its other end: reversed, with each node flipped."""
    return F.transform(F.reverse(c(path)), lambda n: node(n["id"], ~n["fwd"]))


def path_string(path) -> Column:
    return F.array_join(F.transform(c(path), lambda n: F.concat(F.when(n["fwd"], ">").otherwise("<"), n["id"].cast("string"))), "")


def _order(path: Column) -> Column:
    # reverse nodes come before forward nodes, then by id
    return F.transform(path, lambda n: F.struct(n["fwd"].alias("f"), n["id"].alias("i")))


def canonical_path(path) -> Column:
    """The smaller of a path and its flip."""
    p, q = c(path), flip_path(path)
    return F.when(_order(p) <= _order(q), p).otherwise(q)


def canonical_edge(a, b) -> Column:
    """The smaller of an oriented edge and its mirror, as a path of two nodes."""
    return canonical_path(F.array(c(a), c(b)))


def is_indel(ref_len, alt) -> Column:
    return c(ref_len) != F.length(c(alt))


def is_snp(ref_len, alt) -> Column:
    return (c(ref_len) == 1) & (F.length(c(alt)) == 1)


def is_double_snp(ref_len, alt) -> Column:
    return (c(ref_len) == 2) & (F.length(c(alt)) == 2)


def is_big_indel(ref_len, alt, least: int = 10) -> Column:
    return F.abs(c(ref_len) - F.length(c(alt))) >= least


def is_repeat_of(s, unit_len: Column) -> Column:
    """Whether ``s`` is a whole number of copies of its first ``unit_len`` characters."""
    n = F.length(c(s))
    return (n >= unit_len) & (n % unit_len == 0) & (F.repeat(F.substring(c(s), F.lit(1), unit_len), (n / unit_len).cast("int")) == c(s))


def is_microsatellite(change, left, right, longest: int = 9) -> Column:
    """Whether an inserted or deleted string repeats a unit of 1 to ``longest`` bases of which a copy stands next to it, left or right."""
    x = c(change)

    def unit(i):
        u = F.substring(x, F.lit(1), i)
        return is_repeat_of(x, i) & (F.endswith(c(left), u) | F.startswith(c(right), u))

    return (F.length(x) > 0) & F.exists(F.sequence(F.lit(1), F.lit(longest)), unit)


def tangle_number(name) -> Column:
    """``tangle7_…`` to 7, else null."""
    n = F.regexp_extract(c(name), r"^tangle(\d+)_", 1)
    return F.when(n != "", n.cast("bigint"))


def morph_name(prefix, index, kind, coverage) -> Column:
    p = F.when(c(prefix) != "", F.concat(c(prefix), F.lit("_"))).otherwise("")
    return F.concat(p, F.lit("morphconsensus"), c(index).cast("string"), F.lit("_"), c(kind), F.lit("_coverage"), c(coverage).cast("string"))


def morph_type(starts_anchored, ends_anchored) -> Column:
    s, e = c(starts_anchored), c(ends_anchored)
    return F.when(s & e, "isolated").when(s, "borderone").when(e, "bordertwo").otherwise("inner")


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it."""
    return F.transform(F.array(value), use)[0]


def wang_hash(key) -> Column:
    """Wang's 64-bit integer hash (fixed function). Sums wrap, so they are taken in 32-bit halves."""

    def add(a: Column, b: Column) -> Column:
        mask = F.lit(0xFFFFFFFF)
        low = a.bitwiseAND(mask) + b.bitwiseAND(mask)
        high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
        return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(mask))

    k = c(key).cast("long")
    for step in (
        lambda k: add(F.bitwise_not(k), F.shiftleft(k, 21)),
        lambda k: k.bitwiseXOR(F.shiftrightunsigned(k, 24)),
        lambda k: _let(add(k, F.shiftleft(k, 3)), lambda x: add(x, F.shiftleft(k, 8))),
        lambda k: k.bitwiseXOR(F.shiftrightunsigned(k, 14)),
        lambda k: _let(add(k, F.shiftleft(k, 2)), lambda x: add(x, F.shiftleft(k, 4))),
        lambda k: k.bitwiseXOR(F.shiftrightunsigned(k, 28)),
        lambda k: add(k, F.shiftleft(k, 31)),
    ):
        k = _let(k, step)
    return k


def interpolate(offset, path_len, start, end) -> Column:
    """A place in a path to one in the read, in proportion; start over end is the reverse strand. Truncated to an integer."""
    share = c(offset) / F.greatest(c(path_len), F.lit(1))
    return (c(start) + (c(end) - c(start)) * share).cast("bigint")


def parts(seq, n: int = 10) -> Column:
    """A sequence cut into ``n`` parts of nearly equal length."""
    size = F.length(c(seq))
    cut = lambda i: F.floor(size * i / n).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substring(c(seq), cut(i) + 1, cut(i + 1) - cut(i)))
