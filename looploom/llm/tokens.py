"""Token ids of whole texts by the tokenizers library, or by its merges in numpy for pre-tokens of plain characters.

BPE of these vocabularies never joins what white space separates, nor what their pre-tokenizers part. So a text's ids are those of its
chunks (a word, with the white space before it where that counts), one after another, and a chunk's are those of its pre-tokens. The different
chunks of a batch are parted and encoded all at once (:mod:`looploom.llm.merges`). Those with an apostrophe are parted one by one, and
pre-tokens of more than LONG bytes go to the library's model; a worker remembers these in two generations: what the younger one
lacks is taken over from the older one, and when the younger is full it becomes the older. So what is in use stays, whenever it first
came, and memory is bounded. Chunks with characters other than those of
:data:`LATIN`, vocabularies with another pre-tokenizer, and texts with special tokens' strings or rare white space go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from looploom.llm.merges import Merges
from looploom.llm.text import keep

#: Chunks and pre-tokens in a generation of a worker's memory, for each vocabulary.
CHUNKS, PARTS = 200_000, 400_000
#: Longer pre-tokens (bytes) go to the library's model, as each merge is a step for all.
LONG = 32
END_ID = 2
#: A batch of texts is closed at so many rows or characters, whichever comes first; a longer text is a batch alone.
BATCH_ROWS, BATCH_CHARS = 1024, 3_000_000

#: Rare white space, and what stands between chunks here: texts with such are given to the library whole.
_OTHER_SPACE = re.compile("[\0\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")

# The pre-tokenizers of the two vocabulary files, with letters and digits narrowed to those of LATIN.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
LATIN = re.compile(rf"[\x20\x09-\x0D!-~¡§«»°¿‐-‧{LETTERS}]*")
WORD_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s0-9{LETTERS}]+")
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+")

# The same by bytes of UTF-8: kinds (white space, letters, digits, others), bytes that LATIN has not and such as depend on the next, lower case.
SPACE, LETTER, DIGIT, OTHER = range(4)
_KIND = np.array([SPACE if 9 <= b <= 13 or b == 32 else DIGIT if 48 <= b <= 57 else LETTER if chr(b).isalpha() and b < 128 or b == 0xC3 else OTHER for b in range(256)], np.uint8)
_FOREIGN = np.array([b < 32 and not 9 <= b <= 13 or b == 127 or b >= 0xC0 and b not in (0xC2, 0xC3, 0xE2) for b in range(256)])
_MARKS = np.array([b in (0xA1, 0xA7, 0xAB, 0xB0, 0xBB, 0xBF) for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def batches(texts: list[str | None], rows: int = BATCH_ROWS, chars: int = BATCH_CHARS) -> Iterator[slice]:
    """Slices of ``texts`` of up to ``rows`` texts and, but for a single longer text, ``chars`` characters."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and (i - start >= rows or size + n > chars):
            yield slice(start, i)
            start, size = i, 0
        size += n
    if start < len(texts):
        yield slice(start, len(texts))


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: visible Latin-1 characters for themselves, the others from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


def _strings(values: pa.Array, between: str) -> list[str]:
    """An Arrow array as a list (``between`` is in none of the values), made by one split, which is much faster than a value at a time."""
    if not len(values):
        return []
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(pa.string())), between)[0].as_py().split(between)


def _buffers(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow array of large strings or binaries without nulls."""
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]], offsets - offsets[0]


def _joined(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids one after another, and how many of them each has."""
    return np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids], np.int64)


class _Memo:
    """Two generations of remembered values."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def turn(self) -> None:
        """Begin a generation if the younger is full."""
        if len(self.young) >= self.most:
            self.young, self.old = {}, self.young


class Encoder:
    """``encode(texts)``: for each text the bytes of its ids as little-endian unsigned 32-bit integers. Null texts count as empty."""

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file if os.path.isabs(file) else public_tokenizers.path(file))
        self.model = self.tokenizer.model
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special, self.folded = [t.content for t in added], any(t.normalized for t in added)
        # a vocabulary with word ends drops white space and case; a byte-level one keeps them
        self.drops_space = self.tokenizer.normalizer is not None
        self.letters = _byte_letters()
        spec = json.loads(self.tokenizer.to_str())
        self.parts_of = self._parts_pattern(spec)
        self.merges = Merges.of(spec["model"], self.letters) if self.parts_of else None
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.chunks, self.parts = _Memo(CHUNKS), _Memo(PARTS)

    @classmethod
    def of(cls, file: str) -> Encoder:
        """The encoder of this process for a vocabulary file (a name of the public collection, or a path)."""
        return keep(("encoder", file, CHUNKS, PARTS), lambda: cls(file))

    def _parts_pattern(self, spec: dict) -> re.Pattern | None:
        """How this vocabulary's pre-tokenizer parts a chunk, or None if it is not one of the known two."""
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("byte_fallback"):
            return None
        if not self.drops_space and pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"]:
            return BYTE_PARTS
        steps = pre.get("pretokenizers", [])
        normal = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        if normal == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": WORD_PATTERN} and not steps[1]["add_prefix_space"]:
            return WORD_PARTS
        return None

    def _ask(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _part(self, part: str) -> bytes:
        """Ids of a pre-token by the library's model."""
        ids = self.parts.old.get(part)
        if ids is None:
            # visible ASCII is written as it is, but for spaces
            plain = part.isascii() and part.isprintable()
            letters = part.replace(" ", self.letters[32]) if plain else part.encode().decode("latin-1").translate(self.letters)
            ids = b"".join([self.id_bytes[t.id] for t in self.model.tokenize(letters)])
        self.parts.young[part] = ids
        return ids

    def _new(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks that the younger generation lacks."""
        out, whole, old, known, ask = {}, [], self.chunks.old, self.parts.young, self._part
        plain, split, lower = LATIN.fullmatch, self.parts_of and self.parts_of.findall, self.drops_space
        for c in chunks:
            ids = old.get(c)
            if ids is None:
                if split is None or not (c.isascii() or plain(c)):
                    whole.append(c)
                    continue
                p = c.lower() if lower else c
                # ASCII letters, with or without one space before them, are one pre-token
                if p.isascii() and (p[1:] if p[:1] == " " else p).isalpha():
                    ids = known.get(p) or ask(p)
                else:
                    got = [known.get(x) or ask(x) for x in split(p)]
                    ids = got[0] if len(got) == 1 else b"".join(got)
            out[c] = ids
        if whole:
            out.update(zip(whole, self._ask(whole), strict=True))
        self.parts.turn()
        return out

    def _split(self, texts: pa.Array) -> pa.ListArray:
        """The chunks of each text."""
        if self.drops_space:
            return pc.ascii_split_whitespace(texts)
        # a chunk begins before each run of white space
        there = [c for c in " \n\t\r" if pc.any(pc.match_substring(texts, c)).as_py()]
        for c in there:
            texts = pc.replace_substring(texts, c, "\0" + c)
        for c in there:
            texts = pc.replace_substring(texts, c + "\0", c)
        return pc.split_pattern(texts, "\0")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [x for s in batches(texts) for x in self._encode(texts[s])]

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        odd = [i for i, t in enumerate(texts) if t and (_OTHER_SPACE.search(t) or self.folded or any(s in t for s in self.special))]
        given = ["" if t is None else t for t in texts]
        for i in odd:
            given[i] = ""
        lists = self._split(pa.array(given, pa.large_string()))
        chunks = lists.flatten().dictionary_encode()
        flat, size = self._ids(chunks.dictionary)
        start, at = np.cumsum(size) - size, chunks.indices.to_numpy()
        n = size[at]
        ends = np.cumsum(n)
        out = flat[np.arange(n.sum()) + np.repeat(start[at] - ends + n, n)].tobytes()
        cuts = (4 * np.r_[0, ends][lists.offsets.to_numpy() - lists.offsets[0].as_py()]).tolist()
        done = [out[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        for i, x in zip(odd, self._ask([texts[i] for i in odd]), strict=True):
            done[i] = x
        return done

    def _ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different chunks, one after another, and how many each has."""
        if self.merges is None or not len(chunks):
            return _joined(self._remembered(_strings(chunks, " " if self.drops_space else "\0")))
        one = self._by_one(*_buffers(chunks))
        if not one.any():
            return self._at_once(*_buffers(chunks))
        flat, size = self._at_once(*_buffers(chunks.filter(pa.array(~one))))
        other, n = _joined(self._remembered(_strings(chunks.filter(pa.array(one)), " " if self.drops_space else "\0")))
        both = np.empty(len(one), np.int64)
        both[~one], both[one] = size, n
        of = np.repeat(one, both)
        out = np.empty(len(of), np.uint32)
        out[~of], out[of] = flat, other
        return out, both

    def _by_one(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which chunks have an apostrophe or characters that LATIN has not."""
        bad = _FOREIGN.take(data) | (data == 0x27)
        after = np.r_[data[1:], np.zeros(2, np.uint8)]
        lead = np.flatnonzero(data >= 0xC2)
        b, x, y = data[lead], after[lead], after[lead + 1]
        bad[lead] |= ((b == 0xC2) & ~_MARKS[x]) | ((b == 0xC3) & ((x == 0x97) | (x == 0xB7))) | ((b == 0xE2) & ~((x == 0x80) & (y >= 0x90) & (y <= 0xA7)))
        out = np.zeros(len(offsets) - 1, bool)
        out[np.searchsorted(offsets, np.flatnonzero(bad), side="right") - 1] = True
        return out

    def _at_once(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`_ids`, for chunks of LATIN characters without apostrophes."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        kind, letter = _KIND.take(data), np.flatnonzero(data == 0xC3) + 1
        kind[letter] = LETTER
        starts = np.r_[True, kind[1:] != kind[:-1]]
        if self.drops_space:
            starts |= kind == DIGIT
            data = _LOWER.take(data)
            data[letter[data[letter] <= 0x9E]] += 32
        else:
            # the last of a run of white space is a part, with what follows if it is a space
            inside = np.ones(len(data) + 1, bool)
            inside[offsets] = False
            spaces = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & inside[1:-1])
            starts[spaces] = True
            starts[spaces[data[spaces] == 32] + 1] = False
        starts[offsets[:-1][np.diff(offsets) > 0]] = True
        begin = np.flatnonzero(starts)
        edges = np.r_[begin, len(data)]
        parts = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
        flat, size = self._parts(*_buffers(parts.dictionary))
        first, at = np.cumsum(size) - size, parts.indices.to_numpy()
        n = size[at]
        ends = np.r_[0, np.cumsum(n)]
        cuts = ends[np.searchsorted(begin, offsets)]
        return flat[np.arange(ends[-1]) + np.repeat(first[at] - ends[:-1], n)], np.diff(cuts)

    def _parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different pre-tokens (of lower case, where that counts), one after another, and how many each has."""
        size = np.diff(offsets)
        long = size > LONG
        if not long.any():
            return self.merges.encode(data, size)
        known, ask = self.parts.young, self._part
        texts = [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1][long].tolist(), offsets[1:][long].tolist(), strict=True)]
        other, n = _joined([known.get(p) or ask(p) for p in texts])
        self.parts.turn()
        of = np.repeat(long, size)
        flat, k = self.merges.encode(data[~of], size[~long]) if not long.all() else (np.zeros(0, np.uint32), 0)
        both = np.empty(len(size), np.int64)
        both[~long], both[long] = k, n
        of = np.repeat(long, both)
        out = np.empty(len(of), np.uint32)
        out[~of], out[of] = flat, other
        return out, both

    def _remembered(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk, most of them different."""
        ids = list(map(self.chunks.young.get, chunks))
        if None in ids:
            new = self._new([c for c, x in zip(chunks, ids, strict=True) if x is None])
            ids = [new[c] if x is None else x for c, x in zip(chunks, ids, strict=True)]
            self.chunks.young.update(new)
            self.chunks.turn()
        return ids
