"""Operators of the llm sub-package against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash

from looploom.llm import cells, counts, lattice, lm, mixing, packing, quality, simhash, tokens, toxicity, urls, wavelet

WORD = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, g string, own long"


def texts(seed=0, n=60):
    r = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("the", "an", "er", "on", "Is", "ü") for b in ("", "ing", "ed.", ",", "ß")]
    out = [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 160))) for _ in range(n)]
    out += [None, "", "  \n\t ", "one", "two words", "a\nb\na\nb\n\n", "x " * 3000, out[3], out[3], out[4] + " tail", "it's  <|endoftext|> 日本語 🙂", "# $% | <b>" * 40]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    t = texts()
    rows = [(i * 3, x, None if i % 17 == 0 else "en" if i % 3 else "de", None if i % 13 == 0 else f"s{i % 2 * i % 3}", None, "clash", "g", 5) for i, x in enumerate(t)]
    return spark.createDataFrame([*rows, rows[5]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


# ---- 1: quality -------------------------------------------------------------------------------------------------------------------


def base(t):
    w = WORD.findall(t or "")
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_quality(docs, none):
    got = quality.quality_rules(docs)
    assert got.columns[:4] == ["doc_id", "text", "lang", "source"] and got.columns.count("n_words") == 1
    rows = got.collect()
    assert len(rows) == docs.count()
    for r in rows:
        n, c, s, d, k = base(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, c, s, d, k)
        assert r["base_failed"] == (n < 50 or 100 * k > 50 * n) and not (r["base_failed"] and r["kept"])
    assert quality.quality_rules(none).count() == 0


def test_quality_rejects_outliers(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    good = [" ".join(word() for _ in range(r.randint(60, 300))) for _ in range(300)]
    bad = [" ".join(word() + "%%%" for _ in range(100)) for _ in range(30)] + [" ".join(word() * 9 for _ in range(100)) for _ in range(30)]
    df = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(good + bad)], "doc_id long, text string, lang string, source string")
    kept = {x["doc_id"]: x["kept"] for x in quality.quality_rules(df).collect()}
    assert all(kept[i] for i in range(300)) and not any(kept[i] for i in range(300, 360))


def test_quality_rejects_repetition_alone(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(4, 8)))
    good = [" ".join(word() for _ in range(r.randint(60, 300))) for _ in range(300)]
    lines = ["\n".join(f"{w}\n" + " ".join(word() for _ in range(9)) for w in [word()] * 10) for _ in range(20)]  # 9 lines in 20 are copies
    phrases = [" ".join(f"{p} " + " ".join(word() for _ in range(11)) for p in [" ".join(word() for _ in range(9))] * 5) for _ in range(20)]
    df = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(good + lines + phrases)], "doc_id long, text string, lang string, source string")
    rows = {x["doc_id"]: x for x in quality.quality_rules(df).collect()}
    assert all(rows[i]["n_dup_lines"] == 9 and rows[i]["n_repeat_words"] == 0 for i in range(300, 320))
    assert all(rows[i]["n_dup_lines"] == 0 and rows[i]["n_repeat_words"] == 45 for i in range(320, 340))
    assert not any(x["base_failed"] for x in rows.values())
    assert all(rows[i]["kept"] for i in range(300)) and not any(rows[i]["kept"] for i in range(300, 340))


def test_quality_estimates_every_group(spark):
    """Groups of a few documents are judged by estimates of their own: what is usual in one is an outlier in the other."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    plain = lambda: " ".join(word() for _ in range(100))
    marked = lambda: " ".join(word() + "%%" for _ in range(100))
    rows = [("en", "a", plain()) for _ in range(12)] + [("en", "b", marked()) for _ in range(12)] + [(None, None, plain())] + [("en", "a", marked()), ("en", "b", plain())]
    df = spark.createDataFrame([(None if i == 3 else i, t, x, s) for i, (x, s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    got = quality.quality_rules(df).collect()
    assert len(got) == 27 and sorted(x["doc_id"] for x in got if not x["kept"]) == [25, 26]


# ---- 2: language model -------------------------------------------------------------------------------------------------------------


def test_lm(docs, none):
    model = lm.fit(docs.select("text"), rounds=(0.1,), share=1)
    n, s = model.score([t for t in by_id(docs).values()])
    got = {r["doc_id"]: r for r in lm.score_lm(docs, model).collect()}
    for i, (k, (a, b)) in enumerate(zip(by_id(docs), zip(n, s, strict=True), strict=True)):
        assert got[k]["n_tokens"] == a == len(WORD.findall(by_id(docs)[k] or "")) if i < 3 else got[k]["n_tokens"] == a
        assert math.isclose(got[k]["log_probability"], b, rel_tol=1e-5, abs_tol=1e-5)
        assert (got[k]["mean_log_probability"] is None) == (a == 0)
    # the conditional distribution sums to one, and a sum over places is the sum of its terms
    around = np.array([[1], [2], [3], [lm.EDGE]]).repeat(lm.TOKENS, axis=1)
    assert math.isclose(float(np.exp(model.log_probability(np.arange(lm.TOKENS), around)).sum()), 1, rel_tol=1e-4)
    ids = model.tokens(["the an the er"])
    token, sides = model.sides(ids)
    assert sides[:, 0].tolist() == [lm.EDGE, lm.EDGE, ids[0][1], ids[0][2]] and token.tolist() == ids[0].tolist()
    untrained = lm.Model(list(model.own), lm.Model.start(np.ones(lm.TOKENS)))
    assert model.score(texts())[1].sum() > untrained.score(texts())[1].sum()
    assert lm.score_lm(none, lm.fit(none.select("text"))).count() == 0


def test_lm_trains_on_every_place(docs, monkeypatch):
    kept, places = lm.materialize, []

    def spy(df, name):
        out = kept(df, name)
        if name == "models":
            places.append(sum(r["places"] for r in out.select("places").collect()))
        return out

    monkeypatch.setattr(lm, "materialize", spy)
    lm.fit(docs.select("text").coalesce(1))  # one partition: no averages are materialized
    assert sum(places) == sum(len(WORD.findall(r["text"] or "")) for r in docs.collect())


def test_lm_tells_rare_words_apart(spark, monkeypatch):
    monkeypatch.setattr(lm, "OWN", 1)  # 33 * 33 tokens, of which 65 words
    rows = [(i, f"w{i % 65}a " * 30) for i in range(65)] + [(100, "walking " * 20), (101, "xqzking"), (102, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm.fit(docs)
    assert len(model.own) == 65 and "walking" not in model.own
    p = dict(zip(("walking", "xqzking", "unking"), np.exp(model.score(["walking", "xqzking", "unking"])[1]), strict=True))
    assert math.isclose(p["walking"], 20 * p["xqzking"], rel_tol=1e-5) and math.isclose(p["unking"], p["xqzking"], rel_tol=1e-5)
    ended = model.first + lm.ending("king")
    whole = float(np.exp(model.log_probability(np.array([ended]), np.full((4, 1), model.edge)))[0])
    assert math.isclose(p["walking"] + p["xqzking"] + p["unking"], whole, rel_tol=1e-5)
    got = {r["doc_id"]: r["log_probability"] for r in lm.score_lm(docs, model).collect()}
    model.known = None  # as for more words than are sent out
    joined = {r["doc_id"]: r["log_probability"] for r in lm.score_lm(docs, model).collect()}
    assert got.keys() == joined.keys() and all(math.isclose(got[i], joined[i], rel_tol=1e-6) for i in got)


def test_lm_vocabulary_grows(spark, monkeypatch):
    monkeypatch.setattr(lm, "LEAST", 2)
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i * 1000, i * 1000 + 1000)) + " ") for i in range(5)] * 2, "doc_id long, text string")
    model = lm.fit(docs)
    assert len(model.own) == 5000 and model.classes == model.inside == 78
    around = np.full((4, model.edge), model.edge)
    assert math.isclose(float(np.exp(model.log_probability(np.arange(model.edge), around)).sum()), 1, rel_tol=1e-4)
    assert np.isfinite(model.score(["w1 w4999 none"])[1]).all()


def test_lm_gradient():
    r = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in lm.Model.start(r.random(lm.TOKENS) * 9).items()}
    m = lm.Model([], w)
    token, around = r.integers(0, lm.TOKENS, 40), r.integers(0, lm.TOKENS + 1, (4, 40))
    loss, grad, _ = m.gradients(token, around)
    assert math.isclose(loss, -m.log_probability(token, around).mean())
    for k in ("b", "C", "c", "T", "t"):
        flat, i = w[k].reshape(-1), int(np.argmax(np.abs(grad[k])))
        old = flat[i]
        flat[i] = old + 1e-5
        up = m.gradients(token, around)[0]
        flat[i] = old - 1e-5
        down = m.gradients(token, around)[0]
        flat[i] = old
        assert math.isclose((up - down) / 2e-5, grad[k].reshape(-1)[i], rel_tol=1e-4)


# ---- 3: SimHash --------------------------------------------------------------------------------------------------------------------


def brute_fingerprint(t, k=3):
    w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, near):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in near:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash(docs, none):
    t = by_id(docs)
    fp = {i: brute_fingerprint(x) for i, x in t.items()}
    want = brute_components(t, [(a, b) for a in t for b in t if a < b and (fp[a] ^ fp[b]).bit_count() <= 3])
    rows = simhash.simhash_components(docs).collect()
    assert len(rows) == docs.count()
    assert all(r["fp"] & (1 << 64) - 1 == fp[r["doc_id"]] and r["component_id"] == want[r["doc_id"]] for r in rows)
    assert simhash.simhash_components(none).count() == 0


@pytest.mark.parametrize("cell_rows", [4096, 50])
def test_grid_loses_no_link(spark, monkeypatch, cell_rows):
    """Chance links, chains and a dense cluster; with small tasks, hot cells are divided."""
    monkeypatch.setattr(simhash, "CELL_ROWS", cell_rows)
    r = random.Random(4)
    some = [r.getrandbits(64) for _ in range(150)]
    near = [x ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 5))) for x in some[:60] for _ in range(4)]
    hub = [some[99] ^ sum(1 << 4 * b for b in r.sample(range(12), r.randint(1, 6))) for _ in range(900)]
    fps = sorted({*some, *near, *hub})
    signed = {x: x - (1 << 64) if x >> 63 else x for x in fps}
    from looploom.operators.components import connected_components

    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed.values()], "fp long"))
    got = dict(map(tuple, connected_components(links).collect()))
    a = np.array(fps, np.uint64)
    want = brute_components(signed.values(), [(signed[fps[i]], signed[fps[i + 1 + int(j)]]) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 3)])
    assert all(got.get(k, k) == v for k, v in want.items())


def test_divided_cells_meet_once(spark):
    rows = spark.createDataFrame([(c, i) for c in (1, 2) for i in range(40 if c == 1 else 3)], "cell long, id long")
    out = cells.divided(rows, rows.groupBy("cell").count().withColumnRenamed("count", "n"), 7).collect()
    tasks = collections.defaultdict(list)
    for r in out:
        tasks[r["cell"], r["task"]].append((r["id"], r["side"]))
    met = collections.Counter()
    for (cell, _), t in tasks.items():
        t.sort(key=lambda x: (x[1], x[0]))
        starts, side = np.array([0, len(t)]), np.array([s for _, s in t])
        for a, b in cells.candidate_pairs(starts, side):
            met.update((cell, *sorted((t[i][0], t[j][0]))) for i, j in zip(a, b, strict=True))
    assert set(met.values()) == {1} and len(met) == 40 * 39 // 2 + 3


# ---- 4: packing --------------------------------------------------------------------------------------------------------------------


def check_packed(rows, want, limit, segments):
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] > 0
        pieces[r["doc_id"]].append((r["start"], bytes(r["ids"]), r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    got = collections.Counter()
    for d, p in pieces.items():
        whole = [b for _, b, _ in sorted(p)]
        got[d] = sum(map(len, whole)) // 4
        if want[d][1] == 1:
            assert b"".join(whole) == want[d][0] and [s for s, _, _ in sorted(p)] == [0, *np.cumsum([len(b) // 4 for b in whole])[:-1].tolist()]
    assert got == {d: n * len(b) // 4 for d, (b, n) in want.items()}
    for s in sequences.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= limit and at & (at - 1) == 0 and len(s) <= segments


def test_packing(docs, none):
    count = collections.Counter(r["doc_id"] for r in docs.collect())
    t = by_id(docs)
    enc = tokens.Encoder.of("word_bpe_49k.json")
    want = {i: (b + (2).to_bytes(4, "little"), count[i]) for i, b in zip(t, enc.encode(list(t.values())), strict=True)}
    check_packed(packing.pack_documents(docs).collect(), want, 4096, packing.SEGMENTS)
    check_packed(packing.pack_documents(docs, tokens=64, segments=3).collect(), want, 64, 3)
    assert packing.pack_documents(none).count() == 0


def test_packer_keeps_all_limits():
    r = random.Random(0)
    p = packing.Packer(tokens=64, segments=4, loss=30, pool=16)
    out = []
    for i in range(300):
        n = r.randint(1, 200)
        out += p.add(packing.Piece(i, bytes(4 * n), bytes(r.random() < 0.5 for _ in range(n)), 0, n))
    out += p.finish()
    for s in out:
        d = np.sum([x.demand() for x in s], axis=0)
        assert d[0] <= 64 and d[1] <= 4 and d[2] <= 30
    assert collections.Counter(x.key for s in out for x in s).keys() == set(range(300))


def test_pack_conversations(spark):
    df = spark.createDataFrame([(1, 0, "user", "a b c"), (1, 1, "assistant", "d e"), (2, 0, None, None), (2, 1, "assistant", "f")], "conv_id long, turn long, role string, text string")
    rows = packing.pack_conversations(df).collect()
    n = {i: sum(r["length"] for r in rows if r["doc_id"] == i) for i in (1, 2)}
    assert n == {1: 7, 2: 3} and sum(r["loss_tokens"] for r in rows) <= 5


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_is_the_library(file, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(file))
    r = random.Random(6)
    parts = ["a", "Bé", "12", "x's", "!?", "日本", "ª²½", "İ", "…", " ", "  ", "\n", "\t", "\r\n", " \n", "\n\n", "   ", "\t ", "\x0b", "\0"]
    mixed = ["".join(r.choice(parts) for _ in range(30)) for _ in range(300)]
    odd = ["a  b\n\n c", "x\xa0y \xa0\n\nz", "'s it's 's don't", "", "  lead", "trail  ", "\t\tq\r\n\r\nw", "é e\u0301 \u0301x", "<|endoftext|> a<|endoftext|>", "日本語 テスト  🙂", "a\x1c b\x1cc", "a\u2028b", None]
    for most in (10**6, 20):
        monkeypatch.setattr(tokens, "CHUNKS", most)
        monkeypatch.setattr(tokens, "PARTS", most)
        e = tokens.Encoder(file)
        assert e.parts_of is not None
        for _ in range(2):
            both = [*odd, *mixed, *texts()]
            assert e.encode(both) == [np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in both]


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_merges_at_once(file, monkeypatch):
    """Plain texts are encoded without asking the library a pre-token at a time; long pre-tokens and others give its ids too."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from looploom.llm import merges

    t = Tokenizer.from_file(public_tokenizers.path(file))
    r = random.Random(7)
    some = lambda letters, most: "".join(r.choice(letters) for _ in range(r.randint(1, most)))
    plain = ["".join(some("aaaenthirsdou", 12) + r.choice([" ", "  ", "\n", " \n", ". ", "12, ", "É", "ß-", "«x» ", "…", "¿Ñ", "\t7"]) for _ in range(40)) for _ in range(200)]
    others = [some(x, 90) for x in ("a", "an", "ÀÉßö", "!?-", "0123456789", "\n ", "a'st ", "×÷¢a", "日本a ", "―‧‐") for _ in range(20)]
    want = lambda x: np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes()
    for block in (merges.BLOCK, 7):
        monkeypatch.setattr(merges, "BLOCK", block)
        monkeypatch.setattr(tokens, "LONG", 32)
        e = tokens.Encoder(file)
        both = [x for y in zip(plain, others, strict=True) for x in y]
        assert e.encode(both) == list(map(want, both))
        assert e.encode(["", None, " "]) == list(map(want, ["", "", " "])) and e.encode([]) == []
        monkeypatch.setattr(tokens, "LONG", 1000)
        e = tokens.Encoder(file)
        e._part = e._ask = lambda texts: [] if texts == [] else pytest.fail("asked")
        assert e.encode(plain) == list(map(want, plain))


# ---- 5: embeddings -----------------------------------------------------------------------------------------------------------------


def test_lattice_points():
    r = np.random.default_rng(0)
    assert len(np.unique(lattice.shortest(), axis=0)) == 240 and set((lattice.shortest() ** 2).sum(axis=1)) == {8}
    y = r.standard_normal((300, 8)) * 2
    p = lattice.nearest(y)
    d = ((y - p / 2) ** 2).sum(axis=1)
    assert (d <= 1 + 1e-9).all() and (p.sum(axis=1) % 4 == 0).all() and all(len(set(x % 2)) == 1 for x in p)
    for q in lattice.shortest():
        assert (d <= ((y - (p + q) / 2) ** 2).sum(axis=1) + 1e-9).all()


@pytest.mark.parametrize("cell_rows", [1024, 40])
def test_embeddings(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(lattice, "CELL_ROWS", cell_rows)
    r = np.random.default_rng(2)
    some = r.standard_normal((80, 64))
    close = np.concatenate([some[i] + 0.1 * r.standard_normal((4, 64)) for i in range(30)])
    dense = some[40] + 0.11 * r.standard_normal((150, 64))
    x = np.concatenate([some, close, dense, some[:5], some[5:7] * 3]).astype(np.float32)
    label = np.r_[np.arange(80) % 3, np.repeat(np.arange(30) % 3, 4), np.full(150, 40 % 3), np.arange(5) % 3, np.arange(5, 7) % 3]
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))]
    odd = [(9001, None, 1), (9002, [0.0] * 64, 1), (9003, [float("nan")] * 64, 1), (9004, rows[0][1], None), (9005, [], 1), (9006, [1.0, None], 1), (9007, [1.0, 2.0], 1), (9008, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    got = {g["vec_id"]: g for g in lattice.embedding_duplicates(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    true, found = near.sum(), sum(got[i]["n_links"] for i in range(len(x)))
    assert 0.97 * true <= found <= true and all(got[i]["n_links"] <= near[i].sum() for i in range(len(x)))
    comp = brute_components(range(len(x)), [(int(a), int(b)) for a, b in np.argwhere(near) if a < b])
    assert np.mean([got[i]["component_id"] == comp[i] for i in comp]) > 0.97
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i in (9001, 9002, 9003, 9004, 9005, 9006))
    assert got[9008]["component_id"] == 9007 and got[9007]["n_links"] == 1
    assert lattice.embedding_duplicates(df.where("false")).count() == 0


# ---- 6: token counts ---------------------------------------------------------------------------------------------------------------


def brute_count(t, x):
    s = [(0.0, 0)]
    for k in range(1, len(x) + 1):
        ways = [(s[k - 1][0] + t.unknown, s[k - 1][1] - len(x[k - 1].encode()))]
        s.append(max(ways + [(s[j][0] + t.pieces[x[j:k]], s[j][1] - 1) for j in range(k) if x[j:k] in t.pieces]))
    return -s[-1][1]


def test_token_counts(docs, none):
    t = counts.Trie.of(counts.VOCABULARY)
    got = {r["doc_id"]: r for r in counts.count_tokens(docs).collect()}
    for i, x in by_id(docs).items():
        w = WORD.findall(x or "")
        assert (got[i]["n_words"], got[i]["n_tokens"]) == (len(w), sum(brute_count(t, counts.SPACE + v) for v in w))
    assert counts.count_tokens(none).count() == 0
    small = counts.Trie(t.pieces, nodes=5)
    assert small.count_texts(texts()) == t.count_texts(texts())


def test_token_counts_at_once_are_those_one_by_one():
    t, r = counts.Trie.of(counts.VOCABULARY), random.Random(5)
    odd = ["".join(r.choice("abcdefeea\0\x1c\xa0\u2581\u0416\u00e9\u4e2d\u00df\U0001f600") for _ in range(r.randint(0, 30))) for _ in range(3000)] + ["x" * r.randint(50, 300) for _ in range(20)]
    given = [None, "", " ", "\n a \t b\x0b\x0cc\r ", "\u00e9" * 32, "\u00e9" * 33] + [" ".join(odd[i : i + 50]) for i in range(0, len(odd), 50)]
    split = [WORD.findall(x or "") for x in given]
    single = counts.Trie(t.pieces)
    assert t.count_texts(given) == ([len(w) for w in split], [sum(single.insert(counts.SPACE + v) for v in w) for w in split])
    # and take less time, where most words are met for the first time
    new = sorted({"".join(r.choice("etaoinshrdlu") for _ in range(r.randint(3, 14))) for _ in range(40_000)}, key=hash)
    single.clear()
    began = time.process_time()
    want = sum(single.insert(counts.SPACE + v) for v in new)
    between = time.process_time()
    assert t.count_texts([" ".join(new)])[1] == [want]
    assert 2 * (time.process_time() - between) < between - began


def test_scores_of_ranks_are_log_probabilities():
    p = counts.Trie.of(counts.VOCABULARY).pieces
    usual = [s for s in p.values() if s > counts.UNREACHABLE]
    assert math.isclose(sum(map(math.exp, usual)), 1, rel_tol=1e-6) and max(usual) < 0
    assert counts.log_probabilities({"a": -1.5, "b": -0.25}) == {"a": -1.5, "b": -0.25}


def test_trie_shares_prefixes():
    t = counts.Trie({"a": -1.0, "ab": -1.5, "b": -1.0, "c": -3.0, "bc": -1.0})
    assert (t.insert("ab"), t.insert("abc"), t.insert("abd")) == (1, 2, 2) and len(t.score) == 5


# ---- 7: mixing ---------------------------------------------------------------------------------------------------------------------


def test_mixing(spark, docs, none):
    r = random.Random(3)
    rows = [(i, "w " * r.randint(1, 40), "big" if i % 10 < 7 else f"s{i % 10}" if i % 10 < 9 else None) for i in range(600)] + [(9999, None, "empty")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, source string, epoch int")
    got = mixing.mix_sources(df, entropy_share=0.97, block_tokens=500).collect()
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    size = {s: n for s, n in size.items() if n}
    total, largest = sum(size.values()), max(size.values())

    def entropy(a):
        z = sum((n / largest) ** a for n in size.values())
        return -sum(p * math.log(p) for n in size.values() if (p := (n / largest) ** a / z))

    a = got[0]["exponent"]
    assert entropy(a) >= 0.97 * math.log(len(size)) > entropy(a + 2e-9)
    z = sum((n / largest) ** a for n in size.values())
    h = lambda *x: int(hashlib.md5("|".join(map(str, x)).encode()).hexdigest()[:15], 16)
    want = []
    for s, n in size.items():
        own = [(h(7, i), i, len(WORD.findall(t or ""))) for i, t, q in rows if q == s]
        budget = (n / largest) ** a / z * total
        whole, key, blocks = int(budget / n), "{}" if s is None else f'{{"source":"{s}"}}', collections.defaultdict(list)
        want += [(i, e) for e in range(whole) for _, i, _ in own]
        for x in own:
            blocks[x[0] % -(-n // 500)].append(x)
        left = budget - whole * n
        for b in sorted(blocks, key=lambda b: (h(7, key, whole, b), b)):
            for _, i, k in sorted(blocks[b]):
                if k > left:
                    break
                left -= k
                want.append((i, whole))
            else:
                continue
            break
    assert sorted((x["doc_id"], x["epoch"]) for x in got) == sorted(want)
    assert mixing.mix_sources(none).count() == 0
    capped = mixing.mix_sources(df, entropy_share=1.0, max_epochs=1.5, block_tokens=500).groupBy("doc_id").count().agg({"count": "max"}).first()[0]
    assert capped <= 2
    assert mixing.mix_sources(docs, entropy_share=None).where("text is not null and trim(text) <> ''").count() > 0


# ---- 8: toxicity -------------------------------------------------------------------------------------------------------------------


def test_toxicity(spark, docs, none):
    r = random.Random(5)
    bad = ["zork", "blarg", "fump"]
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    rows = []
    for i in range(400):
        w = [word() for _ in range(r.randint(5, 200))]
        if i % 4 == 0:
            for _ in range(3):
                w.insert(r.randint(0, len(w)), r.choice(bad))
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    net = toxicity.fit_toxicity(df, df)
    got = toxicity.score_toxicity(df.withColumnRenamed("toxic", "score"), net).collect()
    held = [g for g in got if zlib.crc32(str(g["doc_id"]).encode()) % 5 == 0]
    assert np.mean([g["predicted"] == (g["doc_id"] % 4 == 0) for g in held]) > 0.9 and all(0 <= g["score"] <= 1 for g in got)
    odd = toxicity.score_toxicity(docs, net).collect()
    assert len(odd) == docs.count() and all(x["score"] is not None for x in odd)
    # one more window over a long text: the passage far behind is found
    far = " ".join(word() for _ in range(5000))
    s = toxicity.Scorer(net).scores([far, far + " zork blarg fump zork", "", None])
    assert s[1] > max(s[0], 0.5) and s[2] == s[3]
    assert toxicity.score_toxicity(none, net).count() == 0
    assert toxicity.fit_toxicity(df, df.where("toxic = 0")) is None
    assert {x["score"] for x in toxicity.score_toxicity(docs, None).collect()} == {0.0}


def test_toxicity_texts_stay_off_the_driver(spark, monkeypatch):
    """The driver gets the weights alone; the order of the table's rows does not matter."""
    rows = [(i, f"a{i % 7} b{i % 5} " + ("zork " * 3 if i % 4 == 0 else "calm "), int(i % 4 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    collect, seen = type(df).collect, []
    monkeypatch.setattr(type(df), "collect", lambda self: seen.extend(self.columns) or collect(self))
    net, again = toxicity.fit_toxicity(df, df), toxicity.fit_toxicity(df.orderBy("doc_id", ascending=False).repartition(3), df)
    assert seen and "text" not in seen
    assert all((net.w[k] == again.w[k]).all() for k in net.w) and net.ids == again.ids


def test_toxicity_gradient():
    net = toxicity.Network(["a", "bb", "ccc"], 1)
    r = np.random.default_rng(0)
    net.w = {k: (v + 0.1 * r.standard_normal(v.shape)).astype(np.float64) for k, v in net.w.items()}
    f = net.inputs(["", "a", "bb", "ccc", "zz"])
    at, real, _ = toxicity.layout([r.integers(1, 5, n).astype(np.int64) for n in (40, 5, 0)], 0)
    y = r.integers(0, 2, len(at)).astype(float)
    _, grad = toxicity.gradients(net, f, at, real, y)
    for k in net.w:
        flat, i = net.w[k].reshape(-1), int(np.argmax(np.abs(grad[k])))
        old = flat[i]
        flat[i] = old + 1e-3
        up = toxicity.gradients(net, f, at, real, y)[0]
        flat[i] = old - 1e-3
        down = toxicity.gradients(net, f, at, real, y)[0]
        flat[i] = old
        assert abs((up - down) / 2e-3 - grad[k].reshape(-1)[i]) < 1e-4 + 0.01 * abs(grad[k]).max()


def test_windows_cover_all_words():
    for n in (0, 1, 31, 32, 33, 48, 49, 500):
        s = toxicity.windows(n)
        assert set(range(n)) <= {i + j for i in s for j in range(toxicity.WINDOW)} and all(b - a == toxicity.STEP for a, b in zip(s, s[1:], strict=False))


# ---- 9: wavelet --------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n,top", [(1, 1), (511, 3), (512, 50257), (5000, 70000)])
def test_wavelet_shard(n, top):
    ids = (np.random.default_rng(n).zipf(1.4, n) % top).astype("<u4")
    s = wavelet.Shard(wavelet.encode_shard(np.array([7]), np.array([n]), ids))
    assert (s.ids() == ids).all() and s.lengths.tolist() == [n]
    for i in range(0, n, max(1, n // 40)):
        c = int(ids[i])
        places = np.flatnonzero(ids == c)
        assert s.access(i) == c and s.count(c) == len(places) and s.count(c, 3, n // 2) == ((places >= 3) & (places < n // 2)).sum()
        k = len(places) // 2
        assert s.locate(c, k) == places[k]
    assert s.count(1 << 20) == 0
    with pytest.raises(IndexError):
        s.locate(int(ids[0]), n)


def test_wavelet_files(spark, docs, none, tmp_path):
    folder = str(tmp_path / "shards")
    manifest = wavelet.write_shards(docs, folder, shard_ids=700)
    assert manifest.count() > 3
    rows = wavelet.read_shards(spark, folder, manifest).orderBy("start").collect()
    enc = tokens.Encoder.of(wavelet.VOCABULARY)
    want = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    at = 0
    for r, (i, t) in zip(rows, want, strict=True):
        b = enc.encode([t])[0] + (2).to_bytes(4, "little")
        assert (r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"]), r["ids_crc32"]) == (i, at, len(b) // 4, b, zlib.crc32(b))
        at += len(b) // 4
    assert wavelet.write_shards(none, str(tmp_path / "none")).count() == 0


def test_scoring_bounds_arrow_batches(spark, docs):
    name, net = "spark.sql.execution.arrow.maxRecordsPerBatch", toxicity.Network(["alpha"])
    before = spark.conf.get(name)
    try:
        for given, want in (("10000", "1000"), ("0", "1000"), ("7", "7")):
            spark.conf.set(name, given)
            assert toxicity.score_toxicity(docs, net).where("score is not null").count() == docs.count()
            assert spark.conf.get(name) == want
    finally:
        spark.conf.set(name, before)


# ---- 10: URLs ----------------------------------------------------------------------------------------------------------------------


def test_urls(spark):
    given = ["http://WWW.Spam.example.org/x/?utm_source=a&q=1#f", "https://m.spam.example.org/x.html?q=1", "http://a.example.com/en/7", "http://example.com/en/8", "http://notexample.com/en/7", "http://net/de/8", "http://x.example.net/de/81", "http://ok.example.org/es/?x", "ftp://h?q", "nothing", None, "", "://a/b", "http://a.b/c://d/e"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(given)] + [(0, given[0], "h")], "page_id long, url string, host string")
    listed = spark.createDataFrame([("spam.example.org/x?q=1",), ("spam.example.org/x?q=1",), (None,)], "canonical string")
    got = {r["page_id"]: r for r in urls.filter_urls(df, listed).collect()}
    assert urls.filter_urls(df, listed).count() == len(given) + 1
    want = {0: ("www.spam.example.org", "/x/", None, "block"), 1: ("m.spam.example.org", "/x.html", None, "block"), 2: ("a.example.com", "/en/7", "example.com/en/7", "allow"), 3: ("example.com", "/en/8", "com/en/", "block"), 4: ("notexample.com", "/en/7", "com/en/", "block"), 5: ("net", "/de/8", "net/de/", "block"), 6: ("x.example.net", "/de/81", "example.net/de/8", "block"), 7: ("ok.example.org", "/es/", "org/es/", "block"), 8: ("h", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("", "", None, "allow"), 11: ("", "", None, "allow"), 12: ("a", "/b", None, "allow"), 13: ("a.b", "/c://d/e", None, "allow")}
    assert {k: (r["host"], r["path"], r["rule"], r["verdict"]) for k, r in got.items()} == want
    assert urls.filter_urls(df, listed.where("false")).where("verdict = 'block'").count() == 5
    assert urls.filter_urls(df.where("false"), listed).count() == 0


def test_op10_follows_the_contract(spark, tmp_path):
    contract = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    given = {"http://a.com/en/1": "com/en/", "http://b.example.com/en/71": "example.com/en/7", "http://a.net/de/8": "net/de/", "http://example.net/de/7": "net/de/", "http://spam-farm.net/de/": "net/de/", "http://m.example.net/de/8x": "example.net/de/8", "http://a.org/es/": "org/es/"}
    spark.createDataFrame(list(enumerate(given)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.op10_url_filter(spark, str(tmp_path)).collect()}
    assert got == {i: (rule, contract[rule]) for i, rule in enumerate(given.values())}


def test_bloom_has_no_false_negatives(spark):
    pages = spark.range(3000).selectExpr("id as page_id", "concat('http://h', id, '.org/p') as url")
    listed = pages.where("page_id % 3 = 0").select(urls.canonical(pages["url"]).alias("canonical"))
    for bits in (1, 16):
        assert urls.filter_urls(pages, listed, bits_per_key=bits).where("verdict = 'block'").selectExpr("count(*)", "sum(page_id % 3)").first() == (1000, 0)


def test_one_of_each_loses_no_document(spark):
    far = ["alpha beta gamma delta " * 9, "one two three four five " * 9, "red green blue black " * 9, "north south east west " * 9]
    rows = [(None, far[0]), (None, far[1]), (7, far[2]), (7, far[3]), (9, far[2]), (None, far[3]), (12, "uno dos tres"), (12, "uno dos tres")]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, k0 string, root int, again int").repartition(3)
    got = simhash.one_of_each(df)
    assert got.columns == df.columns
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in got.collect())
    assert kept == sorted([(0, far[0]), (0, far[1]), (7, far[2]), (7, far[3]), (12, "uno dos tres")])
    assert simhash.one_of_each(df.where("false")).count() == 0


def test_embeddings_without_ids_and_with_shared_ids(spark):
    x, y = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, x, 0), (1, y, 0), (2, x, 0), (3, [0.01, 1.0], 0), (None, [1.0, 0.01], 0), (None, [-1.0, 0.0], 0), (None, None, 0), (7, [0.0, -1.0], None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, label long, id string")
    got = sorted((tuple(r) for r in lattice.embedding_duplicates(df).collect()), key=str)
    want = [(1, 2, 1, True), (2, 2, 1, False), (None, 2, 1, False), (1, 1, 1, True), (3, 1, 1, False), (None, 0, None, True), (None, 0, None, True), (7, 0, 7, True)]
    assert got == sorted(want, key=str)


def test_urls_keep_all_columns(spark, monkeypatch):
    long = "http://h.org/" + "x" * 100_000
    df = spark.createDataFrame([(1, "http://h.org/p", "a", "b", 5), (None, long, "a", "b", 6), (3, None, None, None, 7)], "page_id long, url string, __said string, `__block` string, page int")
    listed = spark.createDataFrame([("h.org/p",), (long[7:],)], "canonical string")
    for most in (urls.BROADCAST_BLOCKS, 0):  # sent to the workers, or joined
        monkeypatch.setattr(urls, "BROADCAST_BLOCKS", most)
        got = urls.filter_urls(df, listed)
        assert got.columns[:5] == df.columns
        assert sorted((r["page"], r["__said"], r["verdict"]) for r in got.collect()) == [(5, "a", "block"), (6, "a", "block"), (7, None, "allow")]


def test_wavelet_keeps_null_ids(spark, tmp_path):
    df = spark.createDataFrame([(None, "a b"), (-1, "c"), (None, None), (4, "long " * 3000)], "doc_id long, text string")
    manifest = wavelet.write_shards(df, str(tmp_path / "s"), shard_ids=50)
    rows = wavelet.read_shards(spark, str(tmp_path / "s"), manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, None, -1, 4] and rows[3]["n_tokens"] > 3000


def test_conversation_limits_bind(spark):
    r = random.Random(2)
    rows = [(c, t, ("user", "assistant")[t % 2], " ".join(["the"] * r.randint(1, 60))) for c in range(120) for t in range(r.randint(1, 6))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(2)
    got = packing.pack_conversations(df, tokens=256, segments=3, loss=60).collect()
    sums = collections.defaultdict(lambda: [0, 0, 0])
    for x in got:
        for k, v in enumerate((x["length"], 1, x["loss_tokens"])):
            sums[x["sequence_id"]][k] += v
    assert all(a <= 256 and b <= 3 and c <= 60 for a, b, c in sums.values())
    assert max(b for _, b, _ in sums.values()) == 3 and max(c for *_, c in sums.values()) == 60
    want = {c: sum(len(t.split()) + 1 for i, _, _, t in rows if i == c) for c in range(120)}
    assert {c: sum(x["length"] for x in got if x["doc_id"] == c) for c in want} == want


def test_toxicity_scores_window_by_window():
    """The score of a text is the calibrated highest logit of a plain GRU with attention over each of its windows, word by word."""
    net = toxicity.Network(["a", "bb", "ccc"], 1)
    r = np.random.default_rng(3)
    net.w = {k: (v + 0.3 * r.standard_normal(v.shape)).astype(np.float32) for k, v in net.w.items()}
    net.scale, net.shift = 1.3, -0.2
    w, h = {k: v.astype(float) for k, v in net.w.items()}, toxicity.HIDDEN
    sig = lambda x: 1 / (1 + np.exp(-x))

    def brute(text):
        words = [toxicity.normal(x) for x in WORD.findall(text or "")]
        logits = []
        for s in range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STEP), toxicity.STEP):
            x = [np.r_[w["Ew"][net.ids.get(v, 0)], np.mean([w["Ec"][g] for g in toxicity.trigrams(v)], axis=0)] for v in words[s : s + toxicity.WINDOW]]
            if not x:
                logits.append(float(w["bo"][0]))
                continue
            out = np.zeros((len(x), 2 * h))
            for d, order in enumerate((range(len(x)), reversed(range(len(x))))):
                state = np.zeros(h)
                for t in order:
                    p, g = x[t] @ w["W"][d] + w["b"][d], state @ w["U"][d]
                    z, q = sig(p[:h] + g[:h]), sig(p[h : 2 * h] + g[h : 2 * h])
                    state = state + (1 - z) * (np.tanh(p[2 * h :] + q * g[2 * h :]) - state)
                    out[t, d * h : d * h + h] = state
            e = np.exp(np.tanh(out @ w["Wa"]) @ w["va"])
            logits.append(float((e / e.sum()) @ out @ w["wo"] + w["bo"][0]))
        return sig(net.scale * max(logits) + net.shift)

    given = [x for x in texts() if x is None or len(x) < 2000]
    assert np.allclose(toxicity.Scorer(net).scores(given), [brute(t) for t in given], atol=1e-4)


def test_lm_scores_token_by_token(docs):
    model = lm.fit(docs.select("text"), rounds=(0.1,), share=1)
    w = {k: v.astype(float) for k, v in model.w.items()}
    soft = lambda a, k: a[k] - np.log(np.exp(a - a.max()).sum()) - a.max()

    def brute(text):
        words = WORD.findall((text or "").lower())
        ids = [model.own[x] if x in model.own else model.first + lm.ending(x) for x in words]
        edged = [model.edge] * 2 + ids + [model.edge] * 2
        total = 0.0
        for i, (x, t) in enumerate(zip(words, ids, strict=True)):
            h = np.tanh(sum(w["E"][k][edged[i + 2 + s]] for k, s in enumerate(lm.SIDES)) + w["b"])
            kind, inner = divmod(t, model.inside)
            total += soft(h @ w["C"] + w["c"], kind) + soft(h @ w["T"][kind] + w["t"][kind], inner)
            if t >= model.first:
                n = dict(zip(model.known[0].tolist(), model.known[1].tolist(), strict=True)).get(int(np.uint64(xxhash.xxh64_intdigest(x.encode(), 42)).view(np.int64)), 0)
                total += n - math.log1p(model.ended[t - model.first])
        return total

    given = [t for t in texts() if t is None or len(t) < 900][:25]
    assert np.allclose(model.score(given)[1], [brute(t) for t in given], rtol=1e-4, atol=1e-3)


def test_idle_workers_free_what_they_keep(spark):
    """What a stage's workers keep is gone once they stand idle, so that the next stage's executors have that memory."""
    import os
    import time

    from looploom.llm import text

    def fill(batches):
        for b in batches:
            text.keep(("test",), lambda: bytearray(1 << 24))
            yield b.from_pydict({"pid": [os.getpid()], "kept": [len(text._kept)]})

    def look(batches):
        for b in batches:
            time.sleep(0.5)  # so that all workers have a task
            yield b.from_pydict({"pid": [os.getpid()], "kept": [len(text._kept)]})

    filled = {r["pid"] for r in spark.range(0, 4, 1, 4).mapInArrow(fill, "pid long, kept long").collect() if r["kept"]}
    time.sleep(8)
    seen = spark.range(0, 4, 1, 4).mapInArrow(look, "pid long, kept long").collect()
    assert filled & {r["pid"] for r in seen}
    assert all(r["kept"] == 0 for r in seen if r["pid"] in filled)


def test_lm_softmax_of_any_logits():
    """Logits that are safe are taken as they are, others less their row's largest; both give the softmax, over a number if one is given."""
    r = np.random.default_rng(8)
    for size in (1, 59, 61, 300):
        a = (r.random((40, 65)) * 2 - 1).astype(np.float32) * size
        e = np.exp(a.astype(np.float64) - a.max(axis=1, keepdims=True))
        want = e / e.sum(axis=1, keepdims=True)
        assert np.allclose(lm._softmax(a.copy()), want, rtol=1e-4, atol=1e-30) and np.allclose(lm._softmax(a.copy(), 7), want / 7, rtol=1e-4, atol=1e-30)
    model = lm.Model([], lm.Model.start(r.random(lm.TOKENS)))
    around = np.full((4, lm.TOKENS), lm.EDGE)
    for size in (1, 1000):
        model.w["C"] *= size
        assert math.isclose(float(np.exp(model.log_probability(np.arange(lm.TOKENS), around)).sum()), 1, rel_tol=1e-4)
        assert all(np.isfinite(g).all() for g in model.gradients(np.arange(100), around[:, :100])[1].values())


def test_lm_steps_and_words_are_exact():
    """Orders, largest values and one training step are those of a plain calculation, and words are parted at their white space alone."""
    r = np.random.default_rng(4)
    for below in (100, 1 << 16, 1 << 17):
        x = r.integers(0, below, 5000)
        assert (lm._order(x, below) == np.argsort(x, kind="stable")).all()
    for n in (64, 65, 100):
        a = r.standard_normal((50, n))
        assert (lm._peak(a) == a.max(axis=1, keepdims=True)).all()
    model = lm.Model(["née"], lm.Model.start(r.random(lm.TOKENS)))
    text = "née\xa0x\x1cy\x85z　w NÉE\tlong\x0b\x0cäöü 日本語語語\r\n🙂"
    assert model.tokens([text])[0].tolist() == [model.own[w] if w in model.own else model.first + lm.ending(w) for w in WORD.findall(text.lower())]
    token, around = r.integers(0, lm.TOKENS, 300), r.integers(0, lm.TOKENS + 1, (4, 300))
    around[:, :50] = lm.EDGE
    _, _, ds = model.gradients(token, around)
    e, g = model.w["E"].copy(), np.zeros_like(model.w["E"])
    for side in range(4):
        np.add.at(g[side], around[side], ds)
    lm.Trainer(model, 0.1)._step(token, around)
    assert np.allclose(model.w["E"], e - 0.1 * g / np.sqrt(1e-3 + g * g), rtol=1e-4, atol=1e-6)


def test_lm_cuts_texts_once(spark, docs, monkeypatch):
    """Rounds and scores read the tokens that were cut once, and give what fit and score_lm do."""
    docs = spark.createDataFrame(docs.collect(), SCHEMA).coalesce(1)  # rows in one order
    for bound in (lm.BROADCAST_WORDS, -1):  # counts sent out, and joined
        monkeypatch.setattr(lm, "BROADCAST_WORDS", bound)
        whole = lm.fit(docs)
        model = lm.vocabulary(docs)
        coded = lm.kept(lm.encoded(docs, model))
        assert coded.is_cached and ("others" in coded.columns) == model.joins == (bound < 0)
        rows = {r["doc_id"]: r["tokens"] for r in coded.collect()}
        assert all(np.frombuffer(rows[i], model.stored).tolist() == model.tokens([t])[0].tolist() for i, t in by_id(docs).items())
        lm.train(coded, model)
        assert all(np.allclose(model.w[k], whole.w[k], atol=1e-5) for k in model.w)
        want = {r["doc_id"]: r for r in lm.score_lm(docs, whole).collect()}
        for r in lm.score_encoded(coded, model).collect():
            w = want[r["doc_id"]]
            assert r["n_tokens"] == w["n_tokens"] and math.isclose(r["log_probability"], w["log_probability"], rel_tol=1e-5, abs_tol=1e-4)
        coded.unpersist()


def test_lm_step_of_all_weights():
    """Gradients of rows that repeat are summed whole, and a step changes all weights by plain Adagrad, with classes without a place."""
    r = np.random.default_rng(6)
    for below in (5, 300, 1 << 17, 1 << 40):
        rows, values = r.integers(0, below, 1200), r.standard_normal((300, 16))
        rows[::3] = rows[0]
        found, got = lm._totals(rows, values, below)
        want, at = np.unique(rows, return_inverse=True)
        sums = np.zeros((len(want), 16))
        np.add.at(sums, at, np.tile(values, (4, 1)))
        assert (found == want).all() and np.allclose(got, sums)
    model = lm.Model([], lm.Model.start(r.random(lm.TOKENS)))
    token, around = r.integers(0, 50, 200) * 7, r.integers(0, lm.TOKENS + 1, (4, 200))
    loss, grad, _ = model.gradients(token, around)
    assert math.isclose(loss, -model.log_probability(token, around).mean(), rel_tol=1e-4)
    before = {k: v.copy() for k, v in model.w.items()}
    lm.Trainer(model, 0.1)._step(token, around)
    for k, g in grad.items():
        assert np.allclose(model.w[k], before[k] - 0.1 * g / np.sqrt(1e-3 + g * g), rtol=1e-4, atol=1e-6), k
    assert all((model.to_bytes() == lm.Model([], lm.Model.from_bytes(model.to_bytes(), lm.CLASSES)).to_bytes(), (model.w["T"][10:] == before["T"][10:]).all()))


def test_lm_logits_are_looked_at_only_beyond_their_bound(monkeypatch):
    """Scores of layers whose bound is safe need no look at the logits, which never exceed it; beyond it they are as exact."""
    r, looked = np.random.default_rng(8), []
    lower = lm._lower
    monkeypatch.setattr(lm, "_lower", lambda a: (looked.append(len(a)), lower(a)))
    ids = [r.integers(0, lm.TOKENS, n) for n in (700, 0, 3, 900)]
    for by, safe in ((1, True), (300, False)):
        model = lm.Model([], lm.Model.start(r.random(lm.TOKENS)))
        model.w["C"] *= by
        layers = model.joined()
        token, around = model.sides(ids)
        h = model.hidden(around)
        assert (np.abs(h @ layers[0]).max() <= lm._bound(layers[0])) and (max(map(lm._bound, layers)) < lm.SAFE) == safe
        a, b = (h @ layers[0]).astype(float), np.einsum("nd,ndk->nk", h, layers[1][token // model.inside]).astype(float)
        rows = np.arange(len(token))
        want = sum(x[rows, at] - np.logaddexp.reduce(x, axis=1) for x, at in ((a, token // model.inside), (b, token % model.inside)))
        looked.clear()
        size, got = model.score_tokens(ids, 1000)
        assert size.tolist() == [700, 0, 3, 900] and (not looked) == safe
        assert np.allclose(got, lm._summed(want, size), rtol=1e-4)


def test_lm_cuts_words_of_any_script():
    """A word of the vocabulary has its number, any other that of its last three characters, and the hash of the whole."""
    import xxhash

    model = lm.Model(["the", "über"], lm.Model.start(np.ones(lm.TOKENS)))
    size, token, _, hashes = model.cut(["The ÜBER ab straße", None, " \t", "日本語テキスト the x"])
    words = ["the", "über", "ab", "straße", "日本語テキスト", "the", "x"]
    own = {"the": 0, "über": 1}
    assert size.tolist() == [4, 0, 0, 3] and token.tolist() == [own.get(w, model.first + lm.ending(w)) for w in words]
    assert hashes.view(np.uint64).tolist() == [0 if w in own else xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    assert [len(x) for x in model.cut([None, ""])] == [2, 0, 0, 0]


def test_lm_errors_and_scores_in_cache_sized_rows(monkeypatch):
    """Errors times their factors are the gradients of the mean, and scores hold the logits of ROWS places at once, whatever that is, with the same results."""
    r = np.random.default_rng(9)
    for size in (1, 300):
        a, at, rows = (r.random((60, 65)) * 2 - 1).astype(np.float32) * size, r.integers(0, 65, 50), r.permutation(60)[:50]
        want = np.exp(a.astype(float) - np.logaddexp.reduce(a.astype(float), axis=1)[:, None])
        of = want[rows, at]
        want[rows, at] -= 1
        got, by = lm._errors(a, rows, at, 60)
        assert np.allclose(got, of, rtol=1e-3, atol=1e-6) and np.allclose(a * by, want / 60, rtol=1e-3, atol=1e-7)
    model = lm.Model([], lm.Model.start(r.random(lm.TOKENS)))
    ids = [r.integers(0, 4, n) * r.integers(0, 1024, n) for n in (700, 0, 1, 900)]
    token, around = model.sides(ids)
    h, (outer, inside) = model.hidden(around), model.joined()
    rows = np.arange(len(token))
    both = (h @ outer, token // model.inside), (np.einsum("nd,ndk->nk", h, inside[token // model.inside]), token % model.inside)
    want = lm._summed(sum(a[rows, at] - np.logaddexp.reduce(a.astype(float), axis=1) for a, at in both), np.array([len(x) for x in ids]))
    held, add = [], lm.Model._add
    monkeypatch.setattr(lm.Model, "_add", staticmethod(lambda logp, a, *more: (held.append(len(a)), add(logp, a, *more))))
    for most in (1, 64, 1 << 12):
        monkeypatch.setattr(lm, "ROWS", most)
        held.clear()
        assert np.allclose(model.score_tokens(ids)[1], want, rtol=1e-4) and max(held) <= most and sum(held) == 2 * len(token)
