"""Importance resampling, HyperMinHash and vector codes against brute force and planted cases."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import _crc, hyperminhash, importance, jaccard_join, vector_codes
from tessera.session import Scratch
from tessera.llm.components import connected_components, extended_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=150).map(lambda b: b.replace(b" ", b"x")), min_size=1, max_size=12))
def test_crcs_of_runs(words):
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    for k, found in _crc.run_crcs(data, starts, ends, 3):
        assert found.tolist() == [zlib.crc32(b" ".join(words[i : i + k])) for i in range(len(words) - k + 1)]


@settings(max_examples=60, deadline=None)
@given(st.text("ab é.", max_size=200), st.integers(1, 40))
def test_chunks_own_every_run_once(text, size):
    data = np.frombuffer(text.encode(), np.uint8)
    grams = lambda words: [tuple(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    words = lambda b: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", b)
    found = []
    for at, own, end in importance.chunk_bounds(data, size, 3):
        part, mine = words(data[at:end].tobytes()), len(words(data[at:own].tobytes()))
        found += [tuple(part[i : i + k]) for k in (1, 2, 3) for i in range(min(mine, len(part) - k + 1))]
    assert sorted(found) == sorted(grams(words(text.encode())))


def brute_resample(rows, target, percent=5, least=20):
    """What the contract says, a text at a time."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    buckets = lambda w: [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    mine, theirs = [buckets(words(t)) for _, t in rows], [buckets(words(t)) for t in target]
    s, t = np.zeros(10_000, int), np.zeros(10_000, int)
    for counts, lists in ((s, mine), (t, theirs)):
        for one in lists:
            for b in one:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + 10_000) / ((s[b] + 1) * (t.sum() + 10_000)))) for b in range(10_000)]
    out = []
    for (i, text), one in zip(rows, mine):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in one)
        out.append([i, len(words(text)), len(one), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for n, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = n + 1
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("chunk", [64, 1 << 15])
def test_resampling_brute_force(spark, docs_of, odd, chunk):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(200)] + ["É", "日本", "W5"]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 90)))) for i in range(120)] + [(200, "x" * 500 + " end"), (201, " ".join(["same"] * 60))]
    rows += [(r.doc_id, r.text) for r in odd.collect()]
    target = [" ".join(rng.choice(vocabulary[:40], 50)) for _ in range(8)] + [None, ""]
    bench = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    found = importance.importance_resample(docs_of(rows), bench, chunk_bytes=chunk)
    names = ("doc_id", "n_words", "n_features", "weight", "score", "rank")
    assert sorted(map(tuple, found.select(*names).collect()), key=repr) == brute_resample(rows, target)
    drawn = importance.drawn_documents(docs_of(rows), found)
    assert sorted(r.doc_id for r in drawn.collect()) == sorted(r.doc_id for r in found.collect() if r["rank"]) and drawn.columns == docs_of(rows).columns


def test_resampling_prefers_the_target_and_takes_odd_tables(spark, docs_of, odd):
    rng = np.random.default_rng(8)
    near, far = [f"n{i}" for i in range(30)], [f"f{i}" for i in range(3000)]
    rows = [(i, " ".join(rng.choice(near if i % 10 == 0 else far, 40))) for i in range(400)]
    bench = spark.createDataFrame([(" ".join(rng.choice(near, 100)),) for _ in range(200)], "text string")
    ranks = {r.doc_id: r["rank"] for r in importance.importance_resample(docs_of(rows), bench).collect()}
    assert sorted(r for r in ranks.values() if r) == list(range(1, 21)) and all(i % 10 == 0 for i, r in ranks.items() if r)
    assert importance.importance_resample(odd.where("false"), bench).count() == 0
    uniform = importance.importance_resample(odd, bench.where("false")).collect()
    assert len(uniform) == odd.count() and all(r.weight == 0 and r.n_features == 0 for r in uniform if not r.n_words)
    same = importance.importance_resample(docs_of([(1, rows[0][1])] * 40), bench).collect()
    assert len({(r.weight, r.score) for r in same}) == 1 and sorted(r["rank"] for r in same if r["rank"]) == [1, 2]


def shingles(text, k):
    words = (text or "").translate(LOWER).split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def brute_components(rows, k=4, percent=80):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    out = {}
    for i in range(len(rows)):
        out.setdefault(find(i), []).append(rows[i][0])
    return [(rows[i][0], len(sets[i]), min((d for d in out[find(i)] if d is not None), default=None)) for i in range(len(rows))]


def test_hyperminhash_brute_force(docs_of, odd):
    rng = np.random.default_rng(6)
    rows = []
    for _ in range(25):
        text = [f"t{i}" for i in rng.integers(0, 10**6, rng.integers(4, 90))]
        for _ in range(rng.integers(1, 14)):
            copy = list(text)
            for _ in range(rng.integers(0, 4)):
                copy[rng.integers(len(copy))] = f"n{rng.integers(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    for n in (4, 5, 6, 9):  # sets of n and of n + 1: similarity n / (n + 1)
        words = [f"s{n}x{i}" for i in range(n + 4)]
        rows += [(1000 + 2 * n, " ".join(words[: n + 3])), (1001 + 2 * n, " ".join(words))]
    rows += [(900, "a b c"), (901, "A b c"), (902, "a b c d")] + [(r.doc_id, r.text) for r in odd.collect()]
    got = hyperminhash.near_duplicates(docs_of(rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_components(rows)))
    assert hyperminhash.near_duplicates(odd.where("false")).count() == 0


def test_hyperminhash_large_groups_and_a_shared_passage(docs_of):
    rng = np.random.default_rng(9)
    text, passage = [f"q{i}" for i in range(150)], " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(text)) for i in range(100)]
    for i in range(100, 350):
        copy = list(text)
        for _ in range(3):
            copy[rng.integers(150)] = f"v{rng.integers(10**6)}"
        rows.append((i, " ".join(copy)))
    rows += [(i, f"{passage} {' '.join(f'u{i}x{j}' for j in range(rng.integers(5, 60)))}") for i in range(350, 550)]
    found = hyperminhash.near_duplicates(docs_of(rows))
    assert sorted(map(tuple, found.select("doc_id", "n_shingles", "component_id").collect())) == sorted(brute_components(rows))
    assert found.where("first").count() == found.select("component_id").distinct().count()


def random_sets(rng, n, similarity):
    """Two sorted sets whose union has about n elements and whose similarity is near the wanted one."""
    both = rng.integers(0, 2**64, n, dtype=np.uint64)
    common = max(1, round(n * similarity))
    half = common + (n - common) // 2
    return np.unique(both[:half]), np.unique(np.concatenate([both[:common], both[half:]]))


def test_registers_follow_their_definition():
    rng = np.random.default_rng(1)
    for n in (1, 3, 40, 3000):
        one = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        regs = hyperminhash.registers(one, np.array([0, len(one)]))[0]
        for bucket in range(hyperminhash.REGISTERS):
            inside = [int(h) & (2**55 - 1) for h in one if int(h) >> 55 == bucket]
            if not inside:
                assert regs[bucket] == hyperminhash.EMPTY
                continue
            bits = f"{min(inside):055b}"[:53]
            zeros = len(bits) - len(bits.lstrip("0"))
            assert regs[bucket] == zeros << 10 | int((bits[zeros + 1 :] + "0" * 60)[:10], 2)


@pytest.mark.parametrize("n", [5, 20, 100, 700, 5000])
def test_bands_meet_and_estimates_hold(n):
    """At similarity 0.8 every pair shares a band and none is ruled out; unrelated sets share no band."""
    rng = np.random.default_rng(n)
    sets = [random_sets(rng, n, 0.8) for _ in range(60)]
    rows = lambda side: (np.concatenate([s[side] for s in sets]), np.concatenate([[0], np.cumsum([len(s[side]) for s in sets])]))
    (a, of_a), (b, of_b) = rows(0), rows(1)
    ra, rb = hyperminhash.registers(a, of_a), hyperminhash.registers(b, of_b)
    same = hyperminhash.band_keys(ra) == hyperminhash.band_keys(rb)
    assert same.any(1).all() and not (hyperminhash.band_keys(ra) == np.roll(hyperminhash.band_keys(rb), 1, axis=0)).any()
    na, nb = np.diff(of_a).astype(float), np.diff(of_b).astype(float)
    found, used = hyperminhash.estimates(ra, rb, na, nb)
    assert hyperminhash.may_link(found, used, na, nb).all()
    real = np.array([len(np.intersect1d(x, y)) / len(np.union1d(x, y)) for x, y in sets])
    assert (np.abs(found - real) <= 6 * np.sqrt(0.16 / used)).all() and abs((found - real).mean()) < 0.02


def test_collisions_of_unrelated_sets():
    """Few mantissa bits make collisions frequent enough to count; the closed form gives their rate."""
    rng = np.random.default_rng(3)
    for na, nb in ((5000, 5000), (5000, 1000), (300, 600)):
        equal = total = 0
        for _ in range(60):
            a, b = (hyperminhash.registers(np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)), np.array([0, n])) for n in (na, nb))
            cut = lambda r: np.where(r == hyperminhash.EMPTY, 0, (r >> 8) + 1)  # noqa: E731  two mantissa bits
            equal += int(((cut(a) == cut(b)) & (a != hyperminhash.EMPTY) & (b != hyperminhash.EMPTY)).sum())
            total += a.size
        want = hyperminhash.collisions(np.array([float(na)]), np.array([float(nb)]), bits=2)[0]
        assert abs(equal / total - want) < 0.12 * want


def test_components_in_steps(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    frame = lambda e: spark.createDataFrame(e, "src long, dst long")
    scratch = Scratch(spark, "test-components")
    whole = dict(map(tuple, connected_components(frame(edges), scratch).collect()))
    some = None
    for i in range(0, len(edges), 90):
        some = extended_components(some, frame(edges[i : i + 90]), scratch)
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges for x in e if find(x) != x}
    assert whole == want and dict(map(tuple, some.collect())) == want and len(want) == some.count()


def test_set_names_agree(spark):
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (1, 2, 50)]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    assert jaccard_join.set_names(np.concatenate(sets), bounds).tolist() == [jaccard_join.set_key(s) for s in sets]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 12), st.integers(1, 30), st.integers(1, 4), st.integers(1, 6))
def test_assignment_is_that_of_a_full_search(seed, entries, rows, parts, spread):
    rng = np.random.default_rng(seed)
    books = vector_codes.Codebooks(rng.integers(-spread, spread + 1, (parts, entries, 2)))
    x = rng.integers(-spread - 2, spread + 3, (rows, parts, 2))
    d = ((x[:, :, None, :] - books.entries[None]) ** 2).sum(-1)
    for start in (None, rng.integers(0, entries, (rows, parts))):
        code, error = books.assign(x, start)
        assert (code == d.argmin(-1)).all() and (error == d.min(-1)).all()


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    x = np.array([v for _, _, v in kept]).reshape(len(kept), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for turn in range(rounds + 1):
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(-1)
        code, error = d.argmin(-1), d.min(-1).sum(1)
        if turn < rounds:
            for p in range(parts):
                for e in range(books.shape[1]):
                    if (mine := x[code[:, p] == e, p]).size:
                        books[p, e] = [sum(map(int, c)) // len(mine) for c in mine.T]
    sums = {}
    for (_, label, _), e in zip(kept, error):
        sums[label] = sums.get(label, 0) + int(e)
    return sorted([(i, "".join(f"{c:02x}" for c in row), int(e), sums[label]) for (i, label, _), row, e in zip(kept, code, error)], key=repr), hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 3, 200])
def test_codes_brute_force(spark, tmp_path, n):
    rng = np.random.default_rng(n)
    rows = [(int(i), list(map(float, rng.normal(0, 0.2, 32).astype(np.float32))), [None, 1, 2][i % 3]) for i in rng.permutation(n)]
    if n > 50:
        rows += [(500, None, 1), (501, [None, *rows[0][1][1:]], 1), (502, [math.nan, *rows[0][1][1:]], 1), (503, [math.inf, *rows[0][1][1:]], 2), rows[4], rows[4], (None, rows[5][1], None), (504, rows[6][1], 0), (505, [0.0] * 32, 0)]
    frame = spark.createDataFrame([(*r, 1.5, "x") for r in rows], "vec_id long, embedding array<float>, label int, error double, code string")
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vector_codes.op13_vector_codes(spark, str(tmp_path)).collect()
    if not n:
        assert got == []
        return
    want, digest = brute_codes(rows)
    assert sorted([tuple(r)[:4] for r in got], key=repr) == want and {r.codebooks_sha256 for r in got} == {digest}


def test_codes_stand_for_their_vectors(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 0.3, (20, 16))
    rows = [(i, list(map(float, centres[i % 20] + rng.normal(0, 0.01, 16))), i % 5) for i in range(600)] + [(900, [1.0, 2.0], 1), (901, [], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    codes, books = vector_codes.compress_vectors(frame, parts=4, entries=20, rounds=3)
    near = {r.vec_id: np.array(r.vector) for r in vector_codes.decode_vectors(codes, books).collect()}
    assert len(near) == 600 and max(np.abs(near[i] - v).max() for i, v, _ in rows[:600]) < 0.06
    with pytest.raises(ValueError):
        vector_codes.compress_vectors(frame, parts=5)


def test_hyperminhash_blocks_of_borderline_copies(docs_of, monkeypatch):
    """Copies whose similarities lie about the threshold, so that many stay apart; bands compared in small blocks."""
    monkeypatch.setattr(hyperminhash, "SMALL", 4)
    monkeypatch.setattr(hyperminhash, "BLOCK", 16)
    rng = np.random.default_rng(12)
    text = [f"q{i}" for i in range(120)]
    rows = []
    for i in range(220):
        copy = list(text)
        for _ in range(rng.integers(0, 9)):
            copy[rng.integers(120)] = f"v{rng.integers(10**6)}"
        rows.append((i, " ".join(copy)))
    got = sorted(map(tuple, hyperminhash.near_duplicates(docs_of(rows)).select("doc_id", "n_shingles", "component_id").collect()))
    want = sorted(brute_components(rows))
    assert got == want and 20 < len({c for _, _, c in want}) < 200


def test_sparse_registers_are_filled_as_by_the_walk(monkeypatch):
    rng = np.random.default_rng(9)
    sizes = [0, 1, 2, 5, 5, 9, 16, 17, 30, 400]
    sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in sizes]
    regs = hyperminhash.registers(np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)]))
    looked_up = hyperminhash.filled(regs)
    monkeypatch.setattr(hyperminhash, "SPARSE", 0)
    assert (looked_up == hyperminhash.filled(regs)).all() and (looked_up[1:] != hyperminhash.EMPTY).all() and (looked_up[0] == hyperminhash.EMPTY).all()
