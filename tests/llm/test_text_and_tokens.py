"""Kernels, token files, counts and packing against plain Python."""

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import _text, _tokens, packing, token_counts, token_shards
from tessera.session import Scratch

TEXTS = st.lists(st.text(alphabet=st.sampled_from("abC zZ\n\t.,'5éßÉ×日|<́ \x0b"), max_size=60), min_size=1, max_size=6)


@settings(max_examples=80, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_words_and_grams(texts, k):
    for members, pattern, lower in ((_text.NON_SPACE, r"[^\x20\x09-\x0D]+", False), (_text.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)):
        seen = {}
        for lo, data, offs in _text.blocks(pa.array([None, *texts]), 16):
            words = _text.Words(data, offs, members, lower)
            grams, bounds, first = words.grams(k)
            for i in range(len(words)):
                text = ([None, *texts][lo + i]) or ""
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower else text
                want = re.findall(pattern, text)
                assert words.counts[i] == len(want)
                runs = [tuple(want[j : j + k]) for j in range(len(want) - k + 1)] or ([tuple(want)] if want else [])
                got = grams[bounds[i] : bounds[i + 1]].tolist()
                assert len(got) == len(runs)
                for g, r in zip(got, runs):
                    assert seen.setdefault(g, r) == r
        assert len(set(seen.values())) == len(seen)


@settings(max_examples=80, deadline=None)
@given(TEXTS)
def test_ids_equal_the_library(texts):
    from tokenizers import Tokenizer

    path = _tokens.vocabulary_path()
    whole = _tokens.encoder(path).whole
    assert isinstance(whole, Tokenizer)
    for row, ids in _tokens.encode_column(pa.array(texts), path):
        assert ids.tolist() == whole.encode(texts[row], add_special_tokens=False).ids + [1]


def test_long_texts_in_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    text = " ".join("".join(rng.choice(list("abcé'1."), rng.integers(1, 9))) for _ in range(3000))
    data, offs = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])
    whole = _text.Words(data, offs, _text.NON_SPACE, False).hash
    want = [ids.tolist() for _, ids in _tokens.encode_column(pa.array([text]), _tokens.vocabulary_path())]
    monkeypatch.setattr(_text, "LANES_AT_ONCE", 64)
    monkeypatch.setattr(_tokens, "BLOCK", 600)
    assert (_text.Words(data, offs, _text.NON_SPACE, False).hash == whole).all()
    assert [ids.tolist() for _, ids in _tokens.encode_column(pa.array([text]), _tokens.vocabulary_path())] == want == [library_ids(text)]
    assert _tokens.count_column(pa.array([text]), _tokens.vocabulary_path()).tolist() == [len(want[0])]


@pytest.mark.parametrize("space", [" ", "\n"])
def test_short_span_before_a_very_long_one(space):
    raw = f"title{space}{'abcdefghij' * 950_000}{space}title".encode()
    data, ends = np.frombuffer(raw, np.uint8), np.array([5, len(raw) - 6, len(raw)])
    starts = np.array([0, 6, len(raw) - 5])
    got = _text.span_hash(data, starts, ends)
    assert (got == _text.Words(data, np.array([0, len(raw)]), _text.NON_SPACE, False).hash).all()
    assert got[0] == got[2] and (got == [_text.span_hash(data[a:b].copy(), np.array([0]), np.array([b - a]))[0] for a, b in zip(starts, ends)]).all()


def test_ids_of_a_short_word_before_a_very_long_one():
    text = "word " + "abcdefghij" * 950_000
    path = _tokens.vocabulary_path()
    (_, ids), *rest = _tokens.encode_column(pa.array([text]), path)
    assert not rest and ids.tolist() == library_ids(text)
    assert _tokens.count_column(pa.array([text]), path).tolist() == [len(ids)]


def thue_morse(n):
    """Two words of n letters whose polynomial hashes modulo 2 ** 64 agree."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 2048, 8192])
def test_thue_morse_words_differ(n):
    a, b = thue_morse(n)
    _, data, offs = next(_text.blocks(pa.array([f"{a} {b}"])))
    assert len(set(_text.Words(data, offs, _text.NON_SPACE, False).hash.tolist())) == 2
    for text, (_, ids) in zip((a, b, a), _tokens.encode_column(pa.array([a, b, a]), _tokens.vocabulary_path())):
        assert ids.tolist() == library_ids(text)


def test_equal_hashes_do_not_mix_ids(monkeypatch):
    """Pieces whose hashes collide still get the library's ids."""
    enc = _tokens.Encoder(_tokens.vocabulary_path())
    monkeypatch.setitem(_tokens._encoders, _tokens.vocabulary_path(), enc)
    monkeypatch.setattr(_tokens, "span_hash", lambda data, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(3))
    texts = ["alpha betas gamma", "delta 12 it's", "alpha", ""]
    for text, (_, ids) in zip(texts, _tokens.encode_column(pa.array(texts), _tokens.vocabulary_path())):
        assert ids.tolist() == enc.whole.encode(text, add_special_tokens=False).ids + [1]


def test_store_is_bounded(monkeypatch):
    enc = _tokens.Encoder(_tokens.vocabulary_path())
    monkeypatch.setattr(_tokens.Encoder, "MOST_BYTES", 400_000)
    for turn in range(20):
        text = " ".join(f"common word{turn}x{i}q" for i in range(1500)).encode()
        ids, bounds = enc.block(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert ids.tolist() == enc.whole.encode(text.decode(), add_special_tokens=False).ids
        assert enc.held_bytes() < 2 * 400_000


def test_other_text_rules_go_to_the_library(tmp_path):
    import json

    rules = json.load(open(_tokens.vocabulary_path()))
    rules["normalizer"] = {"type": "NFC"}
    path = str(tmp_path / "cased.json")
    json.dump(rules, open(path, "w"))
    enc = _tokens.Encoder(path)
    assert not enc.known
    for row, ids in _tokens.encode_column(pa.array(["Upper lower", "A'b"]), path):
        assert ids.tolist() == enc.whole.encode(["Upper lower", "A'b"][row], add_special_tokens=False).ids + [1]


def test_memory_of_a_worker():
    """A million distinct pieces take a bounded store."""
    import resource

    enc = _tokens.Encoder(_tokens.vocabulary_path())
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for turn in range(50):
        text = " ".join(map(_letters, range(turn * 20_000, (turn + 1) * 20_000))).encode()
        enc.block(np.frombuffer(text, np.uint8), np.array([0, len(text)]), ids=False)
    assert enc.held_bytes() < 1.2 * enc.MOST_BYTES
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000  # KB


def _letters(i):
    return "".join(chr(97 + int(c)) for c in str(i)) + "ly"


def library_ids(text):
    return _tokens.encoder(_tokens.vocabulary_path()).whole.encode(text or "", add_special_tokens=False).ids + [1]


def test_token_files_round_trip(spark, odd):
    folder = Scratch(spark, "files").path
    manifest = token_shards.write_token_shards(odd, folder)
    got = token_shards.read_token_shards(token_shards.read_manifest(spark, folder), with_ids=True).orderBy("start").collect()
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert sorted(map(str, (r.ids for r in got))) == sorted(str(library_ids(t)) for _, t in rows)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(b"".join(struct.pack("<I", x) for x in r.ids)))
        at += r.n_tokens
    one = next(r for r in got if r.doc_id == 6)
    where = manifest.where(F.col("start") <= one.start).orderBy(F.desc("start")).first().path
    assert token_shards.fetch_documents(where, [6])["ids"][0].tolist() == one.ids


def test_file_layout_and_checksum(tmp_path):
    import zstandard

    where = str(tmp_path / "a.tok")
    with open(where, "wb") as f:
        writer = token_shards.FrameWriter(f, frame_ids=4)
        for i in range(5):
            writer.add(i, np.array([i, i + 1, 1], np.uint16))
        writer.close()
    raw = open(where, "rb").read()
    n, _, magic = struct.unpack("<IBI", raw[-9:])
    assert magic == token_shards.SEEKABLE_MAGIC and n == 6
    assert b"".join(zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).readall().split())  # a plain reader skips the table
    fs, path = token_shards.open_store(f"file://{where}")
    with fs.open_input_file(path) as f:
        reader = token_shards.FrameReader(f)
        assert [(p, i.tolist()) for p, i in reader.documents([3, 1])] == [(1, [1, 2, 1]), (3, [3, 4, 1])]
        reader.entries = reader.entries.copy()
        reader.entries[0, 2] ^= 1
        with pytest.raises(ValueError):
            reader.frame(0)


def test_only_requested_documents_are_read(tmp_path):
    """By default a document has a frame of its own, and no byte of other documents is read."""
    where = str(tmp_path / "b.tok")
    docs = [np.append(np.full(2000 + i, i, np.uint16), np.uint16(1)) for i in range(50)]
    with open(where, "wb") as f:
        writer = token_shards.FrameWriter(f)
        for i, ids in enumerate(docs):
            writer.add(i, ids)
        writer.close()
    fs, path = token_shards.open_store(f"file://{where}")
    with fs.open_input_file(path) as f:
        reader = token_shards.FrameReader(f)
        assert len(reader.entries) == 51
        seen, plain = [], reader._frames
        reader._frames = lambda wanted: (seen.extend(np.asarray(wanted).tolist()), plain(wanted))[1]
        assert [(p, i.tolist()) for p, i in reader.documents([7, 8, 31])] == [(p, docs[p].tolist()) for p in (7, 8, 31)]
        assert seen == [7, 8, 31]
        assert [i.tolist() for _, i in reader.documents()] == [d.tolist() for d in docs]


def test_histogram_against_brute_force(spark, odd, folder):
    docs = odd.select("text").unionByName(spark.read.parquet(f"{folder}/documents.parquet").select("text"))
    lens = [len(library_ids(r.text)) for r in docs.collect()]
    hist = token_counts.length_histogram(docs)
    rows = {r.n_tokens: r for r in hist.collect()}
    assert sorted(rows) == sorted(set(lens))
    for size, r in rows.items():
        longer = [x for x in lens if x >= size]
        assert (r.n_docs, r.docs_ge, r.tokens_ge, r.truncated_total) == (lens.count(size), len(longer), sum(longer), sum(min(x, size) for x in lens))
    for r in token_counts.context_report(hist, [1, 100, 512, 10**6]).collect():
        assert (r.docs_cut, r.tokens_kept) == (sum(x > r.context_limit for x in lens), sum(min(x, r.context_limit) for x in lens))
    for r in token_counts.length_quantiles(hist, [0.5, 0.9, 1.0]).collect():
        assert r.n_tokens == sorted(lens)[int(np.ceil(r.share * len(lens))) - 1]


def plain_best_fit(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            best = min(fits)
            gaps.remove(best)
            gaps.append(best - s)
        else:
            gaps.append(capacity - s)
    return len(gaps)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_runs_are_a_best_fit(sizes):
    counts = {s: sizes.count(s) for s in set(sizes)}
    filled = {}
    for size, lo, hi, first, offset in packing.pack_runs(counts, 40):
        for r in range(lo, hi):
            filled.setdefault(first + r - lo, []).append((offset, size))
    assert sorted(s for b in filled.values() for _, s in b) == sorted(sizes)
    for b in filled.values():
        at = 0
        for offset, size in sorted(b):
            assert offset == at
            at += size
        assert at <= 40
    assert len(filled) == plain_best_fit(sizes, 40)


def test_packing_of_documents(odd):
    rows = packing.pack_documents(odd, 512).collect()
    want = sorted(str((r.doc_id, i // 512, i, ids[i : i + 512])) for r in odd.collect() for ids in [library_ids(r.text)] for i in range(0, len(ids), 512))
    got = {}
    for r in rows:
        got.setdefault(r.sequence_id, []).append(r)
    assert len(rows) == len(want)
    assert sorted((str(r.doc_id), r.piece, r.start, r.length) for r in rows) == sorted((str(r.doc_id), i // 512, i, len(ids[i : i + 512])) for r in odd.collect() for ids in [library_ids(r.text)] for i in range(0, len(ids), 512))
    crcs = [zlib.crc32(b"".join(struct.pack("<I", x) for x in ids[i : i + 512])) for r in odd.collect() for ids in [library_ids(r.text)] for i in range(0, len(ids), 512)]
    assert sorted(r.ids_crc32 for r in rows) == sorted(crcs)
    for b in got.values():
        at = 0
        for r in sorted(b, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512


def test_empty_tables(spark, odd):
    none = odd.where("false")
    assert token_shards.read_token_shards(token_shards.write_token_shards(none, Scratch(spark, "none").path)).count() == 0
    assert token_counts.length_histogram(none).count() == 0
    assert packing.pack_documents(none).count() == 0
