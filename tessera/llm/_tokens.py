"""Token ids of whole texts with the word-BPE vocabulary, by way of distinct pieces.

The vocabulary's pre-tokenizer never joins text across white space, and it cuts a
plain word (ASCII or Latin-1 letters) into runs of letters, single digits and runs
of other signs. So a block of texts is cut into such pieces with numpy, only pieces
that this worker has not met go through the tokenizers library, and ids are gathered
from the store. A word with an apostrophe, an opening ``<|`` or any other character
goes through the whole tokenizer as it stands, and so does every text if the vocabulary
file has other text rules than these.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa

from tessera.llm._text import LOWER, NON_SPACE, blocks, runs, span_hash, span_lanes

END_ID = 1
BLOCK = 1 << 20
_PLAIN = np.where(~NON_SPACE, 0, 3).astype(np.uint8)
_PLAIN[65:91] = _PLAIN[97:123] = 1
_PLAIN[48:58] = 2
_COMPLEX_SALT = np.uint64(0x5851F42D4C957F2D)


#: The text rules under which a text may be cut into pieces as below.
KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def _byte_characters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Encoder:
    """Ids of the pieces met so far, in two indexes: a large one and a recent one.

    A hit counts only if the stored bytes are those of the piece. Once the store holds over
    ``MOST_BYTES`` its later half goes (frequent pieces come early), so a worker's memory
    doesn't grow with its input.
    """

    MOST_BYTES = 48 << 20

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.words = Tokenizer(self.whole.model)
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        size = self.whole.get_vocab_size()
        if size > 65536:
            raise ValueError("ids must fit 16 bits")
        self.last = np.zeros(size, bool)
        for token, i in self.whole.get_vocab().items():
            self.last[i] = token.endswith("</w>")
        self.table = _byte_characters()
        rules = json.loads(self.whole.to_str())
        self.known = rules["normalizer"] == KNOWN["normalizer"] and rules["pre_tokenizer"] == KNOWN["pre_tokenizer"]
        self.known &= all(t["content"].startswith("<|") for t in rules["added_tokens"])
        self.clear()

    def clear(self) -> None:
        self.keys = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
        self.index = [pd.Index(k) for k in self.keys]
        self.lens, self.begin = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.store, self.used = np.zeros(1 << 16, np.uint16), 0
        self.size, self.lane_at = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.lanes, self.lanes_used = np.zeros(1 << 15, np.uint64), 0

    def held_bytes(self) -> int:
        """What the store takes: ids, lanes and, for each piece, its entry, key and place in an index."""
        return self.store.nbytes + self.lanes.nbytes + len(self.lens) * (16 + 8 + 40)

    def shrink(self) -> None:
        """Keep the first half of the entries."""
        half = len(self.lens) // 2
        self.used, self.lanes_used = int(self.begin[half]), int(self.lane_at[half])
        self.store, self.lanes = self.store[: self.used].copy(), self.lanes[: self.lanes_used].copy()
        self.lens, self.begin, self.size, self.lane_at = (a[:half].copy() for a in (self.lens, self.begin, self.size, self.lane_at))
        self.keys = [np.concatenate(self.keys)[:half], np.zeros(0, np.uint64)]
        self.index = [pd.Index(k) for k in self.keys]

    def _find(self, h: np.ndarray) -> np.ndarray:
        at = self.index[0].get_indexer(h)
        miss = np.flatnonzero(at < 0)
        if len(miss) and len(self.keys[1]):
            found = self.index[1].get_indexer(h[miss])
            at[miss] = np.where(found < 0, -1, found + len(self.keys[0]))
        return at

    def _add(self, keys: np.ndarray, flat: np.ndarray, lens: np.ndarray, size: np.ndarray, lanes: np.ndarray) -> None:
        while self.used + len(flat) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros(max(len(self.store), 1 << 12), np.uint16)])
        while self.lanes_used + len(lanes) > len(self.lanes):
            self.lanes = np.concatenate([self.lanes, np.zeros(max(len(self.lanes), 1 << 12), np.uint64)])
        self.store[self.used : self.used + len(flat)] = flat
        self.lanes[self.lanes_used : self.lanes_used + len(lanes)] = lanes
        many = ((size >> 1) + 7) >> 3
        grow = lambda held, new: np.concatenate([held, new.astype(np.int32)])
        self.begin, self.lens = grow(self.begin, self.used + np.cumsum(lens) - lens), grow(self.lens, lens)
        self.lane_at, self.size = grow(self.lane_at, self.lanes_used + np.cumsum(many) - many), grow(self.size, size)
        self.used += len(flat)
        self.lanes_used += len(lanes)
        self.keys[1] = np.concatenate([self.keys[1], keys])
        if len(self.keys[1]) > max(50_000, len(self.keys[0]) // 4):
            self.keys = [np.concatenate(self.keys), np.zeros(0, np.uint64)]
            self.index[0] = pd.Index(self.keys[0])
        self.index[1] = pd.Index(self.keys[1])

    def _differ(self, source: np.ndarray, starts: np.ndarray, ends: np.ndarray, is_odd: np.ndarray, at: np.ndarray) -> bool:
        """Whether any piece is not the entry that its hash has found, by kind and bytes."""
        if (self.size[at] != 2 * (ends - starts) + is_odd).any():
            return True
        return any((self.lanes[self.lane_at[at[spans]] + places] != lanes).any() for spans, places, lanes in span_lanes(source, starts, ends))

    def _whole(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) by the library alone, text by text."""
        raw = data.tobytes()
        flat, lens = _end_to_end(self.whole.encode_batch_fast([raw[a:b].decode("utf-8", "replace") for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())], add_special_tokens=False))
        return flat, np.concatenate([[0], np.cumsum(lens)])

    def _plain_ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces without white space, end to end, and how many each has."""
        texts = [p.decode("ascii") if p.isalnum() else p.decode("latin1").translate(self.table) for p in pieces]
        joined = [" ".join(texts[i : i + 512]) for i in range(0, len(texts), 512)]
        ids = np.concatenate([np.array(e.ids, np.uint16) for e in self.words.encode_batch_fast(joined, add_special_tokens=False)])
        cuts = np.flatnonzero(self.last[ids]) + 1
        if len(cuts) == len(texts):
            return ids, np.diff(cuts, prepend=0)
        return _end_to_end(self.words.encode_batch_fast(texts, add_special_tokens=False))  # a piece whose last token has no word end

    def block(self, data: np.ndarray, offs: np.ndarray, ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, bounds of each row), without end ids; the bounds alone are cheaper."""
        if not len(data):
            return np.zeros(0, np.uint16), np.zeros(len(offs), np.int64)
        if not self.known:
            return self._whole(data, offs)
        kind, low = _PLAIN[data], LOWER[data]
        odd = data == 39
        high = data >= 128
        if high.any():
            lead = data == 0xC3
            nxt = np.empty_like(data)
            nxt[:-1], nxt[-1] = data[1:], 0
            lead &= (nxt != 0x97) & (nxt != 0xB7)
            at = np.flatnonzero(lead)
            kind[at] = kind[at + 1] = 1
            high[at] = high[at + 1] = False
            up = at[(data[at + 1] <= 0x9E)] + 1
            low[up] += 32
            odd |= high
        angle = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
        odd[angle] = True
        odd = np.flatnonzero(odd)
        if len(odd):
            ws, we = runs(NON_SPACE[data], offs)
            for w in np.unique(np.searchsorted(ws, odd, "right") - 1):
                kind[ws[w] : we[w]] = 4
        n = len(data)
        new = np.empty(n, bool)
        new[0] = True
        np.not_equal(kind[1:], kind[:-1], out=new[1:])
        new |= kind == 2
        new[offs[(offs > 0) & (offs < n)]] = True
        cuts = np.flatnonzero(new)
        ends = np.append(cuts[1:], n)
        keep = kind[cuts] != 0
        starts, ends = cuts[keep], ends[keep]
        is_odd = kind[starts] == 4
        if is_odd.any():
            source = low.copy()
            for s, e in zip(starts[is_odd], ends[is_odd]):
                source[s:e] = data[s:e]
        else:
            source = low
        h = span_hash(source, starts, ends)
        h[is_odd] ^= _COMPLEX_SALT
        if self.held_bytes() > self.MOST_BYTES:
            self.shrink() if len(self.lens) > 1000 else self.clear()
        at = self._find(h)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            codes, keys = pd.factorize(h[miss])
            first = np.full(len(keys), len(miss))
            np.minimum.at(first, codes, np.arange(len(miss)))
            first = miss[first]
            raw = source.tobytes()
            odd_first = is_odd[first]
            if not odd_first.all():
                plain = first[~odd_first]
                flat, lens = self._plain_ids([raw[s:e] for s, e in zip(starts[plain].tolist(), ends[plain].tolist())])
                self._add(keys[~odd_first], flat, lens, *_bytes_of(source, starts[plain], ends[plain], 0))
            if odd_first.any():
                words = [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[first[odd_first]].tolist(), ends[first[odd_first]].tolist())]
                flat, lens = _end_to_end(self.whole.encode_batch_fast(words, add_special_tokens=False))
                self._add(keys[odd_first], flat, lens, *_bytes_of(source, starts[first[odd_first]], ends[first[odd_first]], 1))
            at = self._find(h)
        if self._differ(source, starts, ends, is_odd, at):
            return self._whole(data, offs)
        lens, begin = self.lens[at].astype(np.int64), self.begin[at].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(lens)])
        bounds = total[np.searchsorted(starts, offs)]
        if not ids:
            return np.zeros(0, np.uint16), bounds
        pos = np.repeat(begin - total[:-1], lens) + np.arange(total[-1])
        return self.store[pos], bounds


def _end_to_end(encodings: list) -> tuple[np.ndarray, np.ndarray]:
    ids = [e.ids for e in encodings]
    return np.array([i for one in ids for i in one], np.uint16), np.fromiter(map(len, ids), np.int64, len(ids))


def _bytes_of(source: np.ndarray, starts: np.ndarray, ends: np.ndarray, odd: int) -> tuple[np.ndarray, np.ndarray]:
    """(twice the size of each span and whether it is odd, lanes of all spans end to end)."""
    lanes = [lanes for _, _, lanes in span_lanes(source, starts, ends)]
    return 2 * (ends - starts) + odd, np.concatenate([np.zeros(0, np.uint64), *lanes])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, so later tasks find its store filled."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(data: np.ndarray) -> list[np.ndarray]:
    """A long text in pieces of at most BLOCK bytes that start at white space, where there is any."""
    cuts = [0]
    while len(data) - cuts[-1] > BLOCK:
        space = np.flatnonzero(~NON_SPACE[data[cuts[-1] + BLOCK // 2 : cuts[-1] + BLOCK]])
        if not len(space):
            break
        cuts.append(cuts[-1] + BLOCK // 2 + int(space[-1]))
    return [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)])]


def count_column(column: pa.Array | pa.ChunkedArray, path: str) -> np.ndarray:
    """Number of ids of each row, the end id included."""
    enc, out = encoder(path), [np.zeros(0, np.int64)]
    for _, data, offs in blocks(column, BLOCK):
        if len(offs) == 2 and len(data) > 2 * BLOCK:
            out.append(np.array([sum(int(enc.block(p, np.array([0, len(p)]), ids=False)[1][-1]) for p in pieces(data))]))
        else:
            out.append(np.diff(enc.block(data, offs, ids=False)[1]))
    return np.concatenate(out) + 1


def encode_column(column: pa.Array | pa.ChunkedArray, path: str):
    """Yield (row, ids with the end id) for each row, in order."""
    enc = encoder(path)
    for lo, data, offs in blocks(column, BLOCK):
        if len(offs) == 2 and len(data) > 2 * BLOCK:
            parts = [enc.block(piece, np.array([0, len(piece)]))[0] for piece in pieces(data)]
            yield lo, np.append(np.concatenate(parts), np.uint16(END_ID))
            continue
        ids, bounds = enc.block(data, offs)
        for i in range(len(offs) - 1):
            one = ids[bounds[i] : bounds[i + 1]]
            yield lo + i, np.append(one, np.uint16(END_ID))


def crc_of(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
