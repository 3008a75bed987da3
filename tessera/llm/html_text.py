"""Main text of web pages: suffix arrays over the pages of each host, and page structure.

Each page is cut into blocks. Blocks of menus, headers, footers, sidebars, adverts,
forms, notices and comments go by their markup. All pages then meet the other pages of
their host: the token streams are concatenated, and a suffix array sorted to ``DEPTH``
tokens finds on how many distinct pages every string of that length stands.

* On a page without an article, main or content element, an open block that strings of
  two distinct pages cover is boilerplate; unique runs stay.
* On a page with one, whose markup says what its text is, strings must stand on more
  than half of the host's distinct texts, and on ``TEMPLATE_PAGES`` of them, to say
  otherwise of a block: articles share passages, licence lines and whole copies.

A host of many pages is dealt into shards by its texts, so copies meet in one shard; each
shard has its suffix array in one task. Arrays of one host are merged in Spark: of a
string on one page of a shard, the page hears whether another shard has it too; a string
on more than half of all texts is on more than half of those of some shard, and only such
strings are counted over all shards.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._text import NON_SPACE, Words, as_long, blocks, mix, tidy
from tessera.session import Scratch

DEPTH = 5
COVERED = 0.8
PAGES_IN_TASK = 256
BYTES_IN_TASK = 16 << 20
TEMPLATE_PAGES = 8
HOSTS_SENT = 500_000  # of more shards than one, named to all tasks
SEEN = 1 << 17  # texts that a task remembers, so as to send their copies without text
ROWS_OUT, BYTES_OUT = 1024, 4 << 20
COPIES_OUT = 1024  # rows of one text that its shard gives with the text; the others get it later, in all tasks
COPIED_BYTES, SALTS = 8 << 20, 32  # texts of so many copies that are sent to all tasks; beyond, each is joined in so many places
_P, _END = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x2545F4914F6CDD1D)

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)", re.S)
_STOP = re.compile(r"[>\"']")
_ATTRS = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME = re.compile(r"[a-z0-9]+")
_SIZE = re.compile(r"\d+(?:x\d+)?")

#: Elements by their part in a page.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUT = frozenset("nav footer aside form menu button select option label fieldset dialog template svg canvas object audio video head".split())
MAIN = frozenset("article main".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - frozenset(["body", "html"])
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
OUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget widgets footer masthead comment comments commentlist disqus respond reply replies share sharing social related recommended newsletter subscribe subscription signup login search pagination pager toolbar".split()
)
MAIN_NAMES = frozenset("article content post entry story main maincontent articlebody storybody".split())
#: Parts of a compound name that say where or what kind of box it is, not what is in it.
BOX_NAMES = frozenset(
    "site page blog news single primary secondary global local top bottom left right center inner outer container wrapper wrap box block body area section region bar rail column col row list item items group unit slot zone holder panel header title text links link buttons button icons form field thread author meta posts articles stories articlelist full width main content article post entry story".split()
)


def _says(token: str, names: frozenset) -> bool:
    """Whether a class or id says one of ``names``: by itself, or with words for boxes and numbers only.

    So 'comment-body' and 'ad-300x250' speak of comments and adverts; 'related-work',
    'ad-hoc' and 'no-comments' speak of something else.
    """
    if token in names:
        return True
    parts = _NAME.findall(token)
    return not names.isdisjoint(parts) and all(x in names or x in BOX_NAMES or _SIZE.fullmatch(x) for x in parts)


def _role(name: str, attrs: str, in_main: bool) -> str | None:
    """'out', 'main' or None for a start tag; the names of an article decide before the element does."""
    if name in OUT or name == "header" and not in_main:
        return "out"
    names: list[str] = []
    if attrs:
        for key, a, b, c in _ATTRS.findall(attrs):
            value, key = (a or b or c).lower(), key.lower()
            if key == "role" and value in OUT_ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
                return "out"
            if key == "role" and value in MAIN:
                return "main"
            if key in ("class", "id"):
                names += value.split()
    if name not in ("html", "body", "main") and any(_says(n, OUT_NAMES) for n in names):
        return "out"
    if name in MAIN:
        return "main"
    if name not in ("html", "body"):
        if not in_main and any("header" in _NAME.findall(n) and _says(n, BOX_NAMES) for n in names):
            return "out"
        if any(_says(n, MAIN_NAMES) for n in names):
            return "main"
    return None


def _tag_end(page: str, at: int, failed: set[int], last: dict[str, int]) -> int:
    """Place after the '>' that ends a tag whose attributes go on from ``at``; quotes hide a '>'.

    If no such '>' comes up to the page's end, the tag's quotes are broken and it ends at
    the first '>' of any kind. ``failed`` holds the closing quotes after which none comes,
    so that pages of broken tags are read in linear time.
    """
    first, seen = page.find(">", at) + 1, []
    while True:
        stop = _STOP.search(page, at) if at <= last[">"] else None
        if stop and stop[0] == ">":
            return stop.end()
        close = page.find(stop[0], stop.end()) if stop and stop.start() < last[stop[0]] else -1
        if close < 0 or close in failed:
            failed.update(seen)
            return first
        seen.append(close)
        at = close + 1


def page_blocks(page: str) -> list[tuple[str, str, int]]:
    """Blocks outside 'out' elements in page order: (text, 'main' or 'open', characters inside links)."""
    blocks: list[tuple[str, str, int]] = []
    stack: list[tuple[str, str | None]] = []
    opened: Counter = Counter()  # elements on the stack by name
    block_at: list[int] = []  # places of block elements on the stack
    parts: list[str] = []
    out = main = links = linked = pos = 0
    last, failed = {c: page.rfind(c) for c in ">\"'"}, set()
    size = len(page)
    open_comment = page.find("<!--", last[">"] + 1)  # no tag follows it, and it runs to the page's end

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append((text, "main" if main else "open", linked))
            parts.clear()
        linked = 0

    def pop() -> str:
        nonlocal out, main, links
        name, role = stack.pop()
        opened[name] -= 1
        if block_at and block_at[-1] == len(stack):
            block_at.pop()
        out -= role == "out"
        main -= role == "main"
        links -= name == "a"
        return name

    def text_between(lo: int, hi: int) -> None:
        nonlocal linked
        if lo < hi and not out:
            piece = page[lo:hi]
            if "&" in piece:
                piece = html.unescape(piece)
            parts.append(piece)
            if links:
                linked += len(piece.strip())

    while pos < size:
        tag = _TAG.search(page, pos) if pos <= last[">"] else None
        if not tag or tag[2] and tag.end() > last[">"]:
            text_between(pos, open_comment if open_comment >= pos else size)
            break
        text_between(pos, tag.start())
        pos = tag.end()
        if not tag[2]:
            continue
        pos = _tag_end(page, pos, failed, last)
        name, attrs = tag[2].lower(), page[tag.end() : pos - 1]
        if tag[1]:
            if name in VOID:
                continue
            if opened[name]:
                if name in BLOCK or name in OUT:
                    flush()
                while pop() != name:
                    pass
            elif name == "p":
                flush()
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, pos)
            pos = close.end() if close else size
            continue
        if name in VOID:
            if name == "hr":
                flush()
            else:
                parts.append(" ") if not out and name == "br" else None
            continue
        if name in BLOCK:
            flush()
            if name in ENDS_P and opened["p"] and stack[block_at[-1]][0] == "p":  # no block element inside the open p
                while pop() != "p":
                    pass
        if attrs.endswith("/") and name not in BLOCK:
            continue
        role = _role(name, attrs, main > 0)
        if role == "out":
            flush()
        if name in BLOCK:
            block_at.append(len(stack))
        stack.append((name, role))
        opened[name] += 1
        out += role == "out"
        main += role == "main"
        links += name == "a"
    flush()
    return blocks


class SuffixArray:
    """Suffixes of the token streams of pages, sorted to ``depth`` tokens.

    A block's end is a token, so short blocks count with their neighbours; a page's end
    is a token of its own and no string crosses it.
    """

    def __init__(self, pages: list[list[str]], depth: int = DEPTH):
        tokens = [b.split() for one in pages for b in one]
        self.depth, self.blocks, self.words = depth, np.array([len(one) for one in pages], np.int64), np.array([len(b) for b in tokens], np.int64)
        page = np.repeat(np.arange(len(pages)), self.blocks)
        self.first = np.cumsum(self.words + 1) - self.words - 1 + page
        size = np.bincount(page, self.words + 1, len(pages)).astype(np.int64) + 1
        ends, n = np.cumsum(size) - 1, int(size.sum())
        self.page_of = np.repeat(np.arange(len(pages)), size)
        rank = np.full(n, len(pages), np.int64)
        rank[ends] = np.arange(len(pages))
        code = pd.factorize(np.array([t for b in tokens for t in b], object))[0]
        rank[np.arange(len(code)) + np.repeat(self.first - np.cumsum(self.words) + self.words, self.words)] = code + len(pages) + 1
        sorted_to = 1
        while sorted_to < depth:  # prefix doubling; the last step overlaps so as to end at `depth`
            step = min(sorted_to, depth - sorted_to)
            later = np.full(n, -1, np.int64)
            later[: n - step] = rank[step:]
            rank = np.unique(rank * (rank.max() + 2) + later + 1, return_inverse=True)[1].astype(np.int64)
            sorted_to += step
        self.rank, self.order = rank, np.argsort(rank * len(pages) + self.page_of)
        self.whole = np.arange(n) + depth <= np.repeat(ends, size)

    def on_pages(self, weight: np.ndarray) -> np.ndarray:
        """For each place, the summed weights of the distinct pages that have its string; 0 where it crosses a page's end."""
        r, p = self.rank[self.order], self.page_of[self.order]
        new = np.concatenate([[True], (r[1:] != r[:-1]) | (p[1:] != p[:-1])])
        return np.where(self.whole, np.bincount(r[new], weight[p[new]])[self.rank], 0)

    def shares(self, at: np.ndarray) -> list[np.ndarray]:
        """Share of each block's tokens inside the strings that begin at the places ``at``, by page."""
        edge = np.zeros(len(at) + self.depth, np.int64)
        np.add.at(edge, np.flatnonzero(at), 1)
        np.add.at(edge, np.flatnonzero(at) + self.depth, -1)
        inside = np.concatenate([[0], np.cumsum(np.cumsum(edge) > 0)])
        share = (inside[self.first + self.words] - inside[self.first]) / np.maximum(self.words, 1)
        return np.split(share, np.cumsum(self.blocks)[:-1])


def covered_blocks(pages: list[list[str]], depth: int = DEPTH) -> list[np.ndarray]:
    """Share of each block's tokens inside strings of ``depth`` tokens that stand on two distinct pages."""
    array = SuffixArray(pages, depth)
    return array.shares(array.on_pages(np.ones(len(pages))) > 1)


def page_strings(pages: pa.ListArray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the string of ``depth`` tokens at each place, pages' bounds, blocks' first places, blocks' tokens).

    Places are those of ``covered_blocks``: tokens, and the end of each block. A string
    that would cross its page's end has the hash 0.
    """
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, data, offs in blocks(pages.flatten()):
        words = Words(data, offs, NON_SPACE, False)
        hashes.append(words.hash)
        counts.append(words.counts)
    token, counts = np.concatenate(hashes), np.concatenate(counts)
    at = np.concatenate([[0], np.cumsum(counts + 1)])
    stream = np.full(at[-1], _END, np.uint64)
    stream[np.arange(len(token)) + np.repeat(np.arange(len(counts)), counts)] = token
    bounds = at[np.concatenate([[0], np.cumsum(pages.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)]
    out, n = np.zeros(len(stream), np.uint64), len(stream) - depth + 1
    if n > 0:
        rolled = np.zeros(n, np.uint64)
        for j in range(depth):
            rolled = rolled * _P + stream[j : j + n]
        until = np.repeat(bounds[1:], np.diff(bounds))[:n]
        out[:n] = np.where(np.arange(n) + depth <= until, mix(rolled), np.uint64(0))
    return as_long(out), bounds, at[:-1], counts


def _parts(batches):
    """Batches of few pages, as each token takes many bytes."""
    return (batch.slice(lo, PAGES_IN_TASK) for batch in batches for lo in range(0, batch.num_rows, PAGES_IN_TASK))


def string_keys(batches):
    """(key, row) of the distinct strings of each page, from (host's hash, row, open); keys of two hosts differ."""
    for batch in _parts(batches):
        strings, bounds, _, _ = page_strings(batch.column(2))
        host = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        keys = [_keys_of(np.unique(one[one != 0]), h) for one, h in zip(np.split(strings, bounds[1:-1]), host)]
        row = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), [len(k) for k in keys])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])), pa.array(row, pa.int64())], names=["key", "row"])


def _keys_of(strings: np.ndarray, host: np.uint64) -> np.ndarray:
    return as_long(mix(strings.view(np.uint64) ^ mix(np.array([host]))))


def cover_by_keys(batches):
    """Whether each block is covered by its page's repeated strings, from (host, row, page_id, url, open, linked, host's hash, repeated)."""
    for batch in _parts(batches):
        strings, bounds, first, counts = page_strings(batch.column(4))
        of_page = np.split(strings, bounds[1:-1])
        edge = np.zeros(len(strings) + 1, np.int64)
        for i, one in enumerate(of_page):
            repeated = batch.column(7)[i].values
            if repeated is not None:
                host = batch.column(6)[i].as_py() % 2**64
                at = bounds[i] + np.flatnonzero((one != 0) & np.isin(_keys_of(one, np.uint64(host)), repeated.to_numpy(zero_copy_only=False)))
                np.add.at(edge, at, 1)
                np.add.at(edge, at + DEPTH, -1)
        inside = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
        share = (inside[first + counts] - inside[first]) / np.maximum(counts, 1)
        lens = np.concatenate([[0], np.cumsum(batch.column(4).value_lengths().to_numpy(zero_copy_only=False))])
        covered = pa.ListArray.from_arrays(pa.array(lens, pa.int32()), pa.array(share >= COVERED))
        yield pa.RecordBatch.from_arrays([*batch.columns[:6], covered], names=["host", "row", "page_id", "url", "open", "linked", "covered"])


def parse(batches):
    """Texts of pages, from (host, hash, shards, row, page_id, url, html); a text the task has sent before goes without it."""
    seen: set[bytes] = set()
    for batch in batches:
        marks, contents, packed, links = [], [], [], []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(6)):
            found = page_blocks(page.as_py() or "")
            sure = [t for t, kind, _ in found if kind == "main"]
            marks.append(bool(sure))
            text = "\n".join(sure or [t for t, _, _ in found]).encode()
            linked = None if sure else [2 * n > len(t) for t, _, n in found]
            content = hashlib.blake2b(b"\n".join([host.encode(), repr(linked).encode(), text]), digest_size=16).digest()
            again = content in seen
            if not again:
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(content)
            contents.append(content)
            packed.append(None if again else len(text).to_bytes(8, "little") + pa.compress(text, "zstd", asbytes=True))
            links.append(None if again else linked)
        columns = [pa.array(marks, pa.bool_()), pa.array(contents, pa.binary()), pa.array(packed, pa.binary()), pa.array(links, pa.list_(pa.bool_()))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], batch.column(5).cast(pa.string()), *columns], names=["host", "hash", "shards", "row", "page_id", "url", "marked", "content", "packed", "linked"])


class Shard:
    """Pages of one shard of a host: its distinct texts, and the rows that have them."""

    def __init__(self, host: str, hashed: int, large: bool):
        self.host, self.hash, self.large = host, np.uint64(hashed % 2**64), large
        self.content: list[bytes] = []
        self.marked: list[bool] = []
        self.text: list[str] = []
        self.linked: list[list[bool]] = []
        self.rows: list[tuple[int, int, int | None, str | None]] = []  # text, row, page_id, url

    def add(self, row: int, page_id: int | None, url: str | None, marked: bool, content: bytes, packed: bytes | None, linked: list[bool] | None) -> None:
        if not self.content or self.content[-1] != content:  # a text's first row has it
            self.content.append(content)
            self.marked.append(marked)
            self.text.append(pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True).decode())
            self.linked.append(linked or [])
        self.rows.append((len(self.content) - 1, row, page_id, url))

    def settle(self):
        """Rows of ``KINDS``: pages with their text, open pages of a large host with what is known, copies, and strings to merge."""
        pages = [t.split("\n") if t else [] for t in self.text]
        array = SuffixArray(pages)
        marked, copies = np.array(self.marked), np.bincount([r[0] for r in self.rows])
        open_on = array.on_pages(np.where(marked, 0, np.minimum(copies, 2)))
        marked_on = array.on_pages(marked.astype(np.float64))
        template = 2 * marked_on > marked.sum()
        enough = template & (marked_on >= TEMPLATE_PAGES) & (not self.large)
        covered = [s >= COVERED for s in array.shares(np.where(marked[array.page_of], enough, open_on > 1))]
        boilerplate = {b for one, cover, m in zip(pages, covered, self.marked) if not m for b, c in zip(one, cover) if c}
        texts = []
        for one, cover, m, linked in zip(pages, covered, self.marked, self.linked):
            if m:
                texts.append("\n".join(own_blocks(one, cover)))
            else:
                texts.append("\n".join([b for b, link in zip(one, linked) if not link and b not in boilerplate] or one))
        known: dict[int, np.ndarray] = {}
        if self.large:
            strings = page_strings(pa.array(pages, pa.list_(pa.string())))[0]
            key = np.zeros(len(array.rank), np.int64)
            ends = np.append(array.page_of[1:] != array.page_of[:-1], True)
            key[~ends] = _keys_of(strings, self.hash)
            at = np.flatnonzero(open_on > 1)
            known = {p: np.unique(some) for p, some in enumerate(np.split(key[at], np.searchsorted(array.page_of[at], np.arange(1, len(pages)))))}
            row_of = {r[0]: r[1] for r in self.rows}
            at = np.flatnonzero(open_on)
            at = at[np.unique(array.rank[at], return_index=True)[1]]
            yield from self._strings(key[at], [row_of[p] for p in array.page_of[at].tolist()], (open_on[at] > 1).tolist())
            likely = np.unique(key[template & (marked_on > 0)])
            yield from self._strings(likely, [None] * len(likely), [None] * len(likely))
        near, far, first, times = [], [], {}, Counter()
        for r in self.rows:
            times[r[0]] += 1
            first.setdefault(r[0], r[1])
            (near if times[r[0]] <= COPIES_OUT else far).append(r)
        for part in _pieces(far, len):
            yield _kinds({"row": [first[r[0]] for r in part], "page_id": [r[2] for r in part], "url": [r[3] for r in part]}, len(part))
        for part in _pieces(near, lambda r: len(self.text[r[0]])):
            p = [r[0] for r in part]
            later = [self.large and not self.marked[i] and bool(pages[i]) for i in p]
            yield _kinds({
                "host": [self.host] * len(p), "hash": [int(self.hash.astype(np.int64))] * len(p), "marked": [self.marked[i] for i in p], "content": [self.content[i] for i in p],
                "row": [r[1] for r in part], "page_id": [r[2] for r in part], "url": [r[3] for r in part], "text": [None if wait else texts[i] for i, wait in zip(p, later)],
                "open": [pages[i] if wait else None for i, wait in zip(p, later)], "linked": [self.linked[i] if wait else None for i, wait in zip(p, later)],
                "known": [known.get(i, []) if wait else None for i, wait in zip(p, later)],
            }, len(p))

    def _strings(self, key: np.ndarray, row: list, many: list):
        for lo in range(0, len(key), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            n = len(key[part])
            yield _kinds({"host": [self.host] * n, "key": key[part], "row": row[part], "many": many[part]}, n)


#: What a shard gives: pages (with text or open blocks), copies (page_id, url and the row that has their text), open strings (``many``: on two pages of the shard; else on that of ``row``) and likely templates (``many`` is null).
KINDS = pa.schema(
    [("host", pa.string()), ("hash", pa.int64()), ("marked", pa.bool_()), ("content", pa.binary()), ("row", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())]
    + [("open", pa.list_(pa.string())), ("linked", pa.list_(pa.bool_())), ("known", pa.list_(pa.int64())), ("key", pa.int64()), ("many", pa.bool_())]
)


def _kinds(columns: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in KINDS], schema=KINDS)


def own_blocks(blocks: list[str], covered: np.ndarray) -> list[str]:
    """Blocks that aren't covered; all of them if most of the page's words are."""
    own = [b for b, c in zip(blocks, covered) if not c]
    words = [sum(b.count(" ") + 1 for b in some) for some in (own, blocks)]
    return own if 2 * words[0] >= words[1] else blocks


def _pieces(rows: list, size):
    part, held = [], 0
    for r in rows:
        part.append(r)
        held += size(r)
        if len(part) == ROWS_OUT or held > BYTES_OUT:
            yield part
            part, held = [], 0
    if part:
        yield part


def settle_shards(batches):
    """Rows of all shards of a task, whose pages come sorted by (host, shard, content), texts first."""
    at, shard = None, None
    for batch in batches:
        for host, hashed, shards, number, *row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            if (host, number) != at:
                if shard:
                    yield from shard.settle()
                at, shard = (host, number), Shard(host, hashed, shards > 1)
            shard.add(*row)
    if shard:
        yield from shard.settle()


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``.

    Null and empty html give an empty text. A page with an article, main or content
    element has that element's blocks but those covered by strings of more than half of
    the host's distinct texts (all, if these make up most of it); any other page has its
    open blocks that neither consist of links for the greater part nor are covered by
    strings of other open pages of the host, or all its open blocks if none would be left.
    Pages without a url share the host ''. Repeated rows are kept; they are distinct open
    pages, but one text where templates are counted. Other columns are ignored.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "pages")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))
    chosen = pages.select(host.alias("host"), F.col("page_id").cast("long").alias("page_id"), "url", "html")
    shards = F.greatest(F.ceil(F.count("*") / PAGES_IN_TASK), F.ceil(F.sum(F.octet_length("html")) / BYTES_IN_TASK))
    large = scratch.table(chosen.groupBy("host").agg(shards.alias("shards")).where("shards > 1"), "large")
    n_large = large.count()
    chosen = chosen.join(F.broadcast(large) if n_large <= HOSTS_SENT else large, "host", "left").withColumn("row", F.monotonically_increasing_id())
    chosen = chosen.select("host", F.xxhash64("host").alias("hash"), F.coalesce("shards", F.lit(1)).alias("shards"), "row", "page_id", "url", "html")
    parsed = chosen.mapInArrow(tidy(parse), "host string, hash long, shards long, row long, page_id long, url string, marked boolean, content binary, packed binary, linked array<boolean>")
    parsed = parsed.select("host", "hash", "shards", F.pmod(F.xxhash64("content"), "shards").alias("shard"), "row", "page_id", "url", "marked", "content", "packed", "linked")
    dealt = parsed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "host", "shard").sortWithinPartitions("host", "shard", "content", F.col("packed").isNull())
    kinds = "host string, hash long, marked boolean, content binary, row long, page_id long, url string, text string, open array<string>, linked array<boolean>, known array<long>, key long, many boolean"
    found = scratch.table(dealt.mapInArrow(tidy(settle_shards), kinds), "arrays", "zstd")
    out = found.where("text IS NOT NULL")
    if n_large:
        kind = {"likely": "key IS NOT NULL AND many IS NULL", "open": "open IS NOT NULL", "copies": _COPIES}
        waits = found.where("text IS NULL").agg(*(F.max(F.expr(e)).alias(k) for k, e in kind.items())).first()
        out = _without_templates(scratch, found, out) if waits.likely else out.select("row", "page_id", "url", "text")
        out = out.unionByName(_open_pages(scratch, found)) if waits.open else out
        out = out.unionByName(_copies(scratch, found, out)) if waits.copies else out
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


_COPIES = "text IS NULL AND open IS NULL AND key IS NULL"
_COVER = "host string, row long, page_id long, url string, open array<string>, linked array<boolean>, covered array<boolean>"


def _without_templates(scratch: Scratch, found: DataFrame, settled: DataFrame) -> DataFrame:
    """(row, page_id, url, text) of settled pages; likely templates are counted over all shards of their host."""
    likely = scratch.table(found.where("key IS NOT NULL AND many IS NULL").select("host", "key").distinct(), "likely")
    hosts = likely.select("host").distinct()
    marked = settled.where("marked").join(hosts, "host", "left_semi")
    split = F.split("text", "\n")
    held = scratch.table(marked.select("hash", "row", split.alias("open")).mapInArrow(tidy(string_keys), "key long, row long").join(likely.select("key"), "key"), "held")
    texts = marked.groupBy("host", "content").agg(F.min("row").alias("row"))
    number = texts.groupBy("host").agg(F.count("*").alias("of"))
    count = held.join(texts.select("row"), "row").groupBy("key").agg(F.count("*").alias("n"))
    template = likely.join(count, "key").join(number, "host").where(f"2 * n > of AND n >= {TEMPLATE_PAGES}").select("key")
    repeated = held.join(template, "key").groupBy("row").agg(F.collect_list("key").alias("repeated"))
    named = marked.join(repeated, "row", "left").select("host", "row", "page_id", "url", split.alias("open"), F.col("linked"), "hash", "repeated")
    block = named.mapInArrow(tidy(cover_by_keys), _COVER).withColumn("own", F.expr("filter(open, (b, i) -> NOT covered[i])"))
    words = lambda c: F.coalesce(F.aggregate(c, F.lit(0), lambda n, b: n + F.size(F.split(b, " "))), F.lit(0))
    text = F.array_join(F.when(2 * words("own") >= words("open"), F.col("own")).otherwise(F.col("open")), "\n")
    rest = settled.where("NOT marked").unionByName(settled.where("marked").join(hosts, "host", "left_anti").select(settled.columns))
    return rest.select("row", "page_id", "url", "text").unionByName(block.select("row", "page_id", "url", text.alias("text")))


def _open_pages(scratch: Scratch, found: DataFrame) -> DataFrame:
    """(row, page_id, url, text) of open pages of hosts of several shards, whose strings are merged."""
    strings = found.where("many IS NOT NULL").select("key", "row", "many")
    twice = strings.groupBy("key").agg(F.max("many").alias("many"), F.count("*").alias("shards")).where("many OR shards > 1").select("key")
    heard = strings.where("NOT many").join(twice, "key").groupBy("row").agg(F.collect_list("key").alias("heard"))
    repeated = F.concat("known", F.coalesce("heard", F.array().cast("array<bigint>"))).alias("repeated")
    named = found.where("open IS NOT NULL").join(heard, "row", "left").select("host", "row", "page_id", "url", "open", "linked", "hash", repeated)
    covered = scratch.table(named.mapInArrow(tidy(cover_by_keys), _COVER), "covered", "zstd")
    block = covered.select("host", "row", "page_id", "url", F.posexplode(F.arrays_zip("open", "linked", "covered")).alias("at", "b"))
    block = block.select("host", "row", "page_id", "url", "at", F.col("b.open").alias("block"), F.col("b.linked").alias("linked"), F.col("b.covered").alias("covered"))
    known = block.where("covered").select("host", "block", F.lit(True).alias("elsewhere")).distinct()
    block = block.join(known, ["host", "block"], "left").withColumn("drop", F.col("linked") | F.col("covered") | F.coalesce("elsewhere", F.lit(False)))
    kept = block.groupBy("row", "page_id", "url").agg(
        F.array_sort(F.collect_list(F.when(~F.col("drop"), F.struct("at", "block")))).alias("kept"), F.array_sort(F.collect_list(F.struct("at", "block"))).alias("all")
    )
    joined = F.array_join(F.transform(F.when(F.size("kept") > 0, F.col("kept")).otherwise(F.col("all")), lambda b: b["block"]), "\n")
    return kept.select("row", "page_id", "url", joined.alias("text"))


def _copies(scratch: Scratch, found: DataFrame, out: DataFrame) -> DataFrame:
    """(row, page_id, url, text) of the further copies of texts of very many, dealt over all tasks."""
    spark = scratch.spark
    copies = found.where(_COPIES).select("row", "page_id", "url")
    rows = scratch.table(copies.select("row").distinct(), "copied-rows")
    texts = scratch.table(out.join(F.broadcast(rows) if rows.count() <= HOSTS_SENT else rows, "row", "left_semi").select("row", "text"), "copied", "zstd")
    copies = copies.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    if texts.agg(F.sum(F.octet_length("text"))).first()[0] <= COPIED_BYTES:
        joined = copies.join(F.broadcast(texts), "row")
    else:
        salted = copies.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
        joined = salted.join(texts.crossJoin(spark.range(SALTS).withColumnRenamed("id", "salt")), ["row", "salt"])
    return joined.select("row", "page_id", "url", "text")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all ``pages``."""
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
