"""Suffix arrays over all pages of a host: templates inside articles, shards of large hosts, a brute-force reading."""

from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import html_text

KIND = "page_id long, url string, html string"


def texts(spark, rows):
    out = html_text.extract_main_text(spark.createDataFrame(rows, KIND)).collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    return {r.page_id: r.text for r in out}


def own(i, n=30):
    return " ".join(f"u{i}w{j}" for j in range(n))


@pytest.mark.parametrize("pages", [12, 700])
def test_templates_inside_articles_go(spark, pages):
    """A sentence of most articles of a host goes; passages of few, copied articles and small hosts stay whole."""
    line = "Read this and more from our reporters by joining us today"
    few = "A passage that three articles on this host quote word by word"
    rows = [(i, f"https://h.org/{i}", f"<article><p>{own(i)}</p>{f'<p>{few}</p>' if i < 3 else ''}<p>{line}</p></article>") for i in range(pages)]
    rows += [(1000 + i, f"https://copies.org/{i}", f"<article><p>{own(9999)}</p><p>{line}</p></article>") for i in range(pages)]
    rows += [(2000 + i, f"https://small.org/{i}", f"<article><p>{own(i)}</p><p>{line}</p></article>") for i in range(7)]
    rows += [(3000 + i, f"https://near.org/{i}", f"<article><p>{own(9999)}</p><p>{own(i, 9)}</p></article>") for i in range(pages)]
    got = texts(spark, rows)
    for i in range(pages):
        assert got[i] == own(i) + (f"\n{few}" if i < 3 else "")
        assert got[1000 + i] == f"{own(9999)}\n{line}"
        assert got[3000 + i] == f"{own(9999)}\n{own(i, 9)}"
    assert all(got[2000 + i] == f"{own(i)}\n{line}" for i in range(7))


@pytest.mark.parametrize("sent", [0, 1 << 20])
def test_very_many_copies(spark, monkeypatch, sent):
    """Copies beyond those that a shard gives out get the text of their page, on pages of both kinds."""
    monkeypatch.setattr(html_text, "COPIED_BYTES", sent)
    n, line = html_text.COPIES_OUT + 200, "Read this and more from our reporters by joining us today"
    rows = [(i, "https://c.org/", f"<article><p>{own(0)}</p><p>{line}</p></article>") for i in range(n)]
    rows += [(10_000 + i, "https://c.org/", f"<article><p>{own(i)}</p><p>{line}</p></article>") for i in range(1, 12)]
    rows += [(20_000 + i, "https://o.org/", f"<div>{own(7)}</div><div>{line}</div>") for i in range(n)]
    rows += [(30_000, "https://o.org/", f"<div>{own(8)}</div><div>{line}</div>")]
    got = texts(spark, rows)
    assert all(got[i] == own(0) and got[20_000 + i] == f"{own(7)}\n{line}" for i in range(n))
    assert all(got[10_000 + i] == own(i) for i in range(1, 12)) and got[30_000] == own(8)


def brute(rows):
    """Texts of (page_id, host, marked, blocks) by counting the strings of each host."""
    depth, out = html_text.DEPTH, {}
    hosts = defaultdict(list)
    for r in rows:
        hosts[r[1]].append(r)
    strings = lambda blocks: [tuple(s[i : i + depth]) for s in [[t for b in blocks for t in [*b.split(), "\n"]]] for i in range(len(s) - depth + 1)]
    for of in hosts.values():
        articles = {tuple(b) for _, _, m, b in of if m}
        covers = {}
        for i, _, marked, blocks in of:
            stand = {s for s in set(strings(blocks)) if (2 * (n := sum(s in strings(a) for a in articles)) > len(articles) and n >= html_text.TEMPLATE_PAGES if marked else any(s in strings(b) for j, _, m, b in of if not m and j != i))}
            inside = {j for at, s in enumerate(strings(blocks)) if s in stand for j in range(at, at + depth)}
            covers[i], at = [], 0
            for b in blocks:
                n = len(b.split())
                covers[i].append(sum(j in inside for j in range(at, at + n)) >= html_text.COVERED * n)
                at += n + 1
        elsewhere = {b for i, _, m, blocks in of if not m for b, c in zip(blocks, covers[i]) if c}
        for i, _, marked, blocks in of:
            if marked:
                kept = [b for b, c in zip(blocks, covers[i]) if not c]
                kept = kept if 2 * len(" ".join(kept).split()) >= len(" ".join(blocks).split()) else blocks
            else:
                kept = [b for b in blocks if b not in elsewhere] or blocks
            out[i] = "\n".join(kept)
    return out


@pytest.mark.parametrize("in_task", [4, 10_000])
def test_hosts_equal_a_count_of_their_strings(spark, monkeypatch, in_task):
    """One shard and many give what a count over the whole host gives, copies and repeated rows included."""
    rng = np.random.default_rng(5)
    rows = []
    for h in range(6):
        shared = [" ".join(f"h{h}s{k}w{j}" for j in range(rng.integers(1, 9))) for k in range(5)]
        often = rng.choice([0.1, 0.45, 0.6, 0.9], 5)
        for _ in range(32):
            blocks = [" ".join(f"p{len(rows)}b{b}w{j}" for j in range(rng.integers(1, 14))) for b in range(rng.integers(1, 4))] + [s for s, o in zip(shared, often) if rng.random() < o]
            rows.append((len(rows), f"h{h}", bool(rng.random() < 0.7), [blocks[k] for k in rng.permutation(len(blocks))]))
        for k in rng.integers(len(rows) - 32, len(rows), 6).tolist():
            rows.append((len(rows), *rows[k][1:]))
    monkeypatch.setattr(html_text, "PAGES_IN_TASK", in_task)
    page = lambda marked, blocks: "".join(f"<p>{b}</p>" for b in blocks).join(["<article>", "</article>"] if marked else ["<div>", "</div>"])
    got = texts(spark, [(i, f"http://{h}/{i}", page(m, b)) for i, h, m, b in rows] + [(5000, "http://h0/", None), (5001, "http://h0/", ""), (5002, None, "")])
    want = brute(rows)
    assert sum(want[i] != "\n".join(b) for i, _, m, b in rows if m) > 20 and sum(want[i] != "\n".join(b) for i, _, m, b in rows if not m) > 20
    assert got == want | {5000: "", 5001: "", 5002: ""}
