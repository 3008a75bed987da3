"""Text expressions: URL kinds, snippets, keyword counts, gates, and the recursive splitter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Domains that are never fetched.
SKIP_DOMAINS = (
    "bloomberg.com", "wsj.com", "forbes.com", "businesswire.com", "linkedin.com", "ft.com",
    "sec.gov", "spglobal.com", "pitchbook.com", "reuters.com", "cnbc.com", "nytimes.com",
)
#: Part of a funding stage -> kind of company, first match wins.
STAGE_KINDS = (("Incumbent", ("incumbent", "public", "mature")), ("Utility", ("utility", "muni")), ("Investor", ("investor", "vc", "pe")))
#: Kind of vertex -> colour.
COLOURS = {"Startup": "#f97316", "Company": "#f97316", "Incumbent": "#64748b", "Utility": "#0ea5e9", "Investor": "#10b981", "Document": "#3b82f6"}
#: Fixed value: parts of a regulatory type.
REGULATORY_PART = "(?i)(regul|law|gov|polic|act|bill)"


def url_kind(url: Column) -> Column:
    """Document kind by the URL's extension."""
    low = F.lower(url)
    out = F.when(low.endswith(".pdf"), "pdf").when(low.endswith(".docx"), "docx").when(low.endswith(".pptx"), "pptx")
    return out.when(low.endswith(".xlsx") | low.endswith(".csv"), "spreadsheet").otherwise("html")


def format_of(content_type: Column, url: Column, by_proxy: Column) -> Column:
    """Reader for a fetched object: proxy text first, then content type or extension."""
    kind, ext = F.lower(F.coalesce(content_type, F.lit(""))), url_kind(url)
    out = F.when(by_proxy, "proxy").when(kind.contains("application/pdf") | (ext == "pdf"), "pdf")
    out = out.when(kind.contains("wordprocessingml") | (ext == "docx"), "docx").when(kind.contains("presentationml") | (ext == "pptx"), "pptx")
    return out.when(kind.contains("spreadsheetml") | kind.contains("text/csv") | (ext == "spreadsheet"), "spreadsheet").otherwise("html")


def snippet(text: Column, size: int = 200, always: bool = False) -> Column:
    """A prefix with '...', which is added to longer texts only unless ``always``."""
    cut = F.concat(F.substring(text, 1, size), F.lit("..."))
    return cut if always else F.when(F.length(text) > size, cut).otherwise(text)


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a word; a blank word has none."""
    if not word.strip():
        return F.lit(0)
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """Occurrences of all keywords, case ignored; overlapping keywords count each."""
    low = F.lower(F.coalesce(text, F.lit("")))
    total = F.lit(0)
    for word in keywords:
        total = total + occurrences(low, word.lower())
    return total


def keyword_gate(text: Column, keywords: list[str], least: int = 3, least_chars: int = 200) -> Column:
    """Why a text is kept out, or null if it passes."""
    size = F.length(F.coalesce(text, F.lit("")))
    return F.when(size == 0, "empty").when(size < least_chars, "short").when(keyword_hits(text, keywords) < least, "low density")


def length_route(size: Column, override: Column | None = None, least: int = 200, most: int = 500_000) -> Column:
    """'reject' short texts, 'pending' large ones unless overridden, 'process' the rest."""
    free = F.lit(False) if override is None else override
    return F.when(size < least, "reject").when((size > most) & ~free, "pending").otherwise("process")


def pending_text(action: Column, text: Column, limit: Column) -> Column:
    """Text that goes on after a decision about a pending document; null when it is skipped."""
    return F.when(action == "extract_all", text).when(action == "extract_partial", F.substring(text, F.lit(1), limit))


def pending_status(action: Column) -> Column:
    return F.when(action == "skip", "rejected").when(action.isin("extract_all", "extract_partial"), "processing").otherwise("pending")


def blocked_domain(url: Column, domains: tuple[str, ...] = SKIP_DOMAINS) -> Column:
    """Whether a URL holds a listed domain anywhere."""
    out = F.lit(False)
    for domain in domains:
        out = out | F.lower(url).contains(domain)
    return out


def stage_kind(stage: Column) -> Column:
    """Kind of company by its funding stage."""
    low, out = F.lower(stage), None
    for kind, parts in STAGE_KINDS:
        found = F.lit(False)
        for part in parts:
            found = found | low.contains(part)
        out = F.when(found, kind) if out is None else out.when(found, kind)
    return out.otherwise("Startup")


def colour(kind: Column) -> Column:
    out = None
    for name, code in COLOURS.items():
        out = F.when(kind == name, code) if out is None else out.when(kind == name, code)
    return out.when(kind.rlike(REGULATORY_PART), "#eab308").otherwise("#a855f7")


def node_size(kind: Column, theme: str) -> Column:
    return F.when(kind == "Document", 5.0 if theme == "documents" else 1.5).otherwise(1.5 if theme == "documents" else 2.0)


def score_band(score: Column) -> Column:
    """Colour band of a ratio as a rounded percentage."""
    pct = F.round(F.coalesce(score, F.lit(0.0)) * 100)
    return F.when(pct < 40, "red").when(pct < 70, "yellow").when(pct >= 90, "emerald").otherwise("indigo")


def flat_text(text: Column) -> Column:
    return F.translate(text, "\n", " ")


SEPARATORS = ("\n\n", "\n", " ", "")


def split_recursive(text: str, size: int = 1000, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters cut at the coarsest separator that works.

    Pieces keep their separator in front; consecutive pieces are packed to ``size`` and
    a chunk starts with up to ``overlap`` characters of the one before. A piece of ``size`` or more is
    cut by the finer separators on its own, and nothing is carried over its bounds.
    """
    at = next(i for i, s in enumerate(separators) if s == "" or s in text)
    sep, finer = separators[at], separators[at + 1 :]
    pieces = list(text) if sep == "" else [p for p in _cut_before(text, sep) if p]
    out: list[str] = []
    window: list[str] = []
    held = 0

    def emit() -> None:
        chunk = "".join(window).strip()
        if chunk:
            out.append(chunk)

    for piece in pieces:
        if len(piece) >= size and finer:
            emit()
            window, held = [], 0
            out += split_recursive(piece, size, overlap, finer)
            continue
        if held + len(piece) > size and window:
            emit()
            while window and (held > overlap or held + len(piece) > size):
                held -= len(window.pop(0))
        window.append(piece)
        held += len(piece)
    emit()
    return out


def _cut_before(text: str, sep: str) -> list[str]:
    first, *rest = text.split(sep)
    return [first, *(sep + r for r in rest)]


def chunk_documents(docs: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """One row for each chunk: (key, chunk_index, chunk); null and blank texts have none."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, c) for k, t in zip(pdf[key], pdf[text]) if t for i, c in enumerate(split_recursive(t, size, overlap))]
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "chunk"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInPandas(cut, f"{key} {kind}, chunk_index int, chunk string")


def html_to_text(page: Column) -> Column:
    """Readable text of a page by stripping what is never text, then all markup."""
    out = F.regexp_replace(page, r"(?is)<!--.*?-->|<(script|style|nav|footer|head|aside|form)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?i)<(p|div|h[1-6]|li|tr|br|article|section)\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.btrim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\s*\n\s*", "\n"), F.lit(" \n"))


def backoff_seconds(attempt: Column, most: int = 60) -> Column:
    """Seconds to wait before an attempt is made again: powers of two up to a bound."""
    return F.least(F.pow(F.lit(2.0), attempt), F.lit(float(most))).cast("long")


def prefix(text: Column, size: int = 15_000) -> Column:
    """The first characters of a text, as the reader proxy returns it."""
    return F.substring(text, 1, size)
