"""Language of web pages by Bayesian fusion of text, markup and address.

For each page the log-odds of the languages are the sum of

* the text: likelihood of its byte trigrams (hashed) under a profile of each language, counted over
  all labelled documents; trigrams overlap and repeat, so a share ``TEMPER`` of it counts, and beyond about
  ``FULL_TEXT`` trigrams the weight of more of them grows as a logarithm;
* the markup: how often pages of a language declare what this page declares (its html lang, a
  language we know, another one, or none), estimated from all pages; html tags are looked for in the
  whole page, outside comments, scripts and styles;
* the address: a prior of the host, smoothed towards its domain, that towards its suffix (the last
  label), and that towards all pages.  A level with few pages says little and leaves most to the one
  above it.

Markup and address are learned without labels, from the languages that text alone suggests, summed by
grouped aggregation.  A page's own share is taken out of the counts of its groups before they are its
prior, so that it isn't its own evidence.  Pages are joined to one row a host; both sides are plain
shuffles, which can be split where one host has very many pages.

Cases: null html has no text and declares nothing; a null or malformed address has the empty host; ties
go to the first language by name; repeated rows are pages of their own; without labelled documents there
is no language and the result is empty, as for an empty table; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import staged
from .text import as_bytes, slices

BUCKETS = 1 << 15
TEMPER = 0.2
FULL_TEXT = 400
#: Pages' worth of belief in the level above.
SMOOTHING = 5.0
LEVELS = ("host", "domain", "suffix")

_KINDS = (b"script", b"style", b"nav", b"aside", b"footer", b"header", b"noscript")
#: Where something hidden may begin: an element of these kinds, a comment, a division, any tag, an entity.
_START = re.compile(rb"<(?:(" + b"|".join(_KINDS) + rb")\b|(!--)|(div))?|&[a-z#0-9]+;", re.I)
#: Where it ends, and what makes a division an advertisement.
_MARKS = {kind: re.compile(rb"</" + kind + rb"\s*>", re.I) for kind in _KINDS}
_MARKS |= {b"!--": re.compile(rb"-->"), b"div": re.compile(rb"</div>", re.I), b"ad": re.compile(rb"class=\"?ad\b", re.I)}
#: Comments, scripts and styles, which may quote html tags, end at the text's end if nowhere before; so each byte is passed once.
_HTML_TAG = re.compile(rb"<(?:!--(?:-?>|.*?(?:-->|\Z))|(script|style)\b.*?(?:</\1\s*>|\Z)|html([^>]*))", re.I | re.S)
_LANG = re.compile(rb"\blang\s*=\s*(?:[\"']\s*)?([a-z]{2,3})", re.I)


def trigrams(text: bytes) -> np.ndarray:
    """Bucket of each byte trigram; A-Z count as a-z, runs of what isn't a letter as one space."""
    x = np.frombuffer(b" " + text.lower() + b" ", np.uint8)
    letter = ((x >= 97) & (x <= 122)) | (x >= 128)
    keep = letter | np.concatenate([[True], letter[:-1]])
    x = np.where(letter, x, 32)[keep].astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.int64)
    return ((((x[:-2] << 16) | (x[1:-1] << 8) | x[2:]) * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


class _Marks:
    """The places of the marks in a text, which are asked for from left to right, so that each kind passes over it once."""

    def __init__(self, html: bytes):
        self.html = html
        self.found: dict[bytes, Iterator[re.Match[bytes]]] = {}
        self.next: dict[bytes, re.Match[bytes] | None] = {}

    def first(self, kind: bytes, at: int) -> re.Match[bytes] | None:
        """The first mark of a kind that begins at ``at`` or later."""
        if kind not in self.found:
            self.found[kind] = _MARKS[kind].finditer(self.html)
            self.next[kind] = next(self.found[kind], None)
        while (m := self.next[kind]) is not None and m.start() < at:
            self.next[kind] = next(self.found[kind], None)
        return m


def visible_text(html: bytes) -> bytes:
    """``html`` with a space for each element of a hidden kind, comment, advertisement, tag and entity.

    What has no end hides nothing but its own tag, and a tag without an end is text.  The work is in proportion to the
    length of the page, whatever is left open.
    """
    marks, pieces, kept, at, close = _Marks(html), [], 0, 0, -1
    while (m := _START.search(html, at)) is not None:
        begin, end = m.span()
        if html[begin : begin + 1] == b"<":
            if close < begin:
                close = html.find(b">", begin)
                close = len(html) if close < 0 else close
            kind, comment, div = m.groups()
            ends = None
            if kind or comment:
                ends = marks.first((kind or comment).lower(), end)
            elif div:
                ad = marks.first(b"ad", end)
                ends = marks.first(b"div", ad.end()) if ad and ad.start() < close else None
            end = ends.end() if ends else close + 1
        if end > len(html):
            at = begin + 1
            continue
        pieces.append(html[kept:begin])
        kept = at = end
    pieces.append(html[kept:])
    return b" ".join(pieces)


def declared_language(html: bytes) -> bytes | None:
    """Lower-case code of the first html tag with a lang, wherever in the page it is."""
    for tag in _HTML_TAG.finditer(html):
        m = _LANG.search(tag.group(2) or b"")
        if m:
            return m.group(1).lower()
    return None


def profiles(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages by name and the log-probability of each trigram bucket in them, counted over all ``docs`` (text, lang).

    What the driver gets is bounded by languages times buckets.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in slices(whole, "text"):
                for text, lang in zip(as_bytes(batch, "text"), batch.column("lang").to_pylist(), strict=True):
                    totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    totals[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, n in totals.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(n[some])], names=["lang", "bucket", "n"])

    rows = docs.filter("lang IS NOT NULL").select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found: dict[str, np.ndarray] = {}
    for lang, bucket, n in rows.collect():
        found.setdefault(lang, np.ones(BUCKETS))[bucket] += n
    names = sorted(found)
    return names, np.array([np.log(found[n] / found[n].sum()) for n in names]).reshape(len(names), BUCKETS)


def text_evidence(pages: DataFrame, names: list[str], logs: np.ndarray) -> DataFrame:
    """page_id, url, declared and the tempered log-likelihood of each language (l0, l1, ...)."""
    shared = pages.sparkSession.sparkContext.broadcast(logs.astype(np.float32))
    known = {n.encode() for n in names}
    k = len(names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html"):
                declared, values = [], np.zeros((batch.num_rows, k))
                for i, html in enumerate(as_bytes(batch, "html")):
                    code = declared_language(html)
                    declared.append("none" if code is None else code.decode() if code in known else "other")
                    grams = trigrams(visible_text(html))
                    if len(grams):
                        values[i] = TEMPER * FULL_TEXT * np.log1p(len(grams) / FULL_TEXT) * shared.value[:, grams].mean(axis=1)
                values -= values.max(axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(declared, pa.string()), *(pa.array(values[:, j].copy()) for j in range(k))], names=["page_id", "url", "declared", *(f"l{j}" for j in range(k))])

    schema = "page_id long, url string, declared string, " + ", ".join(f"l{j} double" for j in range(k))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(each, schema)


def address(url: Column) -> dict[str, Column]:
    """host (without www.), domain (its last two labels), suffix (its last label)."""
    host = F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), r"^www\.", "")
    return {"host": host, "domain": F.substring_index(host, ".", -2), "suffix": F.substring_index(host, ".", -1)}


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """For each row of ``pages`` (page_id, url, html): page_id, lang, confidence, text_lang, declared.

    ``docs`` (text, lang) are the labelled documents that the profiles are counted on.
    """
    names, logs = profiles(docs)
    k = len(names)
    if not k:
        return pages.sparkSession.createDataFrame([], "page_id long, lang string, confidence double, text_lang string, declared string")
    ls, ps = [F.col(f"l{j}") for j in range(k)], [f"p{j}" for j in range(k)]
    evidence = text_evidence(pages, names, logs)
    norm = sum((F.exp(x) for x in ls[1:]), F.exp(ls[0]))
    table = staged(evidence.withColumns({p: F.exp(x) / norm for p, x in zip(ps, ls, strict=True)}).withColumns(address(F.col("url"))).drop("url"), "evidence")

    # what pages of a language declare: a small table, |languages| + 2 rows
    declares = {r["declared"]: [r[p] for p in ps] for r in table.groupBy("declared").agg(*(F.sum(p).alias(p) for p in ps)).collect()}
    kinds = [*names, "other", "none"]
    totals = [sum(v[j] for v in declares.values()) for j in range(k)]
    n_pages = sum(totals)

    def markup(j: int) -> Column:
        own = F.col(ps[j])
        chance = None
        for kind in kinds:
            # the page's own share of the count is left out
            value = F.ln((F.lit(declares.get(kind, [0.0] * k)[j]) - own + 1.0) / (F.lit(totals[j]) - own + len(kinds)))
            chance = F.when(F.col("declared") == kind, value) if chance is None else chance.when(F.col("declared") == kind, value)
        return chance

    counts = table.groupBy(*LEVELS).agg(*(F.sum(p).alias(f"host_{p}") for p in ps))
    domains = counts.groupBy("domain").agg(*(F.sum(f"host_{p}").alias(f"domain_{p}") for p in ps))
    suffixes = counts.groupBy("suffix").agg(*(F.sum(f"host_{p}").alias(f"suffix_{p}") for p in ps))
    hosts = counts.join(domains, "domain").join(suffixes, "suffix").drop("domain", "suffix")

    def prior(j: int) -> Column:
        belief = (F.lit(totals[j]) - F.col(ps[j]) + 1.0) / (n_pages - 1 + k)
        for level in reversed(LEVELS):
            own = [F.greatest(F.col(f"{level}_{p}") - F.col(p), F.lit(0.0)) for p in ps]
            size = sum(own[1:], own[0])
            belief = (own[j] + SMOOTHING * belief) / (size + SMOOTHING)
        return belief

    joined = table.drop("domain", "suffix").join(hosts, "host")
    fused = joined.withColumns({f"s{j}": ls[j] + markup(j) + F.ln(prior(j)) for j in range(k)})
    best = F.greatest(*(F.col(f"s{j}") for j in range(k))) if k > 1 else F.col("s0")
    sums = sum((F.exp(F.col(f"s{j}") - best) for j in range(1, k)), F.exp(F.col("s0") - best))
    return fused.select("page_id", _first_largest([F.col(f"s{j}") for j in range(k)], names).alias("lang"), (1 / sums).alias("confidence"), _first_largest(ls, names).alias("text_lang"), "declared")


def _first_largest(values: list[Column], names: list[str]) -> Column:
    best = F.greatest(*values) if len(values) > 1 else values[0]
    chosen = F.when(values[0] == best, names[0])
    for v, n in zip(values[1:], names[1:], strict=True):
        chosen = chosen.when(v == best, n)
    return chosen
