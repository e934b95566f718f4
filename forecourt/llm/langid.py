"""Language identification by Bayesian evidence fusion.

Text likelihoods come from hashed byte triples, counted by language over all labelled
documents. For each page they are joined by the declared markup language, the address suffix
(a two-letter first path segment, else the last label of the host) and a prior of the host,
smoothed towards its domain and that towards all pages. What a declaration, a suffix or a
host says is learnt from the pages themselves: from sums, by grouped aggregation, of the
pages' probabilities given text alone. A page's own share is left out of its host's prior.

A page without text has equal likelihoods; without declaration or suffix that evidence is
left out. Null URLs share the empty host. Rows are judged each, repeated or not. Documents
without a language are not learnt from; with no labelled documents every answer is null.
More than ``LANGUAGES`` languages raise ValueError. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from forecourt.llm.common import map_arrow, slices, written

BUCKETS = 1 << 13
LANGUAGES = 256
TEXT_WEIGHT = 64  # triples whose evidence a text of that length or more gives
HOST_WEIGHT = 8.0  # pages that the domain's prior counts for in a host's
DOMAIN_WEIGHT = 8.0
TABLE_WEIGHT = 2.0

_KEEP = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)).lower()
_START = re.compile(r"[<&]")
_ENTITY = re.compile(r"&#?\w++;")
_RAW = re.compile(r"<(script|style)\b", re.I)
_CLOSED = {name: re.compile(rf"</{name}\s*+>", re.I) for name in ("script", "style")}
_HTML = re.compile(r"<html\b", re.I)
_LANG = re.compile(r"\blang\s*+=\s*+[\"']?+\s*+([A-Za-z]{2,8})", re.I)


def triples(text: str) -> np.ndarray:
    """Buckets of a text's byte triples; letters are lowered, other ASCII is a blank, and runs of blanks are one."""
    data = np.frombuffer(b" " + b" ".join(text.encode("utf-8").translate(_KEEP).split()) + b" ", np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, np.uint32)
    with np.errstate(over="ignore"):
        return ((data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)


def visible(html: str) -> str:
    """The text with a blank for each script or style element, comment, tag and entity.

    What is not closed is text, but for the tag that opens it. An end that was looked for in vain
    is not looked for again, so time grows with the length alone.
    """
    out, done, never = [], 0, set()

    def end_of(what: str, found: int) -> int:
        if found < 0:
            never.add(what)
        return found

    found = _START.search(html)
    while found:
        at, end = found.start(), -1
        if html[at] == "&":
            entity = _ENTITY.match(html, at)
            end = entity.end() if entity else -1
        else:
            raw = _RAW.match(html, at)
            if raw and (name := raw[1].lower()) not in never:
                close = _CLOSED[name].search(html, raw.end())
                end = end_of(name, close.end() if close else -1)
            if end < 0 and html.startswith("<!--", at) and "-->" not in never:
                close = end_of("-->", html.find("-->", at + 4))
                end = close + 3 if close >= 0 else -1
            if end < 0 and ">" not in never:
                end = end_of(">", html.find(">", at + 1)) + 1 or -1
        if end >= 0:
            out += [html[done:at], " "]
            done = end
        found = _START.search(html, end if end >= 0 else at + 1)
    return "".join([*out, html[done:]])


def declared(html: str) -> str | None:
    """The language that the first html tag with one names."""
    tag = _HTML.search(html)
    while tag:
        end = html.find(">", tag.end())
        end = len(html) if end < 0 else end
        found = _LANG.search(html, tag.end(), end)
        if found:
            return found[1].lower()
        tag = _HTML.search(html, end)
    return None


@dataclass
class TextModel:
    languages: list[str]
    log_p: np.ndarray  # (languages, BUCKETS)

    def likelihood(self, text: str) -> np.ndarray:
        """Log likelihoods, weighted as of ``TEXT_WEIGHT`` independent triples at most."""
        at = triples(text)
        if not len(at):
            return np.zeros(len(self.languages))
        return self.log_p[:, at].mean(axis=1) * min(len(at), TEXT_WEIGHT)


def fit(docs: DataFrame) -> TextModel:
    """Counts over the whole texts of all documents with a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                mine = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                mine += np.bincount(triples(text), minlength=BUCKETS)
        for lang, mine in sums.items():
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(mine[at])], names=["lang", "bucket", "n"])

    rows = docs.select(F.col("lang").cast("string"), "text").where("lang IS NOT NULL AND text IS NOT NULL")
    counted = written(map_arrow(rows, run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "triples")
    languages = sorted(r.lang for r in counted.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(languages) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    counts = np.full((len(languages), BUCKETS), 0.5)
    place = {lang: i for i, lang in enumerate(languages)}
    for lang, bucket, n in counted.collect():  # LANGUAGES * BUCKETS at most
        counts[place[lang], bucket] += n
    return TextModel(languages, np.log(counts / counts.sum(axis=1, keepdims=True)))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def address(url: Column) -> dict[str, Column]:
    url = F.coalesce(F.lower(url), F.lit(""))
    host = F.regexp_extract(url, r"^[^/?#]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    labels = F.split(host, r"\.")
    segment = F.regexp_extract(url, r"^[^/?#]*://[^/?#]*/([a-z]{2})(?:[/?#]|$)", 1)
    suffix = F.coalesce(F.nullif(segment, F.lit("")), F.nullif(F.element_at(labels, -1), F.lit("")))
    return {"host": host, "domain": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."), "suffix": suffix}


def evidence(pages: DataFrame, model: TextModel) -> DataFrame:
    """(page_id, host, domain, suffix, declared, ll, p): log likelihoods and probabilities given text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            html = [h or "" for h in batch.column("html").to_pylist()]
            ll = np.array([model.likelihood(visible(h)) for h in html])
            lists = [pa.FixedSizeListArray.from_arrays(x.ravel(), x.shape[1]).cast(pa.list_(pa.float64())) for x in (ll, softmax(ll))]
            said = pa.array([declared(h) for h in html], pa.string())
            kept = [batch.column(c) for c in ("page_id", "host", "domain", "suffix")]
            yield pa.RecordBatch.from_arrays([*kept, said, *lists], names=["page_id", "host", "domain", "suffix", "declared", "ll", "p"])

    rows = pages.select(F.col("page_id").cast("long"), "html", *[c.alias(n) for n, c in address(F.col("url")).items()])
    return map_arrow(rows, run, "page_id long, host string, domain string, suffix string, declared string, ll array<double>, p array<double>")


def identify(pages: DataFrame, model: TextModel) -> DataFrame:
    """(page_id, lang, probability, text_lang, declared, host) of every page."""
    n = len(model.languages)
    if not n:
        null = F.lit(None)
        plain = pages.select(F.col("page_id").cast("long"), null.cast("string").alias("lang"), null.cast("double").alias("probability"))
        return plain.select("*", null.cast("string").alias("text_lang"), null.cast("string").alias("declared"), null.cast("string").alias("host"))
    rows = written(evidence(pages, model), "evidence")
    sums = lambda by, name: rows.groupBy(*by).agg(F.array(*[F.sum(F.col("p")[i]) for i in range(n)]).alias(name))
    whole = np.array((rows.agg(*[F.sum(F.col("p")[i]) for i in range(n)]).first()), float) if not rows.isEmpty() else np.zeros(n)
    everywhere = (whole + 1.0) / (whole.sum() + n)
    hosts = sums(["host", "domain"], "of_host").join(sums(["domain"], "of_domain"), "domain").drop("domain")
    joined = rows.drop("domain").join(hosts, "host")
    for key in ("declared", "suffix"):
        joined = joined.join(sums([key], f"of_{key}").where(f"{key} IS NOT NULL"), key, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            take = lambda c: np.array([x if x is not None else [np.nan] * n for x in batch.column(c).to_pylist()])
            total, text_only = fused({c: take(c) for c in ("ll", "p", "of_host", "of_domain", "of_declared", "of_suffix")}, everywhere, whole)
            best, text_best = total.argmax(axis=1), text_only.argmax(axis=1)
            name = lambda at: pa.array([model.languages[i] for i in at], pa.string())
            columns = [batch.column("page_id"), name(best), pa.array(total.max(axis=1)), name(text_best), batch.column("declared"), batch.column("host")]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "lang", "probability", "text_lang", "declared", "host"])

    return map_arrow(joined, run, "page_id long, lang string, probability double, text_lang string, declared string, host string")


def fused(x: dict[str, np.ndarray], everywhere: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities from all evidence, and from text alone; missing evidence is NaN."""
    domain = (x["of_domain"] + DOMAIN_WEIGHT * everywhere) / (x["of_domain"].sum(axis=1, keepdims=True) + DOMAIN_WEIGHT)
    others = np.maximum(x["of_host"] - x["p"], 0.0)
    prior = (others + HOST_WEIGHT * domain) / (others.sum(axis=1, keepdims=True) + HOST_WEIGHT)
    total = x["ll"] + np.log(prior)
    for c in ("of_declared", "of_suffix"):
        marginal = x[c].sum(axis=1, keepdims=True) / max(whole.sum(), 1e-9)
        given = (x[c] + TABLE_WEIGHT * marginal) / (whole + TABLE_WEIGHT)
        total += np.where(np.isnan(given), 0.0, np.log(np.maximum(given, 1e-300)))
    return softmax(total), x["p"]
