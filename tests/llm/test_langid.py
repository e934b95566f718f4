import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from forecourt.llm import langid

from . import cases

SF = "/root/testdata/sf0.01"


def test_against_brute_force(spark):
    docs, pages = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/pages.parquet")
    model = langid.fit(docs)
    counts = defaultdict(Counter)
    for r in docs.collect():
        counts[r.lang].update(langid.triples(r.text or "").tolist())
    names = sorted(counts)
    logs = np.array([[np.log((counts[n][b] + 0.5) / (sum(counts[n].values()) + 0.5 * langid.BUCKETS)) for b in range(langid.BUCKETS)] for n in names])
    assert model.languages == names and np.allclose(model.log_p, logs)
    rows = []
    for r in pages.collect():
        at = langid.triples(re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", " ", r.html))
        ll = logs[:, at].mean(axis=1) * min(len(at), 64)
        p = np.exp(ll - ll.max())
        host = r.url.split("://")[1].split("/")[0]
        rows.append((r.page_id, host, ".".join(host.split(".")[-2:]), r.url.split("://")[1].split("/")[1][:2], re.search('lang="(..)', r.html)[1], ll, p / p.sum()))
    sums = {k: defaultdict(lambda: np.zeros(len(names))) for k in range(1, 5)}
    for row in rows:
        for k in sums:
            sums[k][row[k]] += row[-1]
    whole = sum(r[-1] for r in rows)
    everywhere = (whole + 1) / (whole.sum() + len(names))
    got = {r.page_id: r for r in langid.identify(pages, model).collect()}
    for row in rows:
        dom = (sums[2][row[2]] + 8 * everywhere) / (sums[2][row[2]].sum() + 8)
        others = np.maximum(sums[1][row[1]] - row[-1], 0)
        total = row[-2] + np.log((others + 8 * dom) / (others.sum() + 8))
        for k in (3, 4):
            c = sums[k][row[k]]
            total = total + np.log((c + 2 * c.sum() / whole.sum()) / (whole + 2))
        p = np.exp(total - total.max())
        p /= p.sum()
        assert got[row[0]].lang == names[p.argmax()] and abs(got[row[0]].probability - p.max()) < 1e-6
    assert np.mean([r.lang == r.declared for r in got.values()]) > 0.97


def test_declaration_helps_where_text_is_absent(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma " * 50, "xx"), (2, "unde omnis iste " * 50, "yy"), (3, None, "xx"), (4, "text", None)], "doc_id long, text string, lang string")
    rows = [(i, f"http://h{i % 4}.org/xx/", f'<HTML class=a lang="xx-AB">alpha beta gamma {i}</html>') for i in range(20)]
    rows += [(100 + i, f"http://k{i % 4}.org/yy/", f"<html lang=yy>omnis iste unde {i}") for i in range(20)]
    rows += [(200, "http://new.org/", '<html lang="yy"></html>'), (201, None, None), (202, "http://k1.org/yy/", ""), (203, "", "<script>alpha beta</script>"), (204, "http://h.org", "<html>" + "alpha " * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "p", "ll", "lang", "declared", "suffix", "of_host")})
    got = {r.page_id: r for r in langid.identify(pages, langid.fit(docs)).collect()}
    assert len(got) == len(rows) and all(0 < r.probability <= 1 for r in got.values())
    assert got[0].lang == "xx" and got[0].declared == "xx" and got[100].lang == "yy" and got[200].lang == "yy" and got[202].lang == "yy" and got[204].lang == "xx"
    assert langid.identify(pages.limit(0), langid.fit(docs)).count() == 0


def test_without_labels(spark):
    docs = cases.docs(spark, []).withColumn("lang", F.lit(None).cast("string"))
    pages = spark.createDataFrame([(1, "http://a.b", "x")], "page_id long, url string, html string")
    assert [r.lang for r in langid.identify(pages, langid.fit(docs)).collect()] == [None]


_MARKUP = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", re.S | re.I)
_DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,8})", re.I)
PARTS = ["<script", "</SCRIPT >", "</script", "<style>", "</style>", "<!--", "-->", "<", ">", "&", "&amp;", "#", ";", "text", " ", "é", "<html", " lang", "=", "'", "en", "\n", "-", "scripts"]


@given(st.lists(st.sampled_from(PARTS), max_size=25).map("".join))
def test_markup_as_by_expressions(html):
    assert langid.visible(html) == _MARKUP.sub(" ", html)
    found = _DECLARED.search(html)
    assert langid.declared(html) == (found[1].lower() if found else None)


@pytest.mark.parametrize("part", ["<script>", "<style ", "<!--", "<!-- <", "<", "&", "&#", "</script", "<html ", "<html lang", "<html lang= ", "<script></style>", "<a>", "&amp;", "<script></script>"])
def test_a_megabyte_ends_soon(part):
    html = part * (1_000_000 // len(part))
    began = time.process_time()
    langid.visible(html), langid.declared(html), langid.declared("<html lang=" + " " * 1_000_000)
    assert time.process_time() - began < 6
