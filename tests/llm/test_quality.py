import zlib

import numpy as np
from pyspark.sql import functions as F

from forecourt.llm import quality

from . import cases

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).join(labels, "doc_id").where(quality.held_out("doc_id")).collect()
    assert len(rows) > 80 and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([(r.score >= 0.5) == (r.quality == 1) for r in rows]) > 0.95


def test_matches_plain_discriminant(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    texts, marks = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.quality for r in labels.collect()}
    train = [d for d in marks if zlib.crc32(str(d).encode()) % 3 != 1]
    x, y = np.array([quality.statistics(texts[d]) for d in train]), np.array([marks[d] for d in train])
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = (x - centre) / scale
    cov = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    pooled = np.diag(sum((y == c).mean() * np.diag(cov[c]) for c in (0, 1)))
    test = (np.array([quality.statistics(t) for t in texts.values()]) - centre) / scale
    density = []
    for c in (0, 1):
        s = 0.9 * cov[c] + 0.1 * pooled + 1e-6 * np.eye(len(centre))
        gap = test - z[y == c].mean(axis=0)
        density.append(np.log((y == c).mean()) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(s), gap))
    want = 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))
    got = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert np.allclose([got[d] for d in texts], want, atol=1e-6)


def test_awkward_documents(spark):
    docs = cases.docs(spark)
    labels = spark.createDataFrame([(d, int(d % 2)) for d, _ in cases.DOCS] + [(None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == len(cases.DOCS) and all(0 <= r.score <= 1 for r in got)
    assert quality.keep(docs, model).columns == docs.columns
    assert quality.keep(docs, model, 0.0).count() == len(cases.DOCS)
    assert quality.score(cases.docs(spark, []), model).count() == 0


def test_missing_classes(spark):
    docs, none = cases.docs(spark), spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, quality.fit(docs, none)).collect()} == {0.5}
    good = spark.createDataFrame([(d, 1) for d in range(1, 13)], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, quality.fit(docs, good)).collect()} == {1.0}


def test_held_out_rule(spark):
    rows = spark.range(50).select("id", quality.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)
    assert spark.range(1).select(quality.held_out(F.lit(None).cast("long")).alias("h")).first().h is False
