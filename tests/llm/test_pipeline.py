"""The pipeline against a plain version of its stages."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from forecourt.llm import packing, quality

from .test_nearcopies import brute as brute_copies
from .test_rules import brute as brute_rules

SF = "/root/testdata/sf0.001"


def test_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "SimHash near-dedup", "best-fit packing"]
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    rows = [r for r in docs.collect() if model.scores(np.array([quality.statistics(r.text)]))[0] >= 0.5]
    judged = brute_rules([(r.doc_id, r.source, r.text) for r in rows], 0.1, 20, 0.3)
    rows = [r for r in rows if judged[r.doc_id][-1]]
    first = brute_copies([(r.doc_id, r.text) for r in rows])
    assert len(first) < len(rows)
    rows = [r for r in rows if r.doc_id in first]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in rows:
        ids = library.encode(r.text, add_special_tokens=False).ids + [1]
        want += [(r.doc_id, i, at, zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for i, at in enumerate(range(0, len(ids), 4096))]
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.ids_crc32) for r in got) == sorted(want)
    assert len({r.sequence_id for r in got}) <= -(-sum(r.length for r in got) // packing.CAPACITY) + 1


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 AS score", "2 AS host", "3 AS component_id")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and 0 < out.count() < docs.count()
