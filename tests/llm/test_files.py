"""ORC output and chunk digests."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from forecourt.llm import chunks, orc
from forecourt.session import scratch_path

from . import cases

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_orc(spark):
    out = scratch_path(spark, "orc-test")
    rows = cases.DOCS + [(None, "no id")]
    orc.write(cases.docs(spark, rows), PATH, out, index_rows=1000)
    got = [tuple(r) for r in orc.manifest(spark, out).orderBy(F.asc_nulls_first("doc_id"), "start").collect()]
    library, at, want = Tokenizer.from_file(PATH), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    picked = orc.read(spark, out).where("doc_id = 7")
    assert "EqualTo(doc_id,7)" in picked._jdf.queryExecution().toString() and picked.count() == 1


def test_orc_has_indexes_and_filters(spark):
    from pyarrow import orc as reader

    out = scratch_path(spark, "orc-meta")
    orc.write(cases.docs(spark), PATH, out)
    files = [f for f in spark.read.orc(out).inputFiles()]
    assert any(reader.ORCFile(f.removeprefix("file:").replace("//", "/")).row_index_stride == orc.ROWS for f in files)
    metadata = spark.sparkContext._jvm.org.apache.orc
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0])
    opened = metadata.OrcFile.createReader(path, metadata.OrcFile.readerOptions(spark.sparkContext._jsc.hadoopConfiguration()))
    streams = [str(s.getKind()) for s in opened.rows().readStripeFooter(opened.getStripes()[0]).getStreamsList()] if opened.getStripes() else []
    assert not streams or "BLOOM_FILTER_UTF8" in streams


def test_orc_empty(spark):
    out = scratch_path(spark, "orc-empty")
    orc.write(cases.docs(spark, []), PATH, out)
    assert orc.manifest(spark, out).count() == 0


def test_digests(spark):
    library = Tokenizer.from_file(PATH)
    got = sorted(tuple(r) for r in chunks.digests(cases.docs(spark), PATH).collect())
    want = []
    for doc, text in cases.DOCS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want)
    assert chunks.digests(cases.docs(spark, []), PATH).count() == 0
    kept = chunks.encode_documents(cases.docs(spark), PATH).where("doc_id = 14").first()
    assert kept.decoded == dict(cases.DOCS)[14]
