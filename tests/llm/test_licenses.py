import pytest

from forecourt.llm import licenses

from . import cases


def test_bands_guarantee():
    for size in range(1, 200):
        held, s, n = -(-4 * size // 5), licenses.stride(size), licenses.bands(size)
        assert size <= s and (1 - held / (2 * s + size - held)) ** n <= 1e-6


def test_scan(spark):
    mit = licenses.NOTICES[3][1]
    altered = mit.replace("obtaining", "receiving", 1)
    rows = cases.DOCS + [
        (50, cases.prose(333, 1) + "\nReleased under the MIT License.\n" + cases.prose(50, 2)), (51, cases.LONG + " LICENSED under CC-BY NC 4.0! " + cases.prose(9, 3)),
        (52, mit), (53, cases.prose(7, 4) + " " + altered), (54, mit[: len(mit) // 2]), (55, "Released under the"), (56, "this work is licensed under the gnu general public license version 3 and " + mit),
        (56, mit), (57, "Released under the MIT license. " * 300),
    ]
    got = {(r.doc_id, r.license): (r.containment, r.first_word) for r in licenses.scan(cases.docs(spark, rows)).collect()}
    assert got[50, "MIT"] == (1.0, 333) and got[51, "CC-BY-NC-4.0"] == (1.0, 30_000) and got[52, "MIT"] == (1.0, 0)
    assert 0.8 <= got[53, "MIT"][0] < 1 and got[56, "GPL-3.0"] == (1.0, 0) and got[57, "MIT"] == (1.0, 0)
    assert {k for k in got if k[0] not in (50, 51, 52, 53, 56, 57)} == set()


def test_limits(spark):
    assert licenses.scan(cases.docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(cases.docs(spark), [("short", "All rights reserved.")])
