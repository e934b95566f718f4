from pyspark.sql import functions as F

from forecourt.llm import urls
from forecourt.llm.queries import RULES


def pages(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "path", "rule", "score", "row", "codes", "code", "decided")})


def test_parts_and_rules(spark):
    rows = [
        None, "", "nothing here", "HTTP://Www.Example.COM/En/x", "http://www.example.com/en/x?q=/a", "http://EXAMPLE.com/en/a#b", "http://a.b.example.com/en/",
        "http://example.com/de/", "http://notexample.com/en/", "http://example.com", "x://a.net/es/1", "x://a.net/esx/1", "http://é.com/", "://h.org?u=http://x.com/", "a://b://c",
    ]
    got = {r.page_id: (r.host, r.path, r.rule) for r in urls.judge(pages(spark, rows), RULES).collect()}
    want = [
        ("", "", None), ("", "", None), ("", "", None), ("www.example.com", "/En/x", "com/"), ("www.example.com", "/en/x", "www.example.com/en/"), ("example.com", "/en/a", "example.com/en/"),
        ("a.b.example.com", "/en/", "example.com/en/"), ("example.com", "/de/", "com/"), ("notexample.com", "/en/", "com/"), ("example.com", "", None), ("a.net", "/es/1", "net/es/"),
        ("a.net", "/esx/1", None), ("é.com", "/", "com/"), ("h.org", "", None), ("b:", "//c", None),
    ]
    assert [got[i] for i in range(len(rows))] == want


def test_models_tell_urls_apart(spark):
    good = [f"http://news.site{i}.com/article/{'story-of-the-day' if i % 2 else 'weather-report'}-{i}" for i in range(200)]
    bad = [f"http://x{i}.net/es/casino-bonus-{i}zzqx" for i in range(200)]
    asked = ["http://daily.org/article/story-of-weather-9", "http://qq.org/casino-bonus-zzqx-77"] * 2 + ["http://long.org/" + "article/" * 20_000]
    got = urls.judge(pages(spark, good + bad + asked), RULES).orderBy("page_id").collect()[400:]
    assert [r.verdict for r in got] == ["allow", "block", "allow", "block", "allow"] and got[0].score > got[1].score
    assert all(r.rule is None for r in got)


def test_without_training_all_is_allowed(spark):
    assert [r.verdict for r in urls.judge(pages(spark, ["http://a.org/x", None, "http://a.org/x"]), RULES).collect()] == ["allow"] * 3
    assert urls.judge(pages(spark, []), RULES).count() == 0


def test_long_contexts_of_real_characters_and_joined_strings(spark, monkeypatch):
    good = [f"http://a{i % 7}.com/item-2024-{'äöü'}" for i in range(120)]
    bad = [f"http://a{i % 7}.net/es/item-2023-{'àòù'}" for i in range(120)]
    asked = ["http://q.org/item-2024-äöü", "http://q.org/item-2023-àòù"] * 2
    whole = urls.judge(pages(spark, good + bad + asked), RULES).orderBy("page_id").collect()
    assert [r.verdict for r in whole[240:]] == ["allow", "block"] * 2
    assert all((r.score is None) <= (r.rule is not None) for r in whole)
    monkeypatch.setattr(urls, "HOT", 8)  # nearly all strings by the join instead of the broadcast
    joined = urls.judge(pages(spark, good + bad + asked), RULES).orderBy("page_id").collect()
    assert [r.verdict for r in joined] == [r.verdict for r in whole]
    assert all(a.score == b.score or abs(a.score - b.score) < 1e-9 for a, b in zip(joined, whole))
