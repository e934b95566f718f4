import re
from collections import Counter, defaultdict

from forecourt.llm import rules

from . import cases


def brute(rows: list[tuple], share: float, least: int, left: float) -> dict:
    """rows: (doc_id, host, text)."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    normal = lambda line: " ".join(word.findall(re.sub("[0-9]", "0", line.lower())))
    spread, first, whole = defaultdict(set), {}, defaultdict(set)
    for doc, host, text in rows:
        whole[host].add(text or "")
        for line in (text or "").split("\n"):
            if word.search(line):
                key = (host, normal(line))
                spread[key].add(text)
                first[key] = min(first.get(key, doc), doc)
    over = {k for k, t in spread.items() if len(t) >= least and len(t) > share * len(whole[k[0]])}
    out = {}
    for doc, host, text in rows:
        text = text or ""
        words = word.findall(text)
        triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = Counter(triples)
        covered = {i + k for i, t in enumerate(triples) if often[t] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if word.search(x)]
        removed = sum(len(word.findall(x)) for x in lines if (host, normal(x)) in over and first[(host, normal(x))] != doc)
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        kept = not failed and not len(words) - removed < left * len(words)
        out[doc] = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed, removed, kept)
    return out


def got(spark, rows, **limits):
    d = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed", "kept")
    return {r.doc_id: tuple(r[n] for n in names) for r in rules.judge(d, **limits).collect()}


def test_awkward_documents(spark):
    rows = [(d, "s" if d % 5 else None, t) for d, t in cases.DOCS]
    want = brute([(d, h or "", t) for d, h, t in rows], 0.1, 20, 0.3)
    assert got(spark, rows) == want
    assert want[6][0] == 30_000 and want[11][4] == 400 and want[12][3] == 2
    kept = rules.keep(cases.docs(spark))
    assert kept.columns == cases.docs(spark).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in cases.DOCS if want[d][-1])


def test_frequent_lines(spark):
    menu = cases.prose(45, 50)
    rows = [(i, "a", f"{menu} {i % 3}\n{cases.prose(40 + i, 100 + i)}") for i in range(30)]  # 3 forms, one normalised line
    rows += [(100 + i, "a", f"{menu} 7\n{cases.prose(9, 200 + i)}") for i in range(5)]  # little else
    rows += [(200 + i, "b", f"{menu} 7\n{cases.prose(9, 300 + i)}") for i in range(5)]  # the same on a host where it is rare
    rows += [(300 + i, "a", cases.prose(80, 9)) for i in range(30)]  # copies alone put nothing over the limit
    found, want = got(spark, rows), brute(rows, 0.1, 20, 0.3)
    assert found == want
    assert found[0][-2] == 0 and found[1][-2] == 46  # the first keeps the line
    assert not any(found[100 + i][-1] for i in range(5)) and all(found[200 + i][-1] for i in range(5))
    assert all(found[300 + i][-1] for i in range(30))


def test_near_copies_leave_their_first(spark):
    body = [cases.prose(30, i) for i in range(6)]
    rows = [(i, "a", "\n".join([*body[:i % 6], cases.prose(30, 900 + i), *body[i % 6 + 1:]])) for i in range(40)]
    found = got(spark, rows)
    assert found == brute(rows, 0.1, 20, 0.3) and found[0][-1] and not found[39][-1]


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "a", cases.COPY)] * 3 + [(None, "a", cases.prose(60, 8))]
    judged = rules.judge(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    assert sorted((r.doc_id or 0, r.kept) for r in judged.collect()) == [(0, True), (1, True), (1, True), (1, True)]
    assert rules.judge(cases.docs(spark, [])).count() == 0 and rules.keep(cases.docs(spark, [])).count() == 0
