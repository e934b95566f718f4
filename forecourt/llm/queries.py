"""The operators over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from forecourt.llm import chunks, hmm, langid, lexical, licenses, orc, packing, phrases, quality, rules, search, simhash, urls
from forecourt.llm.common import table
from forecourt.session import scratch_path

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def _markov_sql() -> str:
    """The models of all orders, from the counts of the longest strings."""
    out = []
    for k in range(urls.ORDER + 1):
        out.append(f"g{k} AS (SELECT right(gram, {k + 1}) AS gram, sum(n1) AS n1, sum(n0) AS n0 FROM counts GROUP BY 1)")
        if not k:
            out.append("p0 AS (SELECT gram, (n1 + 0.5::DOUBLE) / (sum(n1) OVER () + 0.5::DOUBLE * count(*) OVER ()) AS p1, (n0 + 0.5::DOUBLE) / (sum(n0) OVER () + 0.5::DOUBLE * count(*) OVER ()) AS p0 FROM g0)")
            continue
        out.append(f"c{k} AS (SELECT substr(gram, 1, {k}) AS context, sum(n1) AS c1, sum(n0) AS c0, count(*) FILTER (n1 > 0) AS t1, count(*) FILTER (n0 > 0) AS t0 FROM g{k} GROUP BY 1)")
        mix = ", ".join(f"CASE WHEN c{y} >= 2 THEN (e.n{y} + t{y} * q.p{y}) / (c{y} + t{y})::DOUBLE ELSE q.p{y} END AS p{y}" for y in (1, 0))
        out.append(f"p{k} AS (SELECT e.gram, {mix} FROM g{k} e JOIN c{k} ON substr(e.gram, 1, {k}) = context JOIN p{k - 1} q ON substr(e.gram, 2) = q.gram)")
    return ",\n".join(out)


def _rule_sql(what: str) -> str:
    cases = []
    for verdict, rule in sorted(RULES, key=lambda r: -len(r[1])):
        name, slash, start = rule.partition("/")
        cases.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{start}') THEN '{rule if what == 'rule' else verdict}'")
    return "CASE " + " ".join(cases) + " END"


OP1_SQL = rf"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{urls.UPPER}', '{urls.LETTERS}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
d AS (SELECT *, {_rule_sql("rule")} AS rule, {_rule_sql("verdict")} AS decided, md5(host || path)[1] IN ('0', '1', '2') AS held, translate(host || path, '{urls.UPPER}', '{urls.LETTERS}') AS s FROM b),
i AS (SELECT page_id, decided, held, repeat(chr(2), {urls.ORDER}) || s AS s, unnest(range(1, length(s) + 1)) AS i FROM d),
c AS (SELECT page_id, decided, held, substr(s, i, {urls.ORDER + 1}) AS gram FROM i),
counts AS (SELECT gram, count(*) FILTER (decided = 'allow' AND NOT held) AS n1, count(*) FILTER (decided = 'block' AND NOT held) AS n0 FROM c GROUP BY gram),
{_markov_sql()},
z AS (SELECT page_id, sum(ln(p1) - ln(p0)) / count(*) AS score FROM c JOIN p{urls.ORDER} USING (gram) GROUP BY page_id),
h AS (SELECT greatest(least(floor(coalesce(score, 0) * 100), 3000), -3000)::BIGINT AS step, count(*) FILTER (decided = 'allow') AS n1, count(*) FILTER (decided = 'block') AS n0
  FROM d LEFT JOIN z USING (page_id) WHERE decided IS NOT NULL AND held GROUP BY 1),
m AS (SELECT step, (coalesce(lag(step) OVER (ORDER BY step) + 1, step) + step) / 200.0::DOUBLE AS middle, coalesce(sum(n1) OVER p, 0) AS lost, coalesce(sum(n0) OVER p, 0) AS caught, sum(n1) OVER () AS t1, sum(n0) OVER () AS t0
  FROM h WINDOW p AS (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT coalesce((SELECT middle FROM m WHERE t1 > 0 AND t0 > 0 ORDER BY caught * t1 - lost * t0 DESC, step LIMIT 1), 0.0::DOUBLE) AS least)
SELECT page_id, host, path, rule, coalesce(decided, CASE WHEN coalesce(score, 0) >= (SELECT least FROM t) THEN 'allow' ELSE 'block' END) AS verdict
FROM d LEFT JOIN z USING (page_id)
"""


@query("op1_url_filter", OP1_SQL)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return urls.judge(table(spark, sf, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
i AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM w),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM i),
s AS (SELECT doc_id, least(3, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 3)) AS span FROM g WHERE n > 1),
r AS (SELECT doc_id, sum(span) AS n_repeat_words FROM s GROUP BY doc_id),
l AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
m AS (SELECT doc_id, host, text, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
  array_to_string(regexp_extract_all(translate(lower(line), '0123456789', '0000000000'), '[^\x20\x09-\x0D]+'), ' ') AS norm FROM l),
k AS (SELECT * FROM m WHERE n > 0),
u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM k GROUP BY doc_id),
f AS (SELECT host, norm, count(DISTINCT text) AS texts, min(doc_id) AS first FROM k GROUP BY host, norm),
h AS (SELECT host, count(DISTINCT text) AS all_texts FROM d GROUP BY host),
o AS (SELECT host, norm, first FROM f JOIN h USING (host) WHERE texts >= 20 AND texts > 0.1::DOUBLE * all_texts),
x AS (SELECT doc_id, sum(n) AS removed FROM k JOIN o USING (host, norm) WHERE doc_id <> first GROUP BY doc_id),
a AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed, 0) AS removed
  FROM w LEFT JOIN u USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN x USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_words - removed < 0.3::DOUBLE * n_words) AS kept FROM b
"""


@query("op2_quality_rules", OP2_SQL)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    judged = rules.judge(table(spark, sf, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _notices_sql() -> str:
    rows = ", ".join(f"({i}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (name, text) in enumerate(licenses.NOTICES))
    return f"(VALUES {rows}) n(template, license, text)"


_FIVE = " || ' ' || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(5))
_WORDS = r"regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), '[^ ]+')"

#: Every window against every template, without bands.
OP3_SQL = f"""
WITH t AS (SELECT template, license, {_WORDS} AS w FROM {_notices_sql()}),
u AS (SELECT template, license, w, unnest(range(1, len(w) - 3)) AS i FROM t),
s AS (SELECT DISTINCT template, license, {_FIVE} AS shingle FROM u),
z AS (SELECT template, count(*) AS n, (2 ** ceil(log2(count(*))))::BIGINT AS s FROM s GROUP BY template),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
e AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM d),
p AS (SELECT doc_id, i - 1 AS pos, {_FIVE} AS shingle FROM e),
m AS (SELECT doc_id, template, license, n, pos, shingle, unnest([pos // s, pos // s - 1]) AS j FROM p JOIN s USING (shingle) JOIN z USING (template)),
c AS (SELECT doc_id, license, count(DISTINCT shingle) / n::DOUBLE AS containment, min(pos) AS first_word FROM m WHERE j >= 0 GROUP BY doc_id, license, template, n, j)
SELECT doc_id, license, max(containment) AS containment, min(first_word) AS first_word FROM c WHERE containment >= 0.8::DOUBLE GROUP BY doc_id, license
"""


@query("op3_license_scan", OP3_SQL)
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(table(spark, sf, "documents"))


@query("op4_packing")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), WORD)


@query("op5_chunk_reuse")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.digests(table(spark, sf, "documents"), BYTE)


@query("op6_orc_tokens")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch_path(spark, "orc")
    orc.write(table(spark, sf, "documents"), BYTE, out)
    return orc.manifest(spark, out)


@query("op7_simhash")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 10
"""


@query("op8_top_k", OP8_SQL)
def op8(spark: SparkSession, sf: str) -> DataFrame:
    vectors = search.integers(table(spark, sf, "embeddings"))
    return search.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


@query("op9_quality")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf, "labels")))
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op10_language")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return langid.identify(table(spark, sf, "pages"), langid.fit(table(spark, sf, "documents")))


def _grams_sql() -> str:
    """Phrases of one to four words, in one column."""
    return " UNION ALL ".join(f"SELECT lang, {m} AS m, array_to_string(w[i:i + {m - 1}], ' ') AS phrase FROM i WHERE i + {m - 1} <= len(w)" for m in (1, 2, 3, 4))


OP13_SQL = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(text, '{urls.UPPER}', '{urls.LETTERS}') AS text FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?
-
]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM p),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, m, phrase, count(*) AS f FROM ({_grams_sql()}) GROUP BY ALL HAVING count(*) >= 30 OR m = 1),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE m > 1),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.a, k.k, x.f AS l, y.f AS r, ((2000000 * k.a::HUGEINT) // (x.f + y.f)::HUGEINT)::BIGINT AS score
  FROM k JOIN g x ON k.lang = x.lang AND x.phrase = array_to_string(k.w[1:k.k], ' ') JOIN g y ON k.lang = y.lang AND y.phrase = array_to_string(k.w[k.k + 1:k.m], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, a, w, unnest(range(2, m)) AS n, m FROM c WHERE m > 2),
q AS (SELECT lang, a, w, n, unnest(range(1, m - n + 2)) AS i FROM o),
z AS (SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS phrase, max(a) AS around FROM q GROUP BY ALL),
e AS (SELECT b.lang, b.phrase, a, l, r, n, score FROM b JOIN t USING (lang) LEFT JOIN z ON b.lang = z.lang AND b.phrase = z.phrase WHERE around IS NULL OR 100 * around::HUGEINT < 80 * a::HUGEINT)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM e
QUALIFY rank <= 2000
"""


@query("op13_phrases", OP13_SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(table(spark, sf, "documents"))


_TERMS = r"regexp_extract_all(translate(text, '{}', '{}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".format(urls.UPPER, urls.LETTERS)

OP11_SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS words FROM d WHERE len(w) > 0),
u AS (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d),
t AS (SELECT doc_id, n, term, count(*) AS tf FROM u GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)),
x AS (SELECT item_id, doc_id, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w, tf, 10 + (90 * n * docs) // words AS m
  FROM q JOIN t USING (term) JOIN f USING (term), s),
y AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM x GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM y WHERE score > 0
QUALIFY rank <= 10
"""


@query("op11_ranked_search", OP11_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.rank(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op12_hidden_markov")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return hmm.score(table(spark, sf, "documents"))
