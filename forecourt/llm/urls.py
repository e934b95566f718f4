"""URL filter: listed rules, and a character language-model ratio for all other URLs; DataFrame expressions only.

The symbols are the characters of host and path, A-Z lowered, behind a start symbol. URLs that
a rule decides train two variable-order Markov models, one of accepted and one of rejected
URLs: a context of up to five symbols is used where the class has seen it ``SEEN`` times, and
mixes with the next shorter one by Witten-Bell weights, down to smoothed single symbols. All
strings of six symbols that occur are counted map-side, so what is learnt grows with the
input. The logarithm of the ratio of both probabilities is looked up by string: those with
more than 1 / ``HOT`` of all uses, fewer than ``HOT`` by arithmetic, are broadcast, and only
the uses of the others are shuffled and joined, of which none is hot. The score is the mean
over a URL's symbols. The threshold has the best balanced accuracy on decided URLs that were
kept from training (3 of 16, by hash), on a grid of hundredths (scores beyond 30 count as 30
there): halfway between two neighbouring steps seen, the lowest such gap if several are as good.

A null URL, or one without ``://``, has an empty host and path, fits no rule and scores 0.
URLs that train have no score (null). Without decided URLs of both classes the models say 0
for everything and the threshold is 0: all is allowed. Rows are judged each, repeated or not;
other columns are ignored. A character equal to the start symbol counts as it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from forecourt.llm.common import discard, written

ORDER = 5
START = "\x02"
HOT = 1 << 18  # strings broadcast at most
SEEN = 2
PRIOR = 0.5
GRID = 100.0  # steps of the threshold in a unit of score
REACH = 3000  # grid steps to both sides

LETTERS = "abcdefghijklmnopqrstuvwxyz"
UPPER = LETTERS.upper()


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered. Path: from there up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LETTERS), path


def rule_column(rules: Sequence[tuple[str, str]], host: Column, path: Column, what: str) -> Column:
    """Of the rules (``allow`` or ``block``, host/path) that fit, the longest: its text, or its verdict."""
    out = F.lit(None).cast("string")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        out = F.when(fits, F.lit(rule if what == "rule" else verdict)).otherwise(out)
    return out


def decided(pages: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    d = pages.select("page_id", host.alias("host"), path.alias("path"))
    return d.select("*", rule_column(rules, d["host"], d["path"], "rule").alias("rule"), rule_column(rules, d["host"], d["path"], "verdict").alias("decided"))


def coded(d: DataFrame) -> DataFrame:
    """The folded URL's symbols, numbered rows, and which of them neither train nor need a score."""
    whole = F.concat("host", "path")
    held = F.substring(F.md5(whole.cast("binary")), 1, 1).isin("0", "1", "2")
    trains = F.col("decided").isNotNull() & ~held
    return d.select("*", held.alias("held"), trains.alias("trains"), F.translate(whole, UPPER, LETTERS).alias("symbols"), F.monotonically_increasing_id().alias("row"))


def grams(symbols: Column) -> Column:
    """Each symbol behind the ``ORDER`` before it: as many strings of ORDER + 1 as there are symbols, in linear time."""
    each = F.concat(F.array_repeat(F.lit(START), ORDER), F.array_remove(F.split(symbols, ""), ""))
    string = lambda a, s, i: F.concat(*[F.get(a, i + k) for k in range(ORDER)], s)
    # As a lambda's variable the array of symbols is made once, not once for every string.
    return F.transform(F.array(each), lambda a: F.transform(F.slice(a, ORDER + 1, F.size(a)), lambda s, i: string(a, s, i)))[0]


def counted(d: DataFrame) -> DataFrame:
    """(gram, n1, n0, uses): occurrences in accepted and in rejected training URLs, and in URLs to be scored."""
    each = d.select("trains", "decided", F.explode(grams(F.col("symbols"))).alias("gram"))
    n = lambda verdict: F.count_if(F.col("trains") & (F.col("decided") == verdict))
    return each.groupBy("gram").agg(n("allow").alias("n1"), n("block").alias("n0"), F.count_if(~F.col("trains")).alias("uses"))


def log_ratios(counts: DataFrame) -> DataFrame:
    """(gram, uses, llr) of every string that URLs to be scored hold. The shorter strings are ends of the counted ones, so all come from their counts."""
    ends = F.transform(F.sequence(F.lit(1), F.lit(ORDER + 1)), lambda n: F.right(F.col("gram"), n))
    short = counts.select(F.explode(ends).alias("gram"), "n1", "n0").groupBy("gram").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    levels = written(short.withColumn("context", F.expr("left(gram, length(gram) - 1)")), "levels")
    contexts = levels.where("n1 + n0 > 0").groupBy("context").agg(
        *[F.sum(f"n{y}").alias(f"c{y}") for y in (1, 0)], *[F.count_if(F.col(f"n{y}") > 0).alias(f"t{y}") for y in (1, 0)]
    )
    models = levels.join(contexts, "context", "left")
    of = lambda order: models.where(F.length("gram") == order + 1)
    symbols = of(0).agg(F.count(F.lit(1))).scalar()
    start = lambda y: (F.col(f"n{y}") + PRIOR) / (F.coalesce(f"c{y}", F.lit(0)) + PRIOR * symbols)
    probs = of(0).select("gram", start(1).alias("p1"), start(0).alias("p0"))
    mixed = lambda y: F.when(F.col(f"c{y}") >= SEEN, (F.col(f"n{y}") + F.col(f"t{y}") * F.col(f"q{y}")) / (F.col(f"c{y}") + F.col(f"t{y}"))).otherwise(F.col(f"q{y}"))
    for order in range(1, ORDER + 1):
        shorter = probs.select(F.col("gram").alias("suffix"), F.col("p1").alias("q1"), F.col("p0").alias("q0"))
        every = of(order).withColumn("suffix", F.expr("substring(gram, 2)")).join(shorter, "suffix")
        probs = every.select("gram", mixed(1).alias("p1"), mixed(0).alias("p0"))
    used = counts.where("uses > 0").select("gram", "uses")
    ratios = written(used.join(probs, "gram").select("gram", "uses", (F.log("p1") - F.log("p0")).alias("llr")), "ratios")
    discard(levels)
    return ratios


def scored(d: DataFrame, ratios: DataFrame) -> DataFrame:
    """Add the score of the URLs that do not train. Fewer than HOT strings can have more than 1 / HOT of all uses: these are broadcast."""
    least = ratios.agg(F.sum("uses")).scalar() / HOT
    hot = ratios.where(F.col("uses") > least).select("gram", "llr")
    tail = ratios.where(F.col("uses") <= least).select("gram", "llr")
    each = d.where("NOT trains").select("row", F.explode(grams(F.col("symbols"))).alias("gram")).join(F.broadcast(hot), "gram", "left")
    sums = F.sum("llr").alias("llr"), F.count(F.lit(1)).alias("n")
    near = each.where("llr IS NOT NULL").groupBy("row").agg(*sums)
    far = each.where("llr IS NULL").select("row", "gram").join(tail, "gram").groupBy("row").agg(*sums)
    whole = near.unionByName(far).groupBy("row").agg((F.sum("llr") / F.sum("n")).alias("score"))
    score = F.when(~F.col("trains"), F.coalesce("score", F.lit(0.0)))
    return d.drop("symbols").join(whole, "row", "left").withColumn("score", score)


def threshold(d: DataFrame) -> DataFrame:
    """One row: the score from which on URLs are allowed."""
    step = F.greatest(F.least(F.floor(F.col("score") * GRID), F.lit(REACH)), F.lit(-REACH))
    known = d.where("decided IS NOT NULL AND held").select(step.alias("step"), (F.col("decided") == "allow").alias("y"))
    steps = known.groupBy("step").agg(F.count_if("y").alias("n1"), F.count_if(~F.col("y")).alias("n0"))  # 6001 rows at most
    upto = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    before = F.lag("step").over(Window.orderBy("step"))
    rated = steps.select(
        "step", ((F.coalesce(before + 1, F.col("step")) + F.col("step")) / (2 * GRID)).alias("middle"), F.coalesce(F.sum("n1").over(upto), F.lit(0)).alias("lost"), F.coalesce(F.sum("n0").over(upto), F.lit(0)).alias("caught"),
        F.sum("n1").over(whole).alias("t1"), F.sum("n0").over(whole).alias("t0"),
    ).where("t1 > 0 AND t0 > 0")
    merit = F.col("caught") * F.col("t1") - F.col("lost") * F.col("t0")  # balanced accuracy, in integers
    return rated.agg(F.coalesce(F.max_by("middle", F.struct(merit, -F.col("step"))), F.lit(0.0)).alias("least"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row."""
    d = written(coded(decided(pages, rules)), "coded")
    counts = written(counted(d), "counts")
    ratios = log_ratios(counts)
    discard(counts)
    scores = written(scored(d, ratios), "scored")
    discard(d, ratios)
    d = scores
    own = F.when(F.col("score") >= threshold(d).scalar(), "allow").otherwise("block")
    return d.select("page_id", "host", "path", "rule", F.coalesce("decided", own).alias("verdict"), "score")
