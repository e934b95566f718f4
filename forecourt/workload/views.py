"""The given tables mapped onto the operators' inputs.

Column expressions are shared by both engines' views, so an input is defined once.
L = listings, H = price history, T = raw messy text, P = predictions, M = multipliers.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from forecourt.functions.text import unfused
from forecourt.operators import demand, dynamics, snapshots
from forecourt.plans import clean
from forecourt.session import stored
from forecourt.trims import LADDERS, Pattern

REF = "2001-12-31 00:00:00"
MIN_YEAR = 1985
SEGMENT_EDGES = (25_000.0, 50_000.0, 75_000.0)
REPORT_EDGES = (20_000.0, 40_000.0, 60_000.0, 80_000.0)
MARKET_LEVELS = (
    (("make", "model", "variant_grouped", "city", "age_bucket"), 3),
    (("make", "model", "variant_grouped", "age_bucket"), 3),
    (("make", "model", "city", "age_bucket"), 8),
    (("make", "model", "age_bucket"), 5),
    (("make", "model"), 3),
)

KEYS = "concat_ws('-', {})".format(", ".join(
    f"CAST({c} AS STRING)" for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag", "l_linestatus")
))

L_COLUMNS = {
    "listing_id": "CAST(l_orderkey AS STRING)",
    "fetched_on": "l_shipdate",
    "price": "l_extendedprice",
    "make": "p_brand",
    "model": "concat(p_brand, ' ', p_type)",
    "variant": "p_name",
    "city": "n_name",
    "body_type": "p_type",
    "fuel": "l_returnflag",
    "transmission": "l_linestatus",
    "reg_state": "upper(substring(p_type, 1, 2))",
    "ownership": "CAST(l_linenumber AS DOUBLE)",
    "kms": "l_quantity * 4000.0",
    "year": "CAST(year(l_shipdate) - (p_size % 12) AS DOUBLE)",
    "row_key": KEYS,
}

_THOUSANDS = (
    "CASE WHEN l_extendedprice >= 1000 THEN concat(CAST(CAST(floor(l_extendedprice / 1000) AS BIGINT) AS STRING), ',', "
    "lpad(CAST(CAST(floor(l_extendedprice) AS BIGINT) % 1000 AS STRING), 3, '0')) "
    "ELSE CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING) END"
)
_QTY = "CAST(CAST(l_quantity AS BIGINT) AS STRING)"
_YEAR = "CAST(1984 + l_orderkey % 12 AS STRING)"

T_COLUMNS = {
    "id": "CASE WHEN l_orderkey % 97 = 0 THEN NULL WHEN l_orderkey % 89 = 0 THEN '  ' "
          "WHEN l_orderkey % 2 = 0 THEN concat(' ', CAST(l_orderkey AS STRING)) ELSE CAST(l_orderkey AS STRING) END",
    "name": "CASE l_partkey % 7 WHEN 0 THEN concat('MARUTI SUZUKI ', p_type) WHEN 1 THEN 'mercedes-benz c-class' "
            "WHEN 2 THEN 'LAND ROVER' WHEN 3 THEN concat('  ', p_brand, '   ', p_type) WHEN 4 THEN NULL "
            "WHEN 5 THEN p_brand ELSE concat(p_brand, ' ', p_name) END",
    "variant": "CASE l_partkey % 11 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN concat('  ', upper(p_name), '   x ') ELSE p_name END",
    "year": f"CASE l_suppkey % 5 WHEN 0 THEN {_YEAR} WHEN 1 THEN concat(substring({_YEAR}, 1, 1), ',', substring({_YEAR}, 2, 3)) "
            f"WHEN 2 THEN concat({_YEAR}, '.0') WHEN 3 THEN concat(' ', {_YEAR}, ' ') "
            f"ELSE CASE WHEN l_orderkey % 13 = 0 THEN 'n/a' ELSE concat('Year: ', {_YEAR}) END END",
    "kms": f"CASE l_partkey % 7 WHEN 0 THEN concat({_QTY}, '000') WHEN 1 THEN concat({_QTY}, '.5k km') WHEN 2 THEN concat('0.', {_QTY}, 'L KM') "
           f"WHEN 3 THEN concat({_QTY}, ',250') WHEN 4 THEN concat({_QTY}, ',000 km') WHEN 5 THEN NULL ELSE 'n/a' END",
    "ownership": "CASE l_linenumber WHEN 1 THEN '1st owner' WHEN 2 THEN 'second owner' WHEN 3 THEN '3' WHEN 4 THEN ' Fourth ' "
                 "WHEN 5 THEN NULL WHEN 6 THEN 'unknown' ELSE 'FIRST' END",
    "transmission": "CASE l_orderkey % 7 WHEN 0 THEN 'M' WHEN 1 THEN 'A' WHEN 2 THEN 'MANUAL' WHEN 3 THEN 'automatic' "
                    "WHEN 4 THEN ' m ' WHEN 5 THEN NULL ELSE ' CVT  box' END",
    "fuel": "CASE WHEN l_linenumber = 7 AND l_orderkey % 4 = 0 THEN 'LPG' ELSE CASE l_orderkey % 6 WHEN 0 THEN 'Petrol' "
            "WHEN 1 THEN 'petrol/cng' WHEN 2 THEN 'DIESEL' WHEN 3 THEN 'Hybrid   Electric' WHEN 4 THEN '' ELSE NULL END END",
    "body_type": "CASE l_orderkey % 5 WHEN 0 THEN 'suv' WHEN 1 THEN ' Pickup  Truck' WHEN 2 THEN 'Hatchback' WHEN 3 THEN 'Limo' ELSE NULL END",
    "city": "CASE l_suppkey % 4 WHEN 0 THEN concat(' ', lower(n_name)) WHEN 1 THEN n_name WHEN 2 THEN 'Pune' ELSE NULL END",
    "registration": "CASE l_orderkey % 4 WHEN 0 THEN 'ka51**9597' WHEN 1 THEN '9KA' WHEN 2 THEN NULL ELSE ' MH-12' END",
    "price": f"CASE l_partkey % 5 WHEN 0 THEN concat('₹ ', {_THOUSANDS}) WHEN 1 THEN CAST(l_extendedprice AS STRING) "
             f"WHEN 2 THEN concat('INR ', {_THOUSANDS}, '/-') WHEN 3 THEN concat('  ', CAST(l_extendedprice AS STRING)) "
             "ELSE CASE WHEN l_orderkey % 31 = 0 THEN 'on request' ELSE CAST(l_extendedprice AS STRING) END END",
    "date": "CASE WHEN l_orderkey % 61 = 0 THEN 'not a date' WHEN l_orderkey % 67 = 0 THEN NULL WHEN l_orderkey % 3 = 0 "
            "THEN concat(substring(CAST(l_shipdate AS STRING), 1, 10), ' 1', CAST(l_linenumber AS STRING), ':30:00') ELSE CAST(l_shipdate AS STRING) END",
    "row_key": KEYS,
}
# Headers as a scraped file has them; the cleaning plans map them back.
T_HEADERS = {
    "id": "ID", "name": "Name", "variant": "Variant", "year": "Year", "kms": " KM  Driven", "ownership": "Ownership",
    "transmission": "Transmission", "fuel": "Fuel", "body_type": "Body Type", "city": "CITY", "registration": "Registration",
    "price": "Price (₹)", "date": "Fetched On", "row_key": "row_key",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` in as many partitions as there are cores, where a small input's files make fewer, or its row groups
    leave them empty. Files of more than about 4 MB a core are read by all cores and do not travel.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, *keys) if rows.rdd.getNumPartitions() < cores else rows


def _joined(spark: SparkSession, sf: str, dealt: bool = False) -> DataFrame:
    line, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    supplier, nation = table(spark, sf, "supplier"), table(spark, sf, "nation")
    line = _dealt(line, "l_orderkey", "l_linenumber") if dealt else line
    return (
        line.join(part, line.l_partkey == part.p_partkey)
        .join(supplier, line.l_suppkey == supplier.s_suppkey)
        .join(nation, supplier.s_nationkey == nation.n_nationkey)
    )


def listings(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(spark, sf).select(*[F.expr(e).alias(c) for c, e in L_COLUMNS.items()])


def listing_features(spark: SparkSession, sf: str) -> DataFrame:
    return clean.snapshot_features(listings(spark, sf), REF)


#: What snapshot features are worked out from, and what the market's operators read besides.
FEATURED = ("fetched_on", "year", "kms", "ownership")
MARKET_COLUMNS = ("listing_id", "price", "make", "model", "variant", "city", *FEATURED)


def first_listings(spark: SparkSession, sf: str, columns: Sequence[str] = tuple(L_COLUMNS)) -> DataFrame:
    """One row per listing, with snapshot features if ``columns`` has what they come from.

    Picking sorts and ships whole rows, so it gets the wanted columns only, and features are added to what it
    picked. Where all that is wanted are the ID, time and price, equal ones need no row key.
    """
    ties = ["price", "row_key"] if set(columns) - {"listing_id", "fetched_on", "price"} else ["price"]
    wanted = {"listing_id", "fetched_on", *ties, *columns}
    rows = listings(spark, sf).select(*[c for c in L_COLUMNS if c in wanted])
    first = snapshots.first_snapshot(rows, ties=ties)
    return clean.snapshot_features(first, REF) if wanted.issuperset(FEATURED) else first


def market_base(spark: SparkSession, sf: str, columns: Sequence[str] = tuple(L_COLUMNS)) -> DataFrame:
    """First snapshots with the pressure targets of their listing's whole history."""
    # Stored: their bounds are fitted before they are scored, and all snapshots would travel for each.
    components = stored(dynamics.pressure_components(listings(spark, sf), ties=["price", "row_key"]), "components")
    return clean.join_targets(first_listings(spark, sf, columns), dynamics.pressure_score(components))


_REMAINDER = re.compile(r"(l_\w+) % (\d+)")
#: What several columns of T, or branches of one, have in common, longest first.
_COMMON = {
    "__key": KEYS, "__thousands": _THOUSANDS, "__year": _YEAR, "__quantity": _QTY, "__price": "CAST(l_extendedprice AS STRING)", "__order": "CAST(l_orderkey AS STRING)", "__day": "CAST(l_shipdate AS STRING)",
} | {f"__{m[1]}_{m[2]}": m[0] for e in T_COLUMNS.values() for m in _REMAINDER.finditer(e)}


def _shared(e: str) -> str:
    for name, text in sorted(_COMMON.items(), key=lambda c: -len(c[1])):
        e = re.sub(rf"{re.escape(text)}(?!\d)", name, e)
    return e


def raw_text(spark: SparkSession, sf: str, headers: bool = True) -> DataFrame:
    """The columns of T. What they have in common is a column first: worked out once a row.

    Texts cost more than reading them: a small input is dealt to all cores first.
    """
    rows = _joined(spark, sf, dealt=True).withColumns({name: F.expr(e) for name, e in _COMMON.items()})
    columns = {c: F.expr(_shared(e)) for c, e in T_COLUMNS.items()}
    columns["name"] = unfused(columns["name"])
    return rows.select(*[e.alias(T_HEADERS[c] if headers else c) for c, e in columns.items()])


def history(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("listing_id"), F.col("ts").alias("fetched_on"),
        F.col("value").alias("price"), F.col("event_type").alias("fuel"), "event_id",
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Listings priced by their model's and their make's mean, with the actual price's segment."""
    rows = listings(spark, sf)
    sums = rows.groupBy("make", "model").agg(F.sum("price").alias("s"), F.count("price").alias("n"))
    per_make = Window.partitionBy("make")  # one row per model
    means = sums.select(
        "make", "model", (F.col("s") / F.col("n")).alias("prediction"),
        (F.sum("s").over(per_make) / F.sum("n").over(per_make)).alias("prediction_2"),
    )
    out = rows.join(means, ["make", "model"])
    return out.withColumn("segment", clean.bands.price_segment(F.col("price"), SEGMENT_EDGES))


# --- multipliers: rows named after the given tables' own values ----------------------------

M_COLUMNS = "position BIGINT, type STRING, scope STRING, name STRING, parent STRING, min STRING, max STRING, multiplier STRING, notes STRING"
M_BUCKETS = (
    ("age_bucket", 0, 2, "1.00"), ("age_bucket", 2, 5, " 0.90 "), ("age_bucket", 5, 8, "0.75"), ("age_bucket", 8, 100, "0.60"),
    ("kms_year_bucket", 0, 10000, "1.00"), ("kms_year_bucket", 10000, 40000, "0.95"), ("kms_year_bucket", 40000, 90000, "0.85"),
    ("kms_year_bucket", 90000, 300000, "0.70"),
    ("ownership_bucket", 1, 2, "1.00"), ("ownership_bucket", 2, 3, "0.90"), ("ownership_bucket", 3, 4, "bad"), ("ownership_bucket", 4, 100, "0.60"),
)

_BUCKET_SQL = " UNION ALL ".join(
    f"SELECT CAST({90000000 + i} AS BIGINT) AS position, '{t}' AS type, '' AS scope, '' AS name, ' ' AS parent, "
    f"'{lo}' AS min, ' {hi}' AS max, '{m}' AS multiplier, 'bucket' AS notes" for i, (t, lo, hi, m) in enumerate(M_BUCKETS)
)
_ROW = "'' AS scope, {name} AS name, {parent} AS parent, '' AS min, ' ' AS max, {mult} AS multiplier, '' AS notes"


def _m(position: str, kind: str, name: str, parent: str, mult: str, source: str) -> str:
    body = _ROW.format(name=name, parent=parent, mult=mult)
    return f"SELECT CAST({position} AS BIGINT) AS position, {kind} AS type, {body} FROM {source}"


M_SQL = " UNION ALL ".join([
    _m("min(p_partkey)", "'brand'", "concat(' ', p_brand)", "''", "CASE min(p_partkey) % 6 WHEN 0 THEN '0.70' WHEN 1 THEN '0.75' WHEN 2 THEN '0.80' WHEN 3 THEN '0.85' WHEN 4 THEN '1.05' ELSE '' END", "part WHERE p_partkey % 3 <> 1 GROUP BY p_brand"),
    _m("10000000 + min(p_partkey)", "'model'", "upper(concat(p_brand, ' ', p_type))", "p_brand", "CASE min(p_partkey) % 4 WHEN 0 THEN '0.66' WHEN 1 THEN '0.88' WHEN 2 THEN '1.10' ELSE '0.99' END", "part WHERE length(p_type) % 2 = 0 GROUP BY p_brand, p_type"),
    _m("20000000 + min(p_partkey)", "'Variant '", "p_name", "concat(p_brand, ' |  ', p_brand, ' ', p_type)", "'0.91'", "part WHERE p_partkey % 5 = 0 GROUP BY p_brand, p_type, p_name"),
    _m("30000000 + min(p_partkey)", "'variant'", "p_name", "p_brand", "'1.02'", "part WHERE p_partkey % 7 = 0 GROUP BY p_brand, p_name"),
    _m("40000000 + n_nationkey", "'city'", "lower(n_name)", "''", "CASE n_nationkey % 3 WHEN 0 THEN '0.90' WHEN 1 THEN '0.85' ELSE '0.70' END", "nation WHERE n_nationkey % 4 <> 3"),
    _m("50000000 + min(p_partkey)", "'bodytype'", "p_type", "''", "'0.95'", "part WHERE p_type <> 'SMALL' GROUP BY p_type"),
    _m("60000000 + r_regionkey", "'fuel'", "substring('ANR', r_regionkey + 1, 1)", "''", "CASE r_regionkey WHEN 0 THEN '0.90' ELSE '0.80' END", "region WHERE r_regionkey < 2"),
    _m("70000000 + r_regionkey", "'transmission'", "substring('OF', r_regionkey + 1, 1)", "''", "CASE r_regionkey WHEN 0 THEN '0.80' ELSE '0.85' END", "region WHERE r_regionkey < 2"),
    _m("80000000 + r_regionkey", "CASE WHEN r_regionkey = 0 THEN ' ' ELSE NULL END", "'separator'", "''", "''", "region WHERE r_regionkey < 2"),
    _m("85000000 + min(p_partkey)", "'reg_state'", "lower(substring(p_type, 1, 2))", "''", "concat('0.9', CAST(min(p_partkey) % 10 AS STRING))", "part WHERE p_type <> 'LARGE' GROUP BY substring(p_type, 1, 2)"),
    _BUCKET_SQL,
])


def multipliers_raw(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(
        M_SQL.replace("FROM part", "FROM {part}").replace("FROM nation", "FROM {nation}").replace("FROM region", "FROM {region}"),
        part=table(spark, sf, "part"), nation=table(spark, sf, "nation"), region=table(spark, sf, "region"),
    )


def multipliers(spark: SparkSession, sf: str) -> DataFrame:
    return demand.multiplier_table(multipliers_raw(spark, sf))


# --- trim ladders over the words of the part names ------------------------------------------

WORD_LADDERS = {
    "model": {
        "Brand#1 | Brand#1 SMALL": [[Pattern(r"\bold\b")], [Pattern(r"^small\b")], [Pattern(r"\bwidget\b"), Pattern(r"\bring\b")]],
        "Brand#2 | Brand#2 PROMO": [["OLD", "COLD"], ["HOT"], ["RED", "BLUE"], ["LARGE", "GIZMO"]],
        "Brand#3 | Brand#3 LARGE": [["BOLT"], ["ROD", "PLATE"]],
    },
    "brand": {
        "BRAND#1": [["SMALL"], ["COLD"], ["RED"], ["HOT"], ["HOT RING", "LARGE"]],
        "BRAND#2": [["OLD"], ["RING", "BOLT"], ["PLATE"]],
        "BRAND#4": [["WIDGET"]],
        "BRAND#5": [["RED RING"], ["BLUE"], ["GREEN"], ["LARGE ROD"]],
    },
}
WORD_TIERS = {5: ["HOT RING", "LARGE GIZMO"], 4: ["PLATE", "HOT"], 2: ["OLD", "RED ROD"], 1: ["SMALL BOLT", "COLD"]}


# --- names with the tokens of the whole trim ladders, dealt over the parts -------------------

def _as_name(token: str) -> str:
    """A name that a token describes: a regular expression without its anchors and escapes."""
    if isinstance(token, Pattern):
        for sign, text in ((r"\b", ""), (r"\s*", " "), (r"\s+", " "), ("^", ""), ("$", ""), ("\\", "")):
            token = token.replace(sign, text)
    return token.replace("'", "''")


def _trim_names() -> str:
    """Every part takes one token of one ladder, before or after a word of its own name."""
    tokens = [(scope, parent, t) for scope, table in LADDERS.items() for parent, steps in table.items() for step in steps for t in step]
    rows = ", ".join(f"({i}, '{scope}', '{parent}', '{_as_name(t)}')" for i, (scope, parent, t) in enumerate(tokens))
    return f"""SELECT DISTINCT CASE WHEN scope = 'brand' THEN concat(parent, ' | ', p_type) ELSE parent END AS parent,
      CASE WHEN p_partkey % 2 = 0 THEN concat(lower(token), '  ', split_part(p_name, ' ', 1)) ELSE concat(split_part(p_name, ' ', 1), ' ', token) END AS name
      FROM part JOIN (VALUES {rows}) AS x(pos, scope, parent, token) ON p_partkey % {len(tokens)} = pos"""


TRIM_NAMES = _trim_names()
