"""Every operator as a query over the tables of a folder, with the same question in SQL where SQL can ask it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.dates import date_format, date_problem
from millrace.functions.identifiers import CNPJ, CPF, IPV4, cnpj_digits, cpf_digits
from millrace.functions.numbers import stringify
from millrace.functions.statistics import wilson
from millrace.functions.texts import common_prefix, common_suffix, decode_index, digit_groups, encode_index, fill_template, min_length_rule, shift_digits, template
from millrace.operators import encode, flatten, nested, profile, sampling
from millrace.operators.view import TableView, reorder, sort_as_text, top_values
from millrace.plans import shaper, workload
from millrace.sources import catalog, files
from millrace.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
STAR_TABLES = catalog.STAR.levels["full"]


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that asks the same."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# The view -------------------------------------------------------------------------------------

@query("SELECT o_orderpriority, sum(cast(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS sum FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def view_agg_by(spark, d):
    v = TableView(_t(spark, d, "orders")).where("o_orderstatus", "F")
    return v.agg_by("o_orderpriority", "o_totalprice", "sum").select("o_orderpriority", F.round("sum", 2).alias("sum"))


@query("SELECT round(sum(o_totalprice), 2) AS sum, count(*) AS count FROM orders WHERE o_orderstatus = 'F'")
def view_filter_sum(spark, d):
    return TableView(_t(spark, d, "orders")).where("o_orderstatus", "F").aggregate("o_totalprice", "sum", "count").select(F.round("sum", 2).alias("sum"), "count")


@query("SELECT round(avg(o_totalprice), 4) AS avg FROM orders WHERE o_orderstatus = 'O'")
def view_filter_avg(spark, d):
    return TableView(_t(spark, d, "orders")).where("o_orderstatus", "O").aggregate("o_totalprice", "avg").select(F.round("avg", 4).alias("avg"))


@query("SELECT min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders WHERE o_orderstatus = 'P'")
def view_filter_minmax(spark, d):
    return TableView(_t(spark, d, "orders")).where("o_orderstatus", "P").aggregate("o_totalprice", "min", "max")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def view_select_where_chain(spark, d):
    return TableView(_t(spark, d, "orders")).where("o_orderstatus", "F").where("o_orderpriority", "1-URGENT").select(["o_orderkey", "o_custkey"])


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1996-01-01'")
def view_where_pred(spark, d):
    v = TableView(_t(spark, d, "lineitem")).where("l_quantity", pred=lambda c: c > 45)
    v = v.where("l_shipdate", pred=lambda c: (c >= F.lit("1995-01-01").cast("timestamp_ntz")) & (c < F.lit("1996-01-01").cast("timestamp_ntz")))
    return v.select(["l_orderkey", "l_linenumber", "l_quantity"])


@query("SELECT coalesce(l_returnflag, '') AS value, count(*) AS n FROM lineitem GROUP BY 1")
def view_group_count(spark, d):
    return TableView(_t(spark, d, "lineitem")).group_count("l_returnflag")


@query("""WITH o AS (SELECT o_orderpriority AS value, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1 AS p FROM orders)
SELECT value, min(p)::BIGINT AS "start", (max(p) + 1)::BIGINT AS "end" FROM o GROUP BY value""")
def view_group_ranges(spark, d):
    return TableView(_t(spark, d, "orders"), ["o_orderpriority", "o_orderkey"]).group_ranges("o_orderpriority")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY cast(o_orderkey AS VARCHAR)) AS n FROM orders ORDER BY n LIMIT 500")
def view_sort_by(spark, d):
    from pyspark.sql import Window

    top = sort_as_text(_t(spark, d, "orders"), "o_orderkey").select("o_orderkey").limit(500)  # top-k is what is asked
    return top.withColumn("n", F.row_number().over(Window.orderBy(F.col("o_orderkey").cast("string"))).cast("long"))


@query("""SELECT p_partkey, b, row_number() OVER (ORDER BY b DESC NULLS FIRST, p_partkey) AS n
FROM (SELECT p_partkey, nullif(p_brand, (SELECT min(p_brand) FROM part)) AS b FROM part) ORDER BY n LIMIT 100""")
def order_reverse_nulls(spark, d):
    from pyspark.sql import Window

    part = _t(spark, d, "part")
    low = part.agg(F.min("p_brand").alias("low"))
    rows = part.crossJoin(F.broadcast(low)).select("p_partkey", F.nullif("p_brand", "low").alias("b"))  # one row
    top = reorder(rows, "reverse:b", "p_partkey").limit(100)
    return top.withColumn("n", F.row_number().over(Window.orderBy(F.col("b").desc_nulls_first(), "p_partkey")).cast("long"))


@query("SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 5")
def topk_values(spark, d):
    return top_values(_t(spark, d, "part"), "p_type", 5)


@query("SELECT event_id, coalesce(cast(user_id AS VARCHAR), '') AS u, coalesce(nullif(event_type, 'view'), '') AS e FROM events")
def stringify_nulls(spark, d):
    return _t(spark, d, "events").select("event_id", stringify(F.col("user_id")).alias("u"), stringify(F.nullif(F.col("event_type"), F.lit("view"))).alias("e"))


@query("SELECT o_orderstatus, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders GROUP BY 1")
def sql_passthrough(spark, d):
    return catalog.sql(spark, d, "SELECT o_orderstatus, cast(sum(cast(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1", ("orders",))


# Profiles and quality -----------------------------------------------------------------------

def _features_sql(table: str, columns: list[str]) -> str:
    one = """SELECT '{c}' AS "column", count(*) AS n_rows, count(*) FILTER (WHERE v = '') AS n_missing, count(DISTINCT v) AS n_unique, round(avg(length(v)), 6) AS avg_len,
coalesce(bool_and(regexp_matches(v, '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$')) FILTER (WHERE v <> ''), false) AS is_numeric, round(count(DISTINCT v) / count(*), 6) AS cardinality
FROM (SELECT coalesce(cast({c} AS VARCHAR), '') AS v FROM {t})"""
    return " UNION ALL ".join(one.format(c=c, t=table) for c in columns)


PROFILED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


@query(_features_sql("orders", PROFILED))
def profile_features(spark, d):
    return profile.features(_t(spark, d, "orders"), PROFILED).withColumns({"avg_len": F.round("avg_len", 6), "cardinality": F.round("cardinality", 6)})


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS n, min({c}) AS min, max({c}) AS max, round(avg({c}), 6) AS mean, round(median({c}), 6) AS median,
round(stddev_samp({c}), 6) AS stdev, count(*) FILTER (WHERE {c} = 0) AS zeros, count(*) FILTER (WHERE {c} < 0) AS negatives FROM lineitem""" for c in MEASURES))
def profile_numeric(spark, d):
    return profile.numeric_stats(_t(spark, d, "lineitem"), MEASURES).withColumns({c: F.round(c, 6) for c in ("mean", "median", "stdev")})


TEXTS = ["p_name", "p_brand", "p_type"]


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", sum(n)::BIGINT AS n, count(*) AS "distinct", round(-sum(n / t * log2(n / t)), 6) AS entropy_bits
FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS t FROM part GROUP BY {c})""" for c in TEXTS))
def profile_text(spark, d):
    return profile.text_stats(_t(spark, d, "part"), TEXTS).withColumn("entropy_bits", F.round("entropy_bits", 6))


@query("""SELECT 'c_mktsegment' AS "column", c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 2""")
def profile_value_counts(spark, d):
    return profile.value_counts(_t(spark, d, "customer"), ["c_mktsegment"])


@query("""SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars, max(n_chars) AS longest FROM documents GROUP BY 1, 2""")
def doc_column_stats(spark, d):
    return _t(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))


_FAMILIES = {
    "region": "r_regionkey:int r_name:text", "nation": "n_nationkey:int n_name:text n_regionkey:int", "customer": "c_custkey:int c_name:text c_nationkey:int c_mktsegment:text",
    "supplier": "s_suppkey:int s_name:text s_nationkey:int", "part": "p_partkey:int p_name:text p_brand:text p_type:text p_size:int", "orders": "o_orderkey:int o_custkey:int o_orderstatus:text o_orderpriority:text",
    "lineitem": "l_orderkey:int l_partkey:int l_suppkey:int l_linenumber:int l_returnflag:text l_linestatus:text"}
_LONG = " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, '{f}' AS f, cast({c} AS VARCHAR) AS v FROM {t}" for t, cs in _FAMILIES.items() for c, _, f in (x.partition(":") for x in cs.split()))


@query(f"""WITH d AS (SELECT t, c, f, v, count(*) AS n FROM ({_LONG}) WHERE v IS NOT NULL AND v <> '' GROUP BY ALL),
s AS (SELECT t, c, count(*) AS k, sum(n) AS r FROM d GROUP BY ALL), p AS (SELECT t, c FROM s WHERE k / r >= 0.98 AND k >= 2), b AS (SELECT d.* FROM d JOIN p USING (t, c)),
j AS (SELECT a.t AS child, a.c AS child_column, b.t AS parent, b.c AS parent_column, count(*) AS common FROM d a JOIN b ON a.v = b.v AND a.f = b.f AND a.t <> b.t GROUP BY ALL),
o AS (SELECT j.*, k, common / k AS o, regexp_extract(child_column, '[^_]*$') = regexp_extract(parent_column, '[^_]*$') OR ends_with(child_column, parent_column) OR ends_with(parent_column, child_column) AS named
FROM j JOIN s ON s.t = child AND s.c = child_column WHERE k >= 2)
SELECT child, child_column, parent, parent_column, round(o, 6) AS overlap, k - common AS orphan_values,
CASE WHEN named AND o >= 0.99 THEN 'high' WHEN named OR o >= 0.99 AND k >= 1000 THEN 'medium' ELSE 'low' END AS confidence FROM o WHERE o >= 0.85""")
def fk_candidates(spark, d):
    return profile.key_candidates(catalog.load(spark, d, STAR_TABLES), confidence=("high", "medium", "low")).withColumn("overlap", F.round("overlap", 6))


@query("""SELECT o_custkey AS value, count(*) AS n_rows FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') GROUP BY 1""")
def fk_orphans(spark, d):
    return catalog.orphans(_t(spark, d, "orders"), "o_custkey", _t(spark, d, "customer").where("c_mktsegment <> 'BUILDING'"), "c_custkey")


@query(" UNION ALL ".join(f"""SELECT '{k.table}' AS child, '{k.column}' AS child_column, '{k.parent}' AS parent, count(DISTINCT {k.column}) AS orphan_values, count({k.column}) AS orphan_rows
FROM {k.table} WHERE {k.column} NOT IN (SELECT {k.parent_column} FROM {k.parent})""" for k in catalog.STAR.foreign))
def fk_violations(spark, d):
    return catalog.violations(catalog.STAR, catalog.load(spark, d, STAR_TABLES))


_ALERTED = " UNION ALL ".join(f"""SELECT '{c}' AS "column", cast({c} AS VARCHAR) AS v FROM c""" for c in ("c_custkey", "k", "s", "d"))


@query(f"""WITH c AS (SELECT c_custkey, c_custkey // 2 AS k, 'on' AS s, CASE WHEN c_custkey % 5 = 4 THEN 'n/a' ELSE cast(c_custkey AS VARCHAR) END AS d FROM customer),
f AS (SELECT "column", count(*) AS n, count(DISTINCT v) AS u, avg(regexp_full_match(v, '\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*')::INT) FILTER (WHERE v <> '') AS share, count(*) FILTER (WHERE v <> '') AS seen FROM ({_ALERTED}) GROUP BY 1)
SELECT 'c' AS "table", "column", 'duplicate_key' AS alert, 'high' AS severity FROM f WHERE "column" IN ('c_custkey', 'k') AND u < n
UNION ALL SELECT 'c', "column", 'constant', 'medium' FROM f WHERE u = 1 AND n >= 2
UNION ALL SELECT 'c', "column", 'type_drift', 'high' FROM f WHERE seen >= 4 AND share >= 0.5 AND share < 1""")
def quality_alerts(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", F.floor(F.col("c_custkey") / 2).alias("k"), F.lit("on").alias("s"), F.when(F.col("c_custkey") % 5 == 4, "n/a").otherwise(F.col("c_custkey").cast("string")).alias("d"))
    return profile.quality_alerts(c, "c", ("c_custkey", "k"))


DATES = """CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%Y%m%d')
WHEN 3 THEN replace(strftime(o_orderdate, '%Y-%m-%d'), '-0', '-1') ELSE '2999' || strftime(o_orderdate, '-%m-%d') END"""


def _dates(spark, d) -> DataFrame:
    o, k, day = _t(spark, d, "orders"), F.col("o_orderkey") % 5, lambda f: F.date_format("o_orderdate", f)
    text = F.when(k == 0, day("yyyy-MM-dd")).when(k == 1, day("dd/MM/yyyy")).when(k == 2, day("yyyyMMdd")).when(k == 3, F.replace(day("yyyy-MM-dd"), F.lit("-0"), F.lit("-1"))).otherwise(F.concat(F.lit("2999"), day("-MM-dd")))
    return o.select("o_orderkey", text.alias("v"))


_PARTS = f"""WITH t AS (SELECT o_orderkey, {DATES} AS v FROM orders),
p AS (SELECT o_orderkey, v, CASE WHEN v LIKE '%-%' THEN 'iso' WHEN v LIKE '%/%' THEN 'day_first' ELSE 'compact' END AS format,
CASE WHEN v LIKE '%-%' THEN v[6:7] WHEN v LIKE '%/%' THEN v[4:5] ELSE v[5:6] END::INT AS m, CASE WHEN v LIKE '%-%' THEN v[9:10] WHEN v LIKE '%/%' THEN v[1:2] ELSE v[7:8] END::INT AS dd,
CASE WHEN v LIKE '%/%' THEN v[7:10] ELSE v[1:4] END::INT AS y FROM t),
q AS (SELECT *, CASE WHEN m BETWEEN 1 AND 12 AND try_cast(printf('%04d-%02d-%02d', y, m, dd) AS DATE) IS NOT NULL THEN CASE WHEN y > 2100 THEN 'suspicious' END ELSE 'impossible' END AS problem FROM p)
"""


@query(_PARTS + """SELECT 'v' AS "column", count(*) AS n_dates, count(DISTINCT format) AS formats, count(*) FILTER (WHERE problem = 'impossible') AS impossible,
count(*) FILTER (WHERE problem = 'suspicious') AS suspicious, count(DISTINCT format) > 1 AS mixed FROM q""")
def date_checks(spark, d):
    return profile.date_checks(_dates(spark, d), ["v"])


@query(_PARTS + "SELECT format, problem, count(*) AS n FROM q GROUP BY 1, 2")
def date_format_mix(spark, d):
    return _dates(spark, d).groupBy(date_format(F.col("v")).alias("format"), date_problem(F.col("v")).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


# Shaping ---------------------------------------------------------------------------------------

@query("""SELECT l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate, o_orderstatus AS orders_o_orderstatus, p_name AS part_p_name, s_name AS supplier_s_name
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey""")
def star_flatten(spark, d):
    return flatten.star_flatten(catalog.load(spark, d, STAR_TABLES), catalog.STAR)[1]


@query("SELECT 'customer' AS t, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def schema_level_chain(spark, d):
    shaped = shaper.shape(catalog.load(spark, d, STAR_TABLES), catalog.STAR, shaper.ShapeRequest(level="chain")).tables
    out = [df.agg(F.lit(t).alias("t"), F.count(F.lit(1)).alias("n")) for t, df in shaped.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('42:' || o_orderkey) LIMIT 500")
def sample_exact_n(spark, d):
    return sampling.sample_exact(_t(spark, d, "orders"), 500, ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('7:' || o_orderkey) LIMIT (SELECT round_even(count(*) * 0.1, 0)::BIGINT FROM orders)")
def sample_fraction(spark, d):
    return sampling.sample_exact(_t(spark, d, "orders"), 0.1, ["o_orderkey"], seed=7).select("o_orderkey", "o_custkey")


_ALLOCATION = """g AS (SELECT o_orderpriority AS g, count(*) AS pop FROM orders GROUP BY 1),
s AS (SELECT g, pop, least(greatest(round_even(1000 * pop / sum(pop) OVER (), 0), 1), pop) AS share FROM g),
r AS (SELECT *, 1000 - sum(share) OVER () AS rest, row_number() OVER (ORDER BY pop DESC, g) AS k FROM s),
a AS (SELECT g, (share + CASE WHEN k <= abs(rest) THEN sign(rest) ELSE 0 END)::BIGINT AS quota FROM r)"""


@query(f"""WITH {_ALLOCATION}, o AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42:' || o_orderkey)) AS n FROM orders)
SELECT o_orderkey, o_orderpriority FROM o JOIN a ON g = o_orderpriority WHERE n <= quota""")
def sample_stratified(spark, d):
    return sampling.sample_stratified(_t(spark, d, "orders"), 1000, "o_orderpriority", ["o_orderkey"]).select("o_orderkey", "o_orderpriority")


@query("""WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem ORDER BY md5('42:' || l_orderkey || ':' || l_partkey || ':' || l_suppkey || ':' || l_linenumber), l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 300),
o AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM l)), c AS (SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM o)),
s AS (SELECT * FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM l)), n AS (SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c UNION SELECT s_nationkey FROM s))
SELECT 'lineitem' AS t, count(*) AS n FROM l UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'customer', count(*) FROM c UNION ALL SELECT 'supplier', count(*) FROM s
UNION ALL SELECT 'part', count(*) FROM part WHERE p_partkey IN (SELECT l_partkey FROM l) UNION ALL SELECT 'nation', count(*) FROM n UNION ALL SELECT 'region', count(*) FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM n)""")
def sample_fk_preserving(spark, d):
    got = sampling.sample_with_references(catalog.load(spark, d, STAR_TABLES), catalog.STAR, 300, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])
    out = None
    for t, df in got.items():
        one = df.agg(F.lit(t).alias("t"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


_RARITY = """SELECT p_partkey, round(-log2(count(*) OVER (PARTITION BY p_brand) / n) - log2(count(*) OVER (PARTITION BY p_type) / n), 4) AS rarity FROM part, (SELECT count(*) AS n FROM part)"""


@query(_RARITY)
def rarity_scores(spark, d):
    return sampling.rarity(_t(spark, d, "part"), ["p_brand", "p_type"]).select("p_partkey", "rarity")


@query(f"""WITH r AS ({_RARITY}), s AS (SELECT rarity, row_number() OVER (ORDER BY rarity) - 1 AS k, count(*) OVER () AS n FROM r),
t AS (SELECT min(rarity) FILTER (WHERE k = round_even(0.5 * n, 0)) AS low, min(rarity) FILTER (WHERE k = round_even(0.75 * n, 0)) AS high FROM s)
SELECT p_partkey, rarity FROM r, t WHERE rarity BETWEEN low AND high""")
def rarity_band(spark, d):
    return sampling.rarity_band(_t(spark, d, "part").select("p_partkey", "p_brand", "p_type"), ["p_brand", "p_type"], 0.5, 0.75).select("p_partkey", "rarity")


_SAMPLE = "SELECT * FROM orders ORDER BY md5('42:' || o_orderkey) LIMIT 500"
_SHARES = f"""WITH s AS ({_SAMPLE}), p AS (SELECT o_orderpriority AS v, count(*) / (SELECT count(*) FROM orders) AS x FROM orders GROUP BY 1),
q AS (SELECT o_orderpriority AS v, count(*) AS m, count(*) / 500 AS y FROM s GROUP BY 1), b AS (SELECT coalesce(x, 0) AS x, coalesce(y, 0) AS y, coalesce(m, 0) AS m FROM p FULL JOIN q USING (v))
"""


@query(_SHARES + """SELECT round(sum(abs(x - y)) / 2, 4) AS tvd, round(sum(CASE WHEN x > 0 THEN x * log2(x / ((x + y) / 2)) ELSE 0 END + CASE WHEN y > 0 THEN y * log2(y / ((x + y) / 2)) ELSE 0 END) / 2, 4) AS jsd,
round(sqrt(sum((sqrt(x) - sqrt(y)) ** 2)) / sqrt(2), 4) AS hellinger, count(*) FILTER (WHERE x > 0) AS groups, bool_or(x * 500 < 5) AS low_expected FROM b""")
def stratify_metrics(spark, d):
    o = _t(spark, d, "orders")
    return sampling.distances(o, sampling.sample_exact(o, 500, ["o_orderkey"]), "o_orderpriority").drop("chi2")


@query(_SHARES + "SELECT round(sum((m - x * 500) ** 2 / (x * 500)), 4) AS chi2, count(*) - 1 AS freedom FROM b")
def chi2_statistic(spark, d):
    o = _t(spark, d, "orders")
    return sampling.distances(o, sampling.sample_exact(o, 500, ["o_orderkey"]), "o_orderpriority").select("chi2", (F.col("groups") - 1).alias("freedom"))


@query("""WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT a, sum(n) AS na FROM c GROUP BY 1), k AS (SELECT b, sum(n) AS nb FROM c GROUP BY 1)
SELECT round(sum((coalesce(n, 0) - na * nb / t) ** 2 / (na * nb / t)), 4) AS chi2, ((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM k) - 1) AS freedom
FROM r CROSS JOIN k LEFT JOIN c USING (a, b), (SELECT sum(n)::DOUBLE AS t FROM c)""")
def chi2_independence(spark, d):
    return sampling.independence(_t(spark, d, "orders"), "o_orderstatus", "o_orderpriority").select(F.round("chi2", 4).alias("chi2"), "freedom")


@query("""WITH c AS (SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS s, count(*) AS n, 1.959963984540054 AS z FROM orders GROUP BY 1)
SELECT o_orderpriority, round((s / n + z * z / (2 * n) - z * sqrt(s / n * (1 - s / n) / n + z * z / (4 * n * n))) / (1 + z * z / n), 4) AS low,
round((s / n + z * z / (2 * n) + z * sqrt(s / n * (1 - s / n) / n + z * z / (4 * n * n))) / (1 + z * z / n), 4) AS high FROM c""")
def wilson_ci(spark, d):
    g = _t(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("s"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("w", wilson(F.col("s"), F.col("n"))).select("o_orderpriority", F.round("w.low", 4).alias("low"), F.round("w.high", 4).alias("high"))


@query("""WITH b AS (SELECT p_brand AS value, row_number() OVER (ORDER BY p_brand) AS id FROM (SELECT DISTINCT p_brand FROM part)) SELECT p_partkey, id AS p_brand_id, value FROM part JOIN b ON p_brand = value""")
def normalize_dims(spark, d):
    values, slim = sampling.normalize(_t(spark, d, "part").select("p_partkey", "p_brand"), "p_brand")
    return slim.join(values, slim["p_brand_id"] == values["id"]).select("p_partkey", "p_brand_id", "value")


@query("SELECT o_orderkey, coalesce(c_name, cast(o_custkey AS VARCHAR)) AS who FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey")
def lookup_with_fallback(spark, d):
    c = _t(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return flatten.lookup_name(_t(spark, d, "orders"), "o_custkey", c, "c_custkey", "c_name", "who").select("o_orderkey", "who")


# Encodings -------------------------------------------------------------------------------------

_FIRST = """WITH r AS (SELECT o_orderpriority AS value, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders),
c AS (SELECT value, row_number() OVER (ORDER BY min(p)) - 1 AS code FROM r GROUP BY value)
"""


@query(_FIRST + "SELECT value, code, chr((33 + code)::INT) AS symbol FROM c")
def dict_encode(spark, d):
    return encode.dictionary_encode(_t(spark, d, "orders"), "o_orderpriority", ["o_orderkey"])[0]


@query("SELECT o_orderpriority AS value, row_number() OVER (ORDER BY o_orderkey) - 1 AS _pos FROM orders")
def dict_roundtrip(spark, d):
    return encode.dictionary_decode(*encode.dictionary_encode(_t(spark, d, "orders"), "o_orderpriority", ["o_orderkey"]))


_ISLANDS = """WITH r AS (SELECT o_orderstatus AS value, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders),
h AS (SELECT *, sum(CASE WHEN value IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (ORDER BY p) AS run FROM (SELECT *, lag(value) OVER (ORDER BY p) AS prev FROM r))
"""


@query(_ISLANDS + 'SELECT value, min(p) AS "start", count(*) AS length FROM h GROUP BY run, value')
def rle_runs(spark, d):
    return encode.run_lengths(_t(spark, d, "orders"), "o_orderstatus", ["o_orderkey"])


@query("SELECT o_orderstatus AS value, row_number() OVER (ORDER BY o_orderkey) - 1 AS _pos FROM orders")
def rle_roundtrip(spark, d):
    return encode.expand_runs(encode.run_lengths(_t(spark, d, "orders"), "o_orderstatus", ["o_orderkey"]))


_DELTAS = """WITH r AS (SELECT o_custkey AS v, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders), s AS (SELECT *, v - lag(v) OVER (ORDER BY p) AS delta FROM r),
h AS (SELECT *, sum(CASE WHEN p = 0 OR delta IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (ORDER BY p) AS run FROM (SELECT *, lag(delta) OVER (ORDER BY p) AS before FROM s))
"""


@query(_DELTAS + 'SELECT min(p) AS "start", arg_min(v, p) AS value, delta, count(*) AS length FROM h GROUP BY run, delta')
def delta_runs(spark, d):
    return encode.delta_runs(_t(spark, d, "orders"), "o_custkey", ["o_orderkey"])


@query("SELECT o_custkey AS value, row_number() OVER (ORDER BY o_orderkey) - 1 AS _pos FROM orders")
def delta_roundtrip(spark, d):
    return encode.expand_deltas(encode.delta_runs(_t(spark, d, "orders"), "o_custkey", ["o_orderkey"]))


def _day_text(spark, d) -> DataFrame:
    return _t(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("""WITH g AS (SELECT regexp_replace(v, '[0-9]+', '0', 'g') AS template, regexp_extract_all(v, '[0-9]+') AS gs FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') AS v FROM orders)),
y AS (SELECT template, k, count(DISTINCT x) > 1 AS varies FROM (SELECT template, unnest(gs) AS x, generate_subscripts(gs, 1) AS k FROM g) GROUP BY ALL)
SELECT template, count(*) AS n_rows, max(len(gs)) AS n_groups, (SELECT count(*) FROM y WHERE varies AND y.template = g.template) AS n_varying FROM g GROUP BY template""")
def split_template(spark, d):
    return encode.split_template(_day_text(spark, d), "day")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def split_roundtrip(spark, d):
    return encode.merge_columns(encode.split_columns(_day_text(spark, d), "day", 3).select("o_orderkey", "template", "g0", "g1", "g2"), 3, "day")


def _advice_sql(table: str, columns: list[str]) -> str:
    one = """SELECT '{c}' AS "column", sum(n)::BIGINT AS n_rows, count(*) AS n_unique, sum((strlen(v) + 1) * n)::BIGINT AS raw_bytes,
CASE WHEN count(*) >= 2 AND count(*) < sum(n) THEN sum(strlen(v) + 1) + sum(n) * CASE WHEN count(*) <= 94 THEN 1 WHEN count(*) <= 8836 THEN 2 WHEN count(*) <= 830584 THEN 3 ELSE 4 END END::BIGINT AS dictionary_bytes
FROM (SELECT coalesce(cast({c} AS VARCHAR), '') AS v, count(*) AS n FROM {t} GROUP BY 1)"""
    inner = " UNION ALL ".join(one.format(c=c, t=table) for c in columns)
    return f"SELECT *, CASE WHEN dictionary_bytes < raw_bytes THEN 'dictionary' ELSE 'raw' END AS advice FROM ({inner})"


@query(_advice_sql("orders", PROFILED))
def encoding_advice(spark, d):
    return encode.encoding_advice(_t(spark, d, "orders"), PROFILED)


@query("""WITH f AS (SELECT * FROM (""" + _features_sql("orders", PROFILED) + """))
SELECT "column", CASE WHEN n_rows < 100 OR cardinality < 0.2 THEN 3 WHEN avg_len >= 25 THEN 6 WHEN avg_len >= 8 AND cardinality >= 0.4 THEN 6 WHEN avg_len >= 5 AND is_numeric AND cardinality >= 0.8 THEN 6
WHEN avg_len >= 12 AND cardinality >= 0.7 THEN 5 WHEN avg_len >= 3 AND cardinality >= 0.2 THEN 4 ELSE 3 END AS min_len FROM f""")
def affix_min_length(spark, d):
    f = profile.features(_t(spark, d, "orders"), PROFILED)
    return f.select("column", min_length_rule(F.col("n_rows"), F.col("avg_len"), F.col("cardinality"), F.col("is_numeric")).alias("min_len"))


@query("""SELECT p_partkey, p_partkey // 94 % 94 * 94 + p_partkey % 94 AS back, regexp_replace(p_brand, '[0-9]+', '0', 'g') AS template, p_brand AS again,
regexp_replace(p_brand, '[0-9]+', '') || (regexp_extract(p_brand, '[0-9]+')::INT + 1) AS next FROM part""")
def text_codes(spark, d):
    p = _t(spark, d, "part")
    b = F.col("p_brand")
    return p.select("p_partkey", decode_index(encode_index(F.col("p_partkey"), 2), 2).alias("back"), template(b).alias("template"), fill_template(template(b), digit_groups(b)).alias("again"), shift_digits(b, F.lit(1)).alias("next"))


@query("""SELECT n_name, r_name, coalesce(list_position(list_transform(range(1, least(length(n_name), length(r_name)) + 1), lambda i: n_name[i] = r_name[i]), false) - 1, least(length(n_name), length(r_name)))::BIGINT AS prefix,
coalesce(list_position(list_transform(range(1, least(length(n_name), length(r_name)) + 1), lambda i: reverse(n_name)[i] = reverse(r_name)[i]), false) - 1, least(length(n_name), length(r_name)))::BIGINT AS suffix
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def common_affixes(spark, d):
    both = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    a, b = F.col("n_name"), F.col("r_name")
    return both.select("n_name", "r_name", common_prefix(a, b).cast("long").alias("prefix"), common_suffix(a, b).cast("long").alias("suffix"))


# Identifiers -----------------------------------------------------------------------------------

def _check_sql(weights: tuple[int, ...], text: str) -> str:
    return "(" + " + ".join(f"{text}[{k + 1}]::INT * {w}" for k, w in enumerate(weights)) + ")"


_CPF = f"""WITH b AS (SELECT c_custkey, printf('%09d', c_custkey * 7919 % 1000000000) AS b FROM customer),
x AS (SELECT *, {_check_sql(tuple(range(10, 1, -1)), 'b')} * 10 % 11 % 10 AS d1 FROM b), y AS (SELECT *, ({_check_sql(tuple(range(11, 2, -1)), 'b')} + d1 * 2) * 10 % 11 % 10 AS d2 FROM x)
SELECT c_custkey, b[1:3] || '.' || b[4:6] || '.' || b[7:9] || '-' || d1 || d2 AS id, 'compressible' AS class, b[1:3] || '.' || b[4:6] || '.' || b[7:9] || '-' || d1 || d2 AS back, 5::BIGINT AS size FROM y"""


@query(_CPF)
def nature_cpf(spark, d):
    body = F.lpad((F.col("c_custkey") * 7919 % 1000000000).cast("string"), 9, "0")
    raw = F.concat(body, cpf_digits(body))
    ident = F.concat(raw.substr(1, 3), F.lit("."), raw.substr(4, 3), F.lit("."), raw.substr(7, 3), F.lit("-"), raw.substr(10, 2))
    ids = _t(spark, d, "customer").select("c_custkey", ident.alias("id"))
    return ids.select("c_custkey", "id", CPF.classify(F.col("id")).alias("class"), CPF.decode(CPF.encode(F.col("id"))).alias("back"), F.length(CPF.encode(F.col("id"))).cast("long").alias("size"))


_CNPJ = f"""WITH b AS (SELECT s_suppkey, printf('%012d', s_suppkey * 104729 + 11222333000100) AS b FROM supplier),
x AS (SELECT *, {_check_sql((5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2), 'b')} % 11 AS r1 FROM (SELECT s_suppkey, b[1:12] AS b FROM b)), y AS (SELECT *, CASE WHEN r1 < 2 THEN 0 ELSE 11 - r1 END AS d1 FROM x),
z AS (SELECT *, ({_check_sql((6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3), 'b')} + d1 * 2) % 11 AS r2 FROM y)
SELECT s_suppkey, b[1:2] || '.' || b[3:5] || '.' || b[6:8] || '/' || b[9:12] || '-' || d1 || CASE WHEN r2 < 2 THEN 0 ELSE 11 - r2 END AS back, 'compressible' AS class FROM z"""


@query(_CNPJ)
def nature_cnpj(spark, d):
    body = F.substring(F.lpad((F.col("s_suppkey") * 104729 + 11222333000100).cast("string"), 12, "0"), 1, 12)
    raw = F.concat(body, cnpj_digits(body))
    ident = F.concat(raw.substr(1, 2), F.lit("."), raw.substr(3, 3), F.lit("."), raw.substr(6, 3), F.lit("/"), raw.substr(9, 4), F.lit("-"), raw.substr(13, 2))
    ids = _t(spark, d, "supplier").select("s_suppkey", ident.alias("id"))
    return ids.select("s_suppkey", CNPJ.decode(CNPJ.encode(F.col("id"))).alias("back"), CNPJ.classify(F.col("id")).alias("class"))


@query("""WITH i AS (SELECT event_id, CASE event_id % 13 WHEN 0 THEN '' WHEN 1 THEN '10.' || event_id || '000.1.1' WHEN 2 THEN '1.2.3' ELSE
'10.' || user_id % 256 || '.' || CASE WHEN event_id % 7 = 0 THEN lpad(cast(event_id % 200 AS VARCHAR), 3, '0') ELSE cast(event_id % 200 AS VARCHAR) END || '.1' END AS ip FROM events),
c AS (SELECT *, CASE WHEN ip = '' THEN 'empty_value' WHEN NOT regexp_full_match(ip, '[0-9]{1,3}(\\.[0-9]{1,3}){3}') THEN 'format_mismatch' WHEN regexp_matches(ip, '(^|\\.)0[0-9]') THEN 'format_padded_zeros' ELSE 'compressible' END AS class FROM i)
SELECT event_id, ip, class, ip AS back, CASE WHEN class = 'compressible' THEN 7 ELSE length(ip) + 1 END AS size FROM c""")
def nature_ipv4(spark, d):
    k, number = F.col("event_id"), (F.col("event_id") % 200).cast("string")
    usual = F.concat(F.lit("10."), (F.col("user_id") % 256).cast("string"), F.lit("."), F.when(k % 7 == 0, F.lpad(number, 3, "0")).otherwise(number), F.lit(".1"))
    ip = F.when(k % 13 == 0, "").when(k % 13 == 1, F.concat(F.lit("10."), k.cast("string"), F.lit("000.1.1"))).when(k % 13 == 2, "1.2.3").otherwise(usual)
    ids = _t(spark, d, "events").select("event_id", ip.alias("ip"))
    payload = IPV4.encode(F.col("ip"))
    return ids.select("event_id", "ip", IPV4.classify(F.col("ip")).alias("class"), IPV4.decode(payload).alias("back"), F.length(payload).cast("long").alias("size"))


@query("""SELECT CASE WHEN c_custkey % 4 = 0 THEN 'format_unmasked' WHEN c_custkey % 4 = 1 THEN 'empty_value' WHEN c_custkey % 4 = 2 THEN 'length_wrong' ELSE 'format_mismatch' END AS status, count(*) AS n FROM customer GROUP BY 1""")
def nature_apply_rate(spark, d):
    k = F.col("c_custkey") % 4
    v = F.when(k == 0, F.lpad(F.col("c_custkey").cast("string"), 11, "0")).when(k == 1, "").when(k == 2, "abc").otherwise("no number")
    return _t(spark, d, "customer").select(CPF.classify(v).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# Nested ----------------------------------------------------------------------------------------

def _nested(spark, d) -> DataFrame:
    """Customers with their orders; every seventh customer without any has null instead of an empty array."""
    o = nested.dealt(_t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("orders"))
    c = _t(spark, d, "customer").select("c_custkey", "c_name").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey")
    none = F.when(F.col("c_custkey") % 7 == 0, F.lit(None)).otherwise(F.array().cast(c.schema["orders"].dataType))
    return c.withColumn("orders", F.coalesce("orders", none))


_COUNTS = "SELECT c_custkey, c_name, CASE WHEN count(o_orderkey) = 0 AND c_custkey % 7 = 0 THEN NULL ELSE count(o_orderkey) END AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2"


@query(_COUNTS)
def nested_counts(spark, d):
    return nested.shred(_nested(spark, d), "c_custkey", "orders")[0].select("c_custkey", "c_name", F.col("orders_count").cast("long").alias("n"))


@query(f"SELECT count(*) AS records, count(*) FILTER (WHERE n IS NULL) AS null_arrays, count(*) FILTER (WHERE n = 0) AS empty_arrays, sum(n)::BIGINT AS elements, max(n) AS most FROM ({_COUNTS})")
def nested_stats(spark, d):
    return nested.record_stats(_nested(spark, d), "orders")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN '-' WHEN 1 THEN '0' ELSE '.' END AS mask FROM events")
def nested_mask(spark, d):
    k = F.col("event_id") % 3
    text = F.when(k == 0, '{"a": 1}').when(k == 1, '{"v": null}').otherwise(F.concat(F.lit('{"v": '), F.col("event_id").cast("string"), F.lit("}")))
    return _t(spark, d, "events").select("event_id", nested.presence(text, "v").alias("mask"))


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT c_custkey, NULL, CASE WHEN c_custkey % 7 = 0 THEN 'null' ELSE 'empty' END FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def nested_roundtrip(spark, d):
    back = nested.assemble(*nested.shred(_nested(spark, d), "c_custkey", "orders"), "c_custkey", "orders")
    flat = back.select(F.col("c_custkey").alias("o_custkey"), F.explode("orders").alias("o")).select("o_custkey", "o.o_orderkey", "o.o_orderstatus")
    none = back.where("orders IS NULL OR size(orders) = 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(None).cast("long").alias("o_orderkey"), F.when(F.col("orders").isNull(), "null").otherwise("empty").alias("o_orderstatus"))
    return flat.unionByName(none)


@query("SELECT event_id, cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return _t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# The workload ----------------------------------------------------------------------------------

def _star(spark, d) -> workload.Star:
    return workload.star(_t(spark, d, "lineitem"), "l_suppkey", "l_partkey", "l_extendedprice", "l_shipdate", _t(spark, d, "supplier"), "s_suppkey", "s_name", _t(spark, d, "part"), "p_partkey", "p_name")


_TOP = "SELECT {k} FROM lineitem GROUP BY 1 ORDER BY {by} DESC, 1 LIMIT 1"
_STAR_SQL = {
    "q01_count": "SELECT count(*) AS answer FROM lineitem",
    "q02_top_e2": f"SELECT p_name AS answer FROM part WHERE p_partkey = ({_TOP.format(k='l_partkey', by='count(*)')})",
    "q03_distinct_e1": "SELECT count(DISTINCT l_suppkey) AS answer FROM lineitem",
    "q04_sum": "SELECT round(sum(l_extendedprice::DECIMAL(18,2))::DOUBLE, 2) AS answer FROM lineitem",
    "q05_e1_of_max": "SELECT s_name AS answer FROM supplier WHERE s_suppkey = (SELECT l_suppkey FROM lineitem ORDER BY l_extendedprice DESC, l_suppkey LIMIT 1)",
    "q06_max": "SELECT max(l_extendedprice::DECIMAL(18,2))::DOUBLE AS answer FROM lineitem",
    "q07_mean_of_all": "SELECT round(sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / count(*), 2) AS answer FROM lineitem",
    "q08_sum_in_top_month": "SELECT round(sum(l_extendedprice::DECIMAL(18,2))::DOUBLE, 2) AS answer FROM lineitem WHERE strftime(l_shipdate, '%Y-%m') = (SELECT strftime(l_shipdate, '%Y-%m') FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)",
    "q09_rows_of_top_e1": f"SELECT count(*) AS answer FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_name = (SELECT s_name FROM supplier WHERE s_suppkey = ({_TOP.format(k='l_suppkey', by='count(*)')}))",
    "q10_busy_e1": "WITH p AS (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey) SELECT count(*) AS answer FROM p WHERE n > (SELECT greatest(1, floor(avg(n))) FROM p)",
    "q11_e2_of_max_sum": f"SELECT p_name AS answer FROM part WHERE p_partkey = ({_TOP.format(k='l_partkey', by='sum(l_extendedprice::DECIMAL(18,2))')})",
    "q12_e1_above_mean_sum": "WITH p AS (SELECT sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS m FROM lineitem GROUP BY l_suppkey) SELECT count(*) AS answer FROM p WHERE m > (SELECT avg(m) FROM p)",
    "q13_e2_of_top_e1": f"SELECT p_name AS answer FROM part WHERE p_partkey = (SELECT l_partkey FROM lineitem WHERE l_suppkey = ({_TOP.format(k='l_suppkey', by='count(*)')}) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)",
    "q14_e2_most_e1": f"SELECT p_name AS answer FROM part WHERE p_partkey = ({_TOP.format(k='l_partkey', by='count(DISTINCT l_suppkey)')})",
}
for _name, _ask in workload.STAR_QUESTIONS.items():
    QUERIES[_name] = lambda spark, d, ask=_ask: ask(_star(spark, d))
    SQL[_name] = _STAR_SQL[_name]

_TABLE_SQL = {
    "q15_count": "SELECT count(*) AS answer FROM customer",
    "q16_mean": "SELECT round(avg(c_acctbal), 2) AS answer FROM customer",
    "q17_max": "SELECT round(max(c_acctbal), 2) AS answer FROM customer",
    "q18_distinct": "SELECT count(DISTINCT c_nationkey) AS answer FROM customer",
    "q19_top_group": "SELECT c_mktsegment AS answer FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1",
    "q20_count_label": "SELECT count(*) AS answer FROM customer WHERE c_mktsegment = 'BUILDING'",
    "q21_mean_where": "SELECT round(avg(c_acctbal), 2) AS answer FROM customer WHERE c_mktsegment = 'MACHINERY'",
}
for _name in _TABLE_SQL:
    QUERIES[_name] = lambda spark, d, n=_name: workload.table_questions(_t(spark, d, "customer"), "c_acctbal", "c_mktsegment", "c_nationkey", "c_mktsegment", "BUILDING", "MACHINERY")[n]()
    SQL[_name] = _TABLE_SQL[_name]


@query("""SELECT tier, count(*) AS n FROM (SELECT CASE WHEN e <= 0.01 THEN 'T1' WHEN e <= 0.05 THEN 'T2' WHEN e <= 0.15 THEN 'T3' WHEN e <= 0.5 THEN 'T4' ELSE 'T5' END AS tier
FROM (SELECT o_orderkey % 100 / 100 AS e FROM orders)) GROUP BY 1""")
def accuracy_tiers(spark, d):
    said = F.concat(F.lit("about 7, so "), (F.lit(100) + F.col("o_orderkey") % 100).cast("string"))
    return _t(spark, d, "orders").select(workload.accuracy_tier(workload.last_number(said), F.lit(100.0)).alias("tier")).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1")
def first_of_key(spark, d):
    return workload.first_by_key(_t(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id")


# Text formats and streams ----------------------------------------------------------------------

@query("SELECT '  ' || n_nationkey || ',' || n_name || ',' || n_regionkey AS value FROM nation")
def toon_rows(spark, d):
    return files.toon_rows(_t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"))


@query("""SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def event_windows(spark, d):
    w = streams.windowed(_t(spark, d, "events"), "1 hour")
    return w.select(F.unix_micros("start").alias("start_us"), "event_type", "n", "total")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new, event_id FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM e) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, s""")
def event_sessions(spark, d):
    return streams.sessions(_t(spark, d, "events"), "30 minutes").select("user_id", F.unix_micros("start").alias("start_us"), "n")


from millrace import more_queries  # noqa: E402, F401  they register themselves
