"""Operators of the library on small tables, among them the odd ones."""

import random
import re
from collections import Counter

import pytest
from millrace.functions import dates, identifiers, statistics, texts
from millrace.functions.numbers import coerce, numeric, strict_double
from millrace.operators import encode, flatten, nested, profile, sampling
from millrace.operators.view import TableView, reorder, top_values, value_runs
from millrace.plans import reports, shaper, workload
from millrace.sources import catalog, files
from millrace.storage import materialize, ranked, scratch, with_previous
from millrace.streaming import events
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def view_table(spark):
    rows = [("Ana", "Sao Paulo", "Premium", "100"), ("Bia", "Sao Paulo", "Premium", "200"), ("Caio", "Rio de Janeiro", "Basico", "200"), ("Davi", "Sao Paulo", "Basico", "80"),
            ("Eva", "Rio de Janeiro", "Premium", "80"), ("Fabio", "Sao Paulo", "Premium", "90")]
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "pos int, cliente string, cidade string, plano string, valor string")


def test_view_aggregates(view_table):
    v = TableView(view_table, ["pos"])
    assert (v.count(), v.sum("valor"), v.min("valor"), v.max("valor"), v.avg("valor")) == (6, 750, 80, 200, 125)
    sp = v.where("cidade", "Sao Paulo")
    assert (sp.count(), sp.sum("valor"), sp.avg("valor")) == (4, 470, 117.5)
    assert sp.where("plano", "Premium").sum("valor") == 390
    assert {r["value"]: r["n"] for r in v.group_count("cidade").collect()} == {"Sao Paulo": 4, "Rio de Janeiro": 2}
    assert v.where("cidade", None).count() == 0
    assert v.where("valor", pred=lambda c: c > "1").count() == 6
    assert len(v.select([]).columns) == 5
    with pytest.raises(KeyError):
        v.select(["nope"])
    with pytest.raises(KeyError):
        v.agg_by("cidade", "valor", "median")


def test_view_numbers_are_strict(spark, view_table):
    v = TableView(spark.createDataFrame([("10",), ("",), ("30",), (None,)], "v string"))
    assert v.sum("v") == 40 and v.avg("v") == 20
    with pytest.raises(Exception, match="not a number"):
        TableView(view_table).sum("cliente")
    none = v.where("v", "x")
    assert none.sum("v") == 0
    with pytest.raises(ValueError, match="no values"):
        none.min("v")
    got = spark.createDataFrame([(" 1e3 ",), ("inf",), ("-.5",), ("+7.",)], "v string").select(strict_double(F.col("v"))).collect()
    assert [r[0] for r in got] == [1000.0, float("inf"), -0.5, 7.0]
    for bad in ("1d", "1_000", "abc", "1e"):
        with pytest.raises(Exception, match="not a number"):
            spark.createDataFrame([(bad,)], "v string").select(strict_double(F.col("v"))).collect()


def test_view_ranges_and_runs(view_table):
    with pytest.raises(ValueError, match="comes back"):
        TableView(view_table, ["pos"]).group_ranges("cidade")
    got = TableView(view_table, ["cidade", "pos"]).group_ranges("cidade").collect()
    assert sorted((r["start"], r["end"], r["value"]) for r in got) == [(0, 2, "Rio de Janeiro"), (2, 6, "Sao Paulo")]
    assert {r["cidade"]: r["sum"] for r in TableView(view_table).agg_by("cidade", "valor", "sum").collect()} == {"Sao Paulo": 470, "Rio de Janeiro": 280}


def test_view_report_names_what_is_read(view_table, tmp_path):
    view_table.write.parquet(f"file://{tmp_path}/t")
    v = TableView(view_table.sparkSession.read.parquet(f"file://{tmp_path}/t")).where("cidade", "Sao Paulo")
    seen = TableView(v.aggregate("valor", "sum")).report()
    assert seen["columns"] == ["cidade", "valor"] and any("Sao Paulo" in f for f in seen["pushed"])


def test_orders_over_whole_tables(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([None, "a", "b"]), rng.randrange(5)) for k in range(200)]
    df = spark.createDataFrame(rows, "k int, v string, n int").repartition(5)
    assert [(r["k"], r["rank"], r["before"]) for r in ranked(df, [F.col("k")], "rank", {"before": "n"}).orderBy("k").collect()] == [(k, k, sum(r[2] for r in rows[:k])) for k in range(200)]
    seen = with_previous(df, [F.col("k")], ["v"]).orderBy("k").collect()
    assert [(r["_pos"], r["prev_v"]) for r in seen] == [(k, rows[k - 1][1] if k else None) for k in range(200)]
    runs = sorted((r["start"], r["length"], r["value"]) for r in value_runs(df, "v", ["k"]).collect())
    assert [v for s, n, v in runs for _ in range(n)] == [r[1] for r in rows] and all(a[2] != b[2] for a, b in zip(runs, runs[1:]))
    assert ranked(df.limit(0), [F.col("k")], "rank").count() == 0 and value_runs(df.limit(0), "v", ["k"]).count() == 0


def test_reorder(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a")], "k int, v string")
    keys = lambda how: [r["k"] for r in reorder(df, how, "k").collect()]
    assert keys("sorted:v") == [3, 1, 2] and keys("reverse:v") == [2, 1, 3] and keys("sorted:nope") == keys("natural") == [1, 2, 3]
    assert keys("random") == keys("random")
    assert [(r["value"], r["n"]) for r in top_values(df.union(df.limit(1)), "v", 1).collect()] == [("b", 2)]


def test_encodings_round_trip(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice(["x", "y", None, ""]), k * 3 if k % 20 < 15 else rng.randrange(9), f"2024-{k % 12 + 1:02d}-0{k % 9 + 1}") for k in range(150)]
    df = spark.createDataFrame(rows, "k int, v string, n bigint, day string")
    expected = {(k, r[1]) for k, r in enumerate(rows)}
    codes, coded = encode.dictionary_encode(df, "v", ["k"])
    assert {tuple(r) for r in encode.dictionary_decode(codes, coded).collect()} == expected
    first = list(dict.fromkeys(r[1] for r in rows))
    assert {r["value"]: r["code"] for r in codes.collect()} == {v: i for i, v in enumerate(first)}
    assert {tuple(r) for r in encode.expand_runs(encode.run_lengths(df, "v", ["k"])).collect()} == expected
    assert {tuple(r) for r in encode.expand_deltas(encode.delta_runs(df, "n", ["k"])).select("_pos", "value").collect()} == {(k, r[2]) for k, r in enumerate(rows)}
    found = encode.split_template(df, "day").collect()
    assert [(r["template"], r["n_rows"], r["n_groups"]) for r in found] == [("0-0-0", 150, 3)]
    assert encode.same_rows(encode.merge_columns(encode.split_columns(df, "day", 3), 3, "day").select(df.columns), df)
    assert encode.dictionary_encode(df.limit(1), "v", ["k"]) is None and encode.dictionary_encode(df, "k", ["k"]) is None


def test_stats_lines_of_more_rows_than_the_whole(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 4.0), (3, 9.0)], "a long, b double")
    few = {r["column"]: r["line"] for r in encode.stats_lines(df, ["a", "b"], 2).collect()}
    assert few == {"a": "# STATS a: n=3 sum=6 min=1 max=3 avg=2", "b": "# STATS b: n=3 sum=15 min=2 max=9 avg=5"}
    always = {r["column"]: r["line"] for r in encode.stats_lines(df, ["a", "b"], 2, always=True).collect()}
    assert always == {"a": few["a"] + " err=56.6% full_n=2", "b": few["b"] + " err=81.6% full_n=2"}
    assert always == {k: v.replace("full_n=9", "full_n=2") for k, v in ((r["column"], r["line"]) for r in encode.stats_lines(df, ["a", "b"], 9).collect())}


def test_text_functions(spark):
    df = spark.createDataFrame([("abc1x22", "abd"), ("", "a"), ("same", "same"), ("#1", "1#")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = df.select(texts.common_prefix(a, b), texts.common_suffix(a, b), texts.fill_template(texts.template(a), texts.digit_groups(a)), texts.shift_digits(a, F.lit(1))).collect()
    assert [tuple(r) for r in got] == [(2, 0, "abc1x22", "abc1x23"), (0, 0, "", ""), (4, 4, "same", "same"), (0, 0, "#1", "#2")]
    codes = spark.range(0, 94**2, 7).select("id", texts.encode_index(F.col("id"), 2).alias("c")).select("id", "c", texts.decode_index(F.col("c"), 2).alias("back")).collect()
    assert all(r["id"] == r["back"] and len(r["c"]) == 2 for r in codes) and texts.code_width(94) == 1 and texts.code_width(95) == 2
    assert spark.range(1).select(texts.escape_name(F.lit("!a,b=c:d\\e"))).first()[0] == "\\!a\\,b\\=c\\:d\\\\e"


def test_identifiers(spark):
    rows = ["529.982.247-25", "529.982.247-24", "52998224725", "", None, "abc", "something else"]
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    got = df.select(identifiers.CPF.classify(F.col("v")).alias("c"), identifiers.CPF.decode(identifiers.CPF.encode(F.col("v"))).alias("back")).collect()
    assert [r["c"] for r in got] == ["compressible", "check_invalid", "format_unmasked", "empty_value", "empty_value", "length_wrong", "format_mismatch"]
    assert [r["back"] for r in got] == [r or "" for r in rows]
    cnpj = spark.createDataFrame([("11.222.333/0001-81",), ("11.222.333/0001-80",)], "v string").select(identifiers.CNPJ.classify(F.col("v")).alias("c"), identifiers.CNPJ.decode(identifiers.CNPJ.encode(F.col("v"))).alias("b")).collect()
    assert [tuple(r) for r in cnpj] == [("compressible", "11.222.333/0001-81"), ("check_invalid", "11.222.333/0001-80")]
    ips = ["10.0.0.1", "999.1.1.1", "01.2.3.4", "1.2.3"]
    ip = spark.createDataFrame([(r,) for r in ips], "v string").select(identifiers.IPV4.classify(F.col("v")).alias("c"), identifiers.IPV4.decode(identifiers.IPV4.encode(F.col("v"))).alias("b")).collect()
    assert [r["c"] for r in ip] == ["compressible", "compressible", "format_padded_zeros", "format_mismatch"] and [r["b"] for r in ip] == ips
    assert len(set(identifiers.SYMBOLS)) == 64 and "_" not in identifiers.SYMBOLS
    own = identifiers.pattern_codec("plate", r"^A([0-9]{3})-([0-9]{2})$", (3, 2), lambda p: F.concat(F.lit("A"), p[0], F.lit("-"), p[1]), 3)
    back = spark.createDataFrame([("A012-07",), ("B1",)], "v string").select(own.classify(F.col("v")), own.decode(own.encode(F.col("v")))).collect()
    assert [tuple(r) for r in back] == [("compressible", "A012-07"), ("format_mismatch", "B1")]


def test_dates(spark):
    rows = {"2024-02-29": ("iso", None), "2023-02-29": ("iso", "impossible"), "31/12/2024": ("day_first", None), "12/31/2024": ("day_first", "impossible"), "1/2/2024 10:00": ("month_first", None),
            "20240230": ("compact", "impossible"), "2999-01-01": ("iso", "suspicious"), "hello": (None, None), "": (None, None)}
    df = spark.createDataFrame([(v,) for v in rows], "v string")
    got = df.select("v", dates.date_format(F.col("v")).alias("f"), dates.date_problem(F.col("v")).alias("p")).collect()
    assert {r["v"]: (r["f"], r["p"]) for r in got} == rows
    row = profile.date_checks(df, ["v"]).first()
    assert (row["n_dates"], row["formats"], row["impossible"], row["suspicious"], row["mixed"]) == (7, 4, 3, 1, True)
    assert profile.is_date_column(df, "v", ["v"])


def test_keys_and_alerts(spark):
    region = spark.createDataFrame([(k,) for k in range(5)], "r_regionkey int")
    nation = spark.createDataFrame([(k, k % 5) for k in range(25)], "n_nationkey int, n_regionkey int")
    customer = spark.createDataFrame([(k, k % 3) for k in range(1, 21)], "c_custkey int, c_x int")
    orders = spark.createDataFrame([(100 + k, k % 20 + 1 if k else 99) for k in range(60)], "o_orderkey int, o_custkey int")
    got = {(r["child_column"], r["parent_column"]): r for r in profile.key_candidates({"region": region, "nation": nation, "customer": customer, "orders": orders}, confidence=("high", "medium")).collect()}
    assert got["n_regionkey", "r_regionkey"]["confidence"] == "high" and got["o_custkey", "c_custkey"]["orphan_values"] == 1
    t = spark.createDataFrame([(min(k, 8), "on", str(k) if k % 5 else "x") for k in range(10)], "id int, status string, valor string")
    alerts = {(r["column"], r["alert"]) for r in profile.quality_alerts(t, "t", ("id",), order=["id"]).collect()}
    assert alerts == {("id", "duplicate_key"), ("status", "constant"), ("valor", "type_drift")}
    assert profile.report(catalog.STAR, {"t": t}).count() >= 2


def plain_allocation(population, size):
    """Shares rounded half to even, at least one and at most all, then the rest one by one to the largest, at most twice round."""
    total = sum(population.values())
    share = {k: min(max(round(size * n / total), 1), n) for k, n in population.items()}
    rest = size - sum(share.values())
    for k in sorted(sorted(population), key=lambda k: -population[k]) * 2:
        if rest > 0 and share[k] < population[k]:
            share[k], rest = share[k] + 1, rest - 1
        elif rest < 0 and share[k] > 1:
            share[k], rest = share[k] - 1, rest + 1
    return share


def test_sampling(spark, monkeypatch):
    df = spark.createDataFrame([(k, ["a", "b", "c", None][min(k % 10, 3)] if k % 10 < 4 else "a") for k in range(200)], "k int, g string")
    assert sampling.sample_exact(df, 30, ["k"]).count() == 30 and sampling.sample_exact(df, 0.25, ["k"]).count() == 50
    assert sampling.sample_exact(df, 0, ["k"]).count() == 0 and sampling.sample_exact(df, 900, ["k"]).count() == 200
    top = {r["k"] for r in sampling.sample_exact(df, 30, ["k"]).collect()}
    monkeypatch.setattr(sampling, "AT_ONCE", 10)
    assert {r["k"] for r in sampling.sample_exact(df, 30, ["k"]).collect()} == top and sampling.sample_exact(df, 900, ["k"]).count() == 200
    groups = Counter(r["g"] for r in sampling.sample_stratified(df, 20, "g", ["k"]).collect())
    assert groups == Counter({"a": 14, "b": 2, "c": 2, None: 2})
    quota = lambda population, size: {r["value"]: r["quota"] for r in sampling.allocate(spark.createDataFrame(list(population.items()), "value string, n bigint"), size).collect()}
    assert quota({"x": 1, "y": 1, "z": 1}, 1) == {"x": 1, "y": 1, "z": 1}
    assert sum(quota({str(k): 10 + k for k in range(7)}, 33).values()) == 33
    rng = random.Random(3)
    for size in (5, 40, 111):
        population = {str(k): rng.randrange(1, 60) for k in range(12)}
        assert quota(population, size) == plain_allocation(population, size)
    row = sampling.distances(df, df, "g").first()
    assert row["tvd"] == row["jsd"] == row["hellinger"] == row["chi2"] == 0
    assert sampling.fit_p_value(df, df, "g") == pytest.approx(1)


def test_statistics():
    assert statistics.chi2_p_value(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert statistics.chi2_p_value(20, 3) == pytest.approx(0.000169742435552826, rel=1e-6)
    assert statistics.normal_quantile(0.5) == 0 and statistics.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-6)
    assert statistics.serial_fraction(2, 4) == pytest.approx(1 / 3)


def test_references_and_shapes(spark):
    folder = "/root/testdata/sf0.001"
    tables = catalog.load(spark, folder, catalog.STAR.levels["full"])
    got = sampling.sample_with_references(tables, catalog.STAR, 20, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])
    assert got["lineitem"].count() == 20
    assert catalog.violations(catalog.STAR, got).agg(F.sum("orphan_values")).first()[0] == 0
    name, flat = flatten.star_flatten(tables, catalog.STAR)
    assert name == "lineitem" and flat.count() == tables["lineitem"].count() and "part_p_name" in flat.columns and "l_partkey" not in flat.columns
    out = shaper.shape(tables, catalog.STAR, shaper.ShapeRequest(level="core", volume=0.1, references=True, order="reverse:o_orderkey"))
    assert out.counts()["orders"] == 150 and set(out.tables) == {"customer", "orders"} and "customer has no column o_orderkey" in out.trace
    banded = shaper.shape(tables, catalog.STAR, shaper.ShapeRequest(level=("part",), rarity=(0.0, 0.5)))
    assert 0 < banded.counts()["part"] < 200
    with pytest.raises(ValueError, match="volume.*join"):
        shaper.shape(tables, catalog.STAR, shaper.ShapeRequest(volume=-1, join="other"))


def test_orders_are_gathered_in_all_parts_of_the_shuffle(spark, tmp_path):
    """Small parts aren't put together: what a task gathers doesn't depend on how well they compress."""
    from millrace import queries

    spark.range(1000).selectExpr("id AS o_orderkey", "id % 100 AS o_custkey", "'F' AS o_orderstatus").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(110).selectExpr("id AS c_custkey", "'c' AS c_name").write.parquet(f"{tmp_path}/customer.parquet")
    out = queries._nested(spark, str(tmp_path)).where("orders is not null and size(orders) > 0")
    assert out.withColumn("part", F.spark_partition_id()).select("part").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {(r["c_custkey"], len(r["orders"])) for r in out.collect()} == {(k, 10) for k in range(100)}


def test_nested_round_trip(spark):
    rows = [(1, [(1, "a"), None, (2, None)]), (2, []), (3, None), (4, [(5, "z")])]
    df = spark.createDataFrame(rows, "k int, items array<struct<x:int,y:string>>")
    assert {r["k"]: r["items"] for r in nested.assemble(*nested.shred(df, "k", "items"), "k", "items").collect()} == {r["k"]: r["items"] for r in df.collect()}
    flat = spark.createDataFrame([(1, [3, None]), (2, None)], "k int, v array<int>")
    assert {r["k"]: r["v"] for r in nested.assemble(*nested.shred(flat, "k", "v"), "k", "v").collect()} == {1: [3, None], 2: None}
    assert [r[0] for r in flat.select(nested.element_mask(F.col("v"))).collect()] == [".0", None]
    text = spark.createDataFrame([('{"a": 1}',), ('{"a": null, "b": "x"}',), ("{}",)], "t string")
    assert [r[0] for r in text.select(nested.presence(F.col("t"), "a")).collect()] == [".", "0", "-"]
    assert {f.name for f in nested.infer(text, "t")} == {"a", "b"}


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v,ok\n1,2.5,true\n3.0,NA,no\nx,?,\n")
    df = files.read_csv(spark, f"file://{tmp_path}/a.csv", {"id": "int", "v": "float", "ok": "bool"})
    assert [tuple(r) for r in df.collect()] == [(1, 2.5, True), (3, None, False), (None, None, None)]
    with pytest.raises(ValueError, match="header"):
        files.read_csv(spark, f"file://{tmp_path}/a.csv", {"id": "int"})
    t = spark.createDataFrame([(1, "a,b"), (2, None), (3, "x|y\nz")], "k int, s string")
    files.derive(t, "t", f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out/t.jsonl").count() == 3
    assert sorted(r[0] for r in files.toon_rows(t).collect()) == ['  1,"a,b"', "  2,null", '  3,"x|y\\nz"']
    assert files.markdown(t, 2).count("\n| ") == 2 and "first 2 rows" in files.markdown(t, 2) and files.toon_header(t, "t") == "t[3]{k,s}:"
    kinds = files.infer_kinds(spark.createDataFrame([("1", "1.5", "true", "x"), ("", "2", "false", "1")], "a string, b string, c string, d string"))
    assert kinds == {"a": "int", "b": "float", "c": "bool", "d": "string"}
    assert files.project_positions(t, {"j": (0, 1)}, "-").count() == 2
    assert spark.range(1).select(coerce(F.lit("None"), "date")).first()[0] is None and numeric(t, "k") is not None


def test_workload_scoring(spark):
    spark.createDataFrame([(1, 2.0), (2, 4.0)], "a int, b double").createOrReplaceTempView("points")
    assert workload.extract_sql("So:\n```sql\nSELECT 1;\n```") == "SELECT 1"
    assert workload.score_answer(spark, "SELECT count(*) FROM points", 2) and workload.score_answer(spark, "SELECT sum(b) FROM points", 6.1)
    assert not workload.score_answer(spark, "SELECT nope FROM points", 2) and workload.score_answer(spark, "SELECT 'SP'", "sp") and not workload.score_answer(spark, "SELECT 'ESP'", "sp")
    shape = workload.sql_structure(spark, "WITH x AS (SELECT a FROM points) SELECT count(*) FROM x", {"points"})
    assert shape["cte"] and shape["known_tables"] and shape["one_column"] and not shape["join"]
    df = spark.createDataFrame([(1, 5, "x"), (1, 2, "y"), (2, 1, "z")], "k int, line int, v string")
    assert {r["v"] for r in workload.first_by_key(df, ["k"], "line").collect()} == {"y", "z"} and {r["v"] for r in workload.first_by_key(df, ["k"], "line", last=True).collect()} == {"x", "z"}


def test_streams_agree_with_batches(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch.select("event_id", "ts", "user_id", "event_type", "value", "props").write.parquet(f"file://{tmp_path}/in")
    stream = events.windowed(events.read_events(spark, f"file://{tmp_path}/in"), "1 hour", late="400 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert encode.same_rows(spark.table("windows"), events.windowed(batch, "1 hour"))


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_runs_across_parts_and_batches(spark, batch):
    """Runs against plain loops: long ones over many parts, and nulls; with batches of a few rows."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rng = random.Random(7)
        for n in (0, 1, 2, 5, 90, 91):
            values = [x for _ in range(n) for x in [rng.choice([1, 1, 2, None])] * rng.randrange(1, 5)][:n]
            steady = [k * 2 if k % 30 < 22 else rng.randrange(5) for k in range(n)]
            df = spark.createDataFrame([(k, v, s) for k, (v, s) in enumerate(zip(values, steady))], "k int, v int, s bigint").repartition(3)
            expected = [(k, v) for k, v in enumerate(values) if not k or values[k - 1] != v]
            lengths = [b - a for a, b in zip([k for k, _ in expected], [*[k for k, _ in expected[1:]], n])]
            assert sorted(tuple(r) for r in value_runs(df, "v", ["k"]).collect()) == [(k, v, m) for (k, v), m in zip(expected, lengths)]
            deltas = [None, *[b - a for a, b in zip(steady, steady[1:])]][:n]
            heads = [k for k in range(n) if k < 2 or deltas[k] != deltas[k - 1]]
            expected = [(k, steady[k], deltas[k], m - k) for k, m in zip(heads, [*heads[1:], n])]
            assert sorted(map(tuple, encode.delta_runs(df, "s", ["k"]).collect()), key=lambda r: r[0]) == expected
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def plain_text_runs(texts):
    """Greedy: a run goes on while the steps of its groups of digits are those of its first two texts."""
    def step(a, b):
        if re.sub("[0-9]", "0", a) != re.sub("[0-9]", "0", b):
            return None
        d = [int(y) - int(x) for x, y in zip(re.findall("[0-9]+", a), re.findall("[0-9]+", b))]
        return d if len({x for x in d if x}) == 1 else None

    out, i = [], 0
    while i < len(texts):
        j, d = i, step(texts[i], texts[i + 1]) if i + 1 < len(texts) else None
        while d and j + 1 < len(texts) and step(texts[j], texts[j + 1]) == d:
            j += 1
        out.append((i, texts[i], d if j > i else None, j - i + 1))
        i = j + 1
    return out


def test_text_delta_runs(spark):
    rng = random.Random(5)
    texts_ = [f"a{k:03d}-b{(k * 2 if k % 9 < 5 else 7) % 90:02d}" if rng.random() < 0.9 else rng.choice(["x", "a1-b2", ""]) for k in range(120)]
    texts_ += ["n1", "n2", "n4", "n5", "n7", "n7", "n8", "m9", "m10", "m11"]
    df = spark.createDataFrame(list(enumerate(texts_)), "k int, v string")
    runs = encode.text_delta_runs(df, "v", ["k"])
    assert sorted(map(tuple, runs.collect())) == sorted(plain_text_runs(texts_))
    assert sorted(map(tuple, encode.expand_text_deltas(runs).collect())) == list(enumerate(texts_))


def test_view_of_positions_names_and_tests(spark, view_table, tmp_path):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, None)], "k int, v string")
    v = TableView(df, ["k"])
    assert v.without_names().columns == ["0", "1"] and [r["k"] for r in v.at(spark.createDataFrame([(0,), (2,), (2,), (9,)], "_pos int")).orderBy("k").collect()] == [1, 3]
    assert [r["k"] for r in v.where("v", test=lambda x: x == "").select(["k"]).collect()] == [2]
    broken = TableView(spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "k int, v string"), ["k"])
    with pytest.raises(ValueError, match="contiguous"):
        broken.agg_by("v", "k", "sum", contiguous=True)
    df.coalesce(1).write.parquet(f"file://{tmp_path}/t")
    import pyarrow.parquet as pq

    (name,) = tmp_path.glob("t/*.parquet")
    footer = pq.ParquetFile(name).metadata
    expected = {footer.row_group(0).column(c).path_in_schema: footer.row_group(0).column(c).total_compressed_size for c in range(2)}
    assert {c: TableView(spark.read.parquet(f"file://{tmp_path}/t")).column_bytes(c) for c in ("k", "v")} == expected


def test_nested_of_any_depth(spark):
    ddl = "k int, s struct<a:int,t:struct<b:string>>, x array<struct<p:int,q:array<array<int>>,r:struct<u:array<string>>>>, y array<array<struct<z:int>>>"
    rows = [
        (1, (1, ("b",)), [(1, [[1, None], [], None], (["a", None],)), None, (None, None, None), (2, [], ([],))], [[(1,), None], None, []]),
        (2, None, None, None), (3, (None, None), [], []), (4, (None, (None,)), [(5, [[7]], (None,))], [[(None,)]])]
    df = spark.createDataFrame(rows, ddl)
    tables = nested.shred_all(df, "k")
    assert set(tables) == {"", "x[]", "x[]/q[]", "x[]/q[]/element[]", "x[]/r/u[]", "y[]", "y[]/element[]"}
    back = nested.assemble_all(tables, df.schema, "k")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect())) and back.columns == df.columns
    size = {r["part"]: r["bytes"] for r in nested.byte_parts(nested.shred_all(spark.createDataFrame([(1, "ab", [5, 6])], "k int, v string, x array<int>"), "k")).collect()}
    # Tables "" (k, v, x#: 1, ab, 2) and "x[]" (k, i0, element: 1, 0, 5 and 1, 1, 6), each name and value with a line end.
    assert size == {"meta": 1 + 2 + 2 + 3 + 4 + 2 + 3 + 8, "control": 2 + 2 + 8, "leaves": 3 + 4}
    levels = {(r["level"], tuple(r["counts"] or ())) for r in nested.array_counts(spark.createDataFrame([(1, [[1], None, [2, 3]])], "k int, x array<array<int>>"), "k", "x").collect()}
    assert levels == {(0, (3,)), (1, (1, None, 2))}


def test_catalog_and_files(spark, tmp_path):
    data = catalog.Dataset(spark, "/root/testdata/sf0.001", catalog.STAR)
    assert data.row_count("region") == 5 and data.primary_key("lineitem") == [] and data.foreign_keys("nation") == {"n_regionkey": "region.r_regionkey"} and data.schema("region") == {"r_regionkey": "int", "r_name": "string"}
    made = data.statements()
    assert made[0].startswith("CREATE TABLE region (r_regionkey INTEGER, r_name VARCHAR, PRIMARY KEY (r_regionkey))") and "REFERENCES orders (o_orderkey)" in made[-1]
    import duckdb

    con = duckdb.connect()
    for statement in made:
        con.execute(statement)  # each refers to tables that are there
    with pytest.raises(KeyError):
        data.frame("nope")
    t = catalog.from_rows(spark, {"mem": [{"a": 1, "b": "x"}, {"a": None, "c": 2.5}, {"c": 1}]})["mem"]
    assert dict(t.dtypes) == {"a": "bigint", "b": "string", "c": "double"} and spark.sql("SELECT count(c) FROM mem").first()[0] == 2
    files.write_markdown(t, f"file://{tmp_path}/md")
    assert spark.read.text(f"file://{tmp_path}/md").count() == 5
    odd = spark.createDataFrame([(1, 'a"b,c'), (2, "\\n"), (3, "l1\nl2"), (4, None), (5, ""), (6, "null"), (7, "true"), (8, " x ")], "k int, s string")
    files.write_toon(odd, "odd", f"file://{tmp_path}/toon")
    assert sorted(map(tuple, files.read_toon(spark, f"file://{tmp_path}/toon").collect())) == [(str(r["k"]), r["s"]) for r in odd.orderBy("k").collect()]
    quality = profile.quality_markdown({"t": odd}, profile.quality_alerts(odd, "t", ("k",)))
    assert "## t" in quality and "### Most frequent values of t" in quality and "## Alerts" in quality


def test_reports(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(k, rng.gauss(10, 2)) for k in range(2000)], "k int, v double")
    r = reports.bootstrap(df, "v", "k", times=300).first()
    half = 1.96 * df.agg(F.stddev_samp("v")).first()[0] / 2000**0.5
    assert r["low"] < r["mean"] < r["high"] and abs((r["high"] - r["low"]) / 2 - half) < 0.25 * half
    assert statistics.needed_rows(0.7, 0.05) == 1251 and statistics.adequacy(2000, 0.7)["adequate"]
    assert statistics.needed_rows(0.7, statistics.smallest_change(500, 0.7)) <= 500
    assert reports.key_hint("id_nation", ["nations"]) == "nations" and reports.key_hint("nation_id", ["nation"]) == "nation" and reports.key_hint("name", ["nation"]) is None
    shaped = shaper.shape({"t": df}, catalog.Catalog("none", {}, ()), shaper.ShapeRequest(level=("t",), volume=200, stratify="nope"))
    assert "t has no column nope" in shaped.trace and [tuple(x) for x in shaped.summary().collect()] == [("t", 2000, 200, 0.1)]
    shaper.register_step("half", lambda tables, c, request, trace: {t: d.where("k % 2 = 0") for t, d in tables.items()})
    try:
        assert shaper.shape({"t": df}, catalog.Catalog("none", {}, ()), shaper.ShapeRequest(level=("t",))).counts() == {"t": 1000}
    finally:
        del shaper.STEPS["half"]


def test_scratch_deletes_what_is_not_kept(spark):
    with scratch(spark):
        gone, kept = materialize(spark.range(5), "gone"), materialize(spark.range(7), "kept", keep=True)
        paths = gone.inputFiles()
        assert gone.count() == 5
    assert kept.count() == 7
    at = spark._jvm.org.apache.hadoop.fs.Path(paths[0])
    assert not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    assert materialize(spark.range(3), "free").count() == 3
