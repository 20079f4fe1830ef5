"""Footers written by pyarrow, geometry resolution, texts, spatial operators and soundness of pruning."""

import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from stratalake.functions.schema import BBOX, COLUMN_STAT, STAT_VALUE
from stratalake.functions.text import bbox_text, bytes_text, stat_text
from stratalake.jobs import queries
from stratalake.operators import export, geo, prune, report, spatial
from stratalake.sources import catalog_table, footers, stores

EDGES = ("xmin", "ymin", "xmax", "ymax")


def covering(name, edges=EDGES):
    return {"covering": {"bbox": {e: [name, e] for e in edges}}}


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("lake")

    def write(name, geo_text, struct="bbox", leaf=str, **more):
        box = pa.array([{leaf(e): float(i + j) for j, e in enumerate(EDGES)} for i in range(2)])
        t = pa.table({struct: box, "v": pa.array([1, None], pa.int64())})
        if geo_text is not None:
            t = t.replace_schema_metadata({"geo": geo_text})
        pq.write_table(t, d / f"{name}.parquet", row_group_size=1, **more)

    meta = lambda **c: json.dumps({"version": "1.0.0", "primary_column": "geometry", "columns": {"geometry": c}})
    write("declared", meta(**covering("bbox")))
    write("renamed", meta(**covering("extent")), struct="extent")
    write("partial", meta(**covering("bbox", EDGES[:3])))
    write("undeclared", meta(), leaf=str.upper)
    write("upper", meta(), struct="BBOX")
    write("nogeo", None)
    write("badjson", "{'version': 1}")
    write("jsonnull", "null")
    write("emptygeo", "{}")
    write("crsnull", meta(crs=None))
    write("crsnumber", meta(crs={"id": {"authority": "EPSG", "code": 4326}}))
    write("crstext", meta(crs={"id": {"authority": "EPSG", "code": "4326"}}))
    write("sibling", json.dumps({"version": "1.0.0", "primary_column": "geometry", "columns": {"geometry": covering("bbox") | {"crs": {"id": {"authority": "EPSG", "code": 1}}}, "other": 5, "third": "x", "fourth": [1]}}))
    write("entrytext", json.dumps({"version": "1.0.0", "primary_column": "geometry", "columns": {"geometry": "x"}}))
    write("nostats", meta(**covering("bbox")), write_statistics=False)
    pq.ParquetWriter(d / "empty.parquet", pa.schema([("v", pa.int64())])).close()
    (d / "broken.parquet").write_bytes(b"not parquet")
    files = footers.list_files(spark, str(d))
    raw = footers.scan(files).withColumn("file", F.regexp_extract("file", r"([^/]+)\.parquet$", 1))
    return geo.catalog(raw).cache()


def by_file(catalog, *cols):
    return {r[0]: tuple(r[1:]) for r in catalog.where("coalesce(rg_index, 0) = 0").select("file", *cols).collect()}


def test_sources_and_boxes(catalog):
    got = by_file(catalog, "bbox_source", F.size("warnings"), "crs")
    assert got["declared"] == ("bbox-struct", 0, "OGC:CRS84")
    assert got["renamed"] == ("covering", 0, "OGC:CRS84")
    assert got["partial"] == ("bbox-struct", 1, "OGC:CRS84")
    assert got["undeclared"] == ("bbox-struct", 0, "OGC:CRS84")
    assert got["upper"][0] == "unavailable"
    assert got["nogeo"] == ("bbox-struct", 1, None)
    assert got["badjson"] == ("bbox-struct", 1, None)
    assert got["jsonnull"] == ("bbox-struct", 1, None)
    assert got["emptygeo"] == ("bbox-struct", 0, None)
    assert got["crsnull"][2] == "OGC:CRS84"
    assert got["crsnumber"][2] == got["crstext"][2] == "EPSG:4326"
    assert got["nostats"][0] == "unavailable"
    assert got["sibling"] == ("bbox-struct", 0, "EPSG:1") and got["entrytext"][2] is None
    box = catalog.where("file = 'declared' and rg_index = 1").select("bbox.*").first()
    assert tuple(box) == (1.0, 2.0, 3.0, 4.0)


def test_bad_and_empty_files(catalog):
    rows = {r.file: r for r in catalog.where("rg_index is null").collect()}
    assert rows["broken"].error and rows["broken"].columns is None
    assert rows["empty"].error is None and rows["empty"].rg0_paths == []
    files = catalog.select("file").distinct()
    s = {r.file: r for r in report.file_summary(files, catalog).collect()}
    assert s["declared"].n_row_groups == 2 and s["declared"].n_columns == 5 and s["broken"].n_row_groups == 0 and s["broken"].ratio == 0


def test_null_counts_use_all_values(catalog):
    keep = catalog.where("file = 'declared'").select("rg_index", prune.keeps([("v", "is_not_null", "")]).alias("k")).collect()
    assert {r.rg_index: r.k for r in keep} == {0: True, 1: False}


def test_texts(spark):
    sizes = {0: "0 B", 1023: "1023 B", 1024: "1.00 KB", 1152: "1.13 KB", 10240: "10.0 KB", 102400: "100 KB", 1048575: "1024 KB", 2**50: "1024 TB", -5: "0 B"}
    df = spark.createDataFrame([(k,) for k in sizes], "n long")
    assert {r.n: r.t for r in df.select("n", bytes_text(F.col("n")).alias("t")).collect()} == sizes
    box = spark.createDataFrame([((0.0, 0.0012345, 0.5, 12.5),), ((180.0, 100000.0, -0.25, 1.0),), (None,)], f"b {BBOX}")
    assert [r.t for r in box.select(bbox_text(F.col("b")).alias("t")).collect()] == ["[0, 1.235e-3, 0.50000, 12.5000]", "[180.00, 1.000e+5, -0.25000, 1.0000]", None]
    v = lambda k, **x: (k, *(x.get(f) for f in ("num", "int", "str", "ts", "bool", "bin")))
    want = {"1,234,567": v("num", num=1234567.0), "1.0000e-5": v("num", num=1e-5), "1.5": v("num", num=1.5), "0.007813": v("num", num=0.0078125), "0.5": v("num", num=0.5), "-1,234.5": v("num", num=-1234.5), "a" * 63 + "…": v("str", str="a" * 65), "0a0b": v("bin", bin=b"\n\x0b"), "<33 bytes>": v("bin", bin=b"x" * 33), "true": v("bool", bool=True), "NaN": v("num", num=float("nan"))}
    s = spark.createDataFrame([(k, x) for k, x in want.items()], f"want string, s {STAT_VALUE}")
    assert [(r.want, r.t) for r in s.select("want", stat_text(F.col("s")).alias("t")).collect() if r.want != r.t] == []


def test_decimal_bounds_prune(spark, tmp_path):
    import decimal

    t = pa.table({"p": pa.array([decimal.Decimal("1.50"), decimal.Decimal("2.25")], pa.decimal128(9, 2))})
    pq.write_table(t, tmp_path / "d.parquet", store_decimal_as_integer=False)
    rows = footers.scan(footers.list_files(spark, str(tmp_path)))
    got = rows.select(F.col("columns")[0]["min_raw"]["num"].alias("low"), prune.keeps([("p", "gte", "2.25")]).alias("a"), prune.keeps([("p", "gte", "2.26")]).alias("b")).first()
    assert tuple(got) == (1.5, True, False)


def test_filter_sets_take_first_record_and_leave_out_placeholders(spark):
    num = lambda x: ("num", x, None, None, None, None, None)
    col = lambda path, lo, hi: (path, None, None, 3, None, None, num(lo), num(hi), 0, None, None, None, None)
    groups = [("f", 0, [col("a", 1.0, 5.0), col("a", 90.0, 90.0)]), ("f", 1, [col("a", 7.0, 9.0)]), ("broken", None, None), ("g", 0, [col("b", 1.0, 1.0)])]
    b = spark.createDataFrame(groups, f"file string, rg_index int, columns array<{COLUMN_STAT}>")
    filters = [("s", "1", "a", "between", "\t2", "3\u00a0"), ("s", "2", "a", "is_not_null", "", None), ("t", "1", "a", "gte", "6", ""), ("u", "1", "b", "eq", "nothing", "")]
    f = spark.createDataFrame(filters, "filter_set string, filter_id string, column string, op string, value string, value2 string")
    want = {("s", "f", 0): True, ("s", "f", 1): False, ("s", "g", 0): True, ("t", "f", 0): False, ("t", "f", 1): True, ("t", "g", 0): True, ("u", "f", 0): True, ("u", "f", 1): True, ("u", "g", 0): True}
    assert {(r.filter_set, r.file, r.rg_index): r.keep for r in prune.prune_many(b, f).collect()} == want
    assert {tuple(r) for r in prune.match_counts(b, f).collect()} == {("s", 2, 3), ("t", 2, 3), ("u", 3, 3)}
    for s in "stu":
        one = [(c, op, v, w or "") for t, _, c, op, v, w in filters if t == s]
        for r in b.where("rg_index is not null").select("file", "rg_index", prune.keeps(one).alias("k")).collect():
            assert r.k == want[s, r.file, r.rg_index]
    old, prune.BROADCAST_FILTERS = prune.BROADCAST_FILTERS, 0
    try:
        assert {(r.filter_set, r.file, r.rg_index): r.keep for r in prune.prune_many(b, f).collect()} == want
    finally:
        prune.BROADCAST_FILTERS = old


@pytest.mark.parametrize("nan", ["prune", "unknown"])
def test_filter_index_equals_plain_verdicts(spark, nan):
    """Random bounds of all kinds, half known, mixed and NaN, against random literals: as the verdict of each filter says."""
    import datetime
    import decimal
    import random

    from stratalake.functions.predicates import OPS, verdict

    rnd = random.Random(12)
    empty = (None,) * 7

    def bound(kind):
        v = list(empty)
        v[0] = kind
        at, value = {"num": (1, rnd.choice([float("nan"), float("inf"), 0.0, -0.0, 1.5, 2.0**53, rnd.uniform(-5, 5)])), "int": (2, decimal.Decimal(rnd.choice([2**53, 2**53 + 1, rnd.randint(-5, 5)]))), "str": (3, rnd.choice(["", "a", "b", "é", "1"])),
                     "ts": (4, datetime.datetime(2024, 1, rnd.randint(1, 28))), "bool": (5, rnd.random() < 0.5), "bin": (6, b"a")}[kind]
        v[at] = value
        return tuple(v)

    def record(path):
        kind = rnd.choice(["num", "int", "str", "ts", "bool", "bin"])
        other = kind if rnd.random() < 0.9 else rnd.choice(["num", "int", "str"])
        low, high = (bound(k) if rnd.random() < 0.85 else None for k in (kind, other))
        return (path, None, None, rnd.choice([3, 3, None]), None, None, low, high, rnd.choice([None, 0, 3, 1]), None, None, None, None)

    groups = [("f", i, [record(rnd.choice("abc")) for _ in range(rnd.randint(0, 4))] if i % 20 else None) for i in range(150)]
    literals = ["", " ", "1", "2.5", "-3", "9007199254740993", "9007199254740992", "1e3", "yes", "f", "2024-01-14", "a", "b", "zz", "0x2", None]
    filters = [(f"s{i % 40}", str(i), rnd.choice("abcd"), rnd.choice([*OPS, "odd"]), rnd.choice(literals), rnd.choice(literals)) for i in range(90)]
    b = spark.createDataFrame(groups, f"file string, rg_index int, columns array<{COLUMN_STAT}>")
    f = spark.createDataFrame(filters, "filter_set string, filter_id string, column string, op string, value string, value2 string")
    first = F.get(F.filter("columns", lambda c: c["path"] == F.col("column")), F.lit(0))
    plain = b.crossJoin(f).select("filter_set", "rg_index", verdict(first, F.col("op"), F.col("value"), F.coalesce("value2", F.lit("")), nan).alias("k"))
    want = {(r.filter_set, r.rg_index): r.k for r in plain.groupBy("filter_set", "rg_index").agg(F.min("k").alias("k")).collect()}
    assert {(r.filter_set, r.rg_index): r.keep for r in prune.prune_many(b, f, nan).collect()} == want
    assert sorted((r.filter_set, r.rg_index) for r in prune.failures(b, f, nan).collect()) == sorted(k for k, v in want.items() if not v)
    counts = {r.filter_set: (r.matched, r.total) for r in prune.match_counts(b, f, nan).collect()}
    assert counts == {s: (sum(v for (t, _), v in want.items() if t == s), 150) for s, _ in want}
    assert 500 < sum(want.values()) < len(want) - 500


@pytest.mark.parametrize("nan", ["prune", "unknown"])
def test_filters_beyond_the_broadcast_stay_off_the_driver(spark, nan, monkeypatch):
    """Many sets in blocks, one with very many filters and one with none that counts: as each filter's verdict says, and the driver gets no filters."""
    from pyspark.sql.classic.dataframe import DataFrame
    from stratalake.functions.predicates import verdict

    num = lambda x: ("num", float(x), None, None, None, None, None)
    text = lambda x: ("str", None, None, x, None, None, None)
    col = lambda path, lo, hi: (path, None, None, 3, None, None, lo, hi, 0, None, None, None, None)
    groups = [("f", i, [col("a", num(i % 50), num(i % 50 + 3 if i % 9 else "nan")), col("b", text(chr(97 + i % 20)), text(chr(98 + i % 20)))]) for i in range(60)]
    b = spark.createDataFrame([*groups, ("broken", None, None)], f"file string, rg_index int, columns array<{COLUMN_STAT}>")
    filters = [(f"s{i % 90}", str(i), "ab"[i % 2], ("between", "eq", "gte", "lte")[i // 2 % 4], str(i % 60) if i % 2 == 0 else chr(97 + i % 25), str(i % 60 + 20)) for i in range(240)]
    filters += [("most", str(i), "a", "gte", str(i % 30), "") for i in range(150)] + [("none", "0", "a", "eq", " ", "")]
    f = spark.createDataFrame(filters, "filter_set string, filter_id string, column string, op string, value string, value2 string").coalesce(1)
    first = F.get(F.filter("columns", lambda c: c["path"] == F.col("column")), F.lit(0))
    plain = b.where("rg_index is not null").crossJoin(f).select("filter_set", "rg_index", verdict(first, F.col("op"), F.col("value"), F.col("value2"), nan).alias("k"))
    want = {(r.filter_set, r.rg_index): r.k for r in plain.groupBy("filter_set", "rg_index").agg(F.min("k").alias("k")).collect()}
    assert {k for k, v in want.items() if not v} and all(want["none", i] for i in range(60))
    monkeypatch.setattr(prune, "BROADCAST_FILTERS", 100)
    monkeypatch.setattr(prune, "ROW_GROUPS_PER_TASK", 25, raising=False)
    seen, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: seen.append(collect(self)) or seen[-1])
    made = prune.prune_many(b, f, nan), prune.failures(b, f, nan), prune.match_counts(b, f, nan)
    assert max((len(rows) for rows in seen), default=0) <= 2  # of the names of columns, not of the filters
    monkeypatch.setattr(DataFrame, "collect", collect)
    many, failed, counts = (df.collect() for df in made)
    assert len(many) == len(want) and {(r.filter_set, r.rg_index): r.keep for r in many} == want
    assert sorted((r.filter_set, r.rg_index) for r in failed) == sorted(k for k, v in want.items() if not v)
    assert {r.filter_set: (r.matched, r.total) for r in counts} == {s: (sum(v for (t, _), v in want.items() if t == s), 60) for s, _ in want}
    assert prune._cuts(f).where("filter_set = 'most'").count() == 1


def test_filter_sets_on_wide_schemas(spark):
    """Of several records of a path the first counts, and 5,000 columns take no 25 times as long as 1,000."""
    import time

    num = lambda x: ("num", float(x), None, None, None, None, None)

    def took(n):
        cols = [(f"c{i % (n // 2)}", None, None, 3, None, None, num(i), num(i), 0, None, None, None, None) for i in range(n)]
        b = spark.createDataFrame([("f", 0, cols)], f"file string, rg_index int, columns array<{COLUMN_STAT}>")
        f = spark.createDataFrame([("s", "1", "c7", "eq", "7", ""), ("t", "1", "c7", "eq", str(7 + n // 2), "")], "filter_set string, filter_id string, column string, op string, value string, value2 string")
        began = time.time()
        assert {r.filter_set: r.keep for r in prune.prune_many(b, f).collect()} == {"s": True, "t": False}
        return time.time() - began

    took(1000)
    assert took(20_000) < 12 * took(1000) + 5


def test_block_numbers_of_four_digits_are_no_days(spark, tmp_path):
    """O20's query shows no day for a number, as its SQL has it; a date column reads a bare year."""
    from stratalake.functions.predicates import literal

    row = (1, 1000.0, "1995-01-01 00:00:00", "5-LOW")
    keys = [(n * 100,) + row for n in (0, 6, 7, 994, 999, 1000, 1001, 1008, 9996, 10003)]
    orders = spark.createDataFrame(keys, "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate string, o_orderpriority string")
    orders.withColumn("o_orderdate", F.to_timestamp("o_orderdate")).write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.rg_index: (r.number, r.as_int, r.truth, r.day) for r in queries.o20_literals(spark, str(tmp_path)).collect()}
    whole = {n: (float(n), "int", None, None) for n in (7, 994, 1001, 1008, 9996, 10003)}
    assert got == whole | {0: (0.0, "int", False, None), 6: (None, None, None, "2024-02-01"), 999: (1000.0, "num", None, None), 1000: (None, None, None, "2024-02-01")}
    year = spark.range(1).select(F.date_format(literal(F.lit(" 1001 "), F.lit("ts"))["ts"], "yyyy-MM-dd").alias("d")).first()
    assert year.d == "1001-01-01"


def test_paths_that_stores_open():
    """Where tasks find files: schemes, credentials by bucket and account, mounts, and names as they stand."""
    conf = {"fs.s3a.access.key": "a", "fs.s3a.secret.key": "b", "fs.s3a.bucket.own.access.key": "c", "fs.s3a.endpoint": "http://store:9000", "fs.s3a.path.style.access": "true", "fs.s3a.endpoint.region": "r1",
            "fs.azure.account.key.acc.dfs.core.windows.net": "k", "fs.defaultFS": "hdfs://name:8020"}
    of = lambda f, **m: (lambda s, a, p: (*stores.arguments(s, a, conf), p))(*stores.located(f, m))
    assert of("file:/a b/c%20d.parquet") == ("local", {}, "", "/a b/c%20d.parquet") == of("/a b/c%20d.parquet") == of("file:///a b/c%20d.parquet")
    s3 = {"access_key": "a", "secret_key": "b", "endpoint_override": "store:9000", "scheme": "http", "region": "r1"}
    assert of("s3a://lake/x y/z#1.parquet") == ("s3", s3, "lake", "/x y/z#1.parquet")
    assert of("s3a://own/z") == ("s3", s3 | {"access_key": "c"}, "own", "/z")
    assert stores.arguments("s3", "p", {"fs.s3a.aws.credentials.provider": "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider"}) == ("s3", {"anonymous": True}, "p")
    assert of("abfss://box@acc.dfs.core.windows.net/d/f") == ("azure", {"account_name": "acc", "account_key": "k"}, "box", "/d/f")
    assert of("hdfs://other:9000/d/f") == ("hdfs", {"host": "other", "port": 9000}, "", "/d/f")
    assert of("hdfs:/d/f") == ("hdfs", {"host": "name", "port": 8020}, "", "/d/f")
    assert of("viewfs://c/d") == ("hdfs", {"host": "viewfs://c", "port": 0}, "", "/d")
    assert stores.located("s3a://lake/x/y", {"s3a://lake/": "/mnt/", "s3a://lake/x/": "file:/deep/"}) == ("file", "", "/deep/y")
    with pytest.raises(ValueError):
        of("ftp://host/x")


def test_footers_of_oddly_named_files_and_mounted_stores(spark, tmp_path):
    t = pa.table({"v": pa.array([1, 2])})
    names = ["plain", "a b", "c%20d", "e+f#g", "é ü", "h%", "i;j,k"]
    (tmp_path / "sub dir%").mkdir()
    for n in names:
        pq.write_table(t, tmp_path / "sub dir%" / f"{n}.parquet")
    rows = footers.scan(footers.list_files(spark, str(tmp_path))).select("file", "num_rows", "error").collect()
    assert sorted(r.file.rpartition("/")[2] for r in rows) == sorted(f"{n}.parquet" for n in names) and all(r.error is None and r.num_rows == 2 for r in rows)
    far = spark.createDataFrame([(f"s3a://lake/sub dir%/{n}.parquet", 1) for n in names] + [("nowhere://x/y.parquet", 1)], "file string, file_size long")
    rows = footers.scan(far, mounts={"s3a://lake/": f"{tmp_path}/"}).collect()
    assert {r.file: (r.num_rows, r.error is None) for r in rows} == {f"s3a://lake/sub dir%/{n}.parquet": (2, True) for n in names} | {"nowhere://x/y.parquet": (None, False)}


def test_path_segments_tell_flat_columns_from_structs(spark, tmp_path):
    flat = pa.table({f"bbox.{e}": pa.array([float(i)]) for i, e in enumerate(EDGES)})
    pq.write_table(flat, tmp_path / "flat.parquet")
    deep = pa.table({"a.b": pa.array([{"c.d": 1, "e": [{"f": 2}]}]), "m": pa.array([[("k", 1)]], pa.map_(pa.string(), pa.int64())), "bbox": pa.array([{e: float(i) for i, e in enumerate(EDGES)}])})
    pq.write_table(deep, tmp_path / "deep.parquet")
    declared = json.dumps({"version": "1", "primary_column": "g", "columns": {"g": {"covering": {"bbox": {e: [f"bbox.{e}"] for e in EDGES}}}}})
    pq.write_table(flat.replace_schema_metadata({"geo": declared}), tmp_path / "declared.parquet")
    rows = geo.catalog(footers.scan(footers.list_files(spark, str(tmp_path)))).withColumn("file", F.regexp_extract("file", r"([^/]+)\.parquet$", 1)).collect()
    got = {r.file: r for r in rows}
    assert got["flat"].bbox_source == "unavailable" and got["deep"].bbox_source == "bbox-struct" and got["declared"].bbox_source == "covering"
    assert tuple(got["declared"].bbox) == (0.0, 1.0, 2.0, 3.0)
    segments = [c.segments for c in got["deep"].columns]
    assert segments[0] == ["a.b", "c.d"] and segments[1][:2] == ["a.b", "e"] and segments[1][-1] == "f" and segments[2][0] == "m" and ["bbox", "ymax"] in segments
    assert footers.path_segments(pa.schema([("x", pa.int64())]), ["y.z", "w"]) == [["y", "z"], ["w"]]


def test_kept_catalog_opens_changed_files_only(spark, tmp_path, monkeypatch):
    """Runs over a lake that changes: new, changed, gone and broken files; a run that breaks off; several runs on one date."""
    import datetime
    import os

    lake, table = tmp_path / "lake", str(tmp_path / "table")
    lake.mkdir()
    assert catalog_table.current(spark, table).collect() == []
    write = lambda n, rows: pq.write_table(pa.table({"v": pa.array(range(rows))}), lake / f"{n}.parquet")
    for n in ("a", "b", "c"):
        write(n, 3)
    day = datetime.date(2024, 5, 1)
    run = lambda d=0: {(r.file.rpartition("/")[2][:-8], r.state) for r in catalog_table.refresh(spark, str(lake), table, day + datetime.timedelta(d)).collect()}
    now = lambda: {(r.file.rpartition("/")[2][:-8], r.num_rows, r.run) for r in catalog_table.current(spark, table).collect()}
    assert run() == {("a", "new"), ("b", "new"), ("c", "new")} and now() == {("a", 3, 1), ("b", 3, 1), ("c", 3, 1)}
    assert run() == set() and now() == {("a", 3, 1), ("b", 3, 1), ("c", 3, 1)}
    write("b", 5)
    os.remove(lake / "c.parquet")
    write("d", 1)
    (lake / "e.parquet").write_bytes(b"broken")
    assert run(1) == {("b", "changed"), ("c", "gone"), ("d", "new"), ("e", "new")}
    assert now() == {("a", 3, 1), ("b", 5, 2), ("d", 1, 2), ("e", None, 2)}
    assert run(1) == {("e", "changed")}  # what could not be read is tried again
    write("e", 2)
    with monkeypatch.context() as m:  # breaks off between row groups and ledger
        m.setattr(catalog_table, "RAW_ROW_GROUPS", "no schema")
        with pytest.raises(Exception):  # noqa: B017
            run(2)
    assert now() == {("a", 3, 1), ("b", 5, 2), ("d", 1, 2), ("e", None, 3)}
    assert run(2) == {("e", "changed")} and now() == {("a", 3, 1), ("b", 5, 2), ("d", 1, 2), ("e", 2, 4)}
    (tmp_path / "bare").mkdir()
    bare = str(tmp_path / "bare table")
    assert catalog_table.refresh(spark, str(tmp_path / "bare"), bare, day).collect() == [] == catalog_table.current(spark, bare).collect()
    write("c", 4)
    assert run(2) == {("c", "new")} and ("c", 4, 5) in now()


def test_feature_sink_writes_a_line_each(spark, tmp_path):
    b = spark.createDataFrame([("f", 0, (0.0, 1.0, 2.0, 3.0), True), ("f", 1, None, True), ("f", 12, (0.0, 0.0, 1.0, 1.0), False)], f"file string, rg_index int, bbox {BBOX}, visible boolean")
    export.write_geojson_lines(b, str(tmp_path / "out"))
    lines = [json.loads(x) for f in (tmp_path / "out").glob("part-*") for x in f.read_text().splitlines()]
    assert sorted((x["id"], x["type"], x["properties"]["visible"], x["properties"]["color"]) for x in lines) == [(0, "Feature", True, "#4f8cff"), (12, "Feature", False, "#27c197")]
    assert next(x for x in lines if x["id"] == 0)["geometry"] == {"type": "Polygon", "coordinates": [[[0.0, 1.0], [2.0, 1.0], [2.0, 3.0], [0.0, 3.0], [0.0, 1.0]]]}


def test_colors_and_reports(spark):
    b = spark.createDataFrame([("f", i, 1, 0, 0, o, "native", None, t) for i, (o, t) in enumerate([(None, None), (1234567, []), (5, [1, 3])])], f"file string, rg_index int, num_rows long, total_compressed_bytes long, total_uncompressed_bytes long, file_offset long, bbox_source string, bbox {BBOX}, geometry_types array<int>")
    assert [(r.offset, r.types, r.bbox) for r in report.row_group_report(b).orderBy("rg_index").collect()] == [("—", "—", "—"), ("1,234,567", "—", "—"), ("5", "1, 3", "—")]
    colors = [r.c for r in spark.range(12).select(export.color(F.col("id")).alias("c")).collect()]
    assert colors[0] == colors[10] == "#4f8cff" and colors[9] == "#8a4fff" and len({*colors}) == 10


def test_grid_join_of_all_sizes(spark):
    """Boxes from points to the whole world against rectangles of all sizes, many of them odd."""
    import random

    rnd = random.Random(6)

    def box():
        x, y, s = rnd.uniform(-180, 180), rnd.uniform(-90, 90), 10 ** rnd.uniform(-3, 2.6)
        odd = rnd.random()
        return (x, y, x + s, y + s * rnd.random()) if odd > 0.15 else (x, y, x, y) if odd > 0.05 else (x, float("nan"), x + s, y) if odd > 0.02 else (x + s, y, x, y)

    boxes = [("f", i, box()) for i in range(300)]
    rects = [(i, box()) for i in range(120)]
    b = spark.createDataFrame(boxes, f"file string, rg_index int, bbox {BBOX}")
    r = spark.createDataFrame(rects, f"rect_id int, rect {BBOX}")
    pairs = {how: sorted(map(tuple, spatial.range_join(b, r, how).select("rg_index", "rect_id").collect())) for how in ("auto", "grid")}
    assert pairs["auto"] == pairs["grid"] and len({*pairs["grid"]}) == len(pairs["grid"]) > 1000


def shapes(spark, n, name, seed, wide=360.0, size=0.001):
    """n small shapes spread over a square of this width."""
    at = lambda k: (F.pmod(F.xxhash64("id", F.lit(seed + k)), F.lit(10**9)) / 1e9 * wide)
    x, y = at(1), at(2)
    box = F.struct(x.alias("xmin"), y.alias("ymin"), (x + at(3) / wide * size).alias("xmax"), (y + at(4) / wide * size).alias("ymax")).cast(BBOX)
    return spark.range(n).select(F.col("id").alias(f"{name}_id"), box.alias("bbox" if name == "box" else "rect"))


def test_grid_candidates_follow_the_result(spark):
    """Tiny shapes all over the world, and the same in one city: the pairs tried stay within a few times the pairs found."""
    for wide, size in ((360.0, 0.001), (2.0, 0.02)):
        b, r = shapes(spark, 8000, "box", 1, wide, size), shapes(spark, 8000, "rect", 50, wide, size)
        tried = spatial.range_candidates(b, r).count()
        found = spatial.range_join(b, r, "grid").count()
        assert tried <= 20 * found + 2000, (wide, tried, found)
        assert found == spatial.range_join(b, r).count()


def test_grid_splits_dense_cells(spark, monkeypatch):
    """All shapes in one place: pairs are dealt out in blocks, none is lost or doubled, also where dense cells are joined."""
    b = shapes(spark, 900, "box", 1, 0.001, 0.002).unionByName(shapes(spark, 50, "box", 9, 300.0, 10.0).withColumn("box_id", F.col("box_id") + 5000))
    r = shapes(spark, 700, "rect", 50, 0.001, 0.002).unionByName(shapes(spark, 50, "rect", 70, 300.0, 40.0).withColumn("rect_id", F.col("rect_id") + 5000))
    want = sorted(map(tuple, spatial.range_join(b, r).select("box_id", "rect_id").collect()))
    monkeypatch.setattr(spatial, "DENSE", 64)
    for most in (100_000, 0):
        monkeypatch.setattr(spatial, "BROADCAST_CELLS", most)
        assert sorted(map(tuple, spatial.range_join(b, r, "grid").select("box_id", "rect_id").collect())) == want
    assert len(want) > 100_000


SF = "/root/testdata/sf0.001"


def test_grid_equals_broadcast(spark):
    a = queries.o28_range_join(spark, SF).collect()
    b = queries.o28_range_join_grid(spark, SF).collect()
    assert sorted(a) == sorted(b) and len(a) == len(set(a)) > 0


def test_odd_boxes(spark):
    nan = float("nan")
    rows = [("f", 0, (0.0, 0.0, 1.0, 1.0)), ("f", 1, (nan, 0.0, nan, 1.0)), ("f", 2, (-1e6, -1e6, 1e6, 1e6)), ("f", 3, None)]
    boxes = spark.createDataFrame(rows, f"file string, rg_index int, bbox {BBOX}")
    rects = spark.createDataFrame([(1, (1.0, 1.0, 2.0, 2.0)), (2, (5.0, 0.5, 6.0, 0.6)), (3, (0.0, 3.0, 0.0, 3.0))], f"rect_id int, rect {BBOX}")
    want = {(1, 0), (1, 1), (1, 2), (2, 1), (2, 2), (3, 2)}
    for how in ("auto", "grid"):
        got = spatial.range_join(boxes, rects, how).select("rect_id", "rg_index").collect()
        assert sorted(map(tuple, got)) == sorted(want), how


def test_pruning_is_sound_and_monotone(spark):
    rows = queries.order_rows(spark, SF)
    hit = rows.where("price between 20000 and 160000 and o_orderdate >= '1992-03-01' and o_orderpriority <= '4-NOT SPECIFIED'").select("file", "rg_index").distinct()
    b = queries.block_catalog(spark, SF)
    kept = b.where(prune.keeps(queries.FILTERS)).select("file", "rg_index")
    assert hit.join(kept, ["file", "rg_index"], "left_anti").count() == 0
    fewer = b.where(prune.keeps(queries.FILTERS[:1])).select("file", "rg_index")
    assert kept.join(fewer, ["file", "rg_index"], "left_anti").count() == 0


def test_native_box_checks_xmin_only(spark):
    r = queries.geo_blocks(spark, SF).where("case = 0")
    nan = F.lit(float("nan"))
    edit = lambda edge: F.transform("columns", lambda c: F.when(c["path"] == "geo.m", c.withField("geo_bbox", F.struct(*[(nan if e == edge else F.lit(1.0)).alias(e) for e in EDGES]))).otherwise(c))
    assert {x.bbox_source for x in geo.catalog(r.withColumn("columns", edit("ymin"))).collect()} == {"native"}
    assert {x.bbox_source for x in geo.catalog(r.withColumn("columns", edit("xmin"))).collect()} == {"bbox-struct"}
