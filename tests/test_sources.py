import datetime as dt
from decimal import Decimal

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F, types as T

from merchlens.operators import quality as Q
from merchlens.operators.infer import batch_infer, bisected, infer_in_batches, infer_totals
from merchlens.sources import catalog, files
from merchlens.sources.csv import header_lines, load_csv, with_defaults
from tests.conftest import answers

PLACES = '''LOCATION_ID,Name,OPERATING_HOURS,IS_ACTIVE,LATITUDE,CREATED_AT,EXTRA
a1,"Store ""One"", NY","{
  ""mon-fri"": ""9:00-21:00"",
  ""sun"": ""closed""
}",True,40.5,2024-12-19 13:17:53,x
a2,NULL,null,False,not a number,,y
'''


def test_multi_line_json_and_null_tokens(spark, tmp_path):
    (tmp_path / "p.csv").write_text(PLACES)
    df = catalog.load_table(spark, "locations", str(tmp_path), multi_line=True)
    assert df.schema["operating_hours"].dataType == T.MapType(T.StringType(), T.StringType())
    a1, a2 = df.orderBy("location_id").collect()
    assert (a1.name, a1.operating_hours["sun"], a1.is_active, a1.latitude) == ('Store "One", NY', "closed", True, 40.5)
    assert a1.created_at == dt.datetime(2024, 12, 19, 13, 17, 53)
    assert (a2.name, a2.operating_hours, a2.is_active, a2.latitude, a2.created_at) == (None, None, False, None, None)


def test_columns_are_bound_by_name(spark, tmp_path):
    (tmp_path / "p.csv").write_text("B,A\n1,2\n")
    got = load_csv(spark, str(tmp_path), "a int, b int, c string")
    assert answers(got) == [(2, 1, None)]


def test_types_follow_names():
    kinds = {c: catalog.column_type("products", c).simpleString() for c in ("CURRENT_PRICE", "IS_VEGAN", "launch_date", "CREATED_AT", "updated_at", "name", "skin_type_compatibility", "monk_scale_min")}
    assert kinds == {
        "CURRENT_PRICE": "decimal(10,2)", "IS_VEGAN": "boolean", "launch_date": "date", "CREATED_AT": "timestamp_ntz", "updated_at": "timestamp",
        "name": "string", "skin_type_compatibility": "array<string>", "monk_scale_min": "bigint",
    }
    assert catalog.column_type("promotions", "end_date").simpleString() == "timestamp_ntz"
    assert catalog.column_type("orders", "total_cents").simpleString() == "bigint"
    assert len(catalog.TABLES) == 28


def test_defaults(rows):
    df = rows("product_id string, is_active boolean, price_modifier decimal(10,2)", ("a", None, None), (None, False, Decimal("1.50")))
    filled = with_defaults(df, catalog.defaults_for("product_variants", ["price_modifier"]) | {"is_active": True, "product_id": "uuid"}, seed=["price_modifier"])
    got = sorted(filled.collect(), key=lambda r: r.is_active)
    assert (got[1].product_id, got[1].is_active, got[1].price_modifier) == ("a", True, Decimal("0.00"))
    assert len(got[0].product_id) == 36
    assert catalog.defaults_for("orders", ["order_id", "status", "total_cents", "currency"]) == {"status": "pending", "currency": "USD"}


def test_file_registry_and_paths(spark, rows, tmp_path):
    for name in ("a/X_1.png", "b/X_1.png", "a/Y_1.jpeg"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"pixels")
    listed = files.register_files(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert listed.count() == 3
    assert "content" not in listed.columns
    assert answers(files.one_per_name(listed), "file_name") == [("X_1.png",), ("Y_1.jpeg",)]
    asked = rows("path string", ("@PRODUCTS.PRODUCT_MEDIA/x.png",), ("x.png",), ("y.png",))
    got = files.resolve_label_paths(asked, rows("file_path string", ("x.png",)))
    assert answers(got, "path", "resolved", F.col("message").isNotNull()) == [
        ("@PRODUCTS.PRODUCT_MEDIA/x.png", "x.png", False), ("x.png", "x.png", False), ("y.png", None, True),
    ]
    assert answers(files.unprocessed_files(asked.withColumnRenamed("path", "file_path"), rows("file_path string", ("x.png",)))) == [
        ("@PRODUCTS.PRODUCT_MEDIA/x.png",), ("y.png",),
    ]
    encoded = files.file_base64(rows("file_path string, content binary", ("a", b"hi"), ("b", None)))
    assert answers(encoded) == [("a", "aGk=", None), ("b", None, "ERROR: no content in b")]


def test_failing_batches_are_halved(rows):
    calls = []

    def model(values):
        calls.append(len(values))
        if any(v == "bad" for v in values):
            raise ValueError("no " + str(values.index("bad") >= 0))
        return [v.upper() for v in values]

    values = [f"v{i}" for i in range(64)]
    assert bisected(values, model) == ([v.upper() for v in values], [None] * 64) and calls == [64]
    calls.clear()
    values[37] = "bad"
    results, errors = bisected(values, model)
    assert len(calls) == 13 and [i for i, e in enumerate(errors) if e] == [37] and results[36:39] == ["V36", None, "V38"]
    assert bisected([], model) == ([], []) and bisected(["a", "b"], lambda values: ["one"])[1] == [None, None]
    assert bisected(["a"], lambda values: [])[1] == ["0 results for 1 values"]
    got = infer_in_batches(rows("id long, body string", (1, "ok"), (2, "bad"), (3, None), (4, ""), (5, "x")), "id", "body", lambda vs: [v[::-1] if v != "bad" else 1 / 0 for v in vs], 3)
    assert answers(got) == [
        (1, True, "ko", None), (2, False, None, "division by zero"), (3, False, None, "No image provided"), (4, False, None, "No image provided"), (5, True, "x", None),
    ]


def test_inference_keeps_going_after_errors(rows):
    def model(text):
        if text == "bad":
            raise ValueError("cannot read")
        return text.upper()

    got = batch_infer(rows("id long, body string", (1, "ok"), (2, "bad"), (3, None), (4, "")), "id", "body", model)
    assert answers(got) == [(1, True, "OK", None), (2, False, None, "cannot read"), (3, False, None, "No image provided"), (4, False, None, "No image provided")]
    assert answers(infer_totals(got)) == [(1, 3, False)]


def test_quality(rows):
    df = rows("id long, cost double, current_price double, at timestamp_ntz", (1, 1.0, 2.0, dt.datetime(2024, 1, 1)), (2, 3.0, 2.0, None), (2, None, 2.0, dt.datetime(2024, 1, 2)))
    got = Q.table_metrics(df, ["at"], ["cost"], {"cost": Q.cost_exceeds_price()}, "2024-01-02 00:01:00")
    assert answers(got) == [("freshness_seconds", "at", 60), ("null_count", "cost", 1), ("row_count", "", 3), ("rule_violations", "cost", 1)]
    assert answers(Q.unique_violations(df, ["id"])) == [(2, 2)]
    assert answers(Q.fk_violations(df, rows("key long", (1,)), "id", "key")) == [(2, 2)]
    assert answers(Q.null_violations(df, ["cost", "id"])) == [("cost", 1), ("id", 0)]
    assert answers(Q.length_violations(df.select(F.lit("abc").alias("s")), {"s": 2})) == [("s", 3)]


def test_metrics_while_writing(rows, tmp_path):
    df, watch = Q.observed(rows("id long, s string", (1, None), (2, "x")), "load", ["s"], {"big": F.col("id") > 1})
    df.write.parquet(str(tmp_path / "out"))
    assert watch.get == {"row_count": 2, "null_count:s": 1, "rule_violations:big": 1}


def test_constraints(rows):
    products = rows("product_id long, sku string", (1, "a"), (1, "b"), (2, None), (3, None))
    variants = rows("variant_id long, product_id long", (1, 1), (2, 9))
    got = catalog.constraint_report({"products": products, "product_variants": variants})
    assert answers(got.filter("violations > 0")) == [("product_variants", "reference", "product_id", 1), ("products", "primary key", "product_id", 1)]


def test_unknown_table(spark):
    with pytest.raises(KeyError):
        catalog.load_table(spark, "nothing", "/nowhere")


def test_files_are_bound_by_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ID,NAME\n1,x\n")
    (tmp_path / "b.csv").write_text("NAME,ID\ny,2\n")
    (tmp_path / "c.csv").write_text("extra,Id\nz,3\n")
    assert answers(load_csv(spark, str(tmp_path), "id long, name string")) == [(1, "x"), (2, "y"), (3, None)]


def test_python_reaches_workers_from_another_folder(tmp_path):
    """A session started outside the repository, without PYTHONPATH, runs a query with Python in it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys; sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", entry.queries()["vector_topk_l2"](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "rows" in done.stdout, done.stderr[-2000:]


def test_headers_are_read_without_the_rest_of_the_file(spark, tmp_path):
    with open(tmp_path / "long.csv", "w") as out:
        out.write("\ufeffid,name\n")
        out.writelines(f"{i},{'x' * 100}\n" for i in range(200_000))
    for i in range(40):
        (tmp_path / f"s{i}.csv").write_text(f"\nname,id\nn{i},{i}\n" if i % 2 else f"id,name\n{i},n{i}\n")
    (tmp_path / "none.csv").write_text("")
    assert answers(header_lines(spark, str(tmp_path)).groupBy("header").count()) == [("id,name", 21), ("name,id", 20)]
    got = load_csv(spark, str(tmp_path), "id long, name string")
    assert sorted(answers(got.filter("name like 'n%'"))) == [(i, f"n{i}") for i in range(40)]
    assert got.count() == 200_040


def test_quoted_and_repeated_header_names(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"a,b",c,C\n1,2,3\n4,5\n')
    got = load_csv(spark, str(tmp_path), T.StructType([T.StructField("a,b", T.LongType()), T.StructField("c", T.LongType())]))
    assert answers(got) == [(1, 2), (4, 5)]
    assert answers(load_csv(spark, str(tmp_path), lambda names: T.StructType([T.StructField(n, T.StringType()) for n in names[:1]]))) == [("1",), ("4",)]


def test_types_may_be_given(spark, tmp_path):
    (tmp_path / "p.csv").write_text("product_id,sort_order\np,first\n")
    assert answers(catalog.load_table(spark, "products", str(tmp_path))) == [("p", None)]
    assert answers(catalog.load_table(spark, "products", str(tmp_path), types={"Sort_Order": T.StringType()})) == [("p", "first")]
