import pytest
from pyspark.sql import functions as F

from rowtide.functions.predicates import Refused
from rowtide.model import CHANGE, columns_of, decimal_cell, int_cell, row_image, text_cell
from rowtide.operators.normalise import mark_generated, mark_read_only
from rowtide.operators.reverse import plan, with_statements

BASE = {f.name: None for f in CHANGE.fields}


def changes(spark, rows):
    """rows: (op, before, after) with (id, status, total) tuples; total as text."""
    df = spark.createDataFrame([(i + 1, op, b, a) for i, (op, b, a) in enumerate(rows)], "change_id long, op tinyint, b struct<id:long,s:string,t:string>, a struct<id:long,s:string,t:string>")
    image = lambda c: F.when(F.col(c).isNotNull(), row_image(int_cell(F.col(f"{c}.id")), text_cell(F.col(f"{c}.s")), decimal_cell(F.col(f"{c}.t"))))
    return df.select("change_id", "op", F.lit("shop").alias("schema_name"), F.lit("or`ders").alias("table_name"), columns_of("id", "status", "total", key=("id",)).alias("columns"), image("b").alias("before"), image("a").alias("after"))


def statements(df):
    return [(r["statement"], r["refusal"]) for r in with_statements(df).orderBy("change_id").collect()]


def test_each_operation_is_undone(spark):
    df = changes(spark, [(1, None, (1, "x", "1.00")), (2, (1, "x", "1.00"), (2, "it's", "1.00")), (3, (2, None, "9.50"), None)])
    assert statements(df) == [
        ("DELETE FROM `shop`.`or``ders` WHERE `id` = 1 LIMIT 1;", None),
        ("UPDATE `shop`.`or``ders` SET `id` = 1, `status` = 'x' WHERE `id` = 2 LIMIT 1;", None),
        ("INSERT INTO `shop`.`or``ders` (`id`, `status`, `total`) VALUES (2, NULL, 9.50);", None),
    ]


def test_without_a_key_every_column_locates(spark):
    df = changes(spark, [(1, None, (1, None, "1.00"))]).withColumn("columns", columns_of("id", "status", "total"))
    assert statements(df)[0][0] == "DELETE FROM `shop`.`or``ders` WHERE `id` = 1 AND `status` IS NULL AND `total` = 1.00 LIMIT 1;"


def test_read_only_columns_locate_but_are_not_set(spark):
    df = mark_read_only(changes(spark, [(2, (1, "x", "1.00"), (1, "y", "2.00")), (3, (1, "x", "1.00"), None), (2, (1, "x", "1.00"), (1, "x", "2.00"))]), [" SHOP.or`ders.TOTAL ", ""])
    got = statements(df)
    assert got[0][0] == "UPDATE `shop`.`or``ders` SET `status` = 'x' WHERE `id` = 1 LIMIT 1;"
    assert got[1][0] == "INSERT INTO `shop`.`or``ders` (`id`, `status`) VALUES (1, 'x');"
    assert got[2][0] is None and "read-only" in got[2][1]
    catalogue = spark.createDataFrame([("shop", "or`ders", "STATUS"), ("Shop", "or`ders", "id")], "schema_name string, table_name string, column_name string")
    marked = mark_generated(df, catalogue).orderBy("change_id").first()["columns"]
    assert [c["read_only"] for c in marked] == [False, True, True]


@pytest.mark.parametrize(
    ("change", "why"),
    [((2, (1, "x", "1.00"), (1, "x", "1.00")), "no columns"), ((2, None, (1, "x", "1.00")), "before image"), ((1, (1, "x", "1"), None), "after image"), ((9, None, None), "unsupported"), ((1, None, (1, "x", "1.00")), None)],
)
def test_refusals_are_named(spark, change, why):
    ((statement, refusal),) = statements(changes(spark, [change]))
    assert (refusal is None and statement) if why is None else (why in refusal and statement is None)


def test_bad_values_and_no_columns_refuse(spark):
    df = changes(spark, [(3, (1, "x", "1.00"), None), (1, None, (1, "x", "1"))])
    bad = df.withColumn("before", F.transform("before", lambda c: F.when(c["raw"].isNotNull(), F.struct(*[F.lit("1; DROP").alias("raw") if f == "raw" else c[f].alias(f) for f in ("tag", "i", "u", "f", "d", "b", "bin", "t", "raw")])).otherwise(c)))
    assert "not a number" in statements(bad)[0][1]
    assert "no columns" in statements(df.withColumn("columns", F.slice("columns", 1, 0)))[1][1]


def test_plan_is_all_or_nothing_and_newest_first(spark):
    good = changes(spark, [(1, None, (1, "x", "1.00")), (4, None, None), (3, (2, "y", "1.00"), None)])
    assert [r["change_id"] for r in plan(good).collect()] == [3, 1]
    with pytest.raises(Refused, match="change 2"):
        plan(changes(spark, [(1, None, (1, "x", "1.00")), (2, (1, "x", "1.00"), (1, "x", "1.00"))]))
    assert plan(good.where("false")).collect() == []


def test_undoing_everything_restores_the_beginning(spark):
    """Apply the inverse statements, read back as text, to the last state: nothing is left."""
    import re

    from rowtide.sources.fixture import changes as fixture

    log = fixture(spark, "/root/testdata/sf0.001")
    rows = log.orderBy("change_id").select("table_name", "op", F.transform("after", lambda c: F.coalesce(c["i"].cast("string"), c["bin"].cast("string"), c["raw"])).alias("a"), F.get("before", 0)["i"].alias("k")).collect()
    state = {}
    for r in rows:
        key = (r["table_name"], r["a"][0] if r["a"] else str(r["k"]))
        if r["op"] == 3:
            del state[key]
        else:
            state[key] = {"status": r["a"][1], "total": r["a"][2]}
    assert state
    for r in plan(log).select("statement").collect():
        s = r["statement"]
        table = re.search(r"`shop`\.`(\w+)`", s)[1]
        if s.startswith("DELETE"):
            del state[(table, re.search(r"`id` = (\d+)", s)[1])]
        elif s.startswith("INSERT"):
            k, status, total = re.search(r"VALUES \((\d+), '(\w+)', ([\d.]+)\)", s).groups()
            assert (table, k) not in state
            state[(table, k)] = {"status": status, "total": total}
        else:
            k = re.search(r"WHERE `id` = (\d+)", s)[1]
            for name, value in re.findall(r"`(status|total)` = '?([\w.]+)'?", s.partition(" WHERE ")[0]):
                state[(table, k)][name] = value
    assert state == {}
