import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quarry.sinks.writers import export, timestamped_name, write_timestamped
from quarry.sources.files import catalogue, load_folder
from quarry.sources.load import load_source
from quarry.sources.sql import quote_ident, read_jdbc, read_predicates, run_sql, split_name


def test_folder_catalogue(spark, scratch):
    df = spark.createDataFrame([(1, " x"), (2, None)], "id int, ` Comments ` string")
    df.write.parquet(f"{scratch}/20260312154848_output")
    df.toPandas().to_csv(f"{scratch}/notes.csv", index=False)
    df.write.parquet(f"{scratch}/book/Sheet1")
    df.write.parquet(f"{scratch}/book/Sheet2")
    df.write.parquet(f"{scratch}/single/Only")
    open(f"{scratch}/~$lock.csv", "w").write("a\n1\n")
    names = {e.table: e.role for e in catalogue(spark, scratch)}
    assert names == {"20260312154848_output": "primary", "notes": "supplemental",
                     "book__Sheet1": "supplemental", "book__Sheet2": "supplemental",
                     "single": "supplemental"}
    t = load_folder(spark, scratch)
    assert t.table("20260312154848_output").columns == ["id", "Comments"]
    assert t.count_rows("note").first().row_count == 2
    with pytest.raises(ValueError):
        load_folder(spark, scratch, kind="ftp")


def test_quote_ident():
    assert quote_ident(" dbo.Parts ", "sqlserver") == "[dbo].[Parts]"
    assert quote_ident("[dbo].[Parts]", "sqlserver") == "[dbo].[Parts]"
    assert quote_ident('"a]b"', "sqlserver") == "[a]]b]"
    assert quote_ident("db.t.x") == "`db`.`t`.`x`"
    assert quote_ident('"a.b" . [c]]d].`e``f`', "ansi") == '"a.b"."c]d"."e`f"'
    assert split_name(" my table ") == ["my table"]
    for bad in ("", "a.b.c.d", "a..b", "a.", "[a", '"a"b', "a]b.[c"):
        with pytest.raises(ValueError):
            split_name(bad)


def test_jdbc_roundtrip_embedded_derby(spark):
    url = "jdbc:derby:memory:quarrytest;create=true"
    props = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    src = spark.createDataFrame([(i, f"P{i}", "No stock" if i % 2 else "Open WorkOrder")
                                 for i in range(10)], "ID int, PARTNUMBER string, STATUS string")
    src.write.option("createTableColumnTypes", "PARTNUMBER VARCHAR(50), STATUS VARCHAR(200)") \
        .jdbc(url, "PARTS", mode="overwrite", properties=props)
    df = read_jdbc(spark, url, table="PARTS", properties=props, partition_column="ID",
                   lower_bound=0, upper_bound=10, num_partitions=3)
    assert df.rdd.getNumPartitions() == 3
    f = df.where("ID > 2")
    assert "PushedFilters: [*IsNotNull(ID), *GreaterThan(ID,2)]" in \
        f._jdf.queryExecution().executedPlan().toString()
    assert f.count() == 7
    q = read_jdbc(spark, url, query="SELECT STATUS, COUNT(*) AS N FROM PARTS GROUP BY STATUS",
                  properties=props)
    assert {r.STATUS: r.N for r in q.collect()} == {"No stock": 5, "Open WorkOrder": 5}


DERBY = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


def test_sql_tables_in_the_catalogue(spark):
    """Uneven keys with a gap, a heap and nulls: every row is read once, by several tasks of like size."""
    url = "jdbc:derby:memory:quarrycatalogue;create=true"
    keys = [*range(400), *([1_000_000] * 150), *range(2_000_000, 2_000_050), None, None]
    src = spark.createDataFrame([(k, n, f"P{n}", "No stock" if n % 2 else "Open WorkOrder") for n, k in enumerate(keys)],
                                "KEYED long, n int, `Part No` string, STATUS string")
    src.coalesce(1).write.option("createTableColumnTypes", "`Part No` VARCHAR(50), STATUS VARCHAR(200)") \
        .jdbc(url, '"parts.2026"', mode="overwrite", properties=DERBY)
    spark.createDataFrame([("a",), ("b",)], "t string").coalesce(1).write.option("createTableColumnTypes", "t VARCHAR(9)") \
        .jdbc(url, "PLAIN", mode="overwrite", properties=DERBY)

    t = load_source(spark, "JDBC", url, ['"parts.2026"', "APP.PLAIN"], DERBY, tasks=4)
    assert t.roles() == {"parts.2026": "primary", "PLAIN": "primary"}
    df = t.table("parts.2026")
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert df.count() == len(keys) == sum(sizes) and df.select("n").distinct().count() == len(keys)
    assert df.rdd.getNumPartitions() == 5 and sorted(sizes)[1] >= 100 and max(sizes) <= 250, sizes
    assert t.count_rows("parts.2026", "part no", "p17").first().row_count == 1
    assert t.count_rows("parts.2026", "STATUS", "no stok").first().row_count == len(keys) // 2
    assert "PushedFilters: [*IsNotNull(KEYED)" in df.where("KEYED > 7")._jdf.queryExecution().executedPlan().toString()
    assert t.table("PLAIN").count() == 2 and t.table("PLAIN").rdd.getNumPartitions() == 1
    assert read_predicates(spark, url, '"parts.2026"', [], 4, DERBY) == []
    with pytest.raises(ValueError):
        load_source(spark, "jdbc", url, ["APP.PLAIN", "PLAIN"], DERBY)
    with pytest.raises(ValueError):
        load_source(spark, "ftp", url)


def test_run_sql(spark):
    out = run_sql(spark, "select count(*) as n from t1 join t2 using (k)",
                  {"t1": spark.range(5).withColumnRenamed("id", "k"),
                   "t2": spark.range(3).withColumnRenamed("id", "k")})
    assert out.first().n == 3


def test_timestamped_write_never_overwrites(spark, scratch):
    now = datetime(2026, 3, 12, 15, 48, 48)
    assert timestamped_name("output", now) == "20260312154848_output"
    p = write_timestamped(spark.range(3), scratch, "output", now=now)
    assert os.path.basename(p) == "20260312154848_output"
    with pytest.raises(Exception):
        write_timestamped(spark.range(3), scratch, "output", now=now)


def test_export_blank_fill_and_empty(spark, scratch):
    df = spark.createDataFrame([(1, None), (2, "b")], "a int, b string")
    path, rows = export(df, scratch, "parts")
    assert rows == 2 and os.path.basename(path).startswith("parts_")
    back = spark.read.option("header", "true").csv(path).orderBy("a").collect()
    assert [tuple(r) for r in back] == [("1", None), ("2", "b")] or \
        [tuple(r) for r in back] == [("1", ""), ("2", "b")]
    assert export(df.where("a > 5"), scratch, "none") == (None, 0)
