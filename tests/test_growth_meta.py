"""What the meta document and the facets cost."""

from poolgrade.catalog import base
from poolgrade.plans import publish


def test_meta_people_write_what_is_published(spark, monkeypatch, tmp_path):
    parts = [(i, f"rod {i}", f"Brand#{i % 3}", ["ECONOMY", "PROMO", None][i % 3], [9, 30, 50, None][i % 4]) for i in range(30)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    spark.range(300).selectExpr(
        "id % 28 AS l_partkey", "cast(id % 7 + 1 AS int) AS l_linenumber", "cast(id % 50 AS double) AS l_quantity", "0.06D AS l_discount", "0.01D AS l_tax",
        "'A' AS l_returnflag", "if(id % 5 = 0, 'O', 'F') AS l_linestatus", "make_timestamp(1992, 1, 1, 0, 0, 0) AS l_shipdate",
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    seen = []
    write = base.settle
    monkeypatch.setattr(base, "settle", lambda df, name="stage": seen.append((name, df.columns)) or write(df, name))
    people = base.measured_columns(spark, str(tmp_path), *publish.META_FIELDS)
    assert seen == [("people", list(publish.META_FIELDS))]
    assert people.count() == 30
    want = base.measured(spark, str(tmp_path)).select(*publish.META_FIELDS)
    assert sorted(map(repr, people.collect())) == sorted(map(repr, want.collect()))
