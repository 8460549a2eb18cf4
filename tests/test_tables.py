import pytest
from pyspark.sql import functions as F

from quillmat.operators import tables as t
from quillmat.order import numbered


TOWNS = ["oslo", "bern", "riga", "lima", "doha", "kiev", "rome", "male", "suva", "baku"]
POINTS = [7, 3, 9, 0, 12, 5, 8, 2, 11, 6]


def base(spark):
    return t.create_table(spark, town=TOWNS, points=POINTS, river=list("qwertyuiop"))


def test_names_and_columns(spark):
    b = base(spark)
    assert t.names(b) == ["town", "points", "river"] and t.id_name(b) == "town" and t.shape(b) == (10, 3)
    assert t.value_name(t.annotation(b, "points")) == "points"
    with pytest.raises(ValueError):
        t.value_name(b)
    assert t.names(t.get_columns(b, "river", 0)) == ["river", "town"]
    with pytest.raises(KeyError):
        t.get_columns(b, "nope")
    assert t.column_data(b, "points") == POINTS


def test_add_and_bind_columns(spark):
    b = base(spark)
    assert t.column_data(t.add_column(b, "z", F.col("points") + 1), "z")[:2] == [8, 4]
    with pytest.raises(ValueError):
        t.add_column(b, "points", F.lit(1))
    with pytest.raises(ValueError):
        t.add_column(b, "z", t.create_table(spark, z=[1, 2]))
    more = t.create_table(spark, bridges=list(range(10)), mayor=list("asdfghjklz"))
    assert t.column_data(t.hcat(b, more), "mayor") == list("asdfghjklz")
    with pytest.raises(ValueError):
        t.hcat(b, b)


def test_left_join_takes_first_match_and_matches_null(spark):
    left = t.create_table(spark, id=["a", None, "b", "a"], x=[1, 2, 3, 4])
    right = t.create_table(spark, id=["a", "a", None, "c"], z=[10, 11, 12, 13])
    out = t.left_join(left, right).orderBy("ord").collect()
    assert [r.z for r in out] == [10, 12, None, 10] and [r.x for r in out] == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        t.left_join(left, right.withColumnRenamed("id", "key"))
    with pytest.raises(ValueError):
        t.left_join(left, right.withColumnRenamed("z", "x"))


def test_lookup_modes(spark):
    b, want = base(spark), t.create_table(spark, town=["riga", "gone", "oslo"])
    with pytest.raises(KeyError, match="gone"):
        t.lookup(want, b)
    assert t.column_data(t.lookup(want, b, missing="skip"), "town") == ["riga", "oslo"]
    assert t.column_data(t.lookup(want, b, missing="nothing"), "points") == [9, None, 7]


def test_rows(spark):
    b = base(spark)
    assert t.column_data(t.at_positions(b, [9, 0, 4]), "town") == ["baku", "oslo", "doha"]
    assert t.column_data(t.repeat_rows(t.create_table(spark, id=["a", "b"]), 2, 2)) == list("aabbaabb")
    assert t.single(b, F.col("points") == 9).count() == 1
    with pytest.raises(ValueError):
        t.single(b, F.col("points") > 9)
    both = t.concat(b, t.create_table(spark, town=["new"], w=[1]))
    assert t.column_data(both, "w") == [None] * 10 + [1]
    assert t.column_data(t.distinct_values(t.create_table(spark, id=[1, 2, 3, 4], g=["q", None, "p", "q"]), "g"), "g") == ["q", "p"]
    assert [r.n for r in numbered(spark.range(100).repartition(7), F.col("id").desc(), to="n").orderBy(F.col("id").desc()).collect()] == list(range(100))


def test_scalars_of_columns(spark):
    from quillmat.operators import tables

    t = spark.createDataFrame([(1, 2.0, None), (1, 3.0, None), (1, None, None)], "a long, b double, c string")
    assert tables.all_equal(t, "a") and not tables.all_equal(t, "b") and tables.all_equal(t, "c") and tables.all_equal(t.limit(0), "b")
    assert tables.largest(t, "b") == 3 and tables.largest(t, "c") is None and tables.product_of(t, "b") == 6 and tables.product_of(t.limit(0), "b") == 1


def test_a_folder_of_files_is_numbered_by_name(spark, tmp_path):
    from quillmat.sources import readers

    for name, n in (("a", 3), ("b", 50_000), ("c", 10)):
        (tmp_path / f"{name}.csv").write_text("id,x\n" + "".join(f"{name}{i},{i}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 50_000)
    try:
        t = readers.load_csv(spark, str(tmp_path), schema="id string, x long")
        assert t.rdd.getNumPartitions() > 4 and t.columns == ["id", "x", "ord"]
        assert [r.id for r in t.orderBy("ord").collect()] == [f"a{i}" for i in range(3)] + [f"b{i}" for i in range(50_000)] + [f"c{i}" for i in range(10)]
        assert t.agg({"ord": "max"}).first()[0] == 50_012
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_keys_of_several_parts_keep_apart(spark):
    from quillmat.sources import readers

    rows = [("a|b", ""), ("a", "b|"), ("a", "b"), ("a\\", "b"), ("a", "\\|b"), ("a|b", "x")]
    var, key = readers._named(spark.createDataFrame(rows, "id string, kind string"), ("id", "kind"))
    keys = {(r.id, r.kind): r[key] for r in var.collect()}
    assert len(set(keys.values())) == len(rows) and keys["a", "b"] == "a|b"


def test_same_as_looks_at_symbolic_terms(spark):
    from quillmat.operators import design
    from tests.test_matrix import matrix

    d = matrix(spark)
    one, two = design.normalize(d), design.normalize(d, "value")
    assert one.same_as(one) and not one.same_as(two) and not one.same_as(d) and not d.same_as(two)


def test_matched_pairs_are_dealt_to_tasks(spark, monkeypatch):
    """Pairs of rows that agree grow by the square of copies; a task makes about as many as it may, a crowd of equal rows is cut into blocks."""
    left = spark.range(300).selectExpr("id AS k", "if(id < 120, 'hot', if(id < 130, null, string(id % 9))) AS x", "CAST(if(id < 130, null, id % 4) AS INT) AS y", "id AS ord")
    right = spark.range(260).selectExpr("id AS k", "if(id < 90, 'hot', if(id < 105, null, string(id % 7))) AS x", "CAST(if(id < 105, null, id % 4) AS BIGINT) AS y", "id AS ord")
    same = lambda a, b: a.x == b.x and a.y == b.y
    want = sorted((a.ord, b.ord) for a in left.collect() for b in right.collect() if same(a, b))
    assert sorted(map(tuple, t.match_columns(left, right, ["x", "y"]).collect())) == want
    monkeypatch.setattr(t, "PAIRS", 500)
    monkeypatch.setattr(t, "SIDE", 10)
    monkeypatch.setattr(t, "MOST_TASKS", 64)
    for threshold in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            out = t.match_columns(left, right, ["x", "y"])
            assert sorted(map(tuple, out.collect())) == want
            assert max(out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) < len(want) / 4
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert t.match_columns(left.limit(0), right, ["x", "y"]).count() == 0
