from evenlend.sources import tables as io


def test_csv_tokens_types_and_unparsable_values(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("a;b;c\n1;x;2.5\n;NA;oops\n 3 ; ;NA\n")
    rows = io.read_table(spark, str(path), "a int, b string, c double", na_values=("", "NA"), sep=";").collect()
    assert [tuple(r) for r in rows] == [(1, "x", 2.5), (None, None, None), (3, None, None)]
    text = io.read_table(spark, str(path), na_values=("", "NA"), sep=";")
    assert dict(text.dtypes) == {"a": "string", "b": "string", "c": "string"}
    inferred = io.read_table(spark, str(path), sep=";")
    assert inferred.columns == ["a", "b", "c"]


def test_id_list_and_scores(spark, tmp_path):
    path = tmp_path / "ids.csv"
    path.write_text("5\n7\n")
    assert [r[0] for r in io.read_id_list(spark, str(path)).collect()] == [5, 7]
    scores = spark.createDataFrame([(1, 0.25, "x")], "k int, score double, other string")
    io.write_scores(scores, str(tmp_path / "scores"), "k")
    assert io.read_table(spark, str(tmp_path / "scores")).columns == ["k", "score"]
    io.write_table(scores, str(tmp_path / "parts"), partition_by=["k"])
    assert io.read_table(spark, str(tmp_path / "parts"), "score double, other string, k int").first()["k"] == 1
