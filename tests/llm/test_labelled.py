from vellumdex.llm.labelled import labelled_sample


def test_sample_is_bounded_whatever_repeats(spark):
    rows = [("a", k, f"text {k}") for k in range(50)] + [("a", 7, "copied")] * 300 + [("b", None, "x"), ("b", 1, ""), ("b", 2, None), (None, 3, "y"), ("b", 4, "z" * 100)]
    df = spark.createDataFrame(rows, "label string, doc_id bigint, text string").repartition(5)
    got = labelled_sample(df, 10, 50)
    assert len([x for x in got if x[0] == "a"]) == 10 and [x for x in got if x[0] == "b"] == [("b", "x")] and len(set(got)) == len(got)
    assert got == labelled_sample(df.repartition(3), 10, 50)
    assert len(labelled_sample(df, 1000, 50)) == 52 and labelled_sample(df.limit(0), 10, 50) == []
