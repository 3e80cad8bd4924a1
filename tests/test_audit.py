from textorigin.operators import features as E


def test_audit_report(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("1", 1.0, 2.0, nan, 5.0, 0.0), ("2", 2.0, 2.0, 1.0, inf, 1.0), ("3", None, 2.0, 3.0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "id string, burst_a double, burst_b double, struct_c double, struct_d double, burst_todo double")
    found = E.audit_report(df.withColumnRenamed("burst_todo", "burst_unused"), ["burst_a", "burst_b", "struct_c", "struct_d", "struct_gone"])
    assert found["unused"] == ["burst_unused"] and found["missing"] == ["struct_gone"] and found["constant"] == ["burst_b"]
    assert (found["nan_columns"], found["inf_columns"]) == (2, 1) and found["group_counts"] == {"burstiness": 2, "structure": 2}
    assert found["drop_recommended"] == ["burst_b", "struct_gone"]
    marked = E.audit_report(df, ["burst_a", "burst_todo"], placeholder="todo")
    assert marked["placeholder"] == ["burst_todo"] and marked["drop_recommended"] == ["burst_todo"]
