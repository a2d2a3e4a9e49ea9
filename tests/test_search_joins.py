"""Search: tables of names are never broadcast, however small their files look."""

from ridgeline.operators import search


def test_names_and_terms_are_not_broadcast(spark):
    names = spark.createDataFrame([(1, "red green", 1.0, 2.0), (2, "blue green", 1.0, 2.0)], "id long, name string, km double, prominence double")
    asked = spark.createDataFrame([("red green",), ("blue geren",)], "query string")
    out = search.resolved(asked, names, 5)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") >= 4
    assert sorted((r.query, r.id, r.read_as) for r in out.collect()) == [("blue geren", 2, "blue green"), ("red green", 1, "red green")]
