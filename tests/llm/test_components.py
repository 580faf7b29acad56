from logstrata.llm.components import components


def test_paths_stars_and_none(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 100)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    assert {got[i] for i in range(41)} == {0}
    assert {got[i] for i in [*range(100, 130), 200]} == {100}
    assert components(df.limit(0)).count() == 0
