import random

from marlstone.llm.components import GATHERED, _stars, connected_components


def test_matches_union_find(spark):
    r = random.Random(3)
    pairs = [(r.randint(-50, 400), r.randint(-50, 400)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2300)] + [(7, 7), (None, 3), (1000, 1001)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(pairs, "a long, b long")
    assert {(r.node, r.component) for r in connected_components(df, "a", "b").collect()} == {(x, find(x)) for x in root}
    assert connected_components(df.limit(0), "a", "b").count() == 0


def test_stars_of_tasks_and_rounds_agree(spark):
    """Edges go through few jobs if one task can join them; what is too much for it goes through rounds, to the same result."""
    r = random.Random(4)
    pairs = [(r.randint(0, 3000), r.randint(0, 3000)) for _ in range(1400)] + [(i + 1, i) for i in range(5000, 5200)] + [(6000, i) for i in range(6001, 6400)]
    df = spark.createDataFrame(pairs, "a long, b long").repartition(9)
    rows = {x: {(y.node, y.component) for y in connected_components(df, "a", "b", x).collect()} for x in (0, 50, GATHERED)}
    assert rows[0] == rows[50] == rows[GATHERED] and len(rows[0]) == len({i for p in pairs if p[0] != p[1] for i in p})
    few = _stars(df.select("a", "b").toDF("u", "v").coalesce(1), 100)
    assert {(x.node, x.component) for x in connected_components(few, "u", "v").collect()} == rows[0]
    tracker, group = spark.sparkContext.statusTracker(), "components of one task"
    spark.sparkContext.setJobGroup(group, group)
    connected_components(df, "a", "b").count()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup(group)) <= 8
