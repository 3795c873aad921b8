import random

import pytest

from weftmark.llm.common import Workspace
from weftmark.llm.components import components


def plain(edges):
    of = {i: i for edge in edges for i in edge}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            changed |= of[a] != of[b]
            of[a] = of[b] = min(of[a], of[b])
    return of


def graphs():
    rng = random.Random(6)
    chain = [(i, i + 1) for i in range(100, 160)]
    rng.shuffle(chain)
    star = [(1000 + i, 1200) for i in range(400)]
    tree = [(2000 + i, 2000 + rng.randrange(i)) for i in range(1, 300)]
    return [*chain, *star, *tree, *((rng.randrange(-50, 50), rng.randrange(-50, 50)) for _ in range(60))]


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_one_task_and_rounds_give_the_same(spark, most):
    edges = graphs()
    linked = [(a, b) for a, b in edges if a != b]
    df = spark.createDataFrame([*edges, *edges[:50], *((b, a) for a, b in edges[:50]), (None, 1), (7, None), (9999, 9999)], "a long, b long")
    found = components(df, Workspace(spark, "test-both"), one_task_most=most).collect()
    assert len(found) == len({r.node for r in found}) and {r.node: r.component for r in found} == plain(linked)
    assert components(df.limit(0), Workspace(spark, "test-none"), one_task_most=most).count() == 0


def test_few_edges_take_few_tasks(spark):
    """Whatever the number of shuffle partitions: the driver keeps a record of each task."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    df, context = spark.createDataFrame(graphs(), "a long, b long"), spark.sparkContext
    try:
        for (k, _), v in zip(held.items(), ("60", "false")):
            spark.conf.set(k, v)
        context.setJobGroup("few-edges", "")
        assert components(df, Workspace(spark, "test-few")).count() == len(plain([(a, b) for a, b in graphs() if a != b]))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in held.items():
            spark.conf.set(k, v)
    track = context.statusTracker()
    stages = {s for job in track.getJobIdsForGroup("few-edges") for s in track.getJobInfo(job).stageIds}
    assert 0 < sum(track.getStageInfo(s).numTasks for s in stages if track.getStageInfo(s)) < 60
