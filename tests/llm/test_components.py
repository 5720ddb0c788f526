"""Connected components against union-find, and how many tasks small graphs take."""

import random

import pytest

from stratafs.llm.components import components


def brute(links):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {x: root(x) for x in parent}


def graphs():
    rng = random.Random(5)
    names = rng.sample(range(10_000), 200)
    return {
        "none": [],
        "loops and nulls": [(1, 1), (None, 2), (3, None)],
        "one link, repeated and turned": [(7, 3), (3, 7), (7, 3)],
        "stars": [(x, x % 5) for x in range(5, 60)],
        "chain in random order": list(zip(names[:60], names[1:61])),
        "hub that is not the least": [(names[0], x) for x in names[1:]],
        "hubs of over 1,000, one of them the least": [(0, x) for x in range(10, 1300)] + [(5, x) for x in range(1200, 2500)] + [(3000, x) for x in range(2400, 3000)],
        "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(None, 1), (9, 9)],
    }


@pytest.mark.parametrize("name", graphs())
def test_components(spark, name):
    links = graphs()[name]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["root"] for r in got} == brute(links)


def tasks_of(spark, run):
    """What run gives, and the number of tasks that its jobs had."""
    spark.sparkContext.setJobGroup("counted", "counted")
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    told = spark.sparkContext.statusTracker()
    jobs = [told.getJobInfo(j) for j in told.getJobIdsForGroup("counted")]
    stages = {s for j in jobs for s in j.stageIds}
    return out, sum(told.getStageInfo(s).numCompletedTasks for s in stages if told.getStageInfo(s))


def test_few_links_take_few_tasks_with_many_partitions(spark):
    """The driver keeps something of every task, so rounds over a few links mustn't multiply the partitions."""
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    links = list(zip(range(40), range(1, 41)))
    df = spark.createDataFrame(links, "a long, b long")
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got, tasks = tasks_of(spark, lambda: components(df).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r["node"]: r["root"] for r in got} == brute(links)
    assert 0 < tasks < 64 * 80
