"""Near-duplicate classes in few tasks: with many shuffle partitions a job over small tables is as long as its tasks are many."""

import uuid

import numpy as np
import pytest

from mercantile.llm import components, near_dedup
from mercantile.sources.scratch import Scratch
from tests.llm import brute

PARTITIONS = 23


@pytest.fixture()
def tasks(spark):
    """A function to a job's result and its number of tasks."""
    held = {"spark.sql.shuffle.partitions": str(PARTITIONS), "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)

    def run(job):
        context, group = spark.sparkContext, uuid.uuid4().hex
        context.setJobGroup(group, group)
        out = job()
        context.setLocalProperty("spark.jobGroup.id", None)
        context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        tracker = context.statusTracker()
        jobs = [x for x in map(tracker.getJobInfo, tracker.getJobIdsForGroup(group)) if x]
        stages = {s for x in jobs for s in x.stageIds}
        return out, sum(x.numCompletedTasks for x in map(tracker.getStageInfo, stages) if x)

    yield run
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_components_take_few_tasks_a_round(spark, tmp_path, tasks):
    edges = [(100, k) for k in range(40)] + [(101, k) for k in range(38, 80)] + [(300, 200), (5, 5)]
    store = Scratch(spark, str(tmp_path))
    table = store.store(spark.createDataFrame(edges, "a long, b long").coalesce(1), "given")
    got, n = tasks(lambda: [tuple(r) for r in components.connected_components(table, store).collect()])
    assert sorted(got) == [(k, 0) for k in [*range(80), 100, 101]] + [(200, 200), (300, 200)]
    # Two rounds of four shuffles with their test, and the roots; there were three rounds of eight.
    assert n < 14 * PARTITIONS


@pytest.mark.parametrize("edges", [[], [(3, 3)], [(2, 1), (1, 2), (1, 2)], [(k, k + 1) for k in range(30)], [(k, 31 - k) for k in range(31)]])
def test_components_of_small_graphs(spark, tmp_path, edges):
    store = Scratch(spark, str(tmp_path))
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), store).collect()}
    roots = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in roots:
        for a, b in edges:
            if a != b:
                roots[a] = roots[b] = min(roots[a], roots[b])
    assert got == roots


def test_texts_are_read_twice(spark, tasks):
    """Once for signatures and once for the texts of what may be near, however many steps compare them."""
    rng = np.random.default_rng(5)
    words = [f"w{x}" for x in range(400)]
    centre = [words[x] for x in rng.integers(0, 400, 60)]
    rows = [[words[rng.integers(400)] if rng.random() < share else w for w in centre] for share in (0.0, 0.01, 0.02, 0.03, 0.04, 0.06) for _ in range(12)]
    rows += [centre[: int(60 * part)] for part in np.linspace(0.4, 1, 15)] + [centre[int(60 * part) :] for part in np.linspace(0, 0.6, 15)]
    rows = [(i, " ".join(row)) for i, row in enumerate(rows)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).mapInArrow(counted, "doc_id long, text string")
    got, n = tasks(lambda: sorted(map(tuple, near_dedup.near_duplicates(table).collect()), key=str))
    assert got == sorted(brute.classes(rows), key=str)
    assert read.value == 2 * len(rows)
    assert n < 110 * PARTITIONS
