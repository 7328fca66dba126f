"""What a Python worker keeps after a task."""

import os
import subprocess
import sys

import pyarrow as pa
import pytest

from opsloom.llm import decontaminate, near_dedup, quality_knn, sentence_sampling, shared

PROBE = """
import sys
import numpy as np
import pyarrow as pa
from opsloom.llm import shared

def resident():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096 >> 20

def run(batches):
    for batch in batches:
        # In Arrow's pool and in the C library's heap, where what is small and lies below something in use stays.
        yield pa.record_batch([pa.array([x * 40 for x in batch.column(0).to_pylist()])], names=["t"])
        held = [np.zeros(30_000, np.uint8) + 1 for _ in range(3000)]
        kept.append(np.zeros(64, np.uint8))

kept = []
batch = pa.record_batch([pa.array([f"{k:08d}" for k in range(200_000)])], names=["t"])
before = resident()
n = sum(b.num_rows for b in shared.lean(run)([batch]))
assert n == batch.num_rows
print(resident() - before)
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/statm"), reason="needs Linux")
def test_freed_memory_goes_back_after_a_task():
    out = subprocess.run([sys.executable, "-c", PROBE], capture_output=True, text=True, check=True).stdout
    assert int(out) < 20


def test_memory_is_given_back_where_a_task_is_left_early(monkeypatch):
    seen = []
    monkeypatch.setattr(shared, "give_back", lambda: seen.append(1))
    step = shared.lean(lambda batches: (b for b in batches))
    assert list(step([1, 2])) == [1, 2] and seen == [1]
    left = step([1, 2])
    assert next(left) == 1
    left.close()
    assert seen == [1, 1]


def test_memory_is_given_back_while_a_long_task_runs(monkeypatch):
    seen, clock = [], iter(range(100))
    monkeypatch.setattr(shared, "give_back", lambda: seen.append(1))
    monkeypatch.setattr(shared.time, "monotonic", lambda: next(clock))
    assert list(shared.lean(iter)(range(6))) == list(range(6)) and len(seen) > 1


@pytest.mark.parametrize("make", [
    lambda spark, docs: near_dedup.near_duplicates(docs),
    lambda spark, docs: quality_knn.score_quality(docs, quality_knn.learn_neighbours(docs.selectExpr("text", "1D AS label"))),
    lambda spark, docs: decontaminate.drop_contaminated(docs, spark.createDataFrame([(1, "a b c")], "item_id long, text string")),
    lambda spark, docs: sentence_sampling.sample_segmentations(docs),
])
def test_every_step_of_the_pipeline_gives_back(spark, monkeypatch, make):
    steps, whole = [], type(spark.range(0)).mapInArrow

    def noted(self, func, *args, **more):
        steps.append(func)
        return whole(self, func, *args, **more)

    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", noted)
    make(spark, spark.createDataFrame([(k, f"some words of text number {k % 2} here") for k in range(4)], "doc_id long, text string")).count()
    assert steps and all(f.__code__ is shared.lean(iter).__code__ for f in steps)
