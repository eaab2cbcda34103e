"""How much the search for the capacity brings to the driver, and in how many jobs."""

import hashlib
import random

import pytest
from test_llm_small import smallest_capacity

from densityflow.llm import sharding


@pytest.mark.parametrize("copies", [0, 20])
def test_rows_on_the_driver_are_bounded(spark, monkeypatch, copies):
    for name, value in (("PER_BLOCK", 4), ("DIGITS", 2), ("MOST_BLOCKS", 600), ("HEAVY", 64)):
        monkeypatch.setattr(sharding, name, value)
    r = random.Random(copies)
    sizes = [r.randint(1, 500) for _ in range(20_000)]
    sizes += [sum(sizes[:20_000]) // 5 + k for k in range(copies)]
    rows = [(hashlib.md5(str(k).encode()).hexdigest(), s) for k, s in enumerate(sizes)]
    table = spark.createDataFrame(rows, "gid string, size long").repartition(4).cache()
    brought = []
    sums = sharding.Order._sums
    monkeypatch.setattr(sharding.Order, "_sums", lambda self, df, n: brought.append(sums(self, df, n)) or brought[-1])
    capacity, starts, heavy = sharding.minimax_cuts(table, 8)
    table.unpersist()
    order = sorted((("0" if g in set(heavy) else "1") + g, s) for g, s in rows)
    assert capacity == smallest_capacity([s for _, s in order], 8)
    of = [0] * 8
    for g, s in order:
        of[sum(g >= k for k in starts)] += s
    assert max(of) == capacity
    assert len(brought) <= 5
    assert max(map(len, brought)) <= max(600, 16 * 256)
    assert sum(map(len, brought)) < len(rows) / 2
