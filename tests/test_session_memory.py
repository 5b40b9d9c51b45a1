import re

import numpy as np

from tuneframe import session


def held() -> int:
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"\nPss_Anon:\s+(\d+)", f.read())[1]) >> 10


def test_a_task_gives_its_freed_memory_back():
    """Small arrays are taken from the heap, which stays with the process while one behind them is held."""

    def run(batches):
        for n in batches:
            rows = [np.ones(1000) for _ in range(n)]
            yield len(rows)

    before = held()
    kept = []
    for n in session.lean(run)(iter([20_000])):
        kept.append(np.ones(1000) * n)
    assert len(kept) == 1 and held() < before + 80
