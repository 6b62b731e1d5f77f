import random
from datetime import datetime, timedelta

import pytest

from tests import naive
from tests.rows import same_rows
from typeflow.operators.intervals import inter_key_interval


@pytest.mark.parametrize("seed", range(3))
def test_intervals_equal_lag(keys, seed):
    rng = random.Random(seed)
    t, rows = datetime(2024, 1, 1), []
    for _ in range(400):
        t += timedelta(seconds=rng.choice([0, 0, 0, 1, 599, 600, 601, 5000, 100_000]))
        rows.append((t, "hot" if rng.random() < 0.34 else rng.choice(["a", "b", None])))
    kev = keys(rows).cache()
    for by in ([], ["App"]):
        same_rows(inter_key_interval(kev, by), naive.inter_key_interval(kev, by), ["event_id", "App", "interval_us"])


def test_copies_of_one_moment(keys):
    moment = datetime(2024, 1, 1)
    rows = inter_key_interval(keys([(moment - timedelta(seconds=2), "a")] + [(moment, "a")] * 50)).collect()
    by_id = {r.event_id: r.interval_us for r in rows}
    assert by_id[0] is None and by_id[1] == 2_000_000 and all(by_id[i] == 0 for i in range(2, 51))
