"""Two passes in rounds against a pass in order."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from nightframe.operators.carry import two_passes


def in_order(rows, near):
    """rows: batch, pos, ts, solved, fov. As one does it frame by frame."""
    out, rounds = {}, 0
    for batch in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == batch), key=lambda r: r[1])
        fovs = sorted(r[4] for r in own if r[3])
        median = fovs[len(fovs) // 2] if fovs else None
        state = {r[1]: r[4] for r in own if r[3]}
        when = {r[1]: r[2] for r in own}
        for _, pos, ts, solved, fov in own:
            if solved:
                out[batch, pos] = (1, True, None)
                continue
            dated = [(abs(when[p] - ts), p) for p in state if ts and when[p]]
            source = min(dated)[1] if dated else min(state, default=None)
            hint = state[source] if source is not None else median
            good = near(fov, hint)
            out[batch, pos] = (2, good, source)
            if good:
                state[pos] = fov
    return out


@pytest.mark.parametrize("share", [0.9, 0.5, 0.0])
def test_rounds_equal_a_pass_in_order(spark, share):
    """share: of the frames that the first pass solves. Times tie, are missing, and do not follow the files' order."""
    rng = random.Random(int(share * 10))
    start, rows = datetime(2024, 1, 1), []
    for batch in range(3):
        for pos in rng.sample(range(1000), 14 if share else 5):
            ts = None if rng.random() < 0.15 else start + timedelta(seconds=rng.choice([pos, rng.randint(0, 1000), 500]))
            rows.append((batch, pos, ts, rng.random() < share, float(rng.randint(0, 60))))
    near = lambda fov, hint: fov >= 30 if hint is None else abs(fov - hint) <= 15
    frames = spark.createDataFrame(rows, "batch long, pos long, ts timestamp, solved boolean, fov double").withColumn("seen", F.col("fov"))

    def resolve(ready):
        hint = F.coalesce("hint_seen", "hint_fov")
        good = F.when(hint.isNull(), F.col("fov") >= 30).otherwise(F.abs(F.col("fov") - hint) <= 15)
        return ready.select("batch", "pos", good.alias("solved"), "fov", "seen")

    got = {(r.batch, r.pos): (r["pass"], r.solved, r.source) for r in two_passes(frames, resolve, ["seen"]).collect()}
    assert got == in_order(rows, near)
