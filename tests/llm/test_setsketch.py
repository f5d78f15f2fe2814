"""Operator 11: registers, the estimate, and groups of near copies against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from nightframe.llm import jaccard, setsketch
from nightframe.llm.setsketch import BANDS, MARGIN, band_keys, estimate, likely, merged, near_duplicates, registers

RNG = np.random.default_rng(4)


def hashes(n):
    return np.sort(RNG.integers(0, 1 << 48, n, np.uint64))


def test_registers_merge_and_do_not_depend_on_slices(monkeypatch):
    x, y = hashes(900), hashes(70)
    one = registers([x, y, np.union1d(x, y)])
    assert (merged(one[0], one[1]) == one[2]).all()
    monkeypatch.setattr(setsketch, "SLICE", 64)
    assert (registers([x, y, np.union1d(x, y)]) == one).all()


def pair(n, similarity):
    shared = round(2 * n * similarity / (1 + similarity))
    both = hashes(shared)
    return np.union1d(both, hashes(n - shared)), np.union1d(both, hashes(n - shared))


def test_estimate_candidates_and_margin():
    for similarity in (0.3, 0.6, 0.8, 0.95):
        pairs = [pair(300, similarity) for _ in range(200)]
        x, y = (registers([p[i] for p in pairs]) for i in (0, 1))
        n = np.full(len(pairs), 300)
        got, _ = estimate(x, y, n, n)
        assert abs(got.mean() - similarity) < 0.02 and got.std() < 0.06
        if similarity >= 0.8:
            assert likely(x, y, n, n, 80, 100).all()
            assert (band_keys(x) == band_keys(y)).any(axis=1).all()
        if similarity == 0.3:
            assert not likely(x, y, n, n, 80, 100).any()
    assert BANDS * 4 == 128 and MARGIN == 18
    assert not likely(*registers([hashes(10), hashes(100)]).reshape(2, 1, -1), np.array([10]), np.array([100]), 80, 100).any()


def brute(rows, k=2):
    def shingles(t):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()  # the texts have no other spaces
        return {tuple(w[i : i + min(k, len(w))]) for i in range(max(len(w) - k + 1, min(len(w), 1)))}

    sets = [(d, shingles(t)) for d, t in rows]
    root = {d: d for d, _ in sets if d is not None}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (d, x) in enumerate(sets):
        for e, y in sets[:i]:
            if d is not None and e is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return sorted((str(d), len(x), str(None if d is None else find(d))) for d, x in sets)


def test_groups(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate([None, "", " \n", "one", "One", "a b", "A b", "b a", "x" * 50_000, " ".join(words * 60)])]
    for i in range(260):  # near copies of one text, some too far from all others
        copy = list(base)
        for _ in range(rng.choice([0, 1, 3, 6, 9, 12, 20])):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((1000 - i, " ".join(copy)))
    rows += [(2000 + i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(60)]
    rows += [(None, rows[20][1]), (rows[30][0], rows[2][1]), (rows[31][0], rows[31][1])]
    docs = spark.createDataFrame([(d, t, 1, "b") for d, t in rows], "doc_id long, text string, n int, print string").repartition(5)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in near_duplicates(docs).collect())
    assert got == brute(rows)
    assert near_duplicates(docs.where("false")).count() == 0


def test_members_of_a_hub_are_in_several_tasks(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{rng.randrange(900)}" for _ in range(60)]
    copy = lambda: " ".join(rng.choice(["x", "y"]) + str(rng.randrange(10**6)) if rng.random() < 0.1 else w for w in base)
    rows, tasks, checkpointed = [(i, copy()) for i in range(400)], [], jaccard.checkpointed

    def seen(df):
        df = checkpointed(df)
        if {"hub", "tokens", "excess"} <= set(df.columns):
            tasks.append(df.withColumn("task", F.spark_partition_id()).groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("task").alias("tasks")).collect())
        return df

    monkeypatch.setattr(jaccard, "checkpointed", seen)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    finally:
        spark.conf.unset(coalesce)
    assert got == brute(rows)
    assert max((r.n, r.tasks) for r in tasks[0])[0] > 200
    assert max((r.n, r.tasks) for r in tasks[0])[1] >= 3


def test_a_hubs_tokens_are_not_rows():
    """What members differ in is asked for in packed messages, and comes back as counted one by one."""
    rng = random.Random(12)
    members = [(7, i % 3, 100 + i, 50, 100 + i // 2, i - 10, i % 4 > 0, 2 + i % 3, None if i % 4 == 0 else 1 + i % 2, sorted(rng.sample(range(400), rng.randrange(0, 60)))) for i in range(40)]
    names = ["hub", "deal", "doc", "n", "c", "excess", "far", "with_far", "with_near", "tokens"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    table = pa.table([pa.array(x, t) for x, t in zip(zip(*members), types)], names).append_column("slices", pa.array([5] * len(members), pa.int32()))
    asked = pa.Table.from_batches(list(jaccard._asked(iter(table.to_batches(max_chunksize=9)))))
    assert asked.num_rows < sum(len(m[-1]) for m in members) / 4
    told = [jaccard._often((pa.scalar(7), pa.scalar(s)), asked.filter(pc.equal(asked["slice"], s))) for s in range(5)]
    told = pa.concat_tables(told)
    got = []
    for deal in range(3):
        mine, replies = (x.filter(pc.equal(x["deal"], deal)) for x in (table, told))
        got += jaccard._placed((pa.scalar(7), pa.scalar(deal)), mine, replies).to_pylist()

    have = {t: [m for m in members if t in m[-1]] for t in range(400)}
    often = {t: len(ms) for t, ms in have.items() if len({m[4] for m in ms}) > 1 and any(m[6] for m in ms)}
    want = []
    for _, _, doc, n, _, excess, far, with_far, with_near, tokens in members:
        shared = sorted((often[t], t) for t in tokens if t in often)
        for k, (_, t) in enumerate(shared):
            room = len(shared) - k
            kinds = ([0] if room >= with_far else []) + ([1] if room >= with_near else []) if far else ([1] if room >= with_far else [])
            want += [dict(hub=7, token=t, doc=doc, n=n, excess=excess, room=room, far=far, kind=kind) for kind in kinds]
    order = lambda rows: sorted(tuple(r.items()) for r in rows)
    assert want and order(got) == order(want)
