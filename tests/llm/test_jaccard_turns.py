"""Operator 6 where groups are divided several times."""

import random
from itertools import combinations

from nightframe.llm import jaccard
from nightframe.llm.components import Union


def test_estimates_do_not_grow_with_the_divisions(spark, monkeypatch):
    """With no pairs tried but after the last division, groups are divided again and again; the
    driver's estimates stay short all the same, and the links are those of all pairs."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(90), rng.randint(1, 5)):
            words[at] = f"x{rng.randint(0, 3)}"
        rows.append((i, " ".join(words)))
    seen, checkpointed = [], jaccard.checkpointed

    def spied(df):
        out = checkpointed(df)
        seen.append(out._jdf.logicalPlan().stats().simpleString())
        assert "E+" not in seen[-1]
        return out

    monkeypatch.setattr(jaccard, "checkpointed", spied)
    monkeypatch.setattr(jaccard, "FEW", 0)
    monkeypatch.setattr(jaccard, "FEW_DIVIDED", 0)
    monkeypatch.setattr(jaccard, "TURNS", 3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    sets = [set(jaccard.tokens(text.encode()).tolist()) for _, text in rows]
    union = Union()
    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both * 100 >= 75 * (len(sets[a]) + len(sets[b]) - both):
            union.join(a, b)
    assert got == {i: (len(s), union.root(i)) for i, s in enumerate(sets)}
    assert len(seen) > 20  # more than one division
