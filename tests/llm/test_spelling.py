"""Operator 12: automata and groups of near words against all pairs; crowded halves; edge cases."""

import random

import pytest

from nightframe.llm import spelling
from nightframe.llm.spelling import Automaton, half, roots, variants


def near(x, y):
    if len(x) > len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def vocabulary(n, seed, letters="abé"):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 8))) for _ in range(n)})


def test_automaton_numbers_and_one_error():
    words = vocabulary(400, 1)
    automaton = Automaton(words)
    for i, w in enumerate(words):
        node, number = automaton.walk(w)
        assert automaton.final[node] and number == i
        for exact in (0, half(len(w)), len(w)):
            want = {k for k, v in enumerate(words) if near(w, v) and v[:exact] == w[:exact]}
            assert automaton.one_error(w, exact) == want
    assert automaton.walk("abx") is None
    assert len(automaton.step) < sum(map(len, words)) / 3  # it is minimal: equal ends are shared
    assert len({(f, tuple((k, t) for k, (t, _) in s.items())) for f, s in zip(automaton.final, automaton.step, strict=True)}) == len(automaton.step)


def brute(counts, factor=2):
    out = {}
    for w, n in counts.items():
        best = sorted((-m, v) for v, m in counts.items() if near(w, v))
        form = best[0][1] if best and -best[0][0] >= factor * n else None
        out[w] = (n, len(best), form, counts[form] if form else None)
    root = lambda w: w if out[w][2] is None else root(out[w][2])
    return {(w, *x, root(w)) for w, x in out.items()}


@pytest.mark.parametrize("crowd", [20_000, 7])
def test_variants(spark, monkeypatch, crowd):
    """With a small HALF, crowded halves are dealt over many shards; ties go to the least word."""
    monkeypatch.setattr(spelling, "HALF", crowd)
    rng = random.Random(2)
    counts = {w: rng.choice([1, 2, 3, 4, 6, 8, 16, 40]) for w in vocabulary(500, 3) + [f"prefix{w}" for w in vocabulary(200, 4)] + [f"{w}suffix" for w in vocabulary(200, 5)]}
    rows = [(w, n, "x") for w, n in counts.items()] + [(None, 9, "x"), ("rare", 1, "x"), ("twice", 1, "x"), ("twice", 2, "x")]
    words = spark.createDataFrame(rows, "word string, times long, form string").repartition(5)
    got = variants(words, n=words.times)
    want = brute({w: n for w, n in counts.items() if n >= 3} | {"twice": 3})
    assert {tuple(r) for r in got.select("word", "n", "n_near", "form", "form_n", "root").collect()} == want


def test_long_ways_end(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(40)]
    assert {r.root for r in roots(spark.createDataFrame(forms, "word string, form string")).collect()} == {"w40"}


def test_long_words_and_no_words(spark):
    long = "ab" * 20_000
    rows = [(long,)] * 3 + [(long + "c",)] * 6 + [("other",)] * 3
    got = {r.word: r for r in variants(spark.createDataFrame(rows, "word string")).collect()}
    assert got[long].root == long + "c" and got[long + "c"].n_near == 1 and got["other"].form is None
    assert variants(spark.createDataFrame([(None,)], "word string")).count() == 0
