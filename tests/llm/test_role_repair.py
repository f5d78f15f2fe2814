"""Operator 13: the chart against a plain dynamic program over states, whole and in pieces; and a
conversation that is spread over all tasks."""

import random

import pytest

from nightframe.llm.role_repair import FINAL, WAITING, Chart, repair

MOVES = ((1, (0,), "s"), (2, (0, 1, 3), "u"), (3, (2,), "a"))


def brute(rows):
    def closed(best):
        for _ in range(3):
            for a, b in ((0, 2), (1, 2), (3, 2), (2, 3)):
                if a in best:
                    new = (best[a][0] + 5, best[a][1] + "I")
                    best[b] = min(new, best.get(b, new))
        return best

    best = closed({0: (0, "")})
    for initial, forced, truncated in rows:
        new = {}
        for state, (cost, audit) in best.items():
            reached = [(state, cost + 2, "D")]
            if not forced:
                more = 5 if truncated else 0
                reached += [(to, cost + more, "K") for to, of, t in MOVES if state in of and t == initial]
                reached += [(to, cost + more + 1, "R") for to, of, t in MOVES if state in of and t != "s"]
            for to, c, edit in reached:
                new[to] = min((c, audit + edit), new.get(to, (c, audit + edit)))
        best = closed(new)
    return min(best[s] for s in (0, 3) if s in best)


def parsed(rows, begin=None):
    chart = Chart() if begin is None else Chart(begin)
    for r in rows:
        chart.read(*r)
    return chart


@pytest.mark.parametrize("roles", ["ua", "sua", "suax"])
def test_least_cost_and_audit(roles):
    rng = random.Random(len(roles))
    for _ in range(500):
        rows = [(rng.choice(roles), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 14))]
        assert parsed(rows).best() == brute(rows)
        at, cut = {-1: (0, "")}, rng.randint(0, len(rows))
        for part in (rows[:cut], rows[cut:]):
            reached = {}
            for i, (cost, audit) in at.items():
                for j, (c, a) in parsed(part, None if i == -1 else [i]).steps().items():
                    reached[j] = min((cost + c, audit + a), reached.get(j, (cost + c, audit + a)))
            at = reached
        assert min(at[i] for i in FINAL if i in at) == brute(rows)
        assert set(at) <= set(WAITING)


def test_equal_rows_are_read_at_once():
    one, many = Chart(), Chart()
    one.read("u", False, False)
    many.read("u", False, False)
    one.read("u", True, False, 500)
    for _ in range(500):
        many.read("u", True, False)
    assert one.best() == many.best() == (1002, "D" * 501)


def test_one_conversation_over_all_tasks(spark):
    """Long rows of one role keep two parses apart to the very end; a clashing column is ignored."""
    rows = [(1, t, "user", f"Turn {t}." if t % 7 else "cut", "x") for t in range(3000)] + [(0, 5, "user", "Hi.", "x"), (2, 5, "user", "Hi.", "x")]
    found, edits = repair(spark.createDataFrame(rows, "conv_id int, turn long, role string, text string, c string").repartition(7))
    got = {r.conv_id: r for r in found.collect()}
    texts = set()
    line = []
    for _, _, role, text, _ in rows[:3000]:
        line.append((role[:1], text in texts, text[-1] not in ".!?"))
        texts.add(text)
    assert (got[1].cost, got[1].audit) == parsed(line).best()
    assert got[1].illegal == 2999 and got[1].duplicate == 428 and got[1].truncated == 1
    assert got[0].audit == got[2].audit == "D"
    kept = sorted((r.place, r.role, r.text) for r in edits.where("conv_id = 1 and place is not null").collect())
    assert [r[0] for r in kept] == list(range(len(kept)))
    assert [r[1] for r in kept] == ["user", "assistant"] * (len(kept) // 2)
    assert [r[2] for r in kept if r[2]] == [t for t in dict.fromkeys(r[3] for r in rows[:3000]) if t in {k[2] for k in kept}]
