import random

import numpy as np
import pytest

from quarrylens.llm.leaks import Walk, edit_distance, edited, leaks, measured_recall, repetitions_for, words

DOC, ITEM = "doc_id bigint, text string, item_id string", "item_id bigint, suite string, text string"


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], DOC)
    e = spark.createDataFrame([(i, "s", t) for i, t in items], ITEM)
    return sorted(tuple(r) for r in leaks(d, e, **kw).collect())


def brute(docs, items, w):
    grams = lambda t: {tuple(ws[i : i + w]) for ws in [words(t)] for i in range(len(ws) - w + 1)} if t else set()
    return sorted((d, i, 0) for d, x in docs for i, y in items if grams(x) & grams(y))


@pytest.mark.parametrize("limit", [16 << 20, 0])
def test_exact_passages(spark, limit):
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(40)] + ["é", "模型", "x_y"]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, text(30)) for i in range(20)] + [(90, None), (91, ""), (92, text(11)), (93, text(2000))]
    docs = [(i, text(rnd.choice([0, 5, 40, 90]))) for i in range(60)] + [(100, None), (101, "")]
    docs += [(200 + k, f"{text(9)} {' '.join(t.split()[3:16]).upper().replace(' ', '--')} {text(8)}") for k, (_, t) in enumerate(items[:20])]
    docs += [(300, items[23][1] * 20), (301, items[0][1]), (301, items[0][1])]
    got = run(spark, docs, items, broadcast_bytes=limit)
    assert got == sorted(set(brute(docs, items, 12))) and len(got) > 20


@pytest.mark.parametrize("limit", [16 << 20, 0])
def test_edited_passages_are_found(spark, limit):
    rnd = random.Random(4)
    items = [(i, " ".join(f"u{rnd.randrange(5000)}" for _ in range(24))) for i in range(150)]
    docs = []
    for i, t in items:
        ws = t.split()
        for _ in range(rnd.choice([1, 2])):
            ws[rnd.randrange(24)] = "changed"
        docs.append((i, "a b c " + " ".join(ws) + " d e f"))
    got = run(spark, docs, items, window=24, edits=3, broadcast_bytes=limit)
    assert all(d == i and 0 < e <= 3 for d, i, e in got)
    assert len(got) >= 0.9 * len(items)


@pytest.mark.parametrize("window, edits", [(24, 1), (24, 2), (24, 3), (16, 2)])
def test_recall_by_edits_against_all_pairs(spark, window, edits):
    # words changed, left out and put in; the pairs to be found come from comparing all windows
    rng = np.random.default_rng(window * 10 + edits)
    items = [(i, " ".join(f"v{x}" for x in rng.integers(0, 3000, window))) for i in range(250)]
    docs = [(i, " ".join([f"p{j}" for j in range(9)] + edited(t.split(), int(rng.integers(1, edits + 1)), rng) + [f"q{j}" for j in range(9)])) for i, t in items]
    want = set()
    for (i, t), (_, x) in zip(items, docs):
        ws = x.split()
        if min(edit_distance(ws[s : s + window], t.split(), edits) for s in range(len(ws) - window + 1)) <= edits:
            want.add((i, i))
    got = {(d, i) for d, i, _ in run(spark, docs, items, window=window, edits=edits)}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 80


def test_repetitions_follow_the_target():
    few, many = repetitions_for(24, 3, 4, 0.8), repetitions_for(24, 3, 4, 0.99)
    assert few < many
    got = measured_recall(Walk(24, 3, many, 4), 3)
    assert got[many - 1] >= 0.99 > got[many - 2] and got == sorted(got)
    with pytest.raises(ValueError):
        repetitions_for(24, 10, 24, 0.99)


def test_a_window_that_many_share(spark):
    # boilerplate of most documents and of several items, over the join of keys
    boiler = " ".join(f"b{j}" for j in range(12))
    docs = [(i, f"x{i} {boiler} y{i}") for i in range(11_000)]
    got = run(spark, docs, [(1, boiler), (2, f"z {boiler}"), (3, boiler.upper())], broadcast_bytes=0)
    assert got == [(i, j, 0) for i in range(11_000) for j in (1, 2, 3)]


def test_nothing(spark):
    assert run(spark, [], [(1, "a " * 12)]) == [] and run(spark, [(1, "a " * 12)], []) == []


def test_edit_distance():
    rnd = random.Random(5)

    def full(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d = d, [i]
            for j, y in enumerate(b, 1):
                d.append(min(p[j - 1] + (x != y), p[j] + 1, d[-1] + 1))
        return d[-1]

    for _ in range(300):
        a, b = ([rnd.choice("abc") for _ in range(rnd.randrange(9))] for _ in range(2))
        assert edit_distance(a, b, 3) == min(full(a, b), 4)
