"""Subset-sum mixing and ranked search against plain Python."""

import math
import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pytest

from tallyframe.llm import lexical, mixing

from .helpers import AWKWARD, documents, prose


# mixing

def plain_targets(sizes, weights, limit):
    """sizes by source: water filled by weight, one source closed after the other."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        rate = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * rate > limit * sizes[s]}
        if not above:
            out.update({s: weight[s] * rate for s in open_})
            break
        for s in above:
            out[s] = float(limit * sizes[s])
            left -= out[s]
        open_ -= above
    return out


def test_lengths_reach_the_nearest_sum():
    r = random.Random(5)
    for _ in range(200):
        lengths = np.array(sorted(r.sample(range(1, 30), r.randrange(1, 5))))
        counts = np.array([r.randrange(1, 4) for _ in lengths])
        sums = {int(np.dot(k, lengths)) for k in product(*[range(c + 1) for c in counts])}
        for budget in range(int((lengths * counts).sum()) + 1):
            # what an even share takes outright is given; the programme must reach the best sum beyond it
            taken = mixing.fit_lengths(lengths, counts, budget)
            assert (taken <= counts).all() and (taken >= 0).all()
            share = np.array([int(c) * budget // int((lengths * counts).sum()) for c in counts])
            best = min(abs(int(np.dot(k, lengths)) - budget) for k in product(*[range(int(a), int(c) + 1) for a, c in zip(share, counts, strict=True)]))
            assert abs(int((taken * lengths).sum()) - budget) == best
        assert max(sums) == int((lengths * counts).sum())


def test_many_lengths_fit_exactly():
    rng = np.random.default_rng(1)
    lengths = np.arange(1, 4001)
    counts = rng.integers(1, 50, 4000)
    for budget in (123_456_789, 10_000_001, 77, 0):
        assert int((mixing.fit_lengths(lengths, counts, budget) * lengths).sum()) == budget


@pytest.fixture
def sourced(spark):
    r = random.Random(9)
    rows = [(i, "w " * r.choice([0, 1, 2, 3, 5, 8, 200]), r.choice(["a", "a", "a", "a", "b", "é", None, "z"])) for i in range(600)]
    rows += [(None, "x y", "a"), (None, "x y", "a"), (700, None, "b"), (701, " \n\t\x0b", "void"), (702, "word " * 2_000, "a"), (703, "tiny", "one")]
    return rows, spark.createDataFrame([(*r, 1, 2, "t", 3) for r in rows], "doc_id long, text string, source string, rank int, n int, target string, size int")


def test_mix_meets_targets(spark, sourced):
    rows, df = sourced
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^ \t-\r]+", t or ""))
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((i, s, size(t)) for i, t, s in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    want = plain_targets(sizes, (5, 2, 1), 3)
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source], rel=1e-12) and r.source_size == sizes[r.source]
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1, s
    again = mixing.mix(df.repartition(5)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_long_text_beside_short_ones(spark):
    """Copies of the short texts come nearer to the target than the long one."""
    rows = [(1, "w " * 1000, "a"), (2, "w " * 100, "a"), (3, "w " * 101, "a"), (4, "w " * 9000, "b")]
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 20)).collect()}
    assert got[1].target == pytest.approx(10201 / 21) and [got[i].copies for i in (1, 2, 3)] == [0, 3, 2]  # 502, 16 above
    assert got[4].taken == 9000


def test_mix_of_nothing(spark, sourced):
    _, df = sourced
    assert mixing.mix(df.limit(0)).collect() == []
    empty = mixing.mix(df.filter("doc_id = 701")).collect()
    assert [(r.target, r.taken) for r in empty] == [(0.0, 0)]


# search

def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, total = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b, n in bags:
            m = 100 - 90 + (90 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * b[t]) // (1000 * b[t] + 8 * m)) for t in set(terms(text)) if b[t])
            if score > 0:
                scored.append((-score, i is not None, i, score))
        out += [(item, rank, i, s) for rank, (_, _, i, s) in enumerate(sorted(scored)[:k], 1)]
    return out


def same(got, want):
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("bucket", [1024, 3])
def test_search_equals_plain(spark, bucket, monkeypatch):
    monkeypatch.setattr(lexical, "BUCKET", bucket)
    monkeypatch.setattr(lexical, "SEEDS", bucket)
    docs = [*AWKWARD, *[(i + 100, prose(i, 5 + i % 70)) for i in range(300)], (900, "ÀÉ Àé É1 x_y"), *[(1000 + i, prose(7, 40)) for i in range(25)]]
    items = [(1, prose(7, 12)), (2, "River stone, 42!"), (3, None), (4, ""), (5, "unknownword"), (6, "àé É1"), (None, "market"), (7, "the the THE of"), (8, prose(7, 12))]
    df = documents(spark, docs)
    bench = spark.createDataFrame([(*i, 5, "t") for i in items], "item_id long, text string, score int, terms string")
    same(lexical.search(df, bench, 10).collect(), plain_search(docs, items, 10))
    same(lexical.search(df.repartition(7), bench, 2).collect(), plain_search(docs, items, 2))


def test_search_of_nothing(spark):
    empty, bench = documents(spark, []), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(empty, bench).collect() == []
    assert lexical.search(documents(spark, AWKWARD), bench.limit(0)).collect() == []
    blank = documents(spark, [(1, None), (2, ". ! \n")])
    assert lexical.search(blank, bench).collect() == []


def test_coordinate_bounds_keep_all_that_can_win(spark):
    """No document whose exact score reaches the floor is filtered, and long queries do filter some."""
    import pyarrow as pa

    r = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(r.choices(words, weights=[1 / (j + 1) for j in range(60)], k=r.randrange(3, 80)))) for i in range(200)]
    counted = lexical.count_terms(documents(spark, docs), sorted(words))
    n, total = 200, sum(len(terms(t)) for _, t in docs)
    q = lexical.Queries([" ".join(words[5:40]), "w59 w3"], sorted(words), n, total, lexical.document_frequencies(counted, 60))
    table = lexical.with_length(counted, q).toArrow().combine_chunks().to_batches()[0]
    bucket, cut = lexical.Bucket(table, q), 0
    for row in q.rows:
        exact = bucket.scores(q, row, np.arange(200))
        for least in np.quantile(exact, [0.5, 0.9, 0.99]):
            left = set(bucket.survivors(q, row, least).tolist())
            assert {int(i) for i in np.flatnonzero(exact >= least)} <= left
            cut += 200 - len(left)
    assert cut and isinstance(table, pa.RecordBatch)
