import hashlib
import random
from collections import Counter

from tallyframe.llm import repeats

from .helpers import AWKWARD, EMPTY, documents, prose


def brute(texts, length=200):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(r, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, rows):
    done = repeats.remove_repeats(documents(spark, rows))
    return sorted(repr(tuple(r)) for r in done.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


def test_against_brute_force(spark):
    r = random.Random(7)
    passages = [prose(100 + i, 60) for i in range(4)]
    texts = [t for _, t in AWKWARD]
    for i in range(50):
        t, kind = prose(200 + i, r.randrange(90)), r.randrange(6)
        if kind == 0:
            t += r.choice(passages) + prose(300 + i, 9)
        elif kind == 1:
            t = (r.choice(texts) or "") + "!"
            at = r.randrange(len(t))
            t = t[:at] + "X" + t[at + 2:]
        elif kind == 2:
            t = "ab" * r.randrange(250)
        elif kind == 3:
            p = r.choice(passages)
            at = r.randrange(80)
            t += p[at:at + r.randrange(120, 400)] + "é" + p[at:]
        texts.append(t)
    texts += ["a" * 199, "a" * 200, "a" * 201, "z" * 900]
    rows = [(i, t) for i, t in enumerate(texts)]
    want = sorted(repr((i, *x)) for (i, _), x in zip(rows, brute(texts)))
    assert run(spark, rows) == want
    assert sum(x[1] > 0 for x in brute(texts)) > 15


def test_one_passage_in_most_documents(spark):
    p = prose(1, 70)
    texts = [prose(10 + i, 15) + p + prose(50 + i, 15) for i in range(40)] + [p] * 20
    assert run(spark, list(enumerate(texts))) == sorted(repr((i, *x)) for i, x in enumerate(brute(texts)))


def test_long_texts_are_cut_in_steps(spark, monkeypatch):
    monkeypatch.setattr(repeats, "STEP", 300)
    text = (prose(5, 200) + prose(6, 50) + prose(5, 200)).encode()
    lo, hi, *_ = repeats.anchors(text, 200)
    covered = sorted(x for a, b in zip(lo.tolist(), hi.tolist()) for x in range(a, b + 1))
    assert covered == list(range(len(text) - 199))


def test_empty_and_readable(spark):
    assert run(spark, EMPTY) == []
    docs = documents(spark, [(1, "é" * 150 + prose(1, 20)), (2, "é" * 150 + prose(2, 20)), (3, None), (4, prose(3, 90)), (5, prose(3, 90)), (6, "x")])
    got = {r.doc_id: r for r in repeats.without_repeats(docs).collect()}
    assert repeats.without_repeats(docs).columns == docs.columns
    assert set(got) == {1, 2, 3, 6} and got[3].text is None and got[6].text == "x"
    assert all(r.text is None or r.n_chars == len(r.text) for i, r in got.items() if i != 3)


def test_runs_of_windows_are_single_spans_and_copies_have_one_stand_in(spark):
    """What travels to the texts are runs, not grains."""
    p, q = prose(5, 300), prose(6, 300)
    near, at = [q[:900] + f"<{i}>" + q[900:] for i in range(6)], len(q[:900].encode())
    docs = documents(spark, list(enumerate([p] * 20 + near + [prose(9, 40), "b" * 199])))
    texts = docs.selectExpr("unhex(md5(cast(text AS binary))) AS t", "text", "xxhash64(doc_id) AS u")
    found = repeats.repeated_windows(texts)
    got = sorted(tuple((s.lo, s.hi + 200) for s in r.spans) for r in found.collect())
    assert got == sorted([((0, len(p.encode())),)] + [((0, at + 1), (at + 2, len(t.encode()))) for t in near])
    assert run(spark, [(r.doc_id, r.text) for r in docs.collect()]) == sorted(repr((r.doc_id, *x)) for r, x in zip(docs.collect(), brute([r.text for r in docs.collect()])))


def test_spans_whose_bytes_touch_are_one(spark):
    rows = [(b"a", 5, 9), (b"a", 0, 3), (b"a", 210, 215), (b"a", 7, 8), (b"a", 416, 420), (b"b", 1, 1), (b"a", 0, 3)]
    got = repeats.merged_spans(spark.createDataFrame(rows, "t binary, lo long, hi long"), 200).collect()
    assert {bytes(r.t): [tuple(s) for s in r.spans] for r in got} == {b"a": [(0, 9), (210, 215), (416, 420)], b"b": [(1, 1)]}
