"""Conversation repair against a plain search over all edits, on rows with every awkward case."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tallyframe.llm import conversations

SPACES = " \t\n\x0b\x0c\r"
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
NAMES = {"u": "user", "a": "assistant"}


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACES)
        out.append("b" if not bare else "d" if (role, text) in seen else "-" if bare[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """(cost, audit, repaired rows): every state's best whole string of edits, compared as strings."""
    best = {"": (0, "", [])}

    def put(into, state, value):
        if state not in into or value[:2] < into[state][:2]:
            into[state] = value
            return True
        return False

    def inserted(front):
        front, todo = dict(front), list(front)
        while todo:
            state = todo.pop()
            cost, audit, out = front[state]
            for c, name in NAMES.items():
                if c in NEXT[state] and put(front, NEXT[state][c], (cost + 5, audit + "I", [*out, (name, "")])):
                    todo.append(NEXT[state][c])
        return front

    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for state, (cost, audit, out) in inserted(best).items():
            put(new, state, (cost + 2, audit + "D", out))
            if fault in "bd":
                continue
            extra = 5 if fault == "t" else 0
            if role[:1] in NEXT[state]:
                put(new, NEXT[state][role[:1]], (cost + extra, audit + "K", [*out, (role, text)]))
            for c, name in NAMES.items():
                if c in NEXT[state]:
                    put(new, NEXT[state][c], (cost + extra + 1, audit + "R", [*out, (name, text)]))
        best = new
    return min((v for k, v in inserted(best).items() if k in ("", "a")), key=lambda v: v[:2])


def plain_audit(rows):
    faults = faults_of(rows)
    cost, audit, out = cheapest(rows, faults)
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def talk(seed, n_convs, long_one):
    r, rows = random.Random(seed), []
    for conv in [*range(n_convs), None]:
        n = r.choice([1, 2, 3, 5, 8, 25])
        for turn in [*r.sample(range(-2, 2 * n + 2), n), *([None] if r.random() < 0.2 else [])]:
            rows.append((conv, turn, r.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]),
                         r.choice([None, "", " \n", "hi.", "yes", "no!", " x. ", f"{r.random()}.", f"{r.random()}é"])))
    for turn in range(long_one):
        rows.append((n_convs, turn, r.choice(["user", "assistant"]), r.choice(["a", "b.", f"{turn}.", f"{turn}?"])))
    return rows


@pytest.mark.parametrize("chunk", [4096, 3])
def test_audits_equal_plain_search(spark, chunk, monkeypatch):
    monkeypatch.setattr(conversations, "CHUNK", chunk)  # runs of three rows: the workers get the module's source, so this is about the driver's plan
    rows = talk(chunk, 60, 5000 if chunk > 3 else 40)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, cost int, edit string")
    got = {r[0]: tuple(r)[1:] for r in conversations.audits(df, conversations.damaged(df)).collect()}
    hurt = plain_damage(rows)
    assert sorted(map(repr, hurt)) == sorted(repr(tuple(r)) for r in conversations.damaged(df).collect())
    for conv in {r[0] for r in rows}:
        own = sorted([r[1:] for r in hurt if r[0] == conv], key=lambda r: (r[0] is not None, r[0] or 0))
        assert got.pop(conv) == plain_audit(own), conv
    assert not got


def test_runs_chain_to_the_same_result():
    """The parse in runs, chained by costs and ranks, is the parse in one piece."""
    import pandas as pd

    rep, r = conversations.repairer(), random.Random(3)
    for _ in range(200):
        n = r.randrange(1, 12)
        initials, faults = "".join(r.choice("suaua?") for _ in range(n)), "".join(r.choice("----tbd") for _ in range(n))
        rows = [(i, {"s": "system", "?": "tool", **NAMES}[c], "x") for i, c in enumerate(initials)]
        cost, audit, _ = cheapest(rows, faults)
        cut = sorted({0, *r.sample(range(n), min(n, 3))})
        runs = [("=1", k, s, e, c, rank, w) for k, (a, b) in enumerate(zip(cut, [*cut[1:], n], strict=True))
                for s in range(rep.n) for e, c, rank, w in rep.parse(s, initials[a:b], faults[a:b])]
        frame = pd.DataFrame(runs, columns=["_c", "_seq", "_start", "_end", "_cost", "_rank", "edits"])
        steps = conversations._chain(frame).sort_values("_seq").merge(frame, on=["_c", "_seq", "_start", "_end"])
        assert "".join(steps["edits"] + steps["_tail"]) == audit
        ends = rep.parse(0, initials, faults)
        k, tail = rep.close([x[:3] for x in ends])
        assert (ends[k][1] + 5 * len(tail), ends[k][3] + tail) == (cost, audit)


def test_grammar_accepts_only_its_roles():
    g = conversations.Grammar(conversations.GRAMMAR)
    for n in range(6):
        for word in itertools.product("sua", repeat=n):
            stack = (g.state0, None)
            for c in word:
                stack = stack and g.shift(stack, c)
            assert bool(stack and g.accepts(stack)) == bool(re.fullmatch(r"(s?(ua)+)?", "".join(word)))


def test_no_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.audits(df, conversations.damaged(df)).collect() == []
    one = spark.createDataFrame([(5, 1, "user", "a.")], df.schema)
    gone = conversations.audits(one, df).collect()
    assert [tuple(r) for r in gone] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_texts_of_the_trail(spark):
    df = spark.createDataFrame([(1, 0, "user", "q?"), (1, 1, "user", "r."), (1, 2, "assistant", "s.")], "conv_id long, turn long, role string, text string")
    got = [(r.role, r.text, r.edit) for r in conversations.repair(df).collect()]
    assert got == [(None, "q?", "D"), ("user", "r.", "K"), ("assistant", "s.", "K")]
