"""Repair of conversation structure by generalised LR parsing with weighted edits.

The role grammar is compiled to SLR tables. A parse stack is a node (state, node beneath); nodes are shared, so the
stacks form a graph, and heads with equal stacks merge by the minimum of (cost, audit). Every row can be kept, reroled
or deleted, and turns can be inserted before it; each choice forks the heads. All letters of an audit but ``I`` consume
a row and inserts come before a row's own edit, so no audit of one head is a prefix of another head's: their order never
changes again, and heads carry a rank instead of the audit. What heads can become depends only on their costs and
ranks relative to each other, which take few values, so a step is looked up.

A conversation of any length spans tasks: rows are range-partitioned by (conversation, turn, row key), each run of at
most ``CHUNK`` rows is parsed from every stack it can start with, and the runs of a conversation are chained by costs
and ranks alone (some 25 small rows a run).
"""

from __future__ import annotations

import hashlib
from collections import deque
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, materialise

GRAMMAR = {"C": ["", "HL"], "H": ["", "s"], "L": ["P", "LP"], "P": ["ua"]}  # (s?(ua)+)?
ROLES = {"u": "user", "a": "assistant"}  # what can be inserted or reroled to, by initial
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
CHUNK = 4096
FAULTS = {"b": "blank", "d": "duplicate", "t": "truncated"}


class Grammar:
    """SLR tables of a grammar: ``shift(stack, token)`` and ``accepts(stack)`` on shared stack nodes."""

    def __init__(self, rules: dict[str, list[str]], start: str = "C"):
        self.rules = {"^": [start], **rules}
        nullable, first = set(), {n: set() for n in self.rules}
        self.follow = {n: set() for n in self.rules}
        self.follow["^"].add("$")
        size = -1
        while size != (size := len(nullable) + sum(map(len, first.values())) + sum(map(len, self.follow.values()))):
            for left, options in self.rules.items():
                for right in options:
                    if all(x in nullable for x in right):
                        nullable.add(left)
                    for x in right:
                        first[left] |= first.get(x, {x})
                        if x not in nullable:
                            break
                    after = set(self.follow[left])
                    for x in reversed(right):
                        if x in self.rules:
                            self.follow[x] |= after
                        after = (after if x in nullable else set()) | first.get(x, {x})
        self.state0 = self._closure({("^", start, 0)})

    def _closure(self, items: set) -> frozenset:
        items, new = set(items), list(items)
        while new:
            _, right, dot = new.pop()
            if dot < len(right) and right[dot] in self.rules:
                more = {(right[dot], r, 0) for r in self.rules[right[dot]]} - items
                items |= more
                new.extend(more)
        return frozenset(items)

    def _goto(self, state: frozenset, symbol: str) -> frozenset | None:
        moved = {(n, r, d + 1) for n, r, d in state if d < len(r) and r[d] == symbol}
        return self._closure(moved) if moved else None

    def _reduced(self, stack: tuple, token: str) -> tuple:
        """The stack after all reductions that the token allows."""
        while True:
            done = [(n, r) for n, r, d in stack[0] if d == len(r) and n != "^" and token in self.follow[n]]
            if not done:
                return stack
            (left, right), = done  # the grammar has no conflicts
            for _ in right:
                stack = stack[1]
            stack = (self._goto(stack[0], left), stack)

    def shift(self, stack: tuple, token: str) -> tuple | None:
        stack = self._reduced(stack, token)
        to = self._goto(stack[0], token)
        return to and (to, stack)

    def accepts(self, stack: tuple) -> bool:
        return any(n == "^" and d == len(r) for n, r, d in self._reduced(stack, "$")[0])


class Repair:
    """Minimum-cost edits as steps on numbered stacks. A front is a tuple of (stack, cost over the least), by rank."""

    def __init__(self, grammar: Grammar):
        stacks, self.to = [(grammar.state0, None)], []
        for stack in stacks:
            row = {}
            for token in "sua":
                nxt = grammar.shift(stack, token)
                if nxt:
                    if nxt not in stacks:
                        stacks.append(nxt)
                    row[token] = stacks.index(nxt)
            self.to.append(row)
        self.n = len(stacks)
        ends = [grammar.accepts(s) for s in stacks]
        self.inserted = [self._inserts(i) for i in range(self.n)]
        self.final = [min(((c, w) for k, (c, w) in got.items() if ends[k]), default=None) for got in self.inserted]
        self._steps: dict = {}

    def _inserts(self, start: int) -> dict[int, tuple[int, str]]:
        got = {start: (0, "")}
        new = [start]
        while new:
            at = new.pop()
            for role in ROLES:
                to, c = self.to[at].get(role), (got[at][0] + INSERT, got[at][1] + "I")
                if to is not None and (to not in got or c < got[to]):
                    got[to] = c
                    new.append(to)
        return got

    @lru_cache(maxsize=None)  # noqa: B019 - one object per worker
    def _moves(self, start: int, initial: str, fault: str) -> list[tuple[int, int, str]]:
        best: dict[int, tuple[int, str]] = {}
        extra = TRUNCATED if fault == "t" else 0
        for at, (c, word) in self.inserted[start].items():
            options = [(at, c + DELETE, word + "D")]
            if fault not in ("b", "d"):
                if initial in self.to[at]:
                    options.append((self.to[at][initial], c + extra, word + "K"))
                options += [(self.to[at][r], c + REROLE + extra, word + "R") for r in ROLES if r in self.to[at]]
            for to, cost, edits in options:
                best[to] = min(best.get(to, (cost, edits)), (cost, edits))
        return [(to, c, w) for to, (c, w) in best.items()]

    def step(self, front: tuple, initial: str, fault: str) -> tuple[tuple, int, tuple]:
        """``(new front, cost added to all, for each new head the old head and the edits)``."""
        key = (front, initial, fault)
        hit = self._steps.get(key)
        if hit is None:
            best: dict[int, tuple] = {}
            for rank, (stack, cost) in enumerate(front):
                for to, c, w in self._moves(stack, initial, fault):
                    best[to] = min(best.get(to, (cost + c, rank, w)), (cost + c, rank, w))
            least = min(c for c, _, _ in best.values())
            ordered = sorted(best.items(), key=lambda x: x[1][1:])
            hit = self._steps[key] = (tuple((to, c - least) for to, (c, _, _) in ordered), least, tuple((r, w) for _, (_, r, w) in ordered))
        return hit

    def parse(self, start: int, initials: str, faults: str) -> list[tuple[int, int, int, str]]:
        """``(end stack, cost, rank, edits)`` of the cheapest ways through some rows."""
        front, total, back = ((start, 0),), 0, []
        for i, f in zip(initials, faults, strict=True):
            front, add, links = self.step(front, i, f)
            total += add
            back.append(links)
        out = []
        for rank, (stack, cost) in enumerate(front):
            at, words = rank, []
            for links in reversed(back):
                at, w = links[at]
                words.append(w)
            out.append((stack, total + cost, rank, "".join(reversed(words))))
        return out

    def close(self, ends: list[tuple[int, int, int]]) -> tuple[int, str]:
        """Which of (stack, cost, rank) ends best, and the inserts after it."""
        return min(((c + self.final[s][0], r, self.final[s][1], k) for k, (s, c, r) in enumerate(ends) if self.final[s]))[3:1:-1]


@lru_cache(maxsize=1)
def repairer() -> Repair:
    return Repair(Grammar(GRAMMAR))


def key_of(col: str) -> Column:
    """A text that stands for a value of any type, nulls included, for grouping and sorting."""
    return F.coalesce(F.concat(F.lit("="), F.col(col).cast("string")), F.lit(""))


RUN_SCHEMA = "_c string, _turn long, _key binary, _seq long, _start int, _end int, _cost long, _rank int, _open boolean, edits string, faults string"


def _runs(batches):
    """Runs of rows of one conversation in sorted order, parsed: once where the run is the whole conversation, else from every stack."""
    from pyspark import TaskContext

    part, rep, rows = TaskContext.get().partitionId() << 32, repairer(), []
    conv, seq, first, whole = None, 0, True, True  # whole: the run holds its conversation from the start
    initials, faults, head, marked = [], [], None, None

    def flush(closed: bool) -> None:
        nonlocal seq
        i, f = "".join(initials), "".join(faults)
        if closed:
            ends = rep.parse(0, i, f)
            k, tail = rep.close([e[:3] for e in ends])
            rows.append((conv, *head, part + seq, 0, -1, 0, 0, False, ends[k][3] + tail, f))
        else:
            rows.extend((conv, *head, part + seq, s, e, c, r, True, w, f) for s in range(rep.n) for e, c, r, w in rep.parse(s, i, f))
        seq += 1
        initials.clear()
        faults.clear()

    def batch_of() -> pa.RecordBatch:
        names = [x.split()[0] for x in RUN_SCHEMA.split(", ")]
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "int": pa.int32(), "boolean": pa.bool_()}
        cols = [pa.array(c, kinds[x.split()[1]]) for c, x in zip(zip(*rows, strict=True), RUN_SCHEMA.split(", "), strict=True)]
        rows.clear()
        return pa.RecordBatch.from_arrays(cols, names=names)

    for batch in batches:
        for c, turn, key, kind, initial, fault in zip(*[batch.column(n).to_pylist() for n in ("_c", "_turn", "_key", "_kind", "_initial", "_fault")], strict=True):
            if kind == 0:
                marked = (c, turn, key)
                continue
            if c != conv:
                if initials:
                    flush(whole and not first)
                first, conv, whole = conv is None, c, True
            elif len(initials) == CHUNK:
                flush(False)
                whole = False
            if not initials:
                head = (turn, key)
            if fault != "b":
                if marked == (c, turn, key):
                    marked = None  # only the first of equal rows
                else:
                    fault = "d"
            initials.append(initial)
            faults.append(fault)
        if rows:
            yield batch_of()
    if initials:
        flush(False)
    if rows:
        yield batch_of()


def _chain(runs: pd.DataFrame) -> pd.DataFrame:
    """The stacks between the runs of one conversation: cheapest, then least audit (by ranks), then closed."""
    rep, front, steps = repairer(), [(0, 0, 0)], []  # heads (stack, cost, rank)
    runs = runs.sort_values("_seq")
    for seq, run in runs.groupby("_seq", sort=True):
        ranks = {s: (c, r) for s, c, r in front}
        best: dict[int, tuple] = {}
        for s, e, c, r in zip(run["_start"], run["_end"], run["_cost"], run["_rank"], strict=True):
            if s in ranks:
                got = (ranks[s][0] + c, ranks[s][1], r, s)
                best[e] = min(best.get(e, got), got)
        order = sorted(best.items(), key=lambda x: x[1][1:3])
        front = [(e, b[0], k) for k, (e, b) in enumerate(order)]
        steps.append((seq, {e: b[3] for e, b in order}))
    k, tail = rep.close(front)
    at, out = front[k][0], []
    for seq, came in reversed(steps):
        out.append((runs["_c"].iloc[0], seq, came[at], at, tail))
        at, tail = came[at], ""
    return pd.DataFrame(out, columns=["_c", "_seq", "_start", "_end", "_tail"])


TRAIL_SCHEMA = "_c string, turn long, role_before string, role string, text string, edit string, fault string"


def _apply(batches):
    """Edits applied to the rows of each conversation as they stream by, in order."""
    names = [x.split()[0] for x in TRAIL_SCHEMA.split(", ")]
    kinds = pa.schema([(n, pa.int64() if n == "turn" else pa.string()) for n in names])
    conv, edits, faults, last = None, deque(), deque(), ""

    def inserts(out):
        nonlocal last
        while edits and edits[0] == "I":
            edits.popleft()
            last = "a" if last == "u" else "u"
            out.append((conv, None, None, ROLES[last], "", "I", None))

    for batch in batches:
        out: list[tuple] = []
        for c, turn, kind, role, text, e, f in zip(*[batch.column(n).to_pylist() for n in ("_c", "_turn", "_kind", "role", "text", "edits", "faults")], strict=True):
            if c != conv:
                inserts(out)
                conv, last = c, ""
            if kind == 0:
                edits.extend(e)
                faults.extend(f)
                continue
            inserts(out)
            edit, fault, new = edits.popleft(), faults.popleft(), role
            if edit == "R":
                new = ROLES["a" if last == "u" else "u"]
            if edit != "D":
                last = new[0]
            out.append((c, turn, role, new if edit != "D" else None, text, edit, FAULTS.get(fault)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds.types, strict=True)], names=names)
    out = []
    inserts(out)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds.types, strict=True)], names=names)


def repair(rows: DataFrame) -> DataFrame:
    """The cheapest edits that give every conversation the roles ``(s?(ua)+)?``, one row per edit, in order.

    Reads ``conv_id, turn, role, text``; a null role or text is one space, a null turn comes first, rows of equal turn
    are ordered by a digest of role and text. Roles count by their initial. A blank row or a copy of an earlier role
    and text must be deleted (2); a text without a final ``.!?`` costs 5 unless deleted; rerole costs 1, an inserted
    empty turn 5; among equal costs the least string of edits is taken. Returns ``_c`` (the conversation's key, see
    ``key_of``), ``turn, role_before, role`` (null: deleted), ``text, edit`` (K, R, D, I), ``fault``. The rows of
    a conversation follow each other in one partition. Other columns are not read; an empty table gives no rows.
    """
    trimmed = F.rtrim("text", F.lit(SPACES))
    full = rows.select(
        key_of("conv_id").alias("_c"), F.col("turn").cast("long").alias("_turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    ).withColumn("_key", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))))
    fault = F.when(trimmed == "", "b").when(F.substring(trimmed, -1, 1).isin(".", "!", "?"), "-").otherwise("t")
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("?")
    narrow = full.select("_c", "_turn", "_key", F.lit(1).alias("_kind"), initial.alias("_initial"), fault.alias("_fault"))
    none = F.lit(None).cast("string")
    firsts = narrow.groupBy("_c", "_key").agg(F.min(F.struct(F.col("_turn").isNotNull().alias("set"), "_turn")).alias("_at")).select(
        "_c", F.col("_at._turn").alias("_turn"), "_key", F.lit(0).alias("_kind"), none.alias("_initial"), none.alias("_fault"))
    order = ["_c", "_turn", "_key"]
    runs = materialise(narrow.unionByName(firsts).repartitionByRange(*order).sortWithinPartitions(*order, "_kind").mapInArrow(_runs, RUN_SCHEMA))
    chained = runs.filter("_open").select("_c", "_seq", "_start", "_end", "_cost", "_rank").groupBy("_c").applyInPandas(_chain, "_c string, _seq long, _start int, _end int, _tail string")
    picked = runs.filter("_open").join(chained, ["_c", "_seq", "_start", "_end"]).withColumn("edits", F.concat("edits", "_tail"))
    edits = runs.filter("not _open").unionByName(picked.drop("_tail")).select(*order, F.lit(0).alias("_kind"), "_seq", none.alias("role"), none.alias("text"), "edits", "faults")
    texts = full.select(*order, F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_seq"), "role", "text", none.alias("edits"), none.alias("faults"))
    return edits.unionByName(texts).repartition("_c").sortWithinPartitions(*order, "_kind", "_seq").mapInArrow(_apply, TRAIL_SCHEMA)


SUMMARY = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0}
SUMMARY_SCHEMA = "_c string, " + ", ".join(f"{n} long" for n in SUMMARY) + ", audit string, repaired_sha256 string"


def _summaries(batches):
    conv, audit, sha, counts, low, high, distinct, prior, before = None, [], None, {}, None, None, 0, None, None
    schema = pa.schema([("_c", pa.string()), *[(n, pa.int64()) for n in SUMMARY], ("audit", pa.string()), ("repaired_sha256", pa.string())])
    price = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}

    def line() -> tuple:
        counts["gaps"] = high - low + 1 - distinct if distinct else 0
        return (conv, *counts.values(), "".join(audit), sha.hexdigest())

    for batch in batches:
        out = []
        for c, turn, was, role, text, edit, fault in zip(*[col.to_pylist() for col in batch.columns], strict=True):
            if c != conv or sha is None:
                if sha is not None:
                    out.append(line())
                conv, audit, sha, counts, low, high, distinct, prior, before = c, [], hashlib.sha256(), dict(SUMMARY), None, None, 0, None, None
                fresh = True
            audit.append(edit)
            counts["cost"] += price[edit]
            if edit != "I":
                if before is not None and before + was[:1] not in ("su", "ua", "au"):
                    counts["illegal"] += 1
                before = was[:1]
                if fault:
                    counts[fault] += 1
                    if fault == "truncated" and edit != "D":
                        counts["cost"] += TRUNCATED
                if turn is not None and turn != prior:  # sorted by turn, nulls first
                    low, high, distinct, prior = turn if low is None else low, turn, distinct + 1, turn
            if edit != "D":
                sha.update(("" if fresh else "\n").encode() + f"{role}:{text}".encode())
                fresh = False
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)
    if sha is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, line(), strict=True))], schema=schema)


def audits(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per ``conv_id`` of ``conversations`` (a null id is one, too) about the repair of its ``rows``.

    ``gaps`` (turns missing between the least and the greatest), counts of ``blank``, ``duplicate``, ``truncated``
    rows and of ``illegal`` neighbours, ``cost``, ``audit`` (the edits' initials), ``repaired_sha256`` (of the repaired
    ``role:text`` joined by line breaks). A conversation without rows has zeros, an empty audit and the empty hash.
    """
    ids = conversations.select("conv_id").distinct().withColumn("_c", key_of("conv_id"))
    found = ids.join(repair(rows).mapInArrow(_summaries, SUMMARY_SCHEMA), "_c", "left")
    return found.select("conv_id", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in SUMMARY], F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults by the remainder of crc32(``conv_id:turn``) by 20; nulls in any column count as one space.

    0 drops the row, 1 empties its text, 2 removes ``.!?`` from it, 3 repeats the row, 4 sets the role ``user``.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"),
                                (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).alias("_d")).filter("_d <> 0")
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("_d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "_d")
    return rows.withColumn("_x", F.explode(F.array_repeat(F.lit(0), F.when(F.col("_d") == 3, 2).otherwise(1)))).drop("_d", "_x")
