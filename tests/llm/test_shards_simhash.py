import zlib

import xxhash
from pyspark.sql import functions as F

from tallyframe.llm import near_copies, sharding, simhash
from tallyframe.llm.components import connected

from .helpers import AWKWARD, EMPTY, documents, prose


def best_capacity(sizes, shards):
    """Smallest capacity by brute force over an ordered list."""
    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid, n, at = (lo + hi) // 2, 1, 0
        for s in sizes:
            if at + s > mid:
                n, at = n + 1, 0
            at += s
        lo, hi = (lo, mid) if n <= shards else (mid + 1, hi)
    return lo


def test_shards_are_minimax_and_atomic(spark):
    rows = AWKWARD + [(100 + i, prose(i % 150, 5 + i % 40)) for i in range(400)]
    for fence in (16, 65_536):
        got = sharding.minimax_shards(sharding.sized(documents(spark, rows)), 7, fence).collect()
        assert len(got) == len(rows)
        shards, groups = {}, {}
        for r in got:
            shards.setdefault(r.shard, []).append(r)
            groups.setdefault(bytes(r.key), set()).add(r.shard)
        assert all(len(s) == 1 for s in groups.values())
        assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in shards.values())
        big = [s for s in shards if len({bytes(r.key) for r in shards[s]}) == 1]
        sizes = {}
        for r in got:
            if r.shard not in big:
                sizes[bytes(r.key)] = sizes.get(bytes(r.key), 0) + r["size"]
        top = max(sum(r["size"] for r in shards[s]) for s in shards if s not in big)
        assert top == best_capacity([sizes[k] for k in sorted(sizes)], 7 - len(big))
    for r in got:
        text = {i: t for i, t in rows if i is not None}.get(r.doc_id)
        if r.doc_id is not None:
            raw = (text or "").encode()
            assert r["size"] == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw)


def test_one_text_in_a_third_of_all_rows(spark):
    rows = [(i, "copy " * 50 if i % 3 == 0 else prose(i, 30)) for i in range(300)]
    got = sharding.minimax_shards(sharding.sized(documents(spark, rows)), 5).collect()
    assert len({r.shard for r in got if r.doc_id % 3 == 0}) == 1
    rest = {}
    for r in got:
        rest[r.shard] = rest.get(r.shard, 0) + r["size"]
    assert len(rest) == 5


def test_no_and_few_documents(spark):
    assert sharding.minimax_shards(sharding.sized(documents(spark, EMPTY)), 4).count() == 0
    got = sharding.minimax_shards(sharding.sized(documents(spark, [(1, "a"), (2, None)])), 4).collect()
    assert sorted(r.slot for r in got) == [0, 0] and len({r.shard for r in got}) == 2


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark):
    rows = AWKWARD[:]
    for i in range(60):
        t = prose(i // 4, 300)
        rows.append((200 + i, t if i % 4 == 0 else t.replace("river", "RIVER").replace("stone", f"stone{i}", i % 4)))
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                parent[root(a)] = root(b)
    want = []
    for a, (i, _) in enumerate(rows):
        ids = [j for b, (j, _) in enumerate(rows) if root(b) == root(a) and j is not None]
        want.append((i, f"{fps[a]:016x}", min(ids, default=None)))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
    assert any(w[2] != w[0] for w in want)


def test_every_radius_finds_all_links(spark):
    base = 0x123456789ABCDEF0
    marks = [base] + [base ^ sum(1 << b for b in bits) for bits in ([0], [63], [5, 40], [1, 30, 50], [21, 22, 42, 43], [0, 1, 2, 3, 4], [10, 11, 12, 13], [60, 61, 62, 63])]
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    fps = spark.createDataFrame([(x,) for x in signed], "fp long")
    for pieces in (1, 2, 3, 5):
        if pieces == 1:
            continue
        got = {tuple(r) for r in simhash.links(fps, 4, pieces).collect()}
        want = {tuple(sorted((a, b))) for a in signed for b in signed if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
        assert {tuple(sorted(x)) for x in got} == want


def test_one_row_of_each_group_stays(spark):
    rows = AWKWARD + [(300, prose(2, 80))]
    got = simhash.one_of_each(documents(spark, rows))
    assert got.columns == documents(spark, rows).columns
    fps = [(r.doc_id, brute_fingerprint(r.text)) for r in got.collect()]
    assert all((a[1] ^ b[1]).bit_count() > 4 for n, a in enumerate(fps) for b in fps[:n])
    assert 5 in [i for i, _ in fps] and 6 not in [i for i, _ in fps]
    assert simhash.one_of_each(documents(spark, EMPTY)).count() == 0
    assert simhash.near_duplicates(documents(spark, EMPTY)).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in connected(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_near_copies_by_jaccard_have_one_row(spark):
    rows, near = [], set()
    for g in range(40):
        words = prose(1000 + g, 300).split()
        rows.append((10 * g, " ".join(words)))
        for c in range(1, 4):  # 2 to 6 words replaced: 10 to 30 shingles of 296, a similarity of 0.82 to 0.93
            copy = list(words)
            for j in range(2 * c):
                copy[20 + 47 * j] = f"new{c}x{j}"
            rows.append((10 * g + c, " ".join(copy)))
        far = [w if i % 9 else f"far{i}" for i, w in enumerate(words)]
        rows.append((10 * g + 9, " ".join(far)))
    sets = {i: {tuple(t.lower().split()[j:j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = {i: brute_fingerprint(t) for i, t in rows}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                near.add((a, b))
            if a < b and ((a, b) in near or (fps[a] ^ fps[b]).bit_count() <= 4):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    assert len(near) >= 120 and sum((fps[a] ^ fps[b]).bit_count() > 4 for a, b in near) > 20
    got = simhash.one_of_each(documents(spark, AWKWARD[:3] + rows), similarity=0.8)
    assert sorted(r.doc_id for r in got.filter("text like '% %' and doc_id <> 3").collect()) == sorted(i for i in sets if root(i) == i)


def test_a_large_group_and_a_bucket_of_two_texts(spark):
    base = prose(77, 400).split()
    rows = [(i, " ".join(base[:390] + [f"v{i}x{j}" for j in range(10)])) for i in range(120)]
    rows += [(1000 + i, prose(2000 + i, 200)) for i in range(30)]
    got = simhash.one_of_each(documents(spark, rows, extra=False), similarity=0.8)
    assert sorted(r.doc_id for r in got.collect()) == [0, *range(1000, 1030)]


def test_links_of_a_bucket_with_many_components(spark, monkeypatch):
    """Unlike texts in one bucket: each group of like texts is found, although rounds start with two texts of a bucket."""
    monkeypatch.setattr(near_copies, "LEADERS", 2)
    monkeypatch.setattr(near_copies, "bands", lambda hashes: list(range(near_copies.BANDS)))  # all texts meet in every band
    rows = []
    for g in range(12):
        words = prose(3000 + g, 120).split()
        rows += [(100 * g + c, " ".join(words[:118] + [f"c{c}", f"d{c}"])) for c in range(4)]
    texts = spark.createDataFrame([(str(i).encode(), t) for i, t in rows], "t binary, text string")
    nodes = texts.select("t", F.hash("t").cast("long").alias("fp"))
    found = nodes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    ids = {r.fp: int(bytes(r.t)) for r in nodes.collect()}
    roots = connected(near_copies.links(texts, nodes, found, 0.8)).collect()
    groups = {}
    for r in roots:
        groups.setdefault(r.root, set()).add(ids[r.node])
    assert sorted(map(sorted, groups.values())) == [[100 * g + c for c in range(4)] for g in range(12)]
