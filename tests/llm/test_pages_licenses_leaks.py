import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tallyframe.llm import latent_leaks, license_scan, page_text
from tallyframe.llm.dom import Page

from .helpers import AWKWARD, EMPTY, documents, prose


def page(i, semantic=True):
    art, nav, foot = ("article", "nav", "footer") if semantic else ('div class="post-content"', 'div class="menu"', 'div id="footer"')
    close = lambda t: t.split()[0]
    body = "".join(f"<p>{prose(i * 10 + k, 40)} &amp; {k}</p>" for k in range(1 + i % 4))
    return (f'<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script></head><body><{nav}><ul>' + "".join(f'<li><a href="#">l{k}</a></li>' for k in range(6))
            + f'</ul></{close(nav)}><!-- x --><div class="ad">Buy this now.</div><{art}><h1>Head {i}</h1>{body}</{close(art)}>'
            + f'<div class="comments"><p>{prose(i, 30)}</p></div><{foot}>&copy; x</{close(foot)}></body></html>')


def article(i):
    return f"Head {i} " + " ".join(f"{prose(i * 10 + k, 40)} & {k}" for k in range(1 + i % 4))


@pytest.fixture(scope="module")
def trees(spark):
    return page_text.fit(spark.createDataFrame([(page(i),) for i in range(80)], "html string"))


def test_articles_with_and_without_semantic_names(spark, trees):
    rows = [(i, "u", page(i, i % 2 == 0)) for i in range(100, 130)]
    got = {r.page_id: r for r in page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), trees).collect()}
    assert all(got[i].text == article(i) and got[i].n_chars == len(article(i)) for i in range(100, 130, 2))
    near = [got[i].text for i in range(101, 130, 2)]
    assert sum("Buy this" not in t and "l1 l2" not in t and article(i).split(" ", 2)[2][:60] in t for i, t in zip(range(101, 130, 2), near)) >= 13


def test_awkward_pages(spark, trees):
    odd = [None, "", "<", "<p", "plain text", "<p>a<p>b", "<div" * 2000, "<b><i></b></i>", "<script>never closed", "<!-- open", "&#0; &bogus; &#x41;", "<table><tr><td>a<td>b</table>", "x" * 300_000]
    rows = [(i, None, h) for i, h in enumerate(odd)] + [(0, "u", None), (None, "u", "")]
    got = page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), trees).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert page_text.main_text(spark.createDataFrame([], "page_id long, url string, html string, x int")).count() == 0


def test_no_contradictory_choices(trees):
    p = Page(page(3))
    keep = page_text.decode(p, trees.probability(page_text.features(p)))
    for i in range(1, len(keep)):
        if keep[i] and p.parent[i] and p.own[p.parent[i]]:
            assert keep[p.parent[i]]


def test_trees_score_like_the_model(spark):
    import numpy as np
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    r = random.Random(1)
    data = [([r.random(), r.random()], float(r.random() < 0.5)) for _ in range(300)]
    rows = spark.createDataFrame(data, "x array<double>, label double").select(array_to_vector("x").alias("features"), "label")
    model = GBTClassifier(maxIter=4, maxDepth=3, seed=1).fit(rows)
    want = [x.probability[1] for x in model.transform(rows).collect()]
    assert np.allclose(page_text.Trees(model).probability(np.array([x for x, _ in data])), want)


def test_notices_against_brute_force(spark):
    notices = license_scan.NOTICES
    rows = AWKWARD[:]
    r = random.Random(3)
    for i, (name, text) in enumerate(notices.items()):
        words = text.split()
        rows.append((400 + i, prose(i, 37 * i) + "\n" + text.upper() + "\n" + prose(50 + i, 30)))
        if len(words) > 30:  # a word changed: four fifths of the shingles stay
            words[r.randrange(len(words))] = "changed"
            rows.append((500 + i, prose(i, 11) + " " + " ".join(words)))
    got = {(x.doc_id, x.license) for x in license_scan.scan(documents(spark, rows), overlapping=True).collect()}

    def shingles(t):
        import re
        w = [x for x in re.split(r"[ \t-\r]+", re.sub(r"[^\w\s]|_", "", (t or "").lower())) if x]
        return [tuple(w[i:i + 5]) for i in range(len(w) - 4)]

    want = set()
    for i, t in rows:
        s = shingles(t)
        for name, text in notices.items():
            k = set(shingles(text))
            span = len(shingles(text)) + max(1, (len(shingles(text)) + 4) // 4)
            if any(len(k & set(s[a:a + span])) >= 0.8 * len(k) for a in range(len(s))):
                want.add((i, name))
    assert want >= got and len(want - got) == 0
    assert license_scan.scan(documents(spark, EMPTY)).count() == 0
    with pytest.raises(ValueError):
        license_scan.scan(documents(spark, EMPTY), {"short": "three words only"})


def test_the_best_of_overlapping_notices_is_named(spark):
    notices = license_scan.NOTICES
    rows, want = AWKWARD[:], set()
    for i, (name, text) in enumerate(notices.items()):
        rows.append((400 + i, prose(i, 37 * i) + "\n" + text.upper() + "\n" + prose(50 + i, 30)))
        want.add((400 + i, name))
    both = ["LGPL-3.0 header", "GPL header", "ISC"]  # apart, each has its row
    rows.append((600, prose(7, 100) + " " + " ".join(notices[x] for x in both) + " " + prose(9, 50)))
    want |= {(600, x) for x in both}
    rows.append((None, prose(8, 20) + " " + notices["AGPL-3.0 header"]))
    got = [(x.doc_id, x.license) for x in license_scan.scan(documents(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted([*want, (None, "AGPL-3.0 header")], key=repr)


BENCH = [(i, f"What is {prose(900 + i, 20)}? It is {prose(950 + i, 8)}.") for i in range(30)] + [(98, None), (99, "?!")]


def test_leaks_are_found_and_nothing_else(spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    rows = AWKWARD + [(i, prose(i, 200)) for i in range(700, 760)]
    want = set()
    for i, (item, text) in enumerate(BENCH[:20]):
        leaked = text if i % 2 else text.upper()
        if i % 5 == 4:  # a paraphrase: every eighth word is another
            leaked = " ".join("other" if k % 8 == 3 else w for k, w in enumerate(leaked.split()))
        rows.append((800 + i, prose(i, 13 * i) + " " + leaked + "\n" + prose(60 + i, 70)))
        want.add((800 + i, item))
    docs = documents(spark, rows)
    got = {(r.doc_id, r.item_id) for r in latent_leaks.flagged(docs, bench).collect()}
    assert got == want
    clean = latent_leaks.without_leaks(docs, bench)
    assert clean.columns == docs.columns and clean.count() == len(rows) - 20


def test_recall_on_parts_and_paraphrases(spark):
    """Planted leaks by kind: 100 consecutive words of items of 400, every tenth or fifth word another, two clauses swapped."""
    r = random.Random(12)
    vocabulary = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randrange(2, 5))) for _ in range(3000)]
    text = lambda n: " ".join(vocabulary[min(int(r.expovariate(1 / 400)), 2999)] for _ in range(n))
    items = [(i, text(400 if i < 40 else 40)) for i in range(160)]
    rows, kinds = [(i, text(300)) for i in range(400)], {}

    def plant(item, kind, words):
        kinds[1000 + item] = (kind, item)
        rows.append((1000 + item, text(r.randrange(150)) + " " + " ".join(words) + " " + text(100)))

    for i, t in items:
        w = t.split()
        if i < 40:
            at = r.randrange(300)
            plant(i, "part", w[at:at + 100])
        elif i < 100:
            step = 10 if i < 70 else 5
            plant(i, f"one in {step}", [vocabulary[r.randrange(3000)] if k % step == 2 else x for k, x in enumerate(w)])
        elif i < 130:
            plant(i, "clauses", w[6:] + w[:6])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in latent_leaks.flagged(documents(spark, rows), bench).collect()}
    assert got <= {(d, i) for d, (_, i) in kinds.items()}  # clean documents and other items stay alone
    for kind in ("part", "one in 10", "one in 5", "clauses"):
        planted = [(d, i) for d, (k, i) in kinds.items() if k == kind]
        assert sum(x in got for x in planted) >= 0.9 * len(planted), kind


def test_empty_sides(spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert latent_leaks.flagged(documents(spark, EMPTY), bench).count() == 0
    assert latent_leaks.flagged(documents(spark, AWKWARD), bench.limit(0)).count() == 0


def test_common_length_is_the_longest_common_subsequence():
    r = random.Random(2)
    for _ in range(200):
        a, b = [[r.choice("abcd") for _ in range(r.randrange(1, 14))] for _ in range(2)]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        masks = {}
        for i, w in enumerate(a):
            masks[w] = masks.get(w, 0) | 1 << i
        assert latent_leaks.common_length(masks, len(a), b) == best[-1][-1]


def test_words_are_made_plain_all_at_once_as_one_by_one():
    words = [a + w + b for a in ("", "«", "(", "\x1f") for w in ("", "Ab", "É.x", "İ", "1_0") for b in ("", "!", "»", "\x7f")] + [chr(c) for c in range(128)]
    assert latent_leaks.plain_words(pa.array(words)).to_pylist() == [latent_leaks.plain(w) for w in words]
    assert latent_leaks.plain_words(pa.array([], pa.string())).to_pylist() == []


def test_too_few_of_an_items_words_need_no_subsequence(monkeypatch):
    words = latent_leaks.Words(pa.array([prose(3, 40)]))
    item = [f"w{i}" for i in range(9)]
    monkeypatch.setattr(latent_leaks, "common_length", lambda *a: pytest.fail("not needed"))
    assert latent_leaks.verified(words, *latent_leaks.masks_of(item), set(item), 0, 0, 0.8, 0.6) is None


def test_buckets_of_all_words_at_once_are_those_of_plain_words():
    texts = [t or "" for _, t in AWKWARD] + ["".join(map(chr, range(1, 128))), " ".join(chr(c) + "a" + chr(c) for c in range(160, 600)), "x" * 100, "ß" * 30, ""]
    texts += [" ".join(a + w + b for a in ("", "«", "(", "×", "\x1f") for w in ("Ab", "É.x", "ÀÞßÿ×÷ö", "İ", "1_0", "Ã", "ΑΣ", "a·b", "ªº") for b in ("", "!", "»", "÷"))]
    for column in (pa.array(texts), pa.array(texts).slice(2, 9), pa.array([], pa.string()), pa.array(["", " "])):
        bounds, buckets = latent_leaks.word_buckets(column, {})
        words = latent_leaks.Words(column)
        assert bounds.tolist() == words.bounds.tolist()
        assert buckets.tolist() == [zlib.crc32(words.distinct[c].encode()) % latent_leaks.BUCKETS for c in words.codes]


def test_the_latent_space_is_that_of_all_passages(spark, monkeypatch):
    """Words that only one document of 2,500 has, often: a sample of documents misses most of them."""
    seen = {}
    search = latent_leaks.search
    monkeypatch.setattr(latent_leaks, "search", lambda one, items, idf, space, *a: seen.update(idf=idf, space=space) or search(one, items, idf, space, *a))
    r = random.Random(4)
    rare = [[f"rare{d}x{k}" for k in range(3)] for d in range(8)]
    rows = [(i, " ".join(f"w{r.randrange(300)}" for _ in range(40))) for i in range(2492)] + [(5000 + d, " ".join(r.choice(w) for _ in range(2000))) for d, w in enumerate(rare)]
    bench = [(i, " ".join(f"item{i}x{k}" for k in range(20))) for i in range(10)]
    latent_leaks.flagged(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).count()
    bucket = lambda w: zlib.crc32(w.encode()) % latent_leaks.BUCKETS
    assert min((seen["space"][bucket(w)] ** 2).sum() for words in rare for w in words) > 0.25  # a document is one direction

    used = sorted({bucket(w) for _, t in rows + bench for w in t.split()})
    place, passages = {b: i for i, b in enumerate(used)}, []
    for table, weight in ((rows, (1000 / len(rows)) ** 0.5), (bench, 30.0)):
        for _, t in table:
            w = [place[bucket(x)] for x in t.split()]
            for s in range(0, max(1, len(w) - 16), 16):
                v = np.bincount(w[s:s + 32], minlength=len(used)) * seen["idf"][used]
                passages.append(weight * v / np.linalg.norm(v))
    a, space = np.array(passages), seen["space"][used]
    assert ((a @ space) ** 2).sum() > 0.99 * (np.linalg.svd(a, compute_uv=False)[:space.shape[1]] ** 2).sum()
