import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import packing, token_files
from tallyframe.llm.queries import tokenizer_path
from tallyframe.llm.tokens import Encoder

from .helpers import AWKWARD, EMPTY, documents, prose

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def reference(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [0]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4"))


@pytest.mark.parametrize("name", FILES)
def test_units_encode_like_whole_texts(name):
    texts = [t or "" for _, t in AWKWARD] + ["  a  b", "a\n\nb", "It's we'll 's", "<|endoftext|> x", "a<|endoftext|>b c <|startoftext|>", "word <|ENDOFTEXT|>\nline", "plain words, and marks! <|endoftext|>", "a!b !c d! Word, WORD. word; École, ÉCOLE x\n\ny\nLine. \x00z", "İxA!\tx", "ΣΑΣ, ǅ Å", "a.\n b ", "\nA", prose(9, 3000)]
    want, ref = [], reference(name)
    for t in texts:
        want.append(ref(t)[:-1])
    enc = Encoder(tokenizer_path(name))
    for part in (texts, texts[::-1]):
        flat, counts = enc.encode(pa.array(part))
        ends = np.cumsum(counts)
        got = [flat[e - c:e].tolist() for e, c in zip(ends, counts)]
        assert got == (want if part is texts else want[::-1])


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_places_every_piece_once(spark, rule):
    ref = reference(FILES[0])
    docs = documents(spark, AWKWARD + [(100 + i, prose(i, 20 + 7 * i)) for i in range(60)])
    got = packing.pack_documents(docs, tokenizer_path(FILES[0]), 256, rule=rule, group_size=64).collect()
    want = []
    for i, t in AWKWARD + [(100 + i, prose(i, 20 + 7 * i)) for i in range(60)]:
        ids = ref(t)
        want += [(i, n, s, len(ids[s:s + 256]), crc(ids[s:s + 256])) for n, s in enumerate(range(0, len(ids), 256))]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(w[3] for w in want)
    assert len(by) <= 1.05 * total / 256 + 4


def test_other_capacities_hold(spark):
    rows = spark.createDataFrame([(i, 1 + i % 40) for i in range(500)], "doc_id long, length long")
    got = packing.best_fit(rows, max_tokens=100, max_pieces=3, max_attention=2500.0)
    top = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("k"), F.sum(F.col("length") ** 2).alias("a")).agg(F.max("n"), F.max("k"), F.max("a")).first()
    assert top[0] <= 100 and top[1] <= 3 and top[2] <= 2500
    assert got.count() == 500


def test_sequences_hold_the_ids(spark):
    docs = documents(spark, [(i, prose(i, 30)) for i in range(20)])
    path = tokenizer_path(FILES[0])
    packed = packing.pack_documents(docs, path, 128)
    ref = reference(FILES[0])
    seqs = packing.sequences(docs, packed, path, 128).collect()
    assert sorted(d for s in seqs for d in s.doc_ids) == sorted(r.doc_id for r in packed.collect())
    whole = {i: ref(prose(i, 30)) for i in range(20)}
    assert sum(len(s.ids) for s in seqs) == sum(map(len, whole.values()))


def test_token_files_round_trip(spark, tmp_path):
    rows = [(i, t) for i, t in AWKWARD if i is not None and i != 5] + [(5, prose(2, 80))]
    path = str(tmp_path / "tokens")
    token_files.write_tokens(documents(spark, rows), path, tokenizer_path(FILES[1]))
    ref, start, want = reference(FILES[1]), 0, []
    for i, t in sorted(rows):
        ids = ref(t)
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(tuple(r) for r in token_files.digest(spark, path).collect()) == want
    assert token_files.find(spark, path, [8]).first().ids == ref("one")
    plan = token_files.find(spark, path, [8])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id" in plan or "EqualTo(doc_id" in plan


def test_token_files_repeated_and_null_ids(spark, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write_tokens(documents(spark, AWKWARD), path, tokenizer_path(FILES[1]))
    got = sorted(token_files.digest(spark, path).collect(), key=lambda r: r.start)
    assert len(got) == len(AWKWARD) and got[0].start == 0 and got[0].doc_id is None
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))


def test_empty_tables(spark, tmp_path):
    docs = documents(spark, EMPTY)
    assert packing.pack_documents(docs, tokenizer_path(FILES[0])).count() == 0
    token_files.write_tokens(docs, str(tmp_path / "t"), tokenizer_path(FILES[1]))
    assert token_files.digest(spark, str(tmp_path / "t")).count() == 0
