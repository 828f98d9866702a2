import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trawlnet.llm import bpe, packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, texts, ids_of, limit=2048):
    """Every document's ids lie whole in its pieces, and sequences are gapless and within the limit."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for key, text in texts:
        ids, at = ids_of(text), 0
        for k, r in enumerate(sorted(by_doc[key], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (r.length == limit or k == 0)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limit
    return len(by_seq)


def test_ids_are_the_librarys(library):
    docs = ["", "a", " a  b\n\n c", "<|endoftext|>", "don't 42 é中 !!", "x" * 300, "\t\x1c y \x85 z"]
    rnd = random.Random(4)
    docs += ["".join(rnd.choices("ab 1Zé.,'s\n\t中", k=80)) for _ in range(300)]
    e = bpe.encoding_for(RANKS)
    assert all([*bpe.ids_of(packing.encode_bytes(e, t)), 0] == library(t) for t in docs)


def test_best_fit_against_plain_search():
    rng = np.random.default_rng(6)
    lengths = rng.integers(1, 65, 300)
    bins, offsets = packing.best_fit(lengths, 64)
    free, want = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        fit = [f for f in free if f >= lengths[i]]
        if fit:
            at = free.index(min(fit))
            free[at] -= lengths[i]
        else:
            free.append(64 - lengths[i])
    assert bins.max() + 1 == len(free) and sorted(64 - np.bincount(bins, lengths)) == sorted(free)
    assert packing.best_fit(np.array([], dtype=np.int64))[0].size == 0


def test_cuts():
    assert packing.cut_lengths(1) == [1] and packing.cut_lengths(2048) == [2048]
    assert packing.cut_lengths(5000) == [904, 2048, 2048]


def test_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "z " * 9000)], "doc_id long, text string")
    docs = docs.unionByName(odd).selectExpr("*", "1 AS offset", "2 AS bin", "3 AS length")
    rows = packing.pack_documents(docs, RANKS).collect()
    made = check(rows, [(r.doc_id, r.text) for r in docs.collect()], library)
    assert made <= 1.01 * -(-sum(r.length for r in rows) // 2048) + 1
    assert packing.pack_documents(docs.limit(0), RANKS).count() == 0
    twice = docs.limit(4).union(docs.limit(4))
    assert packing.pack_documents(twice, RANKS).count() == 2 * packing.pack_documents(docs.limit(4), RANKS).count()


@pytest.mark.parametrize("task_rows", [50, 500_000])
def test_rounds_over_many_partitions(spark, monkeypatch, task_rows):
    monkeypatch.setattr(packing, "TASK_ROWS", task_rows)
    lengths = spark.range(3000).selectExpr("id", "1 + pmod(xxhash64(id), 90) AS length").repartition(24)
    rows = packing.pack(lengths, 100).collect()
    assert sorted(r.id for r in rows) == list(range(3000))
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in seqs.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 100
    assert len(seqs) <= 1.06 * sum(r.length for r in rows) / 100


def test_added_tokens_are_the_librarys(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.ADDED == {x.content: i for i, x in t.get_added_tokens_decoder().items()}
    own = lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "x  <|endoftext|>\n\n y", "<|endoftext|", "<|<|endoftext|>endoftext|>", "a<|endoftext|> " * 900]
    rnd = random.Random(3)
    texts += ["".join(rnd.choices(["<|endoftext|>", " ", "ab", "\n", "é", "<|", "1"], k=40)) for _ in range(100)]
    docs = list(enumerate(texts))
    rows = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string"), RANKS).collect()
    check(rows, docs, own)


def test_only_bins_without_use_are_emitted_before_the_end(spark, monkeypatch):
    """Against one best-fit over all pieces: rounds cost less than a bin for each partition at the start, ties or not."""
    monkeypatch.setattr(packing, "TASK_ROWS", 400)
    for expr in ("1 + pmod(xxhash64(id), 100)", "IF(id % 3 = 0, 99, 51)", "7", "IF(id < 20, 1, 60)", "100"):
        lengths = spark.range(1600).selectExpr("id", f"CAST({expr} AS BIGINT) AS length").repartition(16)
        rows = packing.pack(lengths, 100).collect()
        best, _ = packing.best_fit(np.array([r.length for r in rows]), 100)
        assert len(rows) == 1600 and len({r.sequence_id for r in rows}) <= best.max() + 1 + 16, expr
