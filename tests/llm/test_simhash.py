import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trawlnet.llm import simhash as s
from trawlnet.llm.components import components


def brute_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(values, budget=4):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= budget:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(values))]


def test_fingerprints_match_brute_force(spark):
    rnd = random.Random(1)
    texts = [None, "", " \t\n", "a", "A b C", "É é a B\x0bc d", "x" * 5000, "K  \xa0 a b c"]
    texts += [" ".join(rnd.choices(["the", "The", "Of", "ñ", "a,b", "\n"], k=rnd.randrange(1, 60))) for _ in range(40)]
    for t in texts:
        assert s.fingerprint((t or "").encode()) == brute_print(t)
    df = spark.createDataFrame([(x,) for x in ("a b c d", "é", "")], "t string").select("t", F.xxhash64("t").alias("h"))
    assert all(r.h % 2**64 == xxhash.xxh64_intdigest(r.t.encode(), seed=42) for r in df.collect())


def clusters(rnd, groups=30, size=12, flips=5):
    out = set()
    for _ in range(groups):
        base = rnd.getrandbits(64)
        for _ in range(size):
            x = base
            for _ in range(rnd.randrange(flips + 1)):
                x ^= 1 << rnd.randrange(64)
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize("leaf", [1, 32])
def test_trie_walk_matches_brute_force(monkeypatch, leaf):
    monkeypatch.setattr(s, "LEAF", leaf)
    monkeypatch.setattr(s, "WALK", 50)
    values = clusters(random.Random(2))
    got = s.trie_forest(np.array(values, dtype=np.uint64), 0)
    assert got.tolist() == brute_roots(values)
    low = sorted({i * 37 % 4096 for i in range(1500)})
    assert s.trie_forest(np.array(low, dtype=np.uint64), 0).tolist() == brute_roots(low)


@pytest.mark.parametrize("chosen,hot", [(1, 200_000), (2, 200_000), (4, 200_000), (1, 3)])
def test_links_of_all_choices_and_of_hot_tries(spark, monkeypatch, chosen, hot):
    monkeypatch.setattr(s, "_blocks_chosen", lambda n: chosen)
    monkeypatch.setattr(s, "HOT", hot)
    values = clusters(random.Random(chosen), 12, 10)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {r.node: r.root for r in components(s.near_links(nodes)).collect()}
    groups = {}
    for v, r in zip(signed, brute_roots(values)):
        groups.setdefault(r, []).append(v)
    for members in groups.values():
        if len(members) == 1:
            assert members[0] not in found
        else:
            assert {found[m] for m in members} == {min(members)}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (7, 8), (8, 7)]
    out = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(out[i] == 0 for i in range(201)) and all(out[1000 + i] == 1000 for i in range(300)) and len(out) == 501
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(900, None), (901, ""), (902, "a"), (902, "a"), (None, "")], "doc_id long, text string")
    docs = docs.select("doc_id", "text", docs.lang.alias("fp")).unionByName(odd.withColumn("fp", F.lit("c")))
    rows = docs.collect()
    prints = [brute_print(r.text) for r in rows]
    roots = brute_roots(prints)
    least = {}
    for r, k in zip(rows, roots):
        least[k] = min([x for x in (least.get(k), r.doc_id) if x is not None], default=None)
    want = sorted((str(r.doc_id), f"{p:016x}", least[k]) for r, p, k in zip(rows, prints, roots))
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in s.simhash_digest(docs).collect())
    assert got == want
    kept = s.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted(set(least.values())) and kept.where("doc_id IS NULL").count() == 1
    assert s.keep_one(docs.limit(0)).count() == 0


def test_hot_fingerprints_in_parts(spark, monkeypatch):
    rows = [(i, "a b c d e f" if i % 3 == 0 else f"text number {i} of many", i % 7) for i in range(300)] + [(None, "a b c d e f", 0), (5, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rows int")
    read = lambda: sorted((tuple(r) for r in s.near_duplicates(df).collect()), key=str)
    want = read()
    monkeypatch.setattr(s, "BROADCAST_IDS", 0)
    assert read() == want
    monkeypatch.setattr(s, "HOT_ROWS", 10)
    assert read() == want and len(want) == len(rows)
