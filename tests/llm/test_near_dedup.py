import random

import numpy as np
import xxhash

from pyspark.sql import functions as F

from partita.llm import graph
from partita.llm.graph import connected_components
from partita.llm.hamming import buckets, owned
from partita.llm.near_dedup import BKTree, fingerprint_links, keep_one_each, near_duplicates, shingle_hashes, similar_groups


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    fp = sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))
    return fp - (1 << 64) if fp >> 63 else fp


def brute_components(ids, links):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def near(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count() <= 3


def check(rows, got):
    fps = {i: brute_fingerprint(t) for i, t in rows}
    ids = sorted(fps)
    want = brute_components(ids, [(a, b) for a in ids for b in ids if a < b and near(fps[a], fps[b])])
    assert sorted((r["doc_id"], r["fp"], r["component_id"]) for r in got) == sorted((i, fps[i], want[i]) for i, _ in rows)


def test_matches_brute_force_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check([(r["doc_id"], r["text"]) for r in docs.collect()], near_duplicates(docs).collect())


def test_edges_nulls_repeats_and_clashing_names(spark):
    text = "the quick brown fox jumps over the lazy dog " * 30
    rows = [(5, None), (3, ""), (9, " \n"), (1, "one"), (2, "one two"), (7, text), (4, text), (4, text), (8, "x" * 200_000), (6, "É é")]
    docs = spark.createDataFrame([(i, t, 1, "a", 2) for i, t in rows], "doc_id long, text string, fp int, key string, component_id int")
    check(rows, near_duplicates(docs).collect())
    kept = keep_one_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 4, 6, 8]
    assert near_duplicates(docs.limit(0)).count() == 0


def test_slices_of_long_texts_change_nothing():
    text = " ".join(random.Random(1).choice(["a", "bb", "ccc", "dddd"]) for _ in range(600_000))
    words = text.encode().split()
    got = [h for part in shingle_hashes(text) for h in part]
    assert got == [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]


def test_trees_find_what_a_scan_finds():
    rng = random.Random(2)
    values = [rng.getrandbits(64) for _ in range(200)]
    values += [v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in values]
    tree = BKTree()
    for v in values:
        tree.add(v)
    for v in values[:50]:
        assert sorted(tree.near(v, 3)) == [i for i, w in enumerate(values) if (v ^ w).bit_count() <= 3]


def test_split_buckets_keep_every_near_pair_together(spark):
    rng = random.Random(3)
    values = set()
    for _ in range(40):  # a crowd around few centres overfills every level
        centre = rng.choice([0x1234567890ABCDEF, 0x0F0F0F0F0F0F0F0F, rng.getrandbits(63)])
        for _ in range(5):
            v = centre
            for _ in range(rng.randrange(4)):
                v ^= 1 << rng.randrange(63)
            values.add(v)
    rows = spark.createDataFrame([(v,) for v in values], "fp long")
    held = {}
    for r in buckets(rows, limit=4, most=5).collect():
        held.setdefault((r["key"], r["part_a"], r["part_b"]), set()).add(r["fp"])
    together = {(a, b) for s in held.values() for a in s for b in s if a < b}
    assert {(a, b) for a in values for b in values if a < b and near(a, b)} <= together
    owners = {}
    for (key, *_), s in held.items():
        for a in s:
            for b in s:
                if a < b and near(a, b) and owned(key, np.array([a ^ b], dtype=np.uint64))[0]:
                    owners.setdefault((a, b), set()).add(key)
    assert set(owners) >= {(a, b) for a in values for b in values if a < b and near(a, b)} and all(len(k) == 1 for k in owners.values())
    want = brute_components(sorted(values), [(a, b) for a in values for b in values if a < b and near(a, b)])
    links = [(r["a"], r["b"]) for r in fingerprint_links(rows).collect()]
    assert all(near(a, b) for a, b in links)
    assert brute_components(sorted(values), links) == want


def test_components_match_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    nodes = {x for e in real for x in e}
    assert got == brute_components(sorted(nodes), real)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_blocks_of_edges_and_struct_nodes_agree(spark, monkeypatch):
    rng = random.Random(9)
    edges = [(rng.randrange(500), rng.randrange(500)) for _ in range(330)] + [(i, i + 1) for i in range(600, 760)] + [(900, i) for i in range(901, 960)] + [(None, 3), (5, 5), (3, 4), (4, 3)]
    want = brute_components(sorted({x for a, b in edges if a is not None and a != b for x in (a, b)}), [(a, b) for a, b in edges if a is not None and a != b])
    df = spark.createDataFrame(edges, "a long, b long")
    node = lambda c: F.when(F.col(c).isNotNull(), F.struct((F.col(c) % 7).alias("h1"), F.col(c).alias("h2")))
    structs = df.select(node("a").alias("a"), node("b").alias("b"))
    key = lambda x: (x % 7, x)
    groups = {}
    for x, r in want.items():
        groups.setdefault(r, []).append(x)
    tops = {x: min(g, key=key) for g in groups.values() for x in g}
    for block in (500_000, 120, 25):
        monkeypatch.setattr(graph, "BLOCK", block)
        assert {r["node"]: r["root"] for r in connected_components(df).collect()} == want
        got = {r["node"]["h2"]: (r["root"]["h1"], r["root"]["h2"]) for r in connected_components(structs).collect()}
        assert got == {x: key(r) for x, r in tops.items()}


def jaccard_components(rows, words_each=5, least=0.8):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(b" ".join(w[k : k + words_each]) for k in range(max(1, len(w) - words_each + 1)))
    ids = sorted(sets)
    links = []
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or (min(len(x), len(y)) >= least * max(len(x), len(y)) and len(x & y) >= least * len(x | y)):
                links.append((a, b))
    return brute_components(ids, links)


def test_similar_groups_match_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rng = random.Random(6)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for i, (_, t) in list(enumerate(rows))[:80]:
        w = (t or "").split()
        for _ in range(len(w) // rng.choice([25, 45, 60, 100])):
            w[rng.randrange(len(w))] = "changed"
        rows.append((10**6 + i, " ".join(w)))
    rows += [(2 * 10**6, None), (2 * 10**6 + 1, ""), (2 * 10**6 + 2, "a"), (2 * 10**6 + 3, "A")]
    got = {r["doc_id"]: r["component_id"] for r in similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == jaccard_components(rows)
    assert len(set(got.values())) < len(got) - 30


def test_a_crowd_of_near_copies_is_one_group(spark):
    rng = random.Random(7)
    base = [rng.choice("abcdefghij") * rng.randint(1, 5) for _ in range(120)]
    rows = []
    for i in range(500):
        w = list(base)
        w[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(w)))
    kept = keep_one_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r["doc_id"] for r in kept] == [0]
