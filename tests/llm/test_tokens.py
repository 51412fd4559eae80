import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from partita.llm.packing import OpenBins, pack_documents
from partita.llm.common import stored
from partita.llm.token_counts import TokenTree, build_trees, count_edited, edit_trees
from partita.llm.word_tokens import WordEncoder, words_of

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a\x1cb <|endoftext|> x", "\x01 q's don't É é 1234,,, İx ǅa", "### a.b it's, end.", "élé  x y", "x" * 3000]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def full(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_the_tokenizer(spark, sf, tokenizer):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(80).collect()] + ODD
    for room in (10, 200_000):
        enc = WordEncoder(PATH, room)
        for _ in range(2):
            for t, raw in zip(texts, enc.encode_many([words_of(t) for t in texts])):
                assert np.frombuffer(raw, "<u4").tolist() == full(tokenizer, t)
        assert len(enc.kept) <= room


def check_packing(rows, out, tokenizer, room=2048):
    want = defaultdict(list)
    for i, t in rows:
        ids = full(tokenizer, t) + [0]
        for k, at in enumerate(range(0, len(ids), room)):
            cut = np.array(ids[at : at + room], dtype="<u4")
            want[i].append((k, at, len(cut), zlib.crc32(cut.tobytes())))
    got, bins = defaultdict(list), defaultdict(list)
    for r in out:
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items()}
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= room
    return bins, sum(n for v in want.values() for *_, n, _ in v)


def test_documents_are_packed_tightly(spark, sf, tokenizer):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    bins, total = check_packing(rows, pack_documents(docs, PATH).collect(), tokenizer)
    assert len(bins) <= 1.05 * -(-total // 2048) + 1


def test_packing_edges(spark, tokenizer):
    rows = [(1, None), (2, ""), (3, "a " * 2047), (4, "a " * 2048), (5, "b " * 10_000), (6, "same text"), (6, "same text"), (None, "x"), *((10 + i, t) for i, t in enumerate(ODD))]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, piece int, length int")
    check_packing(rows, pack_documents(docs, PATH).collect(), tokenizer)
    assert pack_documents(docs.limit(0), PATH).count() == 0


def test_bins_follow_a_plain_best_fit():
    rng = random.Random(8)
    for most in (1, 3, 1000):
        bins, free, opened = OpenBins(100, most), {}, 0
        for _ in range(500):
            n = rng.randint(1, 100)
            b, offset = bins.put(n)
            fits = [f for f in free.values() if f >= n]
            if fits:
                assert 100 - offset == min(fits) == free[b]
            else:
                assert (b, offset) == (opened, 0)
                if len(free) >= most:
                    del free[next(k for k, f in sorted(free.items(), reverse=True) if f == min(free.values()))]
                opened, free[b] = opened + 1, 100
            free[b] -= n
            if not free[b]:
                del free[b]


def test_trees_recount_after_random_edits(tokenizer, spark, sf):
    enc, rng = WordEncoder(PATH), random.Random(9)
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(25).collect()] + ODD
    for t in texts:
        tree = TokenTree(t, enc)
        for _ in range(15):
            a = rng.randint(0, len(t))
            b = min(len(t), a + rng.choice([0, 0, 1, 5, 40, 700]))
            new = rng.choice(["", "", " ", "x", "new words, here\n", "é" * 3, "blah " * 300])
            tree.edit(a, b, new)
            t = t[:a] + new + t[b:]
            assert tree.text() == t and tree.total == len(full(tokenizer, t)) and tree.chars[1] == len(t)


def test_an_edit_encodes_what_it_touches():
    tree = TokenTree("word " * 100_000, WordEncoder(PATH))
    tree.edit(250_002, 250_004, "xx")
    assert tree.encoded < 100


def test_edited_counts_edges(spark, tokenizer):
    docs = spark.createDataFrame([(1, "a b c", 0), (2, None, 0), (3, "", 0), (1, "a b c", 0), (None, "d e", 0)], "doc_id long, text string, edits int")
    edits = spark.createDataFrame(
        [(1, 2, 0, 1, "zz"), (1, 1, 3, 99, None), (2, 0, -5, None, "new text"), (9, 0, 0, 1, "x"), (None, 0, 0, 1, "x")], "doc_id long, seq long, start long, stop long, replacement string"
    )
    got = sorted(((r["doc_id"] or 0, r["tokens_before"], r["tokens_after"], r["chars_after"], r["edits"]) for r in count_edited(docs, edits, PATH).collect()))
    n = lambda t: len(full(tokenizer, t))
    assert got == sorted([(0, n("d e"), n("d e"), 3, 0), *[(1, n("a b c"), n("zz b"), 4, 2)] * 2, (2, 0, n("new text"), 8, 1), (3, 0, 0, 0, 0)])
    assert count_edited(docs.limit(0), edits, PATH).count() == 0


def test_stored_trees_take_further_edits_without_encoding_again(spark, tokenizer):
    rng = random.Random(12)
    texts = {i: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(3000)) for i in range(4)} | {9: None}
    trees = stored(build_trees(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), PATH), "trees")
    now = {i: t or "" for i, t in texts.items()}
    for batch in range(2):
        rows = [(i, 0, at := rng.randrange(len(now[i]) + 1), at + 5, f"new {batch}") for i in (0, 2, 9)] + [(None, 0, 0, 1, "x"), (77, 0, 0, 1, "x")]
        trees = stored(edit_trees(trees, spark.createDataFrame(rows, "doc_id long, seq long, start long, stop long, replacement string"), PATH).select("doc_id", "leaves", "leaf_tokens", "tokens", "edits", "reencoded_chars"), "trees")
        for i, _, a, b, new in rows[:3]:
            now[i] = now[i][:a] + new + now[i][b:]
        got = {r["doc_id"]: r for r in trees.collect()}
        assert {i: r["tokens"] for i, r in got.items()} == {i: len(full(tokenizer, t)) for i, t in now.items()}
        assert {i: "".join(r["leaves"]) for i, r in got.items()} == now
        assert all(got[i]["reencoded_chars"] < 100 and got[i]["edits"] == 1 for i in (0, 2)) and got[1]["edits"] == got[1]["reencoded_chars"] == 0
