import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from partita.llm import queries, token_align
from partita.llm.token_align import align, aligner, corpus_alignment, group_text, link_counts, linked_ids, lockstep

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    tok, model = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in letters)}
    entries = {i: bytes(back[c] for c in t) for t, i in tok.get_vocab().items()}

    def piece(i):
        return bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()

    def encode(text):
        if not text:
            return None
        a, b = tok.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
        raw = (" " + text).encode()
        pa, pb = [entries[i] for i in a], [piece(i) for i in b]
        return (a, b, pa, pb) if b"".join(pa) == raw == b"".join(pb) else None

    return encode


def brute(rows, encode):
    docs, pairs = [], Counter()
    for doc, text in rows:
        got = encode(text)
        if not got:
            docs.append((doc, [], [], []))
            continue
        a, b, pa, pb = got
        ends_b = {int(e): k for k, e in enumerate(np.cumsum([len(x) for x in pb]))}
        links = [(k, ends_b[int(e)]) for k, e in enumerate(np.cumsum([len(x) for x in pa])) if int(e) in ends_b]
        docs.append((doc, a, b, links))
        pairs.update((a[i], b[j]) for i, j in links)
    best = {}
    for (_, j), n in pairs.items():
        best[j] = max(best.get(j, 0), n)
    out = []
    for doc, a, b, links in docs:
        groups, i, j = [], 0, 0
        for x, y in links:
            groups.append(",".join(map(str, a[i : x + 1])) + "|" + ",".join(map(str, b[j : y + 1])))
            i, j = x + 1, y + 1
        counts = [(pairs[a[x], b[y]], best[b[y]]) for x, y in links]
        out.append((doc, len(a), len(b), len(links), len(links), sum(n == m for n, m in counts), sum(n for n, _ in counts), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_matches_brute_force(spark, sf, plain):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = got(queries.op13_lockstep_links(spark, sf))
    assert found == brute(rows, plain) and sum(r[3] for r in found) > 10_000


def random_texts(n, seed):
    rng = random.Random(seed)
    parts = [" ", "  ", "   ", "\n", "\n\n", "\r\n", "\t", " \n ", " ", "　", " ", "\x1c", "\x85", "a", "the", "Ünï", "don't", "1234", "...", ");", "}", "é", "é", "漢字", "𝄞", "👩‍👧", "\x00", "<|endoftext|>", "</s>", "<0x41>", "x" * 40, "=" * 9]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def test_words_are_encoded_as_in_their_texts(plain):
    worker = aligner(A, B)
    assert worker.b.apart
    texts = random_texts(1500, 7)
    for (n_a, n_b, n, _, digest), want in zip(token_align._documents(worker, texts, False), brute(list(enumerate(texts)), plain) and [brute([(0, t)], plain)[0] for t in texts], strict=True):
        assert (n_a, n_b, n, digest) == (want[1], want[2], want[3], want[7])


def test_edges_nulls_repeats_lossy_texts_and_clashing_names(spark, plain):
    rows = [(1, None), (2, ""), (3, " "), (4, "\n"), (5, "one"), (5, "one"), (None, "one"), (6, "a▁b"), (7, "ok ▁ then"), (8, "▁"), (9, "tail  "), (10, "\ttab\r\nend\n"), *((20 + i, t) for i, t in enumerate(random_texts(40, 2)))]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, links int, n_a string")
    assert got(corpus_alignment(df, A, B)) == brute(rows, plain)
    assert got(corpus_alignment(df.limit(0), A, B)) == []
    assert got(corpus_alignment(df.filter("doc_id < 3"), A, B)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_stretches_and_lanes_change_nothing(spark, plain, monkeypatch):
    texts = ["word and more words,\nlines  of it " * 300, "no" * 5000, *random_texts(30, 4)]
    worker = aligner(A, B)
    want = list(token_align._documents(worker, texts, True))
    monkeypatch.setattr(token_align, "PART", 300)
    monkeypatch.setattr(token_align, "LANE", 3)
    monkeypatch.setattr(token_align, "ROOM", 5)
    other = token_align.Aligner(A, B)
    assert list(token_align._documents(other, texts, True)) == want
    assert len(other.kept[0]) <= 5


def test_lockstep_finds_all_common_ends():
    rng = np.random.default_rng(1)
    ends, starts = ([], []), ([0], [0])
    want, base = [], 0
    for lane in range(60):
        total = 0 if lane % 9 == 0 else int(rng.integers(1, 40))
        cut = [sorted({*rng.integers(1, total + 1, int(rng.integers(0, 20))).tolist(), total}) if total else [] for _ in range(2)]
        for e in cut[0]:
            want.append(starts[1][-1] + cut[1].index(e) if e in cut[1] else -1)
        for k in range(2):
            ends[k].extend(base + e for e in cut[k])
            starts[k].append(len(ends[k]))
        base += total
    assert lockstep(*map(np.array, (*ends, *starts))).tolist() == want


def test_cuts_counts_and_tables(spark, plain):
    rows = [(1, "hello world"), (2, "hello there world")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    aligned, worker = align(df, A, B, keep_cuts=True), aligner(A, B)
    for r in aligned.collect():
        a, b, pa, pb = plain(dict(rows)[r["doc_id"]])
        assert [b"".join(pa[:i]) for i in r["a_cuts"]] == [b"".join(pb[:j]) for j in r["b_cuts"]]
        assert r["a_cuts"][-1] == len(a) and r["b_cuts"][-1] == len(b) and len(r["a_cuts"]) == r["n_links"]
    table = linked_ids(spark, link_counts(aligned, len(worker.universe)), worker.universe, len(worker.b.entries)).collect()
    assert sum(r["n"] for r in table) == sum(r["n_links"] for r in aligned.collect())
    for r in table:
        x, y = worker.a.entries[r["a_id"]], worker.b.entries[r["b_id"]]
        assert x.endswith(y) or y.endswith(x)
    assert group_text(np.array([5, 60, 7]), np.array([1, 2]), np.array([1, 2]), np.array([0, 1]), worker.digits) == b"5,60|1;7|2;"
