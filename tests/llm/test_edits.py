import random
import time

import numpy as np

from partita.llm import edits as E
from partita.llm import line_dedup as L


def letters(text):
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng, text, edits):
    b = list(text)
    for _ in range(edits):
        k = rng.randint(0, len(b))
        b[k : k + rng.randint(0, 2)] = [rng.choice("abzé今") for _ in range(rng.randint(0, 2))]
    return "".join(b)


def test_batches_are_exact():
    rng = random.Random(1)
    for most_letters in (3, 64, 65, 150, 300):
        pairs, most, want = [], [], []
        for _ in range(80):
            a = "".join(rng.choice("abcdé ") for _ in range(rng.randint(0, most_letters)))
            b = changed(rng, a, rng.randint(0, 1 + len(a) // 4))
            d = distance(a, b)
            pairs.append((letters(a), letters(b)))
            most.append(max(0, rng.choice([d - 1, d, d + 1, max(len(a), len(b)) // 5])))
            want.append(d <= most[-1])
        assert E.edits_within(*map(list, zip(*pairs, strict=True)), np.array(most)).tolist() == want
        assert 0 < sum(want) < len(want)


def test_blocks_at_both_ends_of_the_band():
    rng = random.Random(2)
    base = "".join(rng.choice("abcdefgh ") for _ in range(330))
    xs, ys, most, want = [], [], [], []
    for k in range(0, 66, 6):  # all of the difference at the start, at the end, or half gone and half new
        new = "".join(rng.choice("xyz") for _ in range(k))
        for b in (new + base, base + new, base[k:] + new, new + base[: len(base) - k]):
            xs.append(letters(base))
            ys.append(letters(b))
            d = k if len(b) != len(base) else distance(base, b)
            most.append(d - 1 if len(xs) % 2 and d else d)
            want.append(d <= most[-1])
    assert E.edits_within(xs, ys, np.array(most)).tolist() == want


def test_many_letters_are_split(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(E, "_MASKS", 2000)
    texts = ["".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(90)) for _ in range(20)]
    others = [changed(rng, t, 12) for t in texts]
    want = [distance(a, b) <= 18 for a, b in zip(texts, others, strict=True)]
    assert E.edits_within([letters(t) for t in texts], [letters(t) for t in others], np.full(20, 18)).tolist() == want


def test_unlike_lines_with_a_common_passage_are_decided_together():
    """Such lines fill buckets of bands; one by one they took most of op7's time."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    passage = " ".join(word() for _ in range(60))
    lines = [" ".join([*[word() for _ in range(30)], passage, *[word() for _ in range(30)]]) for _ in range(40)]
    pairs = [(a, b) for i, a in enumerate(lines) for b in lines[:i]]
    xs = [letters(x) for x in lines]
    size = np.array(list(map(len, lines)))
    i, j = np.tril_indices(len(lines), -1)
    most = (0.2 * np.maximum(size[i], size[j]) + 1e-9).astype(np.int64)
    start = time.process_time()
    together = E.edits_within([xs[k] for k in i], [xs[k] for k in j], most)
    middle = time.process_time()
    alone = [L.edit_similar(a.encode(), b.encode(), 0.8) for a, b in pairs]
    assert together.tolist() == alone
    assert middle - start < 0.5 * (time.process_time() - middle)
