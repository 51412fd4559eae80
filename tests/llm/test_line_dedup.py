import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from partita.llm import line_dedup as L
from partita.llm.common import stored


#: SimHash blocks alone, over lines of five words or more.
WORDS = {"bands": 0, "min_chars": None}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(docs, least=0.8, min_words=5):
    """Texts after dedup, by comparing all pairs of lines."""
    seen = sorted({(i, t) for i, t in docs if t is not None})
    lines = [(i, k, n) for i, t in seen for k, n in enumerate(L.normalised_lines(t)) if len(n.split()) >= min_words]
    fps = L.line_simhashes([n for *_, n in lines]).view(np.uint64) if lines else []
    root = list(range(len(lines)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(lines)):
        for j in range(i):
            a, b = lines[i][2].decode(), lines[j][2].decode()
            if a == b or ((int(fps[i]) ^ int(fps[j])).bit_count() <= 3 and distance(a, b) <= int((1 - least) * max(len(a), len(b)) + 1e-9)):
                p, q = top(i), top(j)
                root[max(p, q)] = min(p, q)
    gone = {}
    for i, (doc, k, _) in enumerate(lines):
        if top(i) != i:
            gone.setdefault(doc, set()).add(k)
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in seen}


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def made():
    rng = random.Random(5)
    base = [words(rng, n) for n in (6, 12, 60, 90, 120)]
    docs = []
    for i in range(40):
        some = []
        for _ in range(rng.randint(1, 6)):
            line = rng.choice(base) if rng.random() < 0.5 else words(rng, rng.randint(1, 12))
            if rng.random() < 0.5:
                w = line.split()
                w[rng.randrange(len(w))] = words(rng, 1)
                line = " ".join(w)
            some.append(rng.choice([line, line.upper(), line + "!!", line.replace(" ", "  ")]))
        docs.append((i, "\n".join(some)))
    return docs


def test_matches_all_pairs(spark, made):
    want = brute(made)
    assert want != dict(made)
    got = {r["doc_id"]: r["text"] for r in L.dedup_lines(spark.createDataFrame(made, "doc_id long, text string"), **WORDS).collect()}
    assert got == want


def test_matches_all_pairs_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) < 1500").limit(60)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    fixed = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in L.dedup_lines(fixed, **WORDS).collect()} == brute(rows)


def test_edges(spark):
    line = "one two three four five six"
    rows = [(1, None), (2, ""), (3, line), (4, f"{line}\nshort\n\nshort"), (4, f"{line}\nshort\n\nshort"), (None, line), (5, "ONE, two three; four five six 9\nx" + "y " * 90_000), (6, f"{line}\r\n{line}")]
    docs = spark.createDataFrame([(i, t, 0, "k", i, 1, 2) for i, t in rows], "doc_id long, text string, n_lines int, fp string, lid long, gone int, _gone int")
    out = L.dedup_lines(docs, **WORDS)
    got = {(r["doc_id"], r["text"], r["n_lines"], r["removed_lines"]) for r in out.collect()}
    assert out.count() == len(rows)
    # a null doc_id sorts first, so its occurrence stays
    assert {g for g in got if g[0] != 5} == {(1, None, 0, 0), (2, "", 1, 0), (3, "", 1, 1), (4, "short\n\nshort", 4, 1), (None, line, 1, 0), (6, "", 2, 2)}
    assert L.dedup_lines(docs.limit(0)).count() == 0


def test_edit_similarity_is_exact():
    rng = random.Random(6)
    for _ in range(800):
        a = "".join(rng.choice("abcé") for _ in range(rng.randint(0, 30)))
        b = list(a)
        for _ in range(rng.randint(0, 9)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = [rng.choice("abz")] * rng.randint(0, 1)
        b = "".join(b)
        assert L.edit_similar(a.encode(), b.encode(), 0.8) == (distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9))


def expected(line):
    h = {int(x) & ((1 << 46) - 1) for part in [line.split(b" ")[i : i + 1000] for i in range(0, line.count(b" ") + 1, 1000)] for x in L._word_hashes(b" ".join(part))[0]}
    f = L.mixed(np.array(sorted(h), dtype=np.uint64))
    return sum(1 << k for k in range(64) if 2 * int(((f >> np.uint64(k)) & np.uint64(1)).sum()) > len(f))


def test_a_line_has_the_hash_of_its_distinct_words():
    rng = random.Random(7)
    lines = [words(rng, 150_000).encode(), b"a b a a c", *(words(rng, rng.randint(1, 40)).encode() for _ in range(50)), b"x" * 1_500_000 + b" y"]
    assert len(lines[0]) > L._CHUNK // 2
    got = [int(x) & (2**64 - 1) for x in L.line_simhashes(lines)]
    assert got[:-1] == [expected(x) for x in lines[:-1]]
    assert L.line_simhashes([b"a b a c"])[0] == L.line_simhashes([b"c b a"])[0]


def test_bands_find_lines_of_edit_similarity(spark):
    rng = random.Random(8)
    rows, pairs = [], 0
    for i in range(120):
        line = words(rng, rng.randint(12, 60)).split()
        new = list(line)
        for k in rng.sample(range(len(line)), max(1, len(line) // 10)):
            new[k] = words(rng, 1)
        similar = L.edit_similar(" ".join(line).encode(), " ".join(new).encode(), 0.8)
        pairs += similar
        rows += [(2 * i, " ".join(line)), (2 * i + 1, " ".join(new))] if similar else []
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"] for r in L.dedup_lines(docs, bands=12).filter("removed_lines = 1").collect()}
    assert all(i % 2 for i in found)  # lines of other pairs are not alike
    assert len(found) >= 0.95 * pairs > 100
    assert L.dedup_lines(docs, **WORDS).filter("removed_lines = 1").count() < 0.5 * pairs


def test_bands_of_parts_and_hot_keys(spark):
    rng = random.Random(9)
    long = words(rng, 150_000).encode()
    whole, _ = L.line_bands([long, long[:-3] + b"xyz"], 12)
    assert (whole[0] == whole[1]).sum() >= 11
    base = words(rng, 30).split()
    rows = []
    for i in range(1200):
        w = list(base)
        w[i % 30] = words(rng, 1)
        rows.append((i, " ".join(w)))
    got = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), bands=12)
    assert got.filter("removed_lines = 0").count() == 1


def test_short_lines_are_grouped_exactly(spark):
    wide = "\u4eca\u65e5\u306f\u5929\u6c17\u304c\u826f\u3044\u306e\u3067\u6563\u6b69\u306b\u884c\u304d\u307e\u3057\u305f\u3068\u5f7c\u5973\u306f\u8a00\u3044\u307e\u3057\u305f\u3088"
    rows = [(1, f"Menu\n\nRead more!\n{wide}"), (2, f"menu\n\nread MORE\n{wide}\nmenus"), (3, wide[:20] + "x" + wide[20:]), (4, "\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in L.dedup_lines(docs, bands=12, min_chars=20).collect()}
    assert got == {1: rows[0][1], 2: "\nmenus", 3: "", 4: "\n\n"}


def test_recall_of_similar_lines(spark):
    """All pairs of the lines of up to 400 bytes of a table, by edit similarity alone."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = sorted({n for r in docs.collect() if r["text"] for n in L.normalised_lines(r["text"]) if L._fuzzy(n, 5, 20) and len(n) <= 400}, key=len)
    size = np.array([len(x) for x in lines])
    grams = np.zeros((len(lines), 512), dtype=np.uint8)
    for i, x in enumerate(lines):
        b = np.frombuffer(x, dtype=np.uint8).astype(np.int64)
        grams[i] = np.minimum(np.bincount((b[:-1] * 257 + b[1:]) % 509, minlength=512), 255)
    pairs = []
    for i, x in enumerate(lines):
        until = np.searchsorted(size, size[i] / 0.8 + 1, side="right")
        other = grams[i + 1 : until]
        # bigrams lost and gained: changes of up to a fifth of a line's letters in runs, or of an eighth anywhere
        apart = (np.maximum(other, grams[i]) - np.minimum(other, grams[i])).sum(axis=1, dtype=np.int64)
        pairs += [(x, lines[k]) for k in np.flatnonzero(apart <= 0.5 * size[i + 1 : until]) + i + 1 if L.edit_similar(x, lines[k], 0.8)]
    assert len(pairs) > 150
    rows = [(2 * i + j, x.decode()) for i, p in enumerate(pairs) for j, x in enumerate(p)]
    alone = spark.createDataFrame(rows, "doc_id long, text string")
    table = L.line_table(alone, bands=6).dropDuplicates(["h1", "h2"]).persist()
    links = {frozenset(((r["a"]["h1"], r["a"]["h2"]), (r["b"]["h1"], r["b"]["h2"]))) for r in L.similar_lines(alone, table).collect()}
    root = {}

    def top(v):
        while v in root:
            v = root[v]
        return v

    for a, b in map(tuple, links):
        if top(a) != top(b):
            root[top(a)] = top(b)
    name = lambda x: tuple(np.frombuffer(L.xxhash.xxh3_128_digest(x), dtype=np.int64).tolist())
    assert np.mean([top(name(a)) == top(name(b)) for a, b in pairs]) >= 0.9
    assert all(any(p == frozenset((name(a), name(b))) for a, b in pairs) for p in links)


def test_every_exact_copy_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = [n for r in L.dedup_lines(docs).select("text").distinct().collect() if r["text"] for n in L.normalised_lines(r["text"]) if n]
    assert len(kept) == len(set(kept))


def test_written_tables_leave_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def held():
        files = disk.getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_") and name.endswith(".data")}

    before, setting = held(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    table = stored(spark.range(100_000).groupBy((F.col("id") % 9973).alias("k")).agg(F.count("*").alias("n")), "counts")
    for _ in range(50):  # they go in the background
        if not (left := held() - before):
            break
        time.sleep(0.2)
    assert not left and table.agg(F.sum("n")).first()[0] == 100_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == setting
