import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from partita.llm import ann, language_id, lm_score

BIG = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{BIG}/documents.parquet")


@pytest.fixture(scope="module")
def languages(docs):
    return language_id.fit(docs)


def test_languages_of_held_out_documents(docs, languages):
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = language_id.identify(docs, languages).collect()
    assert len(got) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["rejected"] for r in got]) < 0.01


def test_held_out_rows_teach_nothing(docs, languages):
    changed = docs.withColumn("text", F.when(language_id.held_out(), F.lit("qqq zzz")).otherwise(F.col("text"))).withColumn("lang", F.when(language_id.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    again = language_id.fit(changed)
    assert np.allclose(again.idf, languages.idf) and np.allclose(again.rows, languages.rows) and again.langs == languages.langs


def test_language_edges(spark, languages):
    rows = [(1, None), (2, ""), (3, "123 !!! 456"), (4, "the and of that with"), (4, "the and of that with"), (None, "der die und nicht"), (5, "le la les des " * 60_000)]
    docs = spark.createDataFrame([(*r, "zz", 0.5, True) for r in rows], "doc_id long, text string, lang string, score double, held_out boolean")
    got = {r["doc_id"]: r for r in language_id.identify(docs, languages).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4, None, 5)] == ["und", "und", "und", "en", "de", "fr"]
    assert all(got[i]["score"] == 0 and got[i]["rejected"] for i in (1, 2, 3))
    kept = language_id.keep_identified(docs, languages)
    assert kept.columns == docs.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 4, 4, 5]
    assert language_id.identify(docs.limit(0), languages).count() == 0
    nothing = language_id.fit(docs.filter("false"))
    assert {r["lang_pred"] for r in language_id.identify(docs, nothing).collect()} == {"und"}


def test_nearest_centroid_matches_brute_force(docs, languages):
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(60).collect() if r["text"]]
    best, score, _ = languages.nearest(texts)
    for t, lang, s in zip(texts, best, score, strict=True):
        v = np.log1p(language_id.ngram_counts(t).astype(float)) * languages.idf
        cosines = [float(v @ c / np.sqrt(v @ v) / np.sqrt(c @ c)) for c in languages.rows.astype(float)]
        assert abs(max(cosines) - s) < 1e-4
        assert lang in {languages.langs[k] for k in range(len(cosines)) if cosines[k] > max(cosines) - 1e-4}


def test_junk_is_rejected_and_clean_documents_stay(spark, docs, languages):
    rng = random.Random(9)
    letters = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n)) for n in (5, 20, 80, 300, 2000) for _ in range(10)]
    with open(language_id.__file__) as f:
        code = f.read()
    code = [code[i : i + n] for n in (300, 1000, 3000) for i in range(0, 6000, 1500)]
    other = ["\u3053\u308c\u306f\u65e5\u672c\u8a9e\u306e\u6587\u7ae0\u3067\u3059\u3002" * n for n in (2, 20, 200)]
    for junk in (letters, code, other):
        assert np.mean(languages.predict(junk)[2]) >= 0.95
    held = docs.filter(language_id.held_out())
    kept = language_id.keep_identified(held, languages)
    assert kept.count() >= 0.98 * held.count()
    assert language_id.keep_identified(docs, languages).count() >= 0.99 * docs.count()
    short = [w for r in docs.limit(100).collect() if r["text"] for w in [" ".join(r["text"].split()[:12])]]
    assert np.mean(languages.predict(short)[2]) <= 0.03


def brute_neighbours(rows, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        s = np.where(ids == ids[i], -np.inf, u @ u[i])
        out[int(ids[i])] = [int(ids[j]) for j in np.lexsort((ids, -s))[: min(k, len(ids) - 1)]]
    return out


def test_recall_against_brute_force(spark):
    base = spark.read.parquet(f"{BIG}/embeddings.parquet")
    want = brute_neighbours([(r["vec_id"], r["embedding"]) for r in base.collect()], 5)
    rows = ann.search(base, F.col("vec_id") % 50 == 0, chunk=100, block=3).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.9


def test_all_lists_and_no_doubt_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(40).tolist()) for i in range(700)] + [(700 + i, [1.0] * 40) for i in range(20)]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(ann.search(base, F.col("vec_id") % 50 == 0, probes=1.0, doubt=1e9, chunk=64).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute_neighbours(rows, 5)
    assert {q: [v for v, _ in x] for q, x in got.items()} == want
    assert [v for v, _ in got[700]] == [701, 702, 703, 704, 705]  # ties to the smaller id
    for q, x in got.items():
        a = np.array(rows[q][1])
        assert all(abs(s - a @ np.array(rows[v][1]) / np.linalg.norm(a) / np.linalg.norm(rows[v][1])) < 1e-12 for v, s in x)


def test_neighbour_edges(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf"), 1.0]), (6, [2.0, 0.0]), (7, []), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (50, [-1.0, 0.0])]
    base = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, rank int, score double")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in ann.search(base, F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 6, 1.0), (0, 2, 50, -1.0), (50, 1, 0, -1.0), (50, 2, 6, -1.0)]
    assert ann.search(base.limit(0), F.lit(True)).count() == 0


def small(*words):
    """A vocabulary of these words with ids of their own; any other word has a thousandth of its bucket."""
    return lm_score.Vocabulary({w.encode(): (i, 0.0) for i, w in enumerate(words)}, np.full(lm_score.TOKENS - lm_score.FREQUENT, np.log(0.001)))


def test_gradients():
    net = lm_score.start(small("the", "a"))
    p = {k: v.astype(float).copy() for k, v in lm_score._cut(net.flat).items()}
    g = {k: np.zeros_like(v) for k, v in p.items()}
    rng = np.random.default_rng(4)
    target, context = lm_score.windows([rng.integers(0, lm_score.TOKENS, n).astype(np.int16) for n in (40, 1, 7)])
    assert len(target) == 48 and (context[40] == lm_score.PAD).all()
    lm_score.step(p, target, context, g)
    for k in p:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        p[k][i] += 1e-5
        up = -lm_score.step(p, target, context).mean()
        p[k][i] -= 2e-5
        down = -lm_score.step(p, target, context).mean()
        p[k][i] += 1e-5
        assert abs(g[k][i] - (up - down) / 2e-5) < 1e-6


def test_probabilities_sum_to_one():
    net = lm_score.start(small("x"))
    p = lm_score._cut(net.flat.astype(float))
    context = np.tile(np.array([[3, 4, 5, 6]]), (lm_score.TOKENS, 1))
    logp = lm_score.step(p, np.arange(lm_score.TOKENS), context)
    assert abs(np.exp(logp).sum() - 1) < 1e-9


def test_shares_of_words_sum_to_one(docs):
    words = lm_score.vocabulary(docs)
    seen = {w.encode() for r in docs.collect() if r["text"] for w in r["text"].lower().split()}
    share = {}
    for w in seen:
        i, s = words.words.get(w) or (lm_score.bucket(w), words.rest[lm_score.bucket(w) - lm_score.FREQUENT])
        share[i] = share.get(i, 0) + np.exp(s)
    assert all(abs(x - 1) < 0.02 for x in share.values()) and len(share) > lm_score.FREQUENT


def brute_score(rows, net):
    """Sums of log-probabilities word by word, with the contexts that other texts share."""
    p = {k: v.astype(float) for k, v in lm_score._cut(net.flat).items()}
    texts = [lm_score.Vocabulary.encode(net.vocabulary, t) for t in rows]
    mark = lambda x: int(lm_score.mixed(np.array([x % 2**64], dtype=np.uint64))[0])
    around = [[(int(h[i - 1]) if i else 0, int(h[i + 1]) if i + 1 < len(h) else 0) for i in range(len(h))] for *_, h in texts]
    seen = [{(c, int(h[i])) for i, c in enumerate(a)} for a, (*_, h) in zip(around, texts, strict=True)]
    out = []
    for d, (ids, shares, h) in enumerate(texts):
        total = 0.0
        for i, x in enumerate(ids):
            context = [int(ids[i + o]) if 0 <= i + o < len(ids) else lm_score.PAD for o in (-2, -1, 1, 2)]
            hidden = np.tanh(np.concatenate([p["embed"][c] for c in context]) @ p["mix"] + p["mix_b"])
            group, member = x % lm_score.CLASSES, x // lm_score.CLASSES
            a, b = hidden @ p["group"] + p["group_b"], hidden @ p["member"][group] + p["member_b"][group]
            prob = np.exp(a[group] - np.log(np.exp(a).sum()) + b[member] - np.log(np.exp(b).sum()) + shares[i])
            left, right = around[d][i]
            others = [w for e, s in enumerate(seen) if e != d for c, w in s if c == (left, right)]
            if others and mark(left * 0x9E3779B97F4A7C15 + right) % lm_score.REMEMBERED == 0:
                n, t = len(others), len(set(others))
                prob = (1 - n / (n + t)) * prob + n / (n + t) * others.count(int(h[i])) / n
            total += np.log(prob)
        out.append(total)
    return out


def test_scores_match_brute_force(spark):
    net = lm_score.start(small(*"abcdefg"))
    rng = random.Random(6)
    rows = [" ".join(rng.choice(["a", "b", "c", "d", "other", "words"]) for _ in range(n)) for n in (1, 2, 30, 30, 80)]
    rows.append(rows[-1])
    rows += ["q1 a q2 q1 b q2 q1 c q2 " * 12, "q1 a q2 " * 40, "lone x frame lone y frame " * 30]  # several words of its own in a context, with and without others
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r["log_likelihood"] for r in lm_score.score(docs, net).collect()}
    want = brute_score(rows, net)
    assert all(abs(got[i] - w) < 1e-3 * max(1, abs(w)) for i, w in enumerate(want))


def test_every_context_is_remembered(spark):
    net = lm_score.start(small(*"abcdefg"))
    texts = ["a b c d e f g a c e g b d f", "g f e d c b a", "", None, "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = lm_score.network_scores(lm_score.encoded(docs, net.vocabulary), net).collect()
    assert {r["doc_id"]: (len(r["k2"]), len(r["logp"])) for r in got} == {i: (len((t or "").split()),) * 2 for i, t in enumerate(texts)}


def test_a_text_alone_gains_nothing_from_itself(spark):
    frames = spark.createDataFrame([(1, [10, 10, 20], [1, 2, 3], [True, True, True], [2, 2, 1], [-0.7, -0.7, -0.1])], "rid long, k2 array<long>, k3 array<long>, first array<boolean>, own array<int>, logp array<float>")
    assert lm_score.memory_gains(frames).count() == 0
    other = spark.createDataFrame([(2, [10], [2], [True], [1], [-0.7])], frames.schema)
    gains = {r["rid"]: r["gain"] for r in lm_score.memory_gains(frames.unionByName(other)).collect()}
    # for text 1 the other has word 2 alone there: N = T = 1; for text 2 the others are words 1 and 2, N = T = 2
    p = np.exp(np.float32(-0.7))
    assert abs(gains[1] - (np.log(p / 2) + np.log(p / 2 + 0.5) - 2 * np.log(p))) < 1e-6
    assert abs(gains[2] - (np.log(p / 2 + 0.5 * 0.5) - np.log(p))) < 1e-6


def test_hot_contexts_are_counted_apart_and_alike(spark):
    net = lm_score.start(small(*"abcdefg"))
    rng = random.Random(8)
    rows = [" ".join(rng.choice(["a", "b", "other", "words"]) for _ in range(n)) for n in (1, 0, 200, 300, 80)] + ["a b a b a b", "q1 a q2 q1 b q2 " * 20]
    texts = lm_score.encoded(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(1), net.vocabulary)
    hot = lm_score._hot_contexts(texts, 700, 40)
    assert 0 < len(hot) < 30
    plain, apart = ({r["rid"]: r["total"] for r in lm_score.text_scores(texts, net, most).collect()} for most in (1 << 40, 40))
    assert set(plain) == set(apart) and len(plain) == 6 and all(abs(apart[i] - v) < 1e-4 * abs(v) for i, v in plain.items())
    want = brute_score(rows, net)
    assert all(abs(plain[i] - want[i]) < 1e-3 * abs(want[i]) for i in plain)


def test_a_token_takes_few_bytes_of_disk(spark, docs):
    words = lm_score.vocabulary(docs)
    texts = lm_score.encoded(docs, words)
    n = texts.selectExpr("sum(n_tokens) n").first()["n"]
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(texts.inputFiles()[0]).getParent()
    assert path.getFileSystem(conf).getContentSummary(path).getLength() < 6 * n  # 26 with two hashes of its context
    each = lm_score._dealt(texts, lm_score.start(words), 8, 1, np.zeros(0, dtype=np.uint64))
    packed = each.selectExpr("sum(octet_length(keys) + octet_length(words) + octet_length(logs) + octet_length(docs)) n").first()["n"]
    assert packed < 16 / lm_score.TURNS * 1.1 * n


def test_partitions_change_nothing_and_words_are_learnt(spark, docs):
    words = lm_score.vocabulary(docs)
    means = []
    for parts in (1, 8, 64):
        texts = lm_score.encoded(docs.repartition(parts), words)
        got = lm_score.score(docs, lm_score.train(texts, lm_score.start(words)), texts).filter("n_tokens > 0")
        one = got.selectExpr("sum(log_likelihood) s", "sum(n_tokens) n").first()
        means.append(one["s"] / one["n"])
    assert max(means) - min(means) < 0.01 * abs(means[0])
    counts = {}
    for r in docs.collect():
        for w in (r["text"] or "").lower().split():
            counts[w] = counts.get(w, 0) + 1
    n = np.array(list(counts.values()))
    assert min(means) > (n * np.log(n / n.sum())).sum() / n.sum() + 0.3


def test_scores_prefer_the_order_of_words(spark, docs):
    words = lm_score.vocabulary(docs)
    net = lm_score.train(lm_score.encoded(docs, words), lm_score.start(words))
    rng = random.Random(5)
    rows = []
    for r in docs.filter("length(text) between 2000 and 6000").orderBy("doc_id").limit(40).collect():
        w = r["text"].split()
        rng.shuffle(w)
        rows += [(2 * r["doc_id"], r["text"]), (2 * r["doc_id"] + 1, " ".join(w))]
    got = {r["doc_id"]: r for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), net).collect()}
    assert all(got[i]["n_tokens"] == len(t.split()) for i, t in rows)
    assert np.mean([got[i]["mean_log_likelihood"] > got[i + 1]["mean_log_likelihood"] for i, _ in rows[::2]]) >= 0.8


def test_copies_score_higher_than_singles(spark):
    rng = random.Random(7)
    make = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(120))
    twice = [make() for _ in range(20)]
    rows = list(enumerate([make() for _ in range(60)] + twice + twice))
    got = {r["doc_id"]: r["mean_log_likelihood"] for r in lm_score.masked_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert min(got[i] for i in range(60, 100)) > max(got[i] for i in range(60))


def test_score_edges(spark):
    net = lm_score.start(small("a"))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b a"), (4, "a b a"), (None, "c"), (5, "w " * 300_000)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, log_likelihood double")
    got = lm_score.score(docs, net).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert all(by[i]["n_tokens"] == 0 and by[i]["log_likelihood"] == 0 and by[i]["mean_log_likelihood"] is None for i in (1, 2, 3))
    assert by[5]["n_tokens"] == 300_000 and by[4]["n_tokens"] == 3
    assert lm_score.masked_scores(docs.limit(0)).count() == 0
