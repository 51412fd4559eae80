"""Masked pseudo-likelihood: a small network predicts every token from both sides; the summed log-probabilities score texts."""

from __future__ import annotations

import zlib
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from partita.llm.common import lean, memory_kept, mixed, slices, spread_join, stored

#: Token ids are dealt to CLASSES groups; a token's probability is that of its group times that within the group.
CLASSES, MEMBERS = 32, 32
TOKENS = CLASSES * MEMBERS
#: Ids below FREQUENT are the most frequent words, the others are buckets of words with a like end; PAD stands beside a text's ends.
FREQUENT, PAD = TOKENS // 2, TOKENS
#: Words whose share of their bucket is kept one by one: the most frequent ones, this many at most.
LISTED = 1 << 17
#: Tokens to each side, numbers of a token's embedding, hidden units, tokens of a training step, tokens scored at once.
WINDOW, EMBED, HIDDEN, STEP, BLOCK = 2, 12, 32, 4096, 16_384
#: One context of so many is remembered with the words seen in it: every one.
REMEMBERED = 1
#: Numbers of a slice of the parameters when they travel.
SLOT = 4096
#: Tokens of a slice of the contexts, and the share of tokens (one in so many) above which a context is reported.
SLICE, HEAVY = 1 << 21, 1 << 14
#: Slices are dealt in so many turns, one after the other, each of which needs its share of the disk.
TURNS = 2

_SHAPES = {
    "embed": (TOKENS + 1, EMBED),
    "mix": (2 * WINDOW * EMBED, HIDDEN),
    "mix_b": (HIDDEN,),
    "group": (HIDDEN, CLASSES),
    "group_b": (CLASSES,),
    "member": (CLASSES, HIDDEN, MEMBERS),
    "member_b": (CLASSES, MEMBERS),
}


def _cut(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in _SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def _count() -> int:
    return sum(int(np.prod(s)) for s in _SHAPES.values())


def bucket(word: bytes) -> int:
    """The id of a word that has none of its own: words with the same last three bytes share one, so it tells of the language."""
    return FREQUENT + zlib.crc32(word[-3:]) % (TOKENS - FREQUENT)


def word_hash(words: list[bytes]) -> np.ndarray:
    return mixed(np.array([zlib.crc32(w) for w in words], dtype=np.uint64))


def _unmixed(h: np.ndarray) -> np.ndarray:
    """The CRC32 that mixed() made h of: its inverse."""
    h = h.copy()
    h ^= h >> np.uint64(31) ^ h >> np.uint64(62)
    h *= np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    h ^= h >> np.uint64(27) ^ h >> np.uint64(54)
    h *= np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    h ^= h >> np.uint64(30) ^ h >> np.uint64(60)
    return h.astype(np.uint32)


def _beside(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of the words beside each token, from hashes of the tokens of texts that start at `starts`; 0 stands beside a text's ends."""
    left, right = np.zeros_like(h), np.zeros_like(h)
    left[1:], right[:-1] = h[:-1], h[1:]
    first = starts[starts < len(h)]
    left[first] = 0
    right[first[first > 0] - 1] = 0
    return mixed(left * np.uint64(0x9E3779B97F4A7C15) + right)


@dataclass
class Vocabulary:
    """words: id and log of the share of that id's occurrences, for listed words; rest: log share of any other word of a bucket."""

    words: Mapping[bytes, tuple[int, float]]
    rest: np.ndarray

    def __post_init__(self) -> None:
        self.place = {w: i for i, w in enumerate(self.words)}
        # the last place stands in for words that are not listed
        self.ids = np.array([*(i for i, _ in self.words.values()), 0], dtype=np.int16)
        self.shares = np.array([*(v for _, v in self.words.values()), 0], dtype=np.float32)
        self.hashes = word_hash([*self.words, b""])

    def places(self, text: str | None) -> tuple[np.ndarray, list[bytes]]:
        """Where the lower-cased words of a text are listed (the last place: nowhere), and those that are not."""
        at, others, place, last = [], [], self.place, len(self.words)
        for part in slices(text or ""):
            words = part.lower().encode("utf-8", "surrogatepass").split()
            at.append(np.array([place.get(w, last) for w in words], dtype=np.int32))
            others += [words[n] for n in np.flatnonzero(at[-1] == last).tolist()]
        return np.concatenate(at), others

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, log shares and hashes of the lower-cased words of a text."""
        at, others = self.places(text)
        return self.values(at, np.array([bucket(w) for w in others], dtype=np.int16), np.array([zlib.crc32(w) for w in others], dtype=np.uint32))

    def values(self, at: np.ndarray, buckets: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, log shares and hashes of words by their places, of those without one by bucket and CRC32."""
        i, v, h = self.ids[at], self.shares[at], self.hashes[at]
        if len(buckets):
            new = np.flatnonzero(at == len(self.words))
            i[new], v[new], h[new] = buckets, self.rest[buckets - FREQUENT], mixed(sums.astype(np.uint64))
        return i, v, h


@dataclass
class Network:
    """A vocabulary and parameters of fixed size."""

    vocabulary: Vocabulary
    flat: np.ndarray


def start(vocabulary: Vocabulary, seed: int = 5) -> Network:
    rng = np.random.default_rng(seed)
    flat = np.zeros(_count(), dtype=np.float32)
    for name, a in _cut(flat).items():
        if a.ndim > 1 and name != "member_b":
            a[...] = rng.standard_normal(a.shape) * (0.3 if name == "embed" else a.shape[-2] ** -0.5)
    return Network(vocabulary, flat)


def windows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(targets, contexts): every token of the texts and the WINDOW tokens to each side of it."""
    gap = np.full(WINDOW, PAD, dtype=np.int32)
    flat = np.concatenate([gap, *(x for t in texts for x in (t.astype(np.int32), gap))])
    at = np.flatnonzero(flat != PAD)
    around = [o for o in range(-WINDOW, WINDOW + 1) if o]
    return flat[at], np.stack([flat[at + o] for o in around], axis=1) if len(at) else np.zeros((0, 2 * WINDOW), np.int32)


def _softmax(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Makes the columns of x exponentials of scores and returns the log-probability of each column's row `at`, and each column's sum."""
    x -= x.max(axis=0)
    picked = x[at, np.arange(len(at))]
    np.exp(x, out=x)
    total = x.sum(axis=0)
    return picked - np.log(total), total


def step(p: dict[str, np.ndarray], target: np.ndarray, context: np.ndarray, grad: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """Log-probability of each target given its context; with grad, also the gradient of minus their mean.

    Tokens are columns: sums over a few units then run along the rows.
    """
    n = len(target)
    order = np.argsort((target % CLASSES).astype(np.uint8), kind="stable")  # a group's tokens side by side
    context = context.take(order, axis=0)
    group, member = target[order] % CLASSES, target[order] // CLASSES
    edges = np.searchsorted(group, np.arange(CLASSES + 1))
    parts = [(c, slice(edges[c], edges[c + 1])) for c in range(CLASSES)]
    each = np.arange(n)
    x = p["embed"].take(context, axis=0).reshape(n, -1)
    with np.errstate(over="ignore"):  # tanh
        h = 1 - 2 / (np.exp(2 * (p["mix"].T @ x.T + p["mix_b"][:, None])) + 1)
    gp, mp = p["group"].T @ h + p["group_b"][:, None], np.empty((MEMBERS, n), dtype=h.dtype)
    for c, rows in parts:
        mp[:, rows] = p["member"][c].T @ h[:, rows]
        mp[:, rows] += p["member_b"][c][:, None]
    (gl, gs), (ml, ms) = _softmax(gp, group), _softmax(mp, member)
    out = np.empty_like(gl)
    out[order] = gl + ml
    if grad is not None:
        gp /= gs
        mp /= ms
        gp[group, each] -= 1
        mp[member, each] -= 1
        gp /= n
        mp /= n
        dh = p["group"] @ gp
        grad["group"][...] = h @ gp.T
        grad["group_b"][...] = gp.sum(axis=1)
        for c, rows in parts:
            dh[:, rows] += p["member"][c] @ mp[:, rows]
            grad["member"][c] = h[:, rows] @ mp[:, rows].T
            grad["member_b"][c] = mp[:, rows].sum(axis=1)
        dz = dh * (1 - h * h)
        grad["mix"][...] = (dz @ x).T
        grad["mix_b"][...] = dz.sum(axis=1)
        dx = (p["mix"] @ dz).reshape(2 * WINDOW, EMBED, n)
        flat = context.T.ravel()
        grad["embed"][...] = np.stack([np.bincount(flat, dx[:, d].ravel(), TOKENS + 1) for d in range(EMBED)], axis=1)
    return out


class Trainer:
    """Adam steps over a stream of token windows, on one part of the corpus."""

    def __init__(self, flat: np.ndarray, rate: float = 0.01) -> None:
        self.flat, self.rate, self.steps, self.tokens = flat.astype(np.float32).copy(), rate, 0, 0
        self.grad = np.zeros_like(self.flat)
        self.mean, self.square = np.zeros_like(self.flat), np.zeros_like(self.flat)
        self.p, self.g = _cut(self.flat), _cut(self.grad)

    def learn(self, texts: list[np.ndarray]) -> None:
        target, context = windows(texts)
        for at in range(0, len(target), STEP):
            n = len(target[at : at + STEP])
            step(self.p, target[at : at + STEP], context[at : at + STEP], self.g)
            self.steps += 1
            self.tokens += n
            self.mean += 0.1 * (self.grad - self.mean)
            self.square += 0.01 * (self.grad**2 - self.square)
            size = self.rate * min(1.0, n / STEP + 0.05) * np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
            self.flat -= size * self.mean / (np.sqrt(self.square) + 1e-8)


def vocabulary(docs: DataFrame) -> Vocabulary:
    """Ids and shares of words, from their counts over all documents.

    The FREQUENT most frequent lower-cased words (ties by the word) have ids, the others share the bucket of their end. Of
    the others the LISTED most frequent (fewer where a count is cut by the limit) have a share of their own; what is left of a bucket is divided evenly
    among its other words, however many the corpus has.
    """
    words = F.split(F.lower("text"), r"[\x20\x09-\x0D]+")
    counts = docs.select(F.explode(words).alias("word")).filter("word != ''").groupBy("word").agg(F.count("*").alias("n"))
    counts = stored(counts, "word-counts")
    held, least = 0, 1
    for r in counts.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():  # few different counts, however many words
        if held + r["count"] > LISTED:
            least = r["n"] + 1
            break
        held += r["count"]
    top = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    own = {r["word"].encode("utf-8", "surrogatepass"): i for i, r in enumerate(top)}
    listed = {r["word"].encode("utf-8", "surrogatepass"): r["n"] for r in counts.filter(F.col("n") >= least).collect()}
    end = F.expr("substring(encode(word, 'UTF-8'), greatest(octet_length(word) - 2, 1), 3)")
    rest = counts.filter(F.col("n") < least).groupBy((F.crc32(end) % (TOKENS - FREQUENT)).alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("words"))
    mass, many = np.zeros(TOKENS - FREQUENT), np.ones(TOKENS - FREQUENT)
    for r in rest.collect():  # a row per bucket
        mass[r["b"]], many[r["b"]] = r["n"], r["words"]
    total = mass.copy()
    for w, n in listed.items():
        if w not in own:
            total[bucket(w) - FREQUENT] += n
    left = np.maximum(mass, 1) / many / np.maximum(total, 1)
    table = {w: (bucket(w), float(np.log(n / total[bucket(w) - FREQUENT]))) for w, n in listed.items() if w not in own}
    return Vocabulary(table | {w: (i, 0.0) for w, i in own.items()}, np.log(left))


_ENCODED = "rid long, doc_id long, n_tokens long, ids binary, places binary, buckets binary, sums binary, heavy array<long>, times array<long>"


def encoded(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """A row per row of docs, stored: a row number, token ids and what gives words their shares and hashes again (`Vocabulary.values`).

    places has three bytes a token, first all low ones. heavy and times are contexts of over a HEAVY-th of some hundred thousand tokens and how often
    they occur there, beside the first of these rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(words)  # LISTED words at most

    def run(batches):
        rid = TaskContext.get().partitionId() << 40

        def done(out, hashes):
            lengths = [len(h) for h in hashes]
            k2 = np.sort(_beside(np.concatenate(hashes), np.cumsum([0, *lengths[:-1]])))
            first = np.flatnonzero(np.append(True, k2[1:] != k2[:-1])) if len(k2) else np.zeros(0, dtype=np.int64)
            many = np.diff(np.append(first, len(k2)))
            over = many > len(k2) // HEAVY
            out[0] = (*out[0][:-2], k2[first[over]].view(np.int64), many[over])
            return pd.DataFrame(out, columns=_NAMES)

        for b in batches:
            out, hashes, held = [], [], 0
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                at, others = shared.value.places(text if isinstance(text, str) else None)
                buckets, sums = np.array([bucket(w) for w in others], dtype=np.int16), np.array([zlib.crc32(w) for w in others], dtype=np.uint32)
                ids, _, h = shared.value.values(at, buckets, sums)
                planes = at.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes()
                out.append((rid, doc_id, len(at), ids.tobytes(), planes, buckets.tobytes(), sums.tobytes(), None, None))
                hashes.append(h)
                rid += 1
                held += len(at)
                if held > 500_000:
                    yield done(out, hashes)
                    out, hashes, held = [], [], 0
            if out:
                yield done(out, hashes)

    return stored(docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(lean(run), _ENCODED), "encoded", "zstd")


_NAMES = [c.split()[0] for c in _ENCODED.split(", ")]


def _sum_slots(rows: DataFrame, by: list[str], out: str) -> DataFrame:
    def add(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v, dtype="<f8") for v in g["value"])
        return pd.DataFrame([(*key, float(g["tokens"].sum()), total.tobytes())], columns=[*by, "tokens", "value"])

    return rows.groupBy(*by).applyInPandas(add, out)


def _learner(shared):
    """A function that trains a copy of the shared parameters on a group of token arrays and returns it in slices, times its tokens."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        with memory_kept():
            return learnt(key, g)

    def learnt(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        trainer, held, n = Trainer(shared.value), [], 0
        for ids in g.sort_values("h", kind="stable")["ids"]:
            held.append(np.frombuffer(ids, dtype=np.int16))
            n += len(held[-1])
            if n >= 32 * STEP:
                trainer.learn(held)
                held, n = [], 0
        if held:
            trainer.learn(held)
        flat = trainer.flat.astype("<f8") * trainer.tokens
        slots = range(0, len(flat), SLOT)
        return pd.DataFrame({"slot": [a // SLOT for a in slots], "task": int(key[0]) // 64, "tokens": float(trainer.tokens), "value": [flat[a : a + SLOT].tobytes() for a in slots]})

    return run


def train(texts: DataFrame, network: Network, rounds: int = 2, each: int = 1 << 20) -> Network:
    """The network after it has learnt from every token of texts (encoded() rows).

    Each round takes a share of the texts by a hash of their tokens, so that `rounds` rounds take each once. In a round
    learners of about `each` tokens, dealt by the same hash, train a copy each in the order of the hash, whatever the
    partitions of the table are; the copies are averaged, weighted by tokens. Slices of the parameters are summed in
    groups of learners first, then over the groups, so no task and not the driver holds more than a few copies.
    """
    spark = texts.sparkSession
    # the id joins the hash, so that copies of one text are spread
    rows = texts.filter("n_tokens > 0").select("ids", "n_tokens", F.xxhash64("ids", F.col("doc_id")).alias("h"))
    learners = max(1, -(-(rows.agg(F.sum("n_tokens")).first()[0] or 0) // (rounds * each)))
    rows = rows.withColumn("learner", F.pmod(F.shiftright("h", 8), F.lit(learners)).cast("int"))
    for r in range(rounds):
        shared = spark.sparkContext.broadcast(network.flat)

        part = rows.filter(F.pmod("h", F.lit(rounds)) == r)
        copies = part.groupBy("learner").applyInPandas(_learner(shared), "slot int, task int, tokens double, value binary")
        some = _sum_slots(copies, ["slot", "task"], "slot int, task int, tokens double, value binary")
        sums = stored(_sum_slots(some, ["slot"], "slot int, tokens double, value binary"), "parameters")
        slots = sorted(sums.collect(), key=lambda x: x["slot"])
        if slots:
            flat = np.concatenate([np.frombuffer(s["value"], dtype="<f8") / s["tokens"] for s in slots])
            network = Network(network.vocabulary, flat.astype(np.float32))
    return network


def _token_in(k2: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Hashes of contexts with their tokens."""
    return mixed(k2 * np.uint64(0xD6E8FEB86659FD93) + h)


def _chunks(texts, vocabulary: Vocabulary, p: dict[str, np.ndarray], chosen=None):
    """For frames of encoded() rows (frame, starts, h, k2, chosen places, logp): whole texts, some hundred thousand tokens at a time.

    h and k2 are hashes of the tokens and of the words beside them; logp is the log-probability of the tokens at the chosen places: all, or those
    where chosen(k2) says so.
    """
    for b in texts:
        lengths, rids, at = b["n_tokens"].to_numpy(), b["rid"].to_numpy(), 0
        while at < len(b):
            until = max(at + 1, int(np.searchsorted(np.cumsum(lengths[at:]), 32 * BLOCK)) + at)
            near = (np.diff(rids[at:until]) > 0) & (rids[at + 1 : until] - rids[at] < 1 << 16)  # row numbers as 16 bits
            until = at + 1 + int(np.argmin(np.append(near, False)))
            part = b.iloc[at:until]
            places = [np.frombuffer(x, dtype=np.uint8).reshape(3, -1).astype(np.int32) for x in part["places"]]
            places = np.concatenate([x[0] | x[1] << 8 | x[2] << 16 for x in places])
            buckets, sums = np.frombuffer(b"".join(part["buckets"]), dtype=np.int16), np.frombuffer(b"".join(part["sums"]), dtype=np.uint32)
            ids, shares, h = vocabulary.values(places, buckets, sums)
            starts = np.cumsum(lengths[at:until]) - lengths[at:until]
            k2 = _beside(h, starts)
            target, context = windows([ids[s : s + n] for s, n in zip(starts, lengths[at:until], strict=True)])
            mine = np.arange(len(k2))
            if chosen is not None:
                mine = np.flatnonzero(chosen(k2))
                target, context = target[mine], context[mine]
            logp = np.concatenate([np.zeros(0, dtype=np.float32), *(step(p, target[k : k + BLOCK], context[k : k + BLOCK]) for k in range(0, len(target), BLOCK))])
            yield part, starts, h, k2, mine, logp + shares[mine]
            at = until


def network_scores(texts: DataFrame, network: Network) -> DataFrame:
    """(rid, doc_id, n_tokens, base, k2, k3, first, own, logp): for encoded() rows the sum of the tokens' log-probabilities, and for each token a hash of the
    words beside it, one of those and the token, whether it is the first of equal ones in the text, how many different ones the text has there, and its
    log-probability.
    """
    shared = texts.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        p = _cut(shared.value.flat)
        for part, starts, h, k2, _, logp in _chunks(batches, shared.value.vocabulary, p):
            k3, rows, edges = _token_in(k2, h), [], np.append(starts, len(h))
            for i, j in zip(edges, edges[1:], strict=False):
                first = np.zeros(j - i, dtype=bool)
                first[np.unique(k3[i:j], return_index=True)[1]] = True
                there, which = np.unique(k2[i:j], return_inverse=True)
                own = np.bincount(which, weights=first, minlength=len(there))[which].astype(np.int32)
                rows.append((float(logp[i:j].sum(dtype=np.float64)), k2[i:j].view(np.int64), k3[i:j].view(np.int64), first, own, logp[i:j].astype(np.float32)))
            yield pd.concat([part[["rid", "doc_id", "n_tokens"]].reset_index(drop=True), pd.DataFrame(rows, columns=["base", "k2", "k3", "first", "own", "logp"])], axis=1)

    return texts.mapInPandas(lean(run), "rid long, doc_id long, n_tokens long, base double, k2 array<long>, k3 array<long>, first array<boolean>, own array<int>, logp array<float>")


def memory_gains(scored: DataFrame) -> DataFrame:
    """(rid, gain): what mixing the contexts of all documents into the network's probabilities adds to each row's sum.

    A context's words are counted once a document, over all documents, and all that a document has there itself are taken off again. With
    N occurrences in other documents and T words of theirs in a context, the mix gives N / (N + T) to the share of the token among them; where
    no other document has the context, nothing is gained or lost.
    """
    return _gains(scored.select("rid", F.inline(F.arrays_zip("k2", "k3", "first", "own", F.col("logp").cast("array<double>").alias("logp")))))


def _gains(places: DataFrame) -> DataFrame:
    """memory_gains() of a row per token."""
    words = places.filter("first").groupBy("k2", "k3").agg(F.count("*").alias("n3"))
    both = words.join(words.groupBy("k2").agg(F.sum("n3").alias("n2"), F.count("*").alias("kinds")), "k2").filter("n2 > 1")
    both = stored(both.withColumn("n", F.col("n3")), "contexts")
    total = both.agg(F.sum("n")).first()[0] or 0
    found = spread_join(places, both, ["k2", "k3"], total).filter(F.col("n2") > F.col("own"))
    lone = F.when(F.col("n3") == 1, 1).otherwise(0)  # words that this document alone has there
    single = found.filter("own = 1").withColumn("lone", lone)
    several = found.filter("own > 1").withColumn("lone", F.sum(F.when(F.col("first"), lone).otherwise(0)).over(Window.partitionBy("rid", "k2")).cast("int"))
    every = single.unionByName(several)
    others, kinds = F.col("n2") - F.col("own"), F.col("kinds") - F.col("lone")
    weight = others / (others + kinds)
    mix = F.ln((1 - weight) * F.exp("logp") + weight * (F.col("n3") - 1) / others)
    return every.groupBy("rid").agg(F.sum(mix - F.col("logp")).alias("gain"))


_DEALT = "slice int, rid long, keys binary, words binary, logs binary, docs binary"


def _dealt(texts: DataFrame, network: Network, parts: int, turn: int, hot: np.ndarray) -> DataFrame:
    """Tokens of encoded() rows with their log-probabilities, packed by slices of the contexts' hash: the slices of a turn, without hot contexts.

    A row has 48 bits of the contexts' hashes beside the slice, CRC32 of the words, log-probabilities and the steps of the row numbers, which begin at rid. Rows
    without words have sums of these tokens by text, with row numbers as keys.
    """
    shared = texts.sparkSession.sparkContext.broadcast(network)

    def dealt(k2):
        return ((k2 >> np.uint64(40)) % np.uint64(parts)).astype(np.int32)

    def chosen(k2):
        mine = dealt(k2) % TURNS == turn
        return mine & ~np.isin(k2, hot) if len(hot) else mine

    def run(batches):
        p = _cut(shared.value.flat)
        for number, (part, starts, h, k2, mine, logp) in enumerate(_chunks(batches, shared.value.vocabulary, p, chosen)):
            if not len(mine):
                continue
            rids = part["rid"].to_numpy()
            doc = np.repeat(rids - rids[0], part["n_tokens"])[mine]
            slot = dealt(k2[mine])
            order = np.argsort(slot.astype(np.uint16) if parts < 1 << 16 else slot, kind="stable")
            base, there = np.bincount(doc, logp), np.flatnonzero(np.bincount(doc))
            keys = k2[mine[order]].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            words, logs, doc = _unmixed(h[mine[order]]), logp[order].astype(np.float32), doc[order]
            edges = np.searchsorted(slot[order], np.arange(parts + 1))
            out = [(number % parts, int(rids[0]), (rids[0] + there).tobytes(), None, base[there].tobytes(), None)]
            for i in np.flatnonzero(np.diff(edges)):
                rows = slice(edges[i], edges[i + 1])
                steps = np.diff(doc[rows], prepend=0).astype(np.uint16)
                out.append((i, int(rids[0]), keys[rows].tobytes(), words[rows].tobytes(), logs[rows].tobytes(), steps.tobytes()))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _DEALT.split(", ")])

    return texts.mapInPandas(lean(run), _DEALT)


def _hot_places(texts: DataFrame, network: Network, hot: np.ndarray) -> DataFrame:
    """(rid, k2, k3, first, own, logp): a row per token of encoded() rows in one of the hot contexts (sorted), as in network_scores."""
    shared = texts.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        p = _cut(shared.value.flat)
        for part, _, h, k2, mine, logp in _chunks(batches, shared.value.vocabulary, p, lambda k2: np.isin(k2, hot)):
            rid = np.repeat(part["rid"].to_numpy(), part["n_tokens"])[mine]
            k2, k3 = k2[mine], _token_in(k2[mine], h[mine])
            order = np.lexsort((k3, k2, rid))
            rid, k2, k3 = rid[order], k2[order], k3[order]
            turn = np.append(True, (rid[1:] != rid[:-1]) | (k2[1:] != k2[:-1]))[: len(rid)]
            first = turn | np.append(True, k3[1:] != k3[:-1])[: len(rid)]
            which = np.cumsum(turn) - 1
            own = np.bincount(which[first])[which] if len(rid) else which
            yield pd.DataFrame({"rid": rid, "k2": k2.view(np.int64), "k3": k3.view(np.int64), "first": first, "own": own, "logp": logp[order].astype(np.float32)})

    return texts.mapInPandas(lean(run), "rid long, k2 long, k3 long, first boolean, own int, logp double")


def _gained(g: pd.DataFrame) -> pd.DataFrame:
    """(rid, value): what the contexts of a slice add to the sums of texts (see memory_gains), and the sums that came along."""
    with memory_kept():
        return _slice_gains(g)


def _slice_gains(g: pd.DataFrame) -> pd.DataFrame:
    summed = g["words"].isna()
    out = [pd.DataFrame({"rid": np.frombuffer(k, dtype=np.int64), "value": np.frombuffer(v, dtype=np.float64)}) for k, v in zip(g.loc[summed, "keys"], g.loc[summed, "logs"], strict=True)]
    g = g[~summed]
    if len(g):
        packed = np.frombuffer(b"".join(g["keys"]), dtype=np.uint8).reshape(-1, 6)
        key = np.zeros((len(packed), 8), dtype=np.uint8)
        key[:, :6] = packed
        key = key.view("<u8").ravel()
        rid = np.concatenate([r + np.cumsum(np.frombuffer(d, dtype=np.uint16), dtype=np.int64) for r, d in zip(g["rid"], g["docs"], strict=True)])
        order = np.argsort(key, kind="stable")  # a text's tokens are side by side, and stay so within a context
        key, rid = key[order], rid[order]
        new = np.append(True, key[1:] != key[:-1])
        turn = new | np.append(True, rid[1:] != rid[:-1])  # a text's tokens in a context begin
        start = np.flatnonzero(new)
        live = np.repeat(np.add.reduceat(turn, start, dtype=np.int64) > 1, np.diff(np.append(start, len(key))))
        order, rid, new, turn = order[live], rid[live], new[live], turn[live]
        if len(order):
            context, mine = np.cumsum(new) - 1, np.cumsum(turn) - 1
            word = np.frombuffer(b"".join(g["words"]), dtype=np.uint32)[order]
            logp = np.frombuffer(b"".join(g["logs"]), dtype=np.float32)[order].astype(np.float64)
            both = context.astype(np.uint64) << np.uint64(32) | word
            by = np.argsort(both, kind="stable")
            kind = np.append(True, both[by[1:]] != both[by[:-1]])
            first = kind | np.append(True, mine[by[1:]] != mine[by[:-1]])
            start = np.flatnonzero(kind)
            n3 = np.empty(len(by), dtype=np.int64)
            n3[by] = np.repeat(np.add.reduceat(first, start, dtype=np.int64), np.diff(np.append(start, len(by))))
            once = by[first]
            n2, kinds = np.bincount(context[once]), np.bincount(context[by[start]])
            own, lone = np.bincount(mine[once]), np.bincount(mine[once], n3[once] == 1).astype(np.int64)
            others = n2[context] - own[mine]
            weight = others / (others + kinds[context] - lone[mine])
            gain = np.log((1 - weight) * np.exp(logp) + weight * (n3 - 1) / others) - logp
            rids, which = np.unique(rid, return_inverse=True)
            out.append(pd.DataFrame({"rid": rids, "value": np.bincount(which, gain)}))
    return pd.concat(out) if out else pd.DataFrame({"rid": np.zeros(0, dtype=np.int64), "value": np.zeros(0)})


def _hot_contexts(texts: DataFrame, total: int, most: int) -> np.ndarray:
    """Contexts of encoded() rows, sorted, among them all with `most` tokens or more (2 / HEAVY of all, if that is more); few more than total / most x 2.

    A context counts in each batch where it is over a HEAVY-th, so it lacks a HEAVY-th of all tokens at most.
    """
    least = max(most / 2, total / HEAVY)
    heavy = texts.filter("heavy is not null").select(F.inline(F.arrays_zip("heavy", "times")))
    found = heavy.groupBy("heavy").agg(F.sum("times").alias("n")).filter(F.col("n") >= least).collect()
    return np.sort(np.array([r["heavy"] for r in found], dtype=np.int64).view(np.uint64))


def text_scores(texts: DataFrame, network: Network, most: int = 2 * SLICE) -> DataFrame:
    """(rid, total): for encoded() rows the sum of the log-probabilities of their tokens, mixed with contexts remembered from all texts, stored.

    Tokens meet those of the same context in slices of about SLICE tokens, each packed in 14 bytes, and sums of texts come back, in TURNS turns. Contexts of
    over `most` tokens would overfill a slice: theirs are counted word by word (see memory_gains).
    """
    total = texts.agg(F.sum("n_tokens")).first()[0] or 0
    hot = _hot_contexts(texts, total, most)
    parts = TURNS * max(-(-total // (TURNS * SLICE)), int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    every = [
        stored(_dealt(texts, network, parts, turn, hot).groupBy("slice").applyInPandas(_gained, "rid long, value double").groupBy("rid").agg(F.sum("value").alias("value")), "text-scores")
        for turn in range(TURNS)
    ]
    if len(hot):
        places = stored(_hot_places(texts, network, hot), "hot-contexts")
        every += [places.select("rid", F.col("logp").alias("value")), stored(_gains(places), "hot-gains").withColumnRenamed("gain", "value")]
    return stored(reduce(DataFrame.unionByName, every).groupBy("rid").agg(F.sum("value").alias("total")), "text-scores")


def score(docs: DataFrame, network: Network, texts: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood) for every row of docs (doc_id, text).

    log_likelihood sums ln p(word | its WINDOW neighbours to each side) over the whole text: the network's probability of
    the word's id times the word's share of that id, mixed with what other documents have there. Null, empty and blank
    texts have 0 tokens, sum 0 and a null mean. Very long texts are read in parts; equal texts have equal scores
    but for rounding. Other columns are ignored; an empty table gives no rows.
    """
    texts = encoded(docs, network.vocabulary) if texts is None else texts
    total = F.coalesce("total", F.lit(0.0))
    out = texts.select("rid", "doc_id", "n_tokens").join(text_scores(texts, network), "rid", "left")
    return out.select("doc_id", "n_tokens", total.alias("log_likelihood"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_likelihood"))


def masked_scores(docs: DataFrame, rounds: int = 2) -> DataFrame:
    """Trains on all of docs and scores all of docs."""
    words = vocabulary(docs.filter(F.col("text").isNotNull()))
    texts = encoded(docs, words)
    return score(docs, train(texts, start(words), rounds), texts)
