"""SimHash near-duplicates: Burkhard-Keller trees in shards that share a block of the fingerprint."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partita.llm.common import bit_counts, fingerprints, group_numbers, lean, mixed, slices, spread_join, stored, whole_groups
from partita.llm.graph import connected_components
from partita.llm.hamming import RADIUS, buckets


def shingle_hashes(text: str | None, words_each: int = 3) -> Iterator[list[int]]:
    """XXH64 (seed 42) of every shingle of a text, in parts of bounded size."""
    h = xxhash.xxh64_intdigest
    held: list[bytes] = []
    seen = False
    for part in slices(text or ""):
        words = held + part.encode("utf-8", "surrogatepass").lower().split()
        if len(words) < words_each:
            held = words
            continue
        line = b" ".join(words)
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends[:-1]]
        yield [h(line[a : b - 1], 42) for a, b in zip(starts, ends[words_each - 1 :], strict=False)]
        seen = True
        held = words[len(words) - words_each + 1 :]
    if not seen and held:
        yield [h(b" ".join(held), 42)]


def simhash_batch(texts) -> np.ndarray:
    """Fingerprints of texts; zero for texts without a word."""
    n = len(texts)
    counts, totals = np.zeros((n, 64), dtype=np.int64), np.zeros(n, dtype=np.int64)
    owners: list[int] = []
    starts: list[int] = []
    pool: list[int] = []

    def flush() -> None:
        if pool:
            at = np.array(starts)
            np.add.at(counts, owners, bit_counts(np.array(pool, dtype=np.uint64), at))
            np.add.at(totals, owners, np.diff(np.append(at, len(pool))))
            owners.clear(), starts.clear(), pool.clear()

    for i, text in enumerate(texts):
        for part in shingle_hashes(text):
            owners.append(i)
            starts.append(len(pool))
            pool.extend(part)
            if len(pool) > 200_000:
                flush()
    flush()
    return fingerprints(counts, totals)


def simhash(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of 3-word shingles of whole texts, as a signed long."""

    def run(batches):
        for b in batches:
            texts = [t if isinstance(t, str) else None for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": simhash_batch(texts)})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(lean(run), "doc_id long, fp long")


class BKTree:
    """Children hang on integer Hamming distances to their parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, x: int) -> None:
        self.values.append(x)
        self.children.append({})
        new, at = len(self.values) - 1, 0
        while new:
            d = (self.values[at] ^ x).bit_count()
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = new
                return
            at = below

    def near(self, x: int, radius: int) -> list[int]:
        """Positions of values within the radius; only edges that can lead there are followed."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ x).bit_count()
            if d <= radius:
                found.append(at)
            todo.extend(c for e, c in self.children[at].items() if d - radius <= e <= d + radius)
        return found


def _tree_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join what the radius joins in one shard: at most one fewer than its values."""
    tree, root, links = BKTree(), list(range(len(values))), []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, x in enumerate(values):
        for j in tree.near(x, radius):
            a, b = top(i), top(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((x, values[j]))
        tree.add(x)
    return links


def fingerprint_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that join all that differ in `radius` bits or fewer."""
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"radius must be 0 to {RADIUS}: four blocks of 16 bits are compared")
    shards = (
        buckets(fps.select("fp").distinct())
        .groupBy("key", "part_a", "part_b")
        .agg(F.collect_list("fp").alias("fps"))
        .filter(F.size("fps") > 1)
        .select("fps")
    )

    def run(batches):
        for b in batches:
            links = [x for v in b["fps"] for x in _tree_links(np.sort(v).astype(np.int64).view(np.uint64).tolist(), radius)]
            ends = np.array(links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pd.DataFrame({"a": ends[:, 0], "b": ends[:, 1]})

    return shards.mapInPandas(lean(run), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs (doc_id, text; other columns are ignored).

    Fingerprints that differ in at most `radius` bits are linked; component_id is the smallest doc_id that a
    document reaches. Equal fingerprints meet in one aggregate first, so copies cost one row in the trees. Shard
    trees go to their queries by a shuffle on the shared block: to broadcast them all, the driver would have to
    hold every fingerprint. Null and empty texts have fingerprint 0 and are linked like any other. Repeated rows
    come back as often as they came; a null doc_id never names a component. An empty table gives no rows.
    """
    marks = stored(simhash(docs), "simhash")
    nodes = marks.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    roots = stored(connected_components(fingerprint_links(nodes, radius)), "roots")
    least = roots.join(nodes, roots.node == nodes.fp).groupBy("root").agg(F.min("first_id").alias("_least"), F.count("*").alias("n"))
    tops = spread_join(roots, least, ["root"], roots.count()).select(F.col("node").alias("fp"), "_least")
    classes = stored(nodes.join(tops, "fp", "left").select("fp", F.coalesce("_least", "first_id").alias("component_id"), "n"), "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    return spread_join(marks, classes, ["fp"], total).select("doc_id", "fp", "component_id")


#: Least hashes of a text's shingles in BINS bins; bands of ROWS bins shard the texts.
BANDS, ROWS = 12, 3
BINS = BANDS * ROWS
_BUCKET = ["key", "part_a", "part_b"]
_KEYS = [f"k{i}" for i in range(BANDS)]
_NONE = np.uint64(2**64 - 1)


def _all_hashes(text: str | None, words_each: int) -> np.ndarray:
    parts = list(shingle_hashes(text, words_each))
    return np.array([h for p in parts for h in p], dtype=np.uint64)


def shingle_set(text: str | None, words_each: int) -> np.ndarray:
    """The different shingles of a text as sorted 32-bit numbers."""
    return np.unique((_all_hashes(text, words_each) >> np.uint64(32)).astype(np.uint32))


def text_digest(text: str | None) -> bytes:
    """A 128-bit digest of the lower-cased words of a text."""
    h = xxhash.xxh3_128()
    for part in slices(text or ""):
        for w in part.encode("utf-8", "surrogatepass").lower().split():
            h.update(w + b" ")
    return h.digest()


def shard_keys(hashes: list[np.ndarray]) -> np.ndarray:
    """Texts by BANDS keys: MinHash of their shingles, one permutation dealt to bins; an empty bin gets a hash of its own over all shingles."""
    least = np.full((len(hashes), BINS), _NONE)
    sizes = np.array([len(h) for h in hashes])
    if sizes.sum():
        flat = mixed(np.concatenate(hashes))
        slot = np.repeat(np.arange(len(hashes)), sizes) * BINS + ((flat >> np.uint64(40)) % np.uint64(BINS)).astype(np.int64)
        np.minimum.at(least.reshape(-1), slot, flat & np.uint64((1 << 40) - 1))
    odd = mixed(np.arange(1, BINS + 1, dtype=np.uint64)) | np.uint64(1)
    for i in np.flatnonzero((least == _NONE).any(axis=1) & (sizes > 0)):
        own = mixed(hashes[i])
        for k in np.flatnonzero(least[i] == _NONE):
            least[i, k] = (own * odd[k]).min() | np.uint64(1 << 63)
    keys = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], len(hashes), axis=0)
    for k in range(BINS):
        keys[:, k // ROWS] = mixed(keys[:, k // ROWS] * np.uint64(0x9E3779B97F4A7C15) + least[:, k])
    return keys.view(np.int64)


def text_marks(docs: DataFrame, words_each: int) -> DataFrame:
    """(doc_id, h1, h2, fp, k0, ...): digest, SimHash and shard keys of every whole text."""

    def run(batches):
        for b in batches:
            texts = [t if isinstance(t, str) else None for t in b["text"]]
            for at in range(0, len(texts), 256):
                some = texts[at : at + 256]
                hashes = [_all_hashes(t, words_each) for t in some]
                sizes = np.array([len(h) for h in hashes])
                counts, full = np.zeros((len(some), 64), dtype=np.int64), np.flatnonzero(sizes)
                if len(full):
                    counts[full] = bit_counts(np.concatenate(hashes), (np.cumsum(sizes) - sizes)[full])
                digests = np.frombuffer(b"".join(map(text_digest, some)), dtype=np.int64).reshape(-1, 2)
                frame = {"doc_id": b["doc_id"].iloc[at : at + 256].to_numpy(), "h1": digests[:, 0], "h2": digests[:, 1], "fp": fingerprints(counts, sizes)}
                yield pd.DataFrame(frame | dict(zip(_KEYS, shard_keys(hashes).T, strict=True)))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(lean(run), "doc_id long, h1 long, h2 long, fp long" + "".join(f", {k} long" for k in _KEYS))


def _tree_pairs(fps: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Index pairs (earlier, later) of each group whose fingerprints a tree of the group finds within the radius."""
    edge = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group))
    for start, end in zip(edge, edge[1:], strict=False):
        tree = BKTree()
        for i in range(start, end):
            x = int(fps[i])
            for j in tree.near(x, radius):
                yield start + j, i
            tree.add(x)


def similar_texts(docs: DataFrame, each: DataFrame, words_each: int, similarity: float, radius: int, most: int = 128) -> DataFrame:
    """(a, b): links (structs of h1, h2) between texts of `each` (h1, h2, fp, k0, ...) whose sets of shingles have a Jaccard similarity of at least `similarity`.

    Texts that share a band of least shingle hashes are a shard; a tree of its fingerprints gives the pairs within the
    radius, whose sets are compared. Shards of over `most` texts are dealt to parts, each pair of which has its tree.
    """
    names = ["h1", "h2", "fp", *_KEYS]
    rows = each.select(*names, F.explode(F.array(*_KEYS)).alias("key"))
    live = rows.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1").select("key", F.ceil(F.col("_n") / most).cast("int").alias("_parts"))
    met = (
        rows.select("key", "h1", "h2", "fp")
        .join(live, "key")
        .withColumn("part", F.pmod(F.hash("h1"), F.col("_parts")))
        .select("key", "h1", "h2", "fp", "part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_o"))
        .select("key", F.least("part", "_o").alias("part_a"), F.greatest("part", "_o").alias("part_b"), "part", "h1", "h2", "fp")
    )

    def there(b: pd.DataFrame, i: int, j: int) -> bool:
        return b["part_a"].iat[i] == b["part_b"].iat[i] or b["part"].iat[i] != b["part"].iat[j]

    def near(batches):
        for b in whole_groups(batches, _BUCKET):
            found = np.zeros(len(b), dtype=bool)
            for i, j in _tree_pairs(b["fp"].to_numpy().view(np.uint64), group_numbers(b, _BUCKET), radius):
                if not (found[i] and found[j]) and there(b, i, j):
                    found[i] = found[j] = True
            yield b.loc[found, [*_BUCKET, "part", "h1", "h2"]]

    dealt = met.repartition(*_BUCKET).sortWithinPartitions(*_BUCKET)
    found = stored(dealt.mapInPandas(lean(near), "key long, part_a int, part_b int, part int, h1 long, h2 long"), "near-texts")
    some = stored(each.select(names).join(found.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi"), "near-marks")

    def sets(batches):
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                digests = np.frombuffer(b"".join(map(text_digest, part["text"])), dtype=np.int64).reshape(-1, 2)
                part = part[(digests == part[["h1", "h2"]].to_numpy()).all(axis=1)]  # an id may come with other texts
                yield pd.DataFrame({"h1": part["h1"], "h2": part["h2"], "shingles": [shingle_set(t, words_each).tobytes() for t in part["text"]]})

    wanted = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text").join(each.select("h1", "h2", F.col("first_id").alias("doc_id")).join(some.select("h1", "h2"), ["h1", "h2"], "left_semi"), "doc_id")
    held = wanted.select("h1", "h2", "text").mapInPandas(lean(sets), "h1 long, h2 long, shingles binary").groupBy("h1", "h2").agg(F.first("shingles").alias("shingles"))
    full = stored(some.join(held, ["h1", "h2"]), "near-sets")

    def verify(batches):
        for b in whole_groups(batches, _BUCKET):
            group, key, k = group_numbers(b, _BUCKET), b["key"].to_numpy(), b[_KEYS].to_numpy()
            label, links = np.arange(len(b)), []
            values = [np.frombuffer(x, dtype=np.uint32) for x in b["shingles"]]
            for i, j in _tree_pairs(b["fp"].to_numpy().view(np.uint64), group, radius):
                if label[i] == label[j] or not there(b, i, j) or k[i, (k[i] == k[j]).argmax()] != key[i]:
                    continue  # joined already, or compared in another bucket: that of their first common band
                x, y = values[i], values[j]
                both = int(np.isin(x, y, assume_unique=True).sum())
                if both >= similarity * (len(x) + len(y) - both):
                    label[label == label[j]] = label[i]
                    links.append((i, j))
            ends = np.array(links, dtype=np.int64).reshape(-1, 2)
            ids = b[["h1", "h2"]].to_numpy()
            yield pd.DataFrame(np.hstack([ids[ends[:, 0]], ids[ends[:, 1]]]), columns=["a1", "a2", "b1", "b2"])

    dealt = found.join(full, ["h1", "h2"]).repartition(*_BUCKET).sortWithinPartitions(*_BUCKET)
    links = dealt.mapInPandas(lean(verify), "a1 long, a2 long, b1 long, b2 long")
    return links.select(F.struct(F.col("a1").alias("h1"), F.col("a2").alias("h2")).alias("a"), F.struct(F.col("b1").alias("h1"), F.col("b2").alias("h2")).alias("b"))


def similar_groups(docs: DataFrame, words_each: int = 5, similarity: float = 0.8, radius: int = 22) -> DataFrame:
    """(doc_id, component_id) for every row of docs (doc_id, text): documents linked by similar sets of shingles.

    Texts of the same words are one; others are linked if their sets of `words_each`-word shingles have a Jaccard
    similarity of at least `similarity` (see similar_texts: a pair at 0.8 shares no band with a chance of 0.0002, and is
    beyond the radius of 22 bits with one of 0.0001). component_id is the smallest doc_id reachable. Null and empty texts have the
    same words; a text of fewer words is one shingle. Ids should be unique. An empty table gives no rows.
    """
    marks = stored(text_marks(docs, words_each), "text-marks")
    each = stored(marks.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("fp", *_KEYS)]), "texts")
    roots = stored(connected_components(similar_texts(docs, each.filter("first_id is not null"), words_each, similarity, radius)), "text-roots")
    ends = roots.select("node.h1", "node.h2", "root")
    tops = each.join(ends, ["h1", "h2"], "left").select("h1", "h2", "n", "first_id", F.coalesce("root", F.struct("h1", "h2")).alias("root"))
    tops = stored(tops, "text-tops")
    least = tops.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n"))
    classes = stored(spread_join(tops, least, ["root"], tops.count()).select("h1", "h2", "component_id", "n"), "text-classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    return spread_join(marks.select("doc_id", "h1", "h2"), classes, ["h1", "h2"], total).select("doc_id", "component_id")


def keep_one_each(docs: DataFrame, words_each: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs without later near-duplicates: of each component of similar_groups() the document with the smallest doc_id stays.

    Rows with a null doc_id stay: there is nothing to tell them apart by. A repeated row of the kept document
    stays once for each time its doc_id came with it.
    """
    gone = similar_groups(docs, words_each, similarity).filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
