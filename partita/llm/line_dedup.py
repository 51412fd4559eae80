"""Fuzzy line dedup: SimHash of normalised lines, pigeonhole blocks, bands of letter n-grams, edit similarity, one occurrence per group."""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partita.llm.common import bit_counts, fingerprints, group_numbers, lean, mixed, pairs_by_offset, spread_join, stored, whole_groups
from partita.llm.edits import edits_within
from partita.llm.graph import connected_components
from partita.llm.hamming import RADIUS, buckets, owned

#: Digits become 0, ASCII marks go, blanks beside the line end become spaces.
_FORM = bytes(48 if 48 <= c <= 57 else 32 if c in b"\t\x0b\x0c\r" else c for c in range(256))
_DROP = bytes(c for c in range(33, 127) if not chr(c).isalnum())

_BASE = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 20
#: Powers of an odd base and their inverses modulo 2^64.
_UP = np.concatenate(([np.uint64(1)], np.full(_CHUNK, _BASE, dtype=np.uint64))).cumprod(dtype=np.uint64)
_DOWN = np.concatenate(([np.uint64(1)], np.full(_CHUNK, np.uint64(pow(int(_BASE), -1, 1 << 64)), dtype=np.uint64))).cumprod(dtype=np.uint64)


def normalised_lines(text: str) -> list[bytes]:
    """The lines of a text, lower-cased, without marks, digits as 0, words one space apart."""
    raw = text.lower().encode("utf-8", "surrogatepass").translate(_FORM, _DROP)
    lines = raw.split(b"\n")
    return [b" ".join(x.split()) if b"  " in x or x[:1] == b" " or x[-1:] == b" " else x for x in lines]


def _fuzzy(line: bytes, min_words: int, min_chars: int | None) -> bool:
    """Whether a normalised line is long enough to be compared with others that are not equal to it."""
    if line.count(b" ") >= min_words - 1 and line:
        return True
    return min_chars is not None and len(line) >= min_chars and len(line.decode("utf-8", "surrogatepass")) >= max(min_chars, 1)


def _word_hashes(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a block, and where they start. Words are parted by single bytes of 32 or less."""
    b = np.frombuffer(block, dtype=np.uint8)
    stop = np.append(np.flatnonzero(b <= 32), len(b))
    start = np.append(0, stop[:-1] + 1)
    sums = np.append(np.uint64(0), np.cumsum(b * _UP[: len(b)], dtype=np.uint64))
    return mixed((sums[stop] - sums[start]) * _DOWN[start]), start


#: Bits of a word's hash that tell it from the line's other words; the bits above hold the line's place.
_OWN = np.uint64(46)


def _distinct(hashes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each owner's distinct hashes, owner by owner, and where each owner starts. Every owner has one at least."""
    key = owners.astype(np.uint64) << _OWN | hashes & np.uint64((1 << int(_OWN)) - 1)
    key.sort()
    key = key[np.append(True, key[1:] != key[:-1])]
    own = key >> _OWN
    return mixed(key & np.uint64((1 << int(_OWN)) - 1)), np.flatnonzero(np.append(True, own[1:] != own[:-1]))


def line_simhashes(lines: list[bytes]) -> np.ndarray:
    """SimHash of the distinct words of each normalised, non-empty line.

    A word counts once however often it occurs: the few words that every line of a language repeats would else make
    unrelated lines alike, and their pairs grow with the square of the lines.
    """
    counts, totals = np.zeros((len(lines), 64), dtype=np.int64), np.zeros(len(lines), dtype=np.int64)

    def add(at: list[int], block: list[bytes]) -> None:
        hashes, starts = _word_hashes(b"\n".join(block))
        sizes = np.fromiter(map(len, block), dtype=np.int64, count=len(block))
        first = np.searchsorted(starts, np.cumsum(sizes + 1) - sizes - 1)
        features, cuts = _distinct(hashes, np.repeat(np.arange(len(block)), np.diff(np.append(first, len(hashes)))))
        counts[at] = bit_counts(features, cuts)
        totals[at] = np.diff(np.append(cuts, len(features)))

    def add_long(i: int, line: bytes) -> None:
        """A line of over half a chunk: its words are hashed in parts; a word of over half a chunk is cut."""
        parts, held, room = [], b"", _CHUNK // 2
        for w in line.split(b" "):
            for k in range(0, len(w), room):
                cut = w[k : k + room]
                if held and len(held) + len(cut) >= room:
                    parts.append(_word_hashes(held)[0])
                    held = b""
                held = held + b" " + cut if held else cut
        hashes = np.concatenate([*parts, _word_hashes(held)[0]])
        features, cuts = _distinct(hashes, np.zeros(len(hashes), dtype=np.uint64))
        counts[i], totals[i] = bit_counts(features, cuts)[0], len(features)

    at, block, size = [], [], 0
    for i, line in enumerate(lines):
        if len(line) > _CHUNK // 2:
            add_long(i, line)
            continue
        if size + len(line) >= _CHUNK - 1:
            add(at, block)
            at, block, size = [], [], 0
        at.append(i)
        block.append(line)
        size += len(line) + 1
    if block:
        add(at, block)
    return fingerprints(counts, totals)


#: Letter n-grams are of 8 bytes; a band is the least hashes in 3 bins; of each bin 3 bits make the sketch.
_GRAM, _ROWS, _SKETCH = 8, 3, 3
_NONE = np.uint64(2**64 - 1)


def _least_hashes(block: bytes, n: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Of n lines, parted by line ends: the least n-gram hash that falls in each bin, and the least of a hash of its own per bin.

    The second serves bins that stay empty (only lines that have such are computed).
    """
    padded = block + b"\n" * _GRAM
    b = np.frombuffer(padded, dtype=np.uint8)
    m = len(b) - _GRAM + 1
    ends = np.flatnonzero(b[: len(block) + 1] == 10)
    inside = np.ones(m, dtype=bool)
    for j in range(_GRAM):  # an n-gram that begins there reaches over the line's end
        inside[np.maximum(ends - j, 0)] = False
    owner = np.repeat(np.arange(n), np.maximum(np.diff(ends, prepend=-1) - _GRAM, 0))
    h = mixed(np.ndarray(m, dtype="<u8", buffer=padded, strides=(1,))[inside])
    least, other = np.full((n, bins), _NONE), np.full((n, bins), _NONE)
    part = (h >> np.uint64(40)).astype(np.uint32)
    part -= part // np.uint32(bins) * np.uint32(bins)
    np.minimum.at(least.reshape(-1), owner * bins + part, h & np.uint64((1 << 36) - 1))
    short = (least == _NONE).any(axis=1)[owner]
    h, owner = h[short], owner[short]
    if len(h):
        start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        odd = mixed(np.arange(1, bins + 1, dtype=np.uint64)) | np.uint64(1)
        for k in range(bins):
            other[owner[start], k] = np.minimum.reduceat(h * odd[k], start) | np.uint64(1 << 63)
    return least, other


def line_bands(lines: list[bytes], bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (lines x bands) and sketches (lines x 2) of normalised lines: MinHash of the letter n-grams in bins.

    Lines with a Jaccard similarity J of n-grams share each key with a chance of J^3, and each 3 bits of the sketch with
    J + (1 - J) / 8. Lines shorter than an n-gram share keys only with each other.
    """
    bins = bands * _ROWS
    out = np.empty((len(lines), bins), dtype=np.uint64)

    def add(at: list[int], block: list[bytes]) -> None:
        least, other = _least_hashes(b"\n".join(block), len(block), bins)
        out[at] = np.where(least == _NONE, other, least)

    def add_long(i: int, line: bytes) -> None:
        least, other = np.full(bins, _NONE), np.full(bins, _NONE)
        for k in range(0, len(line), _CHUNK // 2):
            a, _ = _least_hashes(line[k : k + _CHUNK // 2 + _GRAM - 1], 1, bins)
            least = np.minimum(least, a[0])
        if (least == _NONE).any():
            odd = mixed(np.arange(1, bins + 1, dtype=np.uint64)) | np.uint64(1)
            grams = np.array(sorted({int.from_bytes(line[k : k + _GRAM], "little") for k in range(len(line) - _GRAM + 1)}), dtype=np.uint64)
            other = np.array([(mixed(grams) * x).min() | np.uint64(1 << 63) for x in odd], dtype=np.uint64)
        out[i] = np.where(least == _NONE, other, least)

    at, block, size = [], [], 0
    for i, line in enumerate(lines):
        if len(line) > _CHUNK // 2:
            add_long(i, line)
            continue
        if size + len(line) >= _CHUNK - 1:
            add(at, block)
            at, block, size = [], [], 0
        at.append(i)
        block.append(line)
        size += len(line) + 1
    if block:
        add(at, block)
    keys = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None, :], len(lines), axis=0)
    sketch = np.zeros((len(lines), 2), dtype=np.uint64)
    for k in range(bins):
        band, half = k // _ROWS, k * 2 // bins
        keys[:, band] = mixed(keys[:, band] * _BASE + out[:, k])
        sketch[:, half] = sketch[:, half] << np.uint64(_SKETCH) | mixed(out[:, k]) & np.uint64((1 << _SKETCH) - 1)
    return keys.view(np.int64), sketch.view(np.int64)


def _alike(s0: np.ndarray, s1: np.ndarray, i: np.ndarray, j: np.ndarray, bands: int) -> np.ndarray:
    """Which of the pairs (i, j) have sketches (halves s0, s1) that agree in at least a third of the bins."""
    bins = bands * _ROWS
    low = np.uint64(sum(1 << (_SKETCH * k) for k in range(bins // 2 + 1)))
    differ = np.zeros(len(i), dtype=np.int64)
    for s in (s0, s1):
        d = s[i].view(np.uint64) ^ s[j].view(np.uint64)
        differ += np.bitwise_count((d | d >> np.uint64(1) | d >> np.uint64(2)) & low)
    return differ <= bins - -(-bins // 3)


def _aligned_cost(s: list[str], t: list[str]) -> int:
    """An upper bound of the edit distance of two texts, given by their words.

    Pairs of words that occur once in both stay where they are in the same order; what lies between is replaced.
    """

    def single(words: list[str]) -> dict[tuple[str, str], int]:
        seen: dict[tuple[str, str], int] = {}
        for i, g in enumerate(zip(words, words[1:], strict=False)):
            seen[g] = -1 if g in seen else i
        return seen

    other = single(t)
    places = [(i, j) for g, i in single(s).items() if i >= 0 and (j := other.get(g, -1)) >= 0]
    ends: list[int] = []  # the least last place in t of a chain of each length, and its index in places
    last: list[int] = []
    back = []
    for n, (_, j) in enumerate(places):
        k = bisect_left(ends, j)
        back.append(last[k - 1] if k else -1)
        ends[k : k + 1], last[k : k + 1] = [j], [n]
    kept, at = set(), last[-1] if last else -1
    while at >= 0:
        i, j = places[at]
        kept |= {(i, j), (i + 1, j + 1)}
        at = back[at]
    from_s, from_t = [0, *accumulate(len(w) + 1 for w in s)], [0, *accumulate(len(w) + 1 for w in t)]
    cost, i, j = 0, 0, 0  # words before i and j are dealt with
    for p, q in [*sorted(kept), (len(s), len(t))]:
        if p >= i and q >= j:
            cost += max(from_s[p] - from_s[i], from_t[q] - from_t[j])
            i, j = p + 1, q + 1
    return cost


def _grams_apart(x: np.ndarray, y: np.ndarray, q: int) -> int:
    """How many q-grams, counted in hashed bins, one of two letter sequences has more than the other: an edit changes 2 q at most."""
    counts = []
    for v in (x, y):
        n = max(len(v) - q + 1, 0)
        h = np.zeros(n, dtype=np.int64)
        for k in range(q):
            h = h * 1_000_003 + v[k : k + n]
        counts.append(np.bincount((h & 0xFFFFFFFFFFFF) % 4093, minlength=4093))
    return int(np.abs(counts[0] - counts[1]).sum())


def edit_similar(a: bytes, b: bytes, least: float) -> bool:
    """1 - (edit distance of characters) / (longer length) >= least, exactly.

    Equal ends are cut off first; the distance can only come from what lies between. Upper bounds accept most pairs,
    lower ones (an edit changes 2 q letter q-grams at most) reject others, bit-parallel dynamic programming decides the rest.
    """
    s, t = a.decode("utf-8", "surrogatepass"), b.decode("utf-8", "surrogatepass")
    longest = max(len(s), len(t))
    most = int((1 - least) * longest + 1e-9)
    if abs(len(s) - len(t)) > most:
        return False
    n = min(len(s), len(t))
    x, y = (np.frombuffer(v.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for v in (s, t))
    off = np.flatnonzero(x[:n] != y[:n])
    head = int(off[0]) if len(off) else n
    off = np.flatnonzero(x[len(x) - n + head :][::-1] != y[len(y) - n + head :][::-1])
    tail = int(off[0]) if len(off) else n - head
    s, t = s[head : len(s) - tail], t[head : len(t) - tail]
    if max(len(s), len(t)) <= most:
        return True
    if not s or not t:
        return False
    words, others = s.split(" "), t.split(" ")
    if len(words) == len(others) and sum(max(len(v), len(w)) for v, w in zip(words, others, strict=True) if v != w) <= most:
        return True  # replacing the words that differ, place by place, is cheap enough
    x, y = x[head : len(x) - tail].astype(np.int64), y[head : len(y) - tail].astype(np.int64)
    if _grams_apart(x, y, 2) > 4 * most:
        return False
    if _aligned_cost(words, others) <= most:
        return True
    if any(_grams_apart(x, y, q) > 2 * q * most for q in (3, 4)):
        return False
    return bool(edits_within([x], [y], [most])[0])


#: Pairs, and rows of whole buckets, that wait for a joint decision; lines of more letters are decided pair by pair, where bounds save more.
_WAITING, _ROOM, _LONG = 65_536, 40_000, 4096
#: Distances within a bucket after which the pairs so far are decided all the same: what neighbours join needs no further comparison.
_SOON = (1, 3, 8, 32, 128)


def _gathered(frames):
    """Frames of lines (norm) put together until they have _ROOM rows or 32 MB."""
    held, rows, size = [], 0, 0
    for b in frames:
        held.append(b)
        rows, size = rows + len(b), size + int(b["norm"].map(len).sum())
        if rows >= _ROOM or size >= 32 << 20:
            yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            held, rows, size = [], 0, 0
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]


def _same_ends(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two letter sequences without what they begin and end with alike, where that is a quarter of them at least (else as they are)."""
    n = min(len(x), len(y))
    if not n or (x[0] != y[0] and x[-1] != y[-1]):
        return x, y
    off = np.flatnonzero(x[:n] != y[:n])
    head = int(off[0]) if len(off) else n
    off = np.flatnonzero(x[len(x) - n + head :] != y[len(y) - n + head :])
    tail = n - head - 1 - int(off[-1]) if len(off) else n - head
    return (x[head : len(x) - tail], y[head : len(y) - tail]) if 4 * (head + tail) >= n else (x, y)


def _band_columns(bands: int) -> list[str]:
    return ["s0", "s1", *(f"k{i}" for i in range(bands))] if bands else []


def line_table(docs: DataFrame, min_words: int = 5, min_chars: int | None = 20, bands: int = 0) -> DataFrame:
    """(doc_id, text_hash, line, h1, h2, fp, s0, s1, k0, ...): each line that is not blank; h1 and h2 are its 128-bit digest.

    fp and what follows (two halves of the sketch, a key per band) are null where the line has neither `min_words` words
    nor `min_chars` characters. Without min_chars such lines are left out.
    """
    names = _band_columns(bands)

    def run(batches):
        for b in batches:
            ids, hashes, at, lines = [], [], [], []
            held = 0

            def out() -> pd.DataFrame:
                digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in lines), dtype=np.int64).reshape(-1, 2)
                frame = {"doc_id": pd.array(ids, dtype="Int64"), "text_hash": hashes, "line": at, "h1": digests[:, 0], "h2": digests[:, 1]}
                mine = np.array([_fuzzy(x, min_words, min_chars) for x in lines], dtype=bool)
                fuzzy = [x for x, m in zip(lines, mine, strict=True) if m]
                values = [line_simhashes(fuzzy)]
                if bands:
                    keys, sketch = line_bands(fuzzy, bands)
                    values += [*sketch.T, *keys.T]
                for name, v in zip(["fp", *names], values, strict=True):
                    full = np.zeros(len(lines), dtype=np.int64)
                    full[mine] = v
                    frame[name] = pd.arrays.IntegerArray(full, ~mine)
                return pd.DataFrame(frame)

            for doc_id, text_hash, text in zip(b["doc_id"], b["text_hash"], b["text"], strict=True):
                mine = [(k, x) for k, x in enumerate(normalised_lines(text)) if x and (min_chars is not None or _fuzzy(x, min_words, None))]
                ids += [None if pd.isna(doc_id) else int(doc_id)] * len(mine)
                hashes += [text_hash] * len(mine)
                at += [k for k, _ in mine]
                lines += [x for _, x in mine]
                held += sum(len(x) for _, x in mine)
                if held > 8_000_000:
                    yield out()
                    ids, hashes, at, lines, held = [], [], [], [], 0
            if lines:
                yield out()

    rows = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInPandas(lean(run), "doc_id long, text_hash long, line int, h1 long, h2 long, fp long" + "".join(f", {c} long" for c in names))


#: A bitmap of candidates has 8 to 16 bits for each, and this many bytes at most; above that nothing is sent ahead.
_BITMAP = 64 << 20


def _bitmap(candidates: DataFrame) -> bytes | None:
    """Of the candidates' h1 a bitmap: partial bitmaps by task, joined by bitwise or. None where it would be too large."""
    size = 1 << max(candidates.count() - 1, 1).bit_length()
    if size > _BITMAP:
        return None

    def run(batches):
        bits = np.zeros(size, dtype=np.uint8)
        for b in batches:
            at = b["h1"].to_numpy().view(np.uint64) & np.uint64(8 * size - 1)
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        words = np.concatenate([bits, np.zeros(-size % 8, dtype=np.uint8)]).view(np.int64)
        yield pd.DataFrame({"word": np.arange(len(words)), "bits": words}).query("bits != 0")

    joined = candidates.select("h1").mapInPandas(lean(run), "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    words = np.zeros(-(-size // 8), dtype=np.int64)
    for part in joined.toLocalIterator():
        words[part["word"]] = part["bits"]
    return words.tobytes()[:size]


def _texts_of(docs: DataFrame, candidates: DataFrame, min_words: int, min_chars: int | None) -> DataFrame:
    """candidates (h1, h2, ...; distinct lines) with norm, their texts. A bitmap of theirs, where it is small, keeps most others at home."""
    bits = _bitmap(candidates)
    shared = docs.sparkSession.sparkContext.broadcast(bits) if bits else None

    def run(batches):
        bitmap = np.frombuffer(shared.value, dtype=np.uint8) if shared else None
        for b in batches:
            found: dict[bytes, bytes] = {}
            texts = b["text"].to_numpy()
            for k in range(0, len(texts), 256):
                lines = [x for text in texts[k : k + 256] for x in normalised_lines(text) if _fuzzy(x, min_words, min_chars)]
                digests = [xxhash.xxh3_128_digest(x) for x in lines]
                if bitmap is None:
                    found.update(zip(digests, lines, strict=True))
                    continue
                at = np.frombuffer(b"".join(digests), dtype=np.uint64)[::2] & np.uint64(8 * len(bitmap) - 1)
                for i in np.flatnonzero(bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).tolist():
                    found[digests[i]] = lines[i]
            ids = np.frombuffer(b"".join(found), dtype=np.int64).reshape(-1, 2)
            yield pd.DataFrame({"h1": ids[:, 0], "h2": ids[:, 1], "norm": list(found.values())})

    texts = docs.filter(F.col("text").isNotNull()).select("text").mapInPandas(lean(run), "h1 long, h2 long, norm binary")
    return texts.groupBy("h1", "h2").agg(F.first("norm").alias("norm")).join(candidates, ["h1", "h2"])


_BUCKET = ["key", "part_a", "part_b"]


def _in_order(rows: DataFrame) -> DataFrame:
    """rows dealt by bucket, each bucket's rows side by side."""
    return rows.repartition(*_BUCKET).sortWithinPartitions(*_BUCKET)


def _hashed(keys: DataFrame) -> DataFrame:
    """keys (few columns, a row per key), to be looked up partition by partition: the rows they are joined with, of lines or whole texts, need no sort."""
    return keys.hint("shuffle_hash")


def block_candidates(each: DataFrame, radius: int) -> DataFrame:
    """(h1, h2) of each (h1, h2, fp, ...; distinct lines) whose fingerprint, by pigeonhole blocks, has another within the radius, or another line has."""
    marks = stored(each.filter("fp is not null").groupBy("fp").agg((F.count("*") > 1).alias("twice")), "line-marks")

    def mates(batches):
        frames = [x for x in batches if len(x)]
        if not frames:
            return
        x, bucket = (np.concatenate([b[c].to_numpy() for b in frames]) for c in ("fp", "bucket"))
        order = np.argsort(bucket)
        x, bucket = x[order].view(np.uint64), bucket[order]
        found = np.zeros(len(x), dtype=bool)
        for i, j in pairs_by_offset(bucket):
            hit = np.bitwise_count(x[i] ^ x[j]) <= radius
            found[i[hit]] = found[j[hit]] = True
        yield pd.DataFrame({"fp": np.unique(x[found]).view(np.int64)})

    # comparing a bucket's numbers costs less than dealing them out again until there are some thousands; a task sorts its numbers itself
    dealt = buckets(marks.select("fp"), 2048, 2048).repartition(*_BUCKET).select("fp", F.xxhash64(*_BUCKET).alias("bucket"))
    lively = dealt.mapInPandas(lean(mates), "fp long")
    lively = lively.unionByName(marks.filter("twice").select("fp")).distinct()
    return stored(each.select("h1", "h2", "fp").join(_hashed(lively), "fp", "left_semi").select("h1", "h2"), "block-candidates")


def band_candidates(each: DataFrame, bands: int, most: int = 256) -> DataFrame:
    """(key, part_a, part_b, shard, h1): lines that share a band's key with another line of a like sketch.

    Keys of one line go no further. Keys of over `most` lines are dealt to shards, and each pair of shards is a bucket.
    """
    keys = F.explode(F.array(*[F.col(f"k{i}") for i in range(bands)])).alias("key")
    rows = each.filter("fp is not null").select("h1", "s0", "s1", keys)
    live = rows.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1").select("key", F.ceil(F.col("_n") / most).cast("int").alias("_shards"))
    met = (
        rows.join(_hashed(live), "key")
        .withColumn("shard", F.pmod(F.hash("h1"), F.col("_shards")))
        .select("key", "h1", "s0", "s1", "shard", F.explode(F.sequence(F.lit(0), F.col("_shards") - 1)).alias("_o"))
        .select("key", F.least("shard", "_o").alias("part_a"), F.greatest("shard", "_o").alias("part_b"), "shard", "h1", "s0", "s1")
    )

    def run(batches):
        for b in whole_groups(batches, _BUCKET):
            group, shard, alone = group_numbers(b, _BUCKET), b["shard"].to_numpy(), (b["part_a"] == b["part_b"]).to_numpy()
            s0, s1 = b["s0"].to_numpy(), b["s1"].to_numpy()
            found = np.zeros(len(b), dtype=bool)
            for i, j in pairs_by_offset(group):
                new = (alone[i] | (shard[i] != shard[j])) & ~(found[i] & found[j])
                i, j = i[new], j[new]
                hit = _alike(s0, s1, i, j, bands)
                found[i[hit]] = found[j[hit]] = True
            yield b.loc[found, [*_BUCKET, "shard", "h1"]]

    return stored(_in_order(met).mapInPandas(lean(run), "key long, part_a int, part_b int, shard int, h1 long"), "band-candidates")


def verified_links(rows: DataFrame, bands: int, radius: int, least: float) -> DataFrame:
    """(a, b): digests (structs of h1, h2) of linked lines, from buckets (key, part_a, part_b, shard, band, h1, h2, fp, s0, s1, k0, ..., norm).

    A pair within the radius, or of a like sketch where the bucket is a band's, is compared in one bucket only: that of
    its first common band or, without one, of its first common block. Lines that are joined already are not compared.
    """
    names = [f"k{i}" for i in range(bands)]

    def run(batches):
        for b in _gathered(whole_groups(batches, _BUCKET)):
            group = group_numbers(b, _BUCKET)
            b = b.iloc[np.lexsort((b["norm"].map(len), group))]  # lines of a length side by side: most links are found early
            shard, alone = b["shard"].to_numpy(), (~b["band"] | (b["part_a"] == b["part_b"])).to_numpy()
            key, band, fp, norm = b["key"].to_numpy(), b["band"].to_numpy(), b["fp"].to_numpy().view(np.uint64), b["norm"].to_numpy()
            ids, k = np.stack([b["h1"], b["h2"]], axis=1), b[names].to_numpy()
            if bands:
                s0, s1 = b["s0"].to_numpy(), b["s1"].to_numpy()
            texts = [x.decode("utf-8", "surrogatepass") for x in norm]
            size = np.fromiter(map(len, texts), dtype=np.int64, count=len(b))
            letters: dict[int, np.ndarray] = {}
            label, edge = np.arange(len(b)), np.searchsorted(group, np.arange(group[-1] + 2)) if len(b) else None
            links: list[tuple[int, int]] = []
            waiting: list[tuple[np.ndarray, np.ndarray]] = []

            def of(p: int) -> np.ndarray:
                if p not in letters:
                    letters[p] = np.frombuffer(texts[p].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                return letters[p]

            def decide() -> None:
                """Links of the waiting pairs that nothing joins yet."""
                i, j = (np.concatenate(x) for x in zip(*waiting, strict=True))
                waiting.clear()
                longest = np.maximum(size[i], size[j])
                most = ((1 - least) * longest + 1e-9).astype(np.int64)
                open_ = (label[i] != label[j]) & (np.abs(size[i] - size[j]) <= most)
                now = np.flatnonzero(open_ & (longest <= _LONG))
                ends = [_same_ends(of(p), of(q)) for p, q in zip(i[now].tolist(), j[now].tolist(), strict=True)]
                alike = now[edits_within([x for x, _ in ends], [y for _, y in ends], most[now])] if len(now) else now
                for p, q in zip(i[alike].tolist(), j[alike].tolist(), strict=True):
                    join(p, q)
                late = np.flatnonzero(open_ & (longest > _LONG))
                for p, q in zip(i[late].tolist(), j[late].tolist(), strict=True):
                    if label[p] != label[q] and edit_similar(norm[p], norm[q], least):
                        join(p, q)

            def join(p: int, q: int) -> None:
                if label[p] != label[q]:
                    part = label[edge[group[p]] : edge[group[p] + 1]]
                    part[part == label[q]] = label[p]
                    links.append((p, q))

            for d, (i, j) in enumerate(pairs_by_offset(group), 1):
                new = (label[i] != label[j]) & (alone[i] | (shard[i] != shard[j]))
                i, j = i[new], j[new]
                common = k[i] == k[j]
                shared = common.any(axis=1) if bands else np.zeros(len(i), dtype=bool)
                keep = np.zeros(len(i), dtype=bool)
                if bands:
                    mine = np.flatnonzero(band[i] & shared)
                    mine = mine[k[i[mine], common[mine].argmax(axis=1)] == key[i[mine]]]
                    keep[mine] = _alike(s0, s1, i[mine], j[mine], bands)
                apart = fp[i] ^ fp[j]
                mine = np.flatnonzero(~band[i] & (np.bitwise_count(apart) <= radius))
                if bands:  # pairs of a common band with a like sketch are compared there
                    mine = mine[~(shared[mine] & _alike(s0, s1, i[mine], j[mine], bands))]
                keep[mine] = owned(key[i[mine]], apart[mine])
                if keep.any():
                    waiting.append((i[keep], j[keep]))
                if waiting and (d in _SOON or sum(len(x) for x, _ in waiting) >= _WAITING):
                    decide()
            if waiting:
                decide()
            ends = np.array(links, dtype=np.int64).reshape(-1, 2)
            yield pd.DataFrame(np.hstack([ids[ends[:, 0]], ids[ends[:, 1]]]), columns=["a1", "a2", "b1", "b2"])

    links = _in_order(rows).mapInPandas(lean(run), "a1 long, a2 long, b1 long, b2 long")
    return links.select(F.struct(F.col("a1").alias("h1"), F.col("a2").alias("h2")).alias("a"), F.struct(F.col("b1").alias("h1"), F.col("b2").alias("h2")).alias("b"))


def similar_lines(docs: DataFrame, each: DataFrame, radius: int = RADIUS, least: float = 0.8, min_words: int = 5, bands: int = 6, min_chars: int | None = 20) -> DataFrame:
    """(a, b): links, as digests, that join lines of `each` (h1, h2, fp, ...: distinct lines) whose edit similarity is at least `least`.

    Compared are all lines within the radius, found by pigeonhole blocks of the fingerprint, and with `bands` those whose
    letter n-grams share a band and have a like sketch. Candidates are found by numbers alone; only their texts move.
    """
    names = ["h1", "h2", "fp", *_band_columns(bands)]
    blocks = block_candidates(each, radius)
    found = band_candidates(each, bands) if bands else None
    some = blocks.select("h1").unionByName(found.select("h1")) if bands else blocks.select("h1")
    lines = stored(each.filter("fp is not null").select(names).join(_hashed(some.distinct()), "h1", "left_semi"), "candidate-lines")
    full = stored(_texts_of(docs, lines, min_words, min_chars), "candidate-texts")
    rows = buckets(full.join(_hashed(blocks), ["h1", "h2"], "left_semi"), 256, 256)
    rows = rows.withColumns({"shard": F.lit(0), "band": F.lit(False)})
    if bands:
        rows = rows.unionByName(found.join(full, "h1").withColumn("band", F.lit(True)))
    return verified_links(rows, bands, radius, least)


def line_decisions(docs: DataFrame, radius: int = RADIUS, least: float = 0.8, min_words: int = 5, bands: int = 6, min_chars: int | None = 20) -> DataFrame:
    """(doc_id, text_hash, gone): for each text that loses lines, their numbers (from 0), by groups over all documents."""
    lines = stored(line_table(docs, min_words, min_chars, bands), "lines")
    rest = ["fp", *_band_columns(bands)]
    each = stored(lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in rest]), "distinct-lines")
    links = similar_lines(docs, each, radius, least, min_words, bands, min_chars)
    roots = stored(connected_components(links), "line-roots")
    ends = roots.select("node.h1", "node.h2", F.col("root.h1").alias("r1"), F.col("root.h2").alias("r2"))
    classed = each.select("h1", "h2", "n").join(_hashed(ends), ["h1", "h2"], "left").filter("n > 1 or r1 is not null")
    classed = stored(classed.select("h1", "h2", "n", F.coalesce("r1", "h1").alias("r1"), F.coalesce("r2", "h2").alias("r2")), "line-classes")
    total = classed.agg(F.sum("n")).first()[0] or 0
    seen = F.struct("doc_id", "text_hash", "line")
    there = stored(spread_join(lines.select("h1", "h2", "doc_id", "text_hash", "line"), classed, ["h1", "h2"], total), "repeated-lines")
    kept = stored(there.groupBy("r1", "r2").agg(F.min(seen).alias("kept"), F.count("*").alias("n")), "line-kept")
    gone = spread_join(there, kept, ["r1", "r2"], total).filter(~seen.eqNullSafe(F.col("kept")))
    return gone.groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias("gone"))


def dedup_lines(docs: DataFrame, radius: int = RADIUS, least: float = 0.8, min_words: int = 5, bands: int = 6, min_chars: int | None = 20) -> DataFrame:
    """docs with repeated lines removed from text, and (n_lines, removed_lines) as further columns.

    A line is compared after normalisation (lower case, no ASCII marks, digits as 0, single spaces). Equal lines of any
    length are a group. Lines of `min_words` words or `min_chars` characters are linked to others if their SimHashes
    differ in at most `radius` bits, or they share one of `bands` bands of letter n-grams and a like sketch, and their
    edit similarity is at least `least`; of each connected group the first occurrence by (doc_id, text, line) stays.
    Blank lines always stay, and without `min_chars` so do lines of fewer than `min_words` words. A null text stays null
    with 0 lines; a text that loses every line is ''. Rows that repeat a doc_id and its text count as one document and
    get the same result; of rows with a null doc_id equal texts do. Other columns stay as they are; input columns named
    n_lines or removed_lines are replaced. An empty table gives no rows.
    """
    gone = line_decisions(docs, radius, least, min_words, bands, min_chars).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("gone").alias("_gone"))
    d, g = docs.drop("n_lines", "removed_lines").alias("d"), _hashed(gone).alias("g")  # aliases keep input columns of any name apart
    joined = d.join(g, F.col("d.doc_id").cast("long").eqNullSafe(F.col("g._id")) & (F.xxhash64("d.text") == F.col("g._hash")), "left")
    parts, lost = F.split("d.text", "\n", -1), F.col("g._gone")
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(lost, i)), "\n")
    text = F.when(lost.isNull(), F.col("d.text")).otherwise(kept)
    return joined.select(
        *[text.alias(c) if c == "text" else F.col(f"d.`{c}`") for c in d.columns],
        F.when(F.col("d.text").isNull(), 0).otherwise(F.size(parts)).alias("n_lines"),
        F.when(lost.isNull(), 0).otherwise(F.size(lost)).alias("removed_lines"),
    )
