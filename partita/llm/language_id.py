"""Language identification: nearest of several clustered centroids per language over TF-IDF n-gram vectors, rejection by distance."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partita.llm.common import lean, slices, stored

#: Buckets that letter n-grams are hashed into.
FEATURES = 4096
#: Lengths, as powers of 2 of a text's different n-grams, and levels of a score, that distances are fitted by.
LENGTHS, LEVELS = 14, 500

_SPACE = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))


def held_out(doc_id: str = "doc_id"):
    """True for documents that take no part in learning: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed 1- to 3-grams of the bytes of lower-cased letters, words apart; None without a letter."""
    total = np.zeros(FEATURES, dtype=np.int64)
    letters = False
    for part in slices(text or "", 200_000):
        raw = part.lower().encode("utf-8", "surrogatepass").translate(_SPACE)
        letters = letters or (any(c.isalpha() for c in part) if not raw.isspace() else False)
        b = np.frombuffer(b" " + b" ".join(raw.split()) + b" ", dtype=np.uint8).astype(np.uint32)
        if len(b) < 3:
            continue
        one = b[1:-1]
        two = b[:-1] * np.uint32(257) + b[1:]
        three = two[:-1] * np.uint32(257) + b[2:]
        for g, seed in ((one, 0x9E3779B1), (two, 0x85EBCA77), (three, 0xC2B2AE3D)):
            g = g * np.uint32(seed)
            g ^= g >> np.uint32(15)
            total += np.bincount((g * np.uint32(0x27D4EB2F)) >> np.uint32(20), minlength=FEATURES)
    return total if letters else None


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF vector with damped term frequencies."""
    v = np.log1p(counts) * idf
    return (v / max(np.sqrt(v @ v), 1e-12)).astype(np.float32)


@dataclass
class Centroids:
    """idf weights, centroids (one row each), the language of each; by language, the least score of each length that is not rejected."""

    idf: np.ndarray
    rows: np.ndarray
    langs: list[str]
    floors: dict[str, np.ndarray] = field(default_factory=dict)

    def nearest(self, texts) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language (`und` without a letter), score (cosine with the nearest centroid, 0 to 1) and length class of each text."""
        score, best, length = np.zeros(len(texts)), ["und"] * len(texts), np.zeros(len(texts), dtype=np.int64)
        held: list[tuple[int, np.ndarray]] = []

        def settle() -> None:
            near = np.stack([v for _, v in held]) @ self.rows.T
            for (i, _), row in zip(held, near, strict=True):
                k = int(row.argmax())
                score[i], best[i] = min(1.0, max(0.0, float(row[k]))), self.langs[k]
            held.clear()

        for i, text in enumerate(texts):
            counts = ngram_counts(text if isinstance(text, str) else None)
            if counts is not None and len(self.rows):
                length[i] = int(np.count_nonzero(counts)).bit_length()
                held.append((i, vector(counts, self.idf)))
                if len(held) == 128:  # few vectors are held at a time, however many texts come
                    settle()
        if held:
            settle()
        return best, score, length

    def predict(self, texts) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text: `und`, or farther from every centroid than texts of its language and length are."""
        best, score, length = self.nearest(texts)
        gone = [x == "und" or (x in self.floors and s < self.floors[x][n]) for x, s, n in zip(best, score, length, strict=True)]
        return best, score, np.array(gone, dtype=bool)


def _piece(text: str) -> str:
    """A part of a text whose place and length (8 to 1024 characters) come from the text's checksum."""
    h = zlib.crc32(text[:4096].encode("utf-8", "surrogatepass"))
    size = 8 << (h & 7)
    at = (h >> 3) % max(1, len(text) - size)
    return text[at : at + size]


def score_floors(known: DataFrame, model: Centroids, tail: float = 0.005, share: float = 0.5) -> dict[str, np.ndarray]:
    """By language and length class, the score below which a text is rejected, from the known texts and a piece of each.

    It is the score that the share `tail` of them stays below, but at most `share` of their median: long texts that
    repeat a few words of a language are rare and far out, yet nearer than other scripts, code or random letters.
    Only texts that get their own language count. Scores are counted in all tasks, by level. A class of fewer than
    1 / tail texts is joined by the next shorter and longer ones, or by the nearest that have any; few texts give their least score.
    """
    shared, names = known.sparkSession.sparkContext.broadcast(model), sorted(set(model.langs))

    def run(batches):
        seen = np.zeros((len(names), LENGTHS, LEVELS + 1), dtype=np.int64)
        for b in batches:
            for texts in (b["text"].tolist(), [_piece(t) for t in b["text"]]):
                best, score, length = shared.value.nearest(texts)
                for x, said, s, n in zip(best, b["lang"], score, length, strict=True):
                    if x == said:
                        seen[names.index(x), n, int(s * LEVELS)] += 1
        cells = np.flatnonzero(seen)
        yield pd.DataFrame({"cell": cells, "n": seen.ravel()[cells]})

    counted = known.filter("text is not null").select("text", "lang").mapInPandas(lean(run), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    seen = np.zeros((len(names), LENGTHS, LEVELS + 1), dtype=np.int64)
    for r in counted.collect():  # at most a number per language, length and level
        seen.reshape(-1)[r["cell"]] = r["n"]
    floors = {}
    for k, name in enumerate(names):
        floors[name] = np.zeros(LENGTHS)
        for n in range(LENGTHS):
            for reach in range(LENGTHS):
                levels = seen[k, max(0, n - reach) : n + reach + 1].sum(axis=0)
                if levels.sum() * tail >= 1 or (reach and levels.sum()):
                    break
            if levels.sum():
                low, middle = np.searchsorted(np.cumsum(levels), [max(1.0, tail * levels.sum()), levels.sum() / 2])
                floors[name][n] = min(low, share * middle) / LEVELS
    return floors


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all docs each feature occurs, and how many docs have a letter."""

    def run(batches):
        df, n = np.zeros(FEATURES, dtype=np.int64), 0
        for b in batches:
            for text in b["text"]:
                if isinstance(text, str) and (c := ngram_counts(text)) is not None:
                    df += c > 0
                    n += 1
        yield pd.DataFrame({"feature": np.arange(FEATURES + 1), "n": np.append(df, n)})

    rows = docs.select("text").mapInPandas(lean(run), "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(FEATURES + 1, dtype=np.int64)
    for r in rows:
        counts[r["feature"]] = r["n"]
    return counts[:-1], int(counts[-1])


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from spread-out starts."""
    at = [0]
    far = x @ x[0]
    while len(at) < min(k, len(x)):
        at.append(int(far.argmin()))
        far = np.maximum(far, x @ x[at[-1]])
    c = x[at]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(docs: DataFrame, centroids: int = 4, sample_per_lang: int = 1500, tail: float = 0.005) -> Centroids:
    """Learn from docs (doc_id, text, lang): rows with a null lang or a held-out doc_id are left out.

    Document frequencies, and the distances beyond which a text is rejected (score_floors), come from all these rows. The centroids are clustered on a sample bounded by
    `sample_per_lang`: of each language, the rows whose hashed doc_id is smallest. Ties in the hash go to the
    smaller doc_id; repeated rows count as often as they come. Without a labelled row the model knows no language.
    """
    known = docs.filter(F.col("lang").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long"), "text", "lang")
    df, n = document_frequencies(known)
    idf = np.log((n + 1) / (df + 1)) + 1
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    spread = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1 << 30))
    # a threshold on the hash bounds the sample before rows move; no language is gathered in one task
    some = F.lit(False)
    for lang, size in sizes.items():
        some = some | ((F.col("lang") == lang) & (spread < int(min(1.0, 1.15 * sample_per_lang / size) * (1 << 30)) + 1))

    def run(batches):
        for b in batches:
            rows = zip(b["lang"], b["h"], b["doc_id"], b["text"], strict=True)
            got = [(lang, h, i, vector(c, idf).astype(np.float16).tobytes()) for lang, h, i, t in rows if (c := ngram_counts(t)) is not None]
            yield pd.DataFrame(got, columns=["lang", "h", "doc_id", "v"])

    sample = known.filter(some & F.col("text").isNotNull()).withColumn("h", spread).mapInPandas(lean(run), "lang string, h long, doc_id long, v binary")
    # the vectors come to the driver one by one, into arrays that are given back as a whole
    marks: dict[str, list[tuple[int, int, int]]] = {}
    held: dict[str, np.ndarray] = {}
    for r in stored(sample, "language-sample").toLocalIterator():
        mine = marks.setdefault(r["lang"], [])
        x = held.setdefault(r["lang"], np.empty((sample_per_lang * 5 // 4 + 1, FEATURES), dtype=np.float16))
        if len(mine) == len(x):
            x = held[r["lang"]] = np.concatenate([x, np.empty_like(x)])
        x[len(mine)] = np.frombuffer(r["v"], dtype=np.float16)
        mine.append((r["h"], r["doc_id"] if r["doc_id"] is not None else -1, len(mine)))
    rows, langs = [], []
    for lang in sorted(marks):
        kept = [i for *_, i in sorted(marks[lang])[:sample_per_lang]]
        found = _clusters(held.pop(lang)[kept].astype(np.float32), centroids)
        rows.append(found)
        langs += [lang] * len(found)
    model = Centroids(idf, np.concatenate(rows) if rows else np.zeros((0, FEATURES), np.float32), langs)
    if langs:
        model.floors = score_floors(known, model, tail)
    return model


def identify(docs: DataFrame, model: Centroids) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row of docs, from its text alone.

    lang_pred is a learned language, or `und` where the text is null, empty or has no letter (score 0). rejected:
    the text is farther from every centroid than texts of its language and length are, or is `und`. Very long texts are read in
    parts. Other columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few centroids of 4096 numbers per language

    def run(batches):
        for b in batches:
            best, score, gone = shared.value.predict(b["text"])
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": best, "score": score, "rejected": gone})

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return rows.mapInPandas(lean(run), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Centroids) -> DataFrame:
    """The rows of docs that identify() does not reject, with all their columns, without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def kept(text: pd.Series) -> pd.Series:
        return pd.Series(~shared.value.predict(text)[2])

    return docs.filter(kept(F.col("text")))
