"""Alignment of two tokenizations of the same bytes, and how often ids of one are linked with ids of the other."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partita.llm.common import stored

#: Characters that are encoded at once, words of a lane, and words that a worker remembers.
PART, LANE, ROOM = 2_000_000, 256, 200_000
#: Before a space or line end that follows no white space; neither tokenizer has a token across such a place.
_CUTS = re.compile(r"(?<=\S)(?=[ \n])")
#: White space but for spaces and line ends; and the parts between _CUTS of a text that has none.
_RARE, _WORDS = re.compile(r"[^\S \n]"), re.compile(r"\s*\S+|\s+")


class ByteTokenizer:
    """A byte-level BPE file of `tokenizers`; special tokens in texts are plain text."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}  # the format's letters for bytes
        vocabulary = self.tokenizer.get_vocab()
        self.entries = [b""] * (1 + max(vocabulary.values()))
        for entry, i in vocabulary.items():
            self.entries[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()

    def encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]


class PieceTokenizer:
    """A sentencepiece file that puts a space before what it encodes."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        self.entries = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = self.model.piece_to_id("▁")
        #: Whether no piece goes on across a place of _CUTS.
        self.apart = not any(re.search("[^▁]▁|\n", p) for p in pieces)

    def encode(self, words: list[str]) -> list[list[int]]:
        """Words that begin with a space, whose own space is the one that the model puts before, or with a line end, where it is taken off."""
        out = self.model.encode([w[1:] if w[:1] == " " else w for w in words], num_threads=1)
        own = lambda w, ids: (ids or [self.space]) if w[:1] == " " else ids[1:] if ids[:1] == [self.space] else None  # noqa: E731  an empty text gets no space
        return [own(w, ids) for w, ids in zip(words, out, strict=True)]


def possible_links(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """All (id of a) * len(b) + (id of b) whose tokens can end at the same byte: one's bytes end with the other's. In ascending order.

    A token has few endings, so there are about as many links as bytes in both vocabularies at most, whatever the corpus.
    """
    by: list[dict[bytes, list[int]]] = [{}, {}]
    for side, entries in enumerate((a, b)):
        for i, x in enumerate(entries):
            if x:
                by[side].setdefault(x, []).append(i)
    found = set()
    for i, x in enumerate(a):
        for k in range(len(x)):
            found.update(i * len(b) + j for j in by[1].get(x[k:], ()))
    for j, x in enumerate(b):
        for k in range(1, len(x)):
            found.update(i * len(b) + j for i in by[0].get(x[k:], ()))
    return np.array(sorted(found), dtype=np.int64)


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, starts_a: np.ndarray, starts_b: np.ndarray) -> np.ndarray:
    """For each token of a the token of b that ends at the same byte, or -1.

    Lanes (documents or parts of them) lie one after the other: lane k has tokens starts[k] to starts[k + 1], and both
    sides of a lane have as many bytes. One step moves every lane: where its two tokens end together a link is noted and both
    pointers advance, else the pointer whose token ends first. Lanes that are through are taken out of the state.
    """
    partner = np.full(len(ends_a), -1, dtype=np.int64)
    busy = np.flatnonzero(np.diff(starts_a) > 0)
    i, j, stop = starts_a[busy].copy(), starts_b[busy].copy(), starts_a[busy + 1]
    while len(i):
        x, y = ends_a[i], ends_b[j]
        together = x == y
        partner[i[together]] = j[together]
        i += x <= y
        j += y <= x
        going = i < stop
        if not going.all():
            i, j, stop = i[going], j[going], stop[going]
    return partner


def group_text(a: np.ndarray, b: np.ndarray, links_a: np.ndarray, links_b: np.ndarray, digits: tuple[np.ndarray, np.ndarray]) -> bytes:
    """`a1,a2|b1;a3|b2,b3;`: ids of both sides by groups, which end at links (places in a and b). digits: see decimal_rows()."""
    if not len(a):
        return b""
    each_a, each_b = np.diff(links_a, prepend=-1), np.diff(links_b, prepend=-1)  # tokens of each group
    rows = np.empty((len(a) + len(b), 8), dtype=np.uint8)
    at_a = np.arange(len(a)) + np.repeat(np.append(0, links_b[:-1] + 1), each_a)
    at_b = np.arange(len(b)) + np.repeat(links_a + 1, each_b)
    rows[at_a], rows[at_b] = digits[0][a], digits[1][b]
    rows[at_a[links_a], 7], rows[at_b[links_b], 7] = ord("|"), ord(";")
    flat = rows.ravel()
    return flat[flat != 0].tobytes()


def decimal_rows(n: int) -> np.ndarray:
    """A row of 8 bytes for each number below n: its decimal digits, zeros that are dropped later, and a comma."""
    if n > 10**7:
        raise ValueError("ids have 7 digits at most")
    rows = np.zeros((n, 8), dtype=np.uint8)
    for i in range(n):
        text = str(i).encode()
        rows[i, : len(text)] = np.frombuffer(text, dtype=np.uint8)
    rows[:, 7] = ord(",")
    return rows


class Aligner:
    """Both tokenizers of a worker process, the words it remembers, and its tables."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = ByteTokenizer(path_a), PieceTokenizer(path_b)
        self.sizes = tuple(np.array([len(x) for x in t.entries], dtype=np.int64) for t in (self.a, self.b))
        self.digits = tuple(decimal_rows(len(t.entries)) for t in (self.a, self.b))
        self.universe = possible_links(self.a.entries, self.b.entries)
        self.kept: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.lossy: set[str] = set()

    def _each(self, words: list[str]) -> None:
        """Learns words one by one; those that do not come back are lossy and have no ids."""
        for w, *ids in zip(words, self.a.encode(words), self.b.encode(words), strict=True):
            if any(x is None or b"".join(t.entries[i] for i in x) != w.encode() for t, x in zip((self.a, self.b), ids, strict=True)):
                self.lossy.add(w)
                ids = [], []
            for kept, x in zip(self.kept, ids, strict=True):
                kept[w] = np.array(x, dtype="<u4").tobytes()

    def _joined(self, words: list[str]) -> bool:
        """Learns words from one text that consists of them, where their bytes come back and tokens end with every word."""
        text = "".join(words)
        raw, bounds = text.encode(), np.cumsum(np.fromiter((len(w.encode()) for w in words), dtype=np.int64, count=len(words)))
        got = []
        for t, sizes in zip((self.a, self.b), self.sizes, strict=True):
            ids = t.encode([text])[0]
            if ids is None or b"".join(map(t.entries.__getitem__, ids)) != raw:
                return False
            ids = np.array(ids, dtype="<u4")
            ends = np.cumsum(sizes[ids])
            at = np.searchsorted(ends, bounds)
            if (ends[at] != bounds).any():
                return False
            got.append((ids.tobytes(), (4 * at + 4).tolist()))
        for kept, (flat, ends) in zip(self.kept, got, strict=True):
            kept.update(zip(words, (flat[i:j] for i, j in zip([0, *ends], ends, strict=False)), strict=True))
        return True

    def learn(self, words: list[str]) -> None:
        plain = [w for w in words if self.b.apart and w[0] in " \n" and not w[-1].isspace() and "\u2581" not in w]
        some = set(words).difference(plain)
        for at in range(0, len(plain), 5000):
            if not self._joined(plain[at : at + 5000]):
                some.update(plain[at : at + 5000])
        if some:
            self._each(list(some))

    def forget(self, words: list[str]) -> None:
        for w in words[max(0, len(words) - max(0, len(self.kept[0]) - ROOM)) :]:
            del self.kept[0][w], self.kept[1][w]
            self.lossy.discard(w)

    def stretches(self, text: str) -> Iterator[list[str]]:
        """The words of space + text, each of which both tokenizers encode by itself, about PART characters at a time."""
        text, at = " " + text, 0
        if not self.b.apart:
            yield [text]
            return
        while at < len(text):
            place = _CUTS.search(text, at + PART) if len(text) - at > PART else None
            end = place.start() if place else len(text)
            part = text[at:end]
            yield _CUTS.split(part) if _RARE.search(part) else _WORDS.findall(part)
            at = end


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each worker process and pair of files, kept between tasks."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


class _Result:
    """What has been added up of a document."""

    def __init__(self) -> None:
        self.n_a = self.n_b = 0
        self.lossy = False
        self.links: list[np.ndarray] = []
        self.cuts: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        self.digest, self.last = hashlib.sha256(), b""

    def row(self, keep_cuts: bool) -> tuple:
        if self.lossy:
            return _Result().row(keep_cuts)
        links = np.concatenate(self.links) if self.links else np.zeros(0, dtype="<u4")
        self.digest.update(self.last[:-1])
        out = self.n_a, self.n_b, len(links), links.astype("<u4").tobytes(), self.digest.hexdigest() if self.n_a else ""
        return (*out, *(np.concatenate(c).astype(np.int64).tolist() if c else [] for c in self.cuts)) if keep_cuts else out

    def add(self, worker: Aligner, a: np.ndarray, b: np.ndarray, links_a: np.ndarray, links_b: np.ndarray, codes: np.ndarray, keep_cuts: bool) -> None:
        self.digest.update(self.last)
        self.last = group_text(a, b, links_a, links_b, worker.digits)
        if keep_cuts:
            self.cuts[0].append(links_a + 1 + self.n_a)
            self.cuts[1].append(links_b + 1 + self.n_b)
        self.n_a, self.n_b = self.n_a + len(a), self.n_b + len(b)
        self.links.append(codes)


def _align(worker: Aligner, lanes: list[tuple[_Result, np.ndarray, np.ndarray]], keep_cuts: bool) -> None:
    """All lanes (result, ids of a, ids of b) in lockstep; the results get what is theirs, in order."""
    if not lanes:
        return
    a, b = (np.concatenate([x[k] for x in lanes]).astype(np.int64) for k in (1, 2))
    starts_a, starts_b = (np.append(0, np.cumsum([len(x[k]) for x in lanes])) for k in (1, 2))
    partner = lockstep(np.cumsum(worker.sizes[0][a]), np.cumsum(worker.sizes[1][b]), starts_a, starts_b)
    links_a = np.flatnonzero(partner >= 0)
    links_b = partner[links_a]
    codes = np.searchsorted(worker.universe, a[links_a] * len(worker.b.entries) + b[links_b]).astype("<u4")
    at = np.searchsorted(links_a, starts_a)
    k = 0
    while k < len(lanes):  # neighbouring lanes of one document are one stretch
        end = k + 1
        while end < len(lanes) and lanes[end][0] is lanes[k][0]:
            end += 1
        p, q, some = slice(starts_a[k], starts_a[end]), slice(starts_b[k], starts_b[end]), slice(at[k], at[end])
        lanes[k][0].add(worker, a[p], b[q], links_a[some] - p.start, links_b[some] - q.start, codes[some], keep_cuts)
        k = end


def _documents(worker: Aligner, texts: list[str | None], keep_cuts: bool) -> Iterator[tuple]:
    """A row for each text; about PART characters are held as words at a time."""
    waiting: list[_Result] = []
    lanes: list[tuple[_Result, list[str]]] = []
    held = 0

    def flush() -> None:
        new: set[str] = set()
        for _, words in lanes:
            new.update(filterfalse(worker.kept[0].__contains__, words))
        new_words = list(new)
        worker.learn(new_words)
        for result, words in lanes:
            result.lossy |= bool(worker.lossy) and not worker.lossy.isdisjoint(words)
        join = lambda k, words: np.frombuffer(b"".join(map(worker.kept[k].__getitem__, words)), dtype="<u4")
        _align(worker, [(r, join(0, words), join(1, words)) for r, words in lanes if not r.lossy], keep_cuts)
        worker.forget(new_words)

    for text in texts:
        result = _Result()
        waiting.append(result)
        for words in worker.stretches(text) if text else ():
            for at in range(0, len(words), LANE):
                lanes.append((result, words[at : at + LANE]))
                held += sum(map(len, lanes[-1][1]))
            if held >= PART:
                flush()
                lanes.clear()
                held = 0
        if not lanes:
            yield from (r.row(keep_cuts) for r in waiting)
            waiting.clear()
    if lanes:
        flush()
    yield from (r.row(keep_cuts) for r in waiting)


def align(docs: DataFrame, path_a: str, path_b: str, keep_cuts: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_links, links, groups_sha256) of every row of docs (doc_id, text), as a written table.

    a: a byte-level file of `tokenizers`, for space + text; b: a sentencepiece file, for the text, before which it puts the space. Bytes at which
    tokens of both end are links; they cut the tokens into groups, whose ids are hashed as `a1,a2|b1;a3|b2,b3`. links: the
    place of each link's pair of ids in possible_links(), as little-endian unsigned 32-bit numbers. keep_cuts adds a_cuts
    and b_cuts: how many tokens of each side lie before the end of each group.

    Texts are encoded by words that neither tokenizer reaches across, which a worker remembers; documents advance in lockstep, in lanes
    of LANE words, and a long text a stretch at a time. Null and empty texts, and texts of which either side's bytes differ (those
    with U+2581), have no tokens: zeros and an empty string. Repeated rows, null or repeated ids and other columns change nothing.
    """
    schema = "doc_id {}, n_a long, n_b long, n_links long, links binary, groups_sha256 string".format(docs.schema["doc_id"].dataType.simpleString())
    schema += ", a_cuts array<long>, b_cuts array<long>" if keep_cuts else ""
    names = [part.split()[0] for part in schema.split(", ")][1:]

    def run(batches):
        worker = aligner(path_a, path_b)
        for b in batches:
            rows = list(_documents(worker, b["text"].tolist(), keep_cuts))
            yield pd.DataFrame({"doc_id": b["doc_id"]} | {n: [r[k] for r in rows] for k, n in enumerate(names)})

    return stored(docs.select("doc_id", "text").mapInPandas(run, schema), "aligned")


def link_counts(aligned: DataFrame, pairs: int) -> np.ndarray:
    """How often each of the possible `pairs` is linked in all documents. A task returns a row for each pair that it has seen; the vocabularies bound their number."""

    def run(batches):
        total = np.zeros(pairs, dtype=np.int64)
        for b in batches:
            for raw in b["links"]:
                total += np.bincount(np.frombuffer(raw, dtype="<u4"), minlength=pairs) if len(raw) > pairs else 0
            rest = [raw for raw in b["links"] if len(raw) <= pairs]
            total += np.bincount(np.frombuffer(b"".join(rest), dtype="<u4"), minlength=pairs)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"pair": seen.astype(np.int32), "n": total[seen]})

    got = aligned.select("links").mapInPandas(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(pairs, dtype=np.int64)
    out[got["pair"].to_numpy(int)] = got["n"].to_numpy(np.int64)
    return out


def linked_ids(spark, counts: np.ndarray, universe: np.ndarray, ids_b: int) -> DataFrame:
    """(a_id, b_id, n) of the pairs that are linked at all: a table from ids of one tokenizer to those of the other."""
    seen = np.flatnonzero(counts)
    return spark.createDataFrame(pd.DataFrame({"a_id": universe[seen] // ids_b, "b_id": universe[seen] % ids_b, "n": counts[seen]}), "a_id long, b_id long, n long")


def corpus_alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of docs.

    count_sum adds up, over a document's links, how many links of the corpus hold the same pair of ids; n_best counts links whose pair
    is the commonest of its b id, ties included. The counts, whose number the vocabularies bound (324,302 pairs of ids can end together for the files of
    the query), are added by Spark and sent to all tasks. For the rest see align().
    """
    spark = docs.sparkSession
    worker = aligner(path_a, path_b)
    universe, ids_b = worker.universe, len(worker.b.entries)
    aligned = align(docs, path_a, path_b)
    counts = link_counts(aligned, len(universe))
    best = np.zeros(ids_b, dtype=np.int64)
    np.maximum.at(best, universe % ids_b, counts)
    shared = spark.sparkContext.broadcast((counts, counts == best[universe % ids_b]))

    def run(batches):
        counts, top = shared.value
        for b in batches:
            links = [np.frombuffer(raw, dtype="<u4") for raw in b["links"]]
            out = b.drop(columns=["links"])
            out["n_groups"] = out["n_links"]
            out["n_best"] = [int(top[x].sum()) for x in links]
            out["count_sum"] = [int(counts[x].sum()) for x in links]
            yield out[names]

    kind = aligned.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return aligned.mapInPandas(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
