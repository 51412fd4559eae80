"""Best-fit packing of token pieces into sequences, online and in bounded space."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partita.llm.common import lean, slices, stored
from partita.llm.word_tokens import encoder, words_of

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, room: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and `end_id`, cut into pieces of `room` ids if longer."""
    width, tail = 4 * room, np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        enc = encoder(tokenizer)
        for b in batches:
            out: list[tuple] = []
            waiting: list[tuple] = []
            size = 0

            def settle() -> None:
                for (doc_id, _), raw in zip(waiting, enc.encode_many([w for _, w in waiting]), strict=True):
                    emit(doc_id, raw + tail)
                waiting.clear()

            def emit(doc_id, raw: bytes) -> None:
                for k, at in enumerate(range(0, len(raw), width)):
                    cut = raw[at : at + width]
                    out.append((doc_id, k, at // 4, len(cut) // 4, zlib.crc32(cut)))

            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                text = text if isinstance(text, str) else ""
                if len(text) > 2_000_000:  # a very long text goes part by part
                    emit(doc_id, b"".join(x for part in slices(text) for x in enc.encode_many([words_of(part)])) + tail)
                    continue
                waiting.append((doc_id, words_of(text)))
                size += len(text)
                if size > 4_000_000:
                    settle()
                    size = 0
            settle()
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(lean(run), _PIECES)


class OpenBins:
    """Up to `most` open bins; those of equal free space form a stack, and a bitset says which free spaces occur."""

    def __init__(self, room: int, most: int) -> None:
        self.room, self.most, self.bits, self.count, self.next = room, most, 0, 0, 0
        self.stacks: list[list[int]] = [[] for _ in range(room + 1)]

    def _pop(self, free: int) -> int:
        bin_id = self.stacks[free].pop()
        if not self.stacks[free]:
            self.bits &= ~(1 << free)
        self.count -= 1
        return bin_id

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece: the fullest open bin that has room, else a new one; at the limit the fullest closes."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_id = self._pop(free)
        else:
            if self.count >= self.most:
                self._pop((self.bits & -self.bits).bit_length() - 1)
            bin_id, free = self.next, self.room
            self.next += 1
        left = free - length
        if left:
            self.stacks[left].append(bin_id)
            self.bits |= 1 << left
            self.count += 1
        return bin_id, self.room - free


def pack(pieces: DataFrame, room: int = 2048, open_bins: int = 2048, each: int = 40_000) -> DataFrame:
    """pieces with (sequence_id, offset): gapless, at most `room` ids a sequence.

    The pieces shorter than `room` are dealt by row number (pieces should be a written table, so that it holds) to packers of
    about `each` pieces, so a packer's memory does not grow with the input, however often a row repeats; it sees them in the order of a hash and keeps at most
    `open_bins` bins open. Full pieces are sequences by themselves. Repeated rows are packed one by one.
    """
    short = pieces.filter(F.col("length") < room)
    packers = max(1, -(-short.count() // each))
    mark = F.xxhash64("doc_id", "piece", "ids_crc32")

    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["mark", "doc_id", "piece"], kind="stable")
        bins = OpenBins(room, open_bins)
        placed = np.array([bins.put(int(n)) for n in group["length"]], dtype=np.int64).reshape(-1, 2)
        out = group[["doc_id", "piece", "start", "length", "ids_crc32"]].copy()
        out["sequence_id"] = placed[:, 0] * packers + int(key[0])
        out["offset"] = placed[:, 1]
        return out

    packed = (
        short.withColumn("mark", mark)
        .withColumn("packer", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(packers)))
        .groupBy("packer")
        .applyInPandas(run, f"{_PIECES}, sequence_id long, offset long")
    )
    # ids below zero: one sequence for each full piece
    whole = pieces.filter(F.col("length") >= room).select(
        *pieces.columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return packed.unionByName(whole)


def pack_documents(docs: DataFrame, tokenizer: str, room: int = 2048, open_bins: int = 2048) -> DataFrame:
    """One row per piece of every row of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. A text of over `room` ids is cut into pieces of `room`; only the last
    may be shorter. Very long texts are tokenized in parts. Other columns are ignored; an empty table gives no rows.
    """
    return pack(stored(token_pieces(docs, tokenizer, room), "pieces"), room, open_bins)
