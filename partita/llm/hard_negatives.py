"""Hard negatives by exact integer scores: subset-sum tables of anchors, looked up by the bit planes of candidates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from partita.llm.common import stored

#: Anchors whose tables are used at once, and candidates that are scored at once: tables and scores stay in the processor's cache.
ANCHORS, ROWS = 64, 4096


def pack_planes(values: np.ndarray, planes: int) -> np.ndarray:
    """Bit planes of whole numbers (rows by dimensions): rows by planes by bytes; bit k of byte g is dimension 8 g + k, the last plane the sign."""
    wide = np.zeros((len(values), -(-values.shape[1] // 8) * 8), dtype=np.int64)
    wide[:, : values.shape[1]] = values
    out = np.empty((len(wide), planes, wide.shape[1] // 8), dtype=np.uint8)
    for b in range(planes):
        out[:, b] = np.packbits((wide >> b & 1).astype(np.uint8), axis=1, bitorder="little")
    return out


def unpack_planes(packed: np.ndarray) -> np.ndarray:
    """The whole numbers of pack_planes()."""
    rows, planes, octets = packed.shape
    bits = np.unpackbits(packed, axis=2, bitorder="little").astype(np.int64).reshape(rows, planes, 8 * octets)
    weights = np.left_shift(np.int64(1), np.arange(planes))
    return np.tensordot(bits[:, :-1], weights[:-1], axes=(1, 0)) - (bits[:, -1] << (planes - 1)) if planes > 1 else -bits[:, 0]


def subset_sums(values: np.ndarray, kind: type) -> np.ndarray:
    """Tables of anchors (rows by dimensions): group of eight dimensions, byte, anchor -> sum of the dimensions whose bit is set."""
    groups = values.shape[1] // 8
    tables = np.zeros((groups, 256, len(values)), dtype=kind)
    for g in range(groups):
        for k in range(8):
            tables[g, 1 << k : 2 << k] = tables[g, : 1 << k] + values[:, 8 * g + k].astype(kind)
    return tables


def planes_scores(tables: np.ndarray, octets: np.ndarray) -> np.ndarray:
    """Scores (candidates by anchors): from the sign's plane down, the sum so far is doubled and the groups' lookups are added.

    octets: planes by groups by candidates, as indices.
    """
    planes, groups, n = octets.shape
    total = np.zeros((n, tables.shape[2]), dtype=tables.dtype)
    part = np.empty_like(total)
    for b in range(planes - 1, -1, -1):
        if b < planes - 1:
            np.left_shift(total, 1, out=total)
        for g in range(groups):
            np.take(tables[g], octets[b, g], axis=0, out=part, mode="clip")
            if b == planes - 1:
                np.subtract(total, part, out=total)  # the sign's plane counts negative
            else:
                np.add(total, part, out=total)
    return total


def first_places(keys: np.ndarray, most: int) -> np.ndarray:
    """Of numbers in ascending order those that stand among the first `most` of their kind."""
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
    return np.arange(len(keys)) - np.repeat(start, np.diff(np.append(start, len(keys)))) < most


def packed_rows(base: DataFrame) -> tuple[DataFrame | None, int, int]:
    """(vec_id, label, bits) of usable rows, one for each vec_id, as a written table; the number of planes and of bytes a plane. None without rows."""
    vector = F.col("embedding")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(256 * x.cast("double")) < float(2**62)))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vector.isNotNull() & finite
    whole = F.transform(vector, lambda x: F.floor(256 * x.cast("double")).cast("long"))
    rows = base.filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("v"))
    one = rows.agg(F.max(F.size("v")), F.max(F.array_max("v")), F.min(F.array_min("v"))).first()
    if one[0] is None:
        return None, 0, 0
    planes = 1 + max(int(one[1] or 0).bit_length(), int(-1 - (one[2] or 0)).bit_length() if (one[2] or 0) < 0 else 0)
    octets = max(1, -(-one[0] // 8))

    def pack(batches):
        for b in batches:
            if not len(b):
                continue
            values = np.zeros((len(b), 8 * octets), dtype=np.int64)
            for i, v in enumerate(b["v"]):
                values[i, : len(v)] = v
            raw = pack_planes(values, planes).reshape(len(b), -1)
            yield pd.DataFrame({"vec_id": b["vec_id"], "label": b["label"], "bits": [r.tobytes() for r in raw]})

    packed = rows.mapInPandas(pack, "vec_id long, label long, bits binary")
    once = packed.groupBy("vec_id").agg(F.min(F.struct("label", "bits")).alias("r")).select("vec_id", "r.label", "r.bits")
    return stored(once, "planes"), planes, octets


def _meet(rows: DataFrame, anchors: DataFrame, blocks: tuple[int, int], compare, schema: str) -> DataFrame:
    """Every block of rows with every block of anchors in one task each. Both have vec_id, by whose hash they are dealt."""
    of_rows, of_anchors = blocks
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select(deal(of_rows).alias("i"), every(of_anchors).alias("j"), *rows.columns)
    right = anchors.select(every(of_rows).alias("i"), deal(of_anchors).alias("j"), *anchors.columns)
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(compare, schema)


class Block:
    """The rows of a block in order of (label, vec_id), their bit planes as indices by parts of ROWS."""

    def __init__(self, frame: pd.DataFrame, planes: int, octets: int) -> None:
        frame = frame.sort_values(["label", "vec_id"], kind="stable")
        self.ids, self.labels = frame["vec_id"].to_numpy(np.int64), frame["label"].to_numpy(np.int64)
        raw = np.frombuffer(b"".join(frame["bits"]), dtype=np.uint8).reshape(len(frame), planes, octets)
        self.bits = raw

    def indices(self, start: int, end: int) -> np.ndarray:
        return np.ascontiguousarray(self.bits[start:end].transpose(1, 2, 0)).astype(np.intp)


def _kind(planes: int, octets: int) -> type:
    """Whole numbers that hold every score and every sum on the way; 64-bit ones wrap, so a score that fits is right."""
    return np.int32 if 8 * octets * 4 ** (planes - 1) * 2 < 2**31 else np.int64


def _positives(planes: int, octets: int, most: int):
    kind, columns = _kind(planes, octets), ["anchor_id", "vec_id", "score"]

    def compare(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(rows) and len(anchors):
            block, anchors = Block(rows, planes, octets), anchors.sort_values(["label", "vec_id"], kind="stable")
            for label, mine in anchors.groupby("label", sort=True):
                low, high = np.searchsorted(block.labels, [label, label + 1])
                ids = mine["vec_id"].to_numpy(np.int64)
                values = unpack_planes(np.frombuffer(b"".join(mine["bits"]), dtype=np.uint8).reshape(len(mine), planes, octets))
                for a in range(0, len(mine), ANCHORS) if high > low else ():
                    tables, own = subset_sums(values[a : a + ANCHORS], kind), ids[a : a + ANCHORS]
                    for start in range(low, high, ROWS):
                        end = min(high, start + ROWS)
                        scores, who = planes_scores(tables, block.indices(start, end)), block.ids[start:end]
                        cut = np.partition(scores, max(0, len(scores) - most - 1), axis=0)[max(0, len(scores) - most - 1)]  # the anchor itself may be above it
                        at, which = np.nonzero(scores >= cut)
                        away = who[at] != own[which]
                        at, which = at[away], which[away]
                        order = np.lexsort((who[at], -scores[at, which].astype(np.int64), which))
                        at, which = at[order], which[order]
                        top = first_places(which, most)
                        found.append((own[which[top]], who[at[top]], scores[at[top], which[top]].astype(np.int64)))
        if not found:
            return pd.DataFrame({c: np.zeros(0, dtype=np.int64) for c in columns})
        out = pd.DataFrame(dict(zip(columns, map(np.concatenate, zip(*found, strict=True)), strict=True)))
        out = out.sort_values(["anchor_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
        return out[out.groupby("anchor_id").cumcount() < most]

    return compare


def _negatives(planes: int, octets: int, most: int, low: int, high: int):
    kind, columns = _kind(planes, octets), ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]

    def compare(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(rows) and len(anchors):
            block = Block(rows, planes, octets)
            values = unpack_planes(np.frombuffer(b"".join(anchors["bits"]), dtype=np.uint8).reshape(len(anchors), planes, octets))
            ids, labels = anchors["vec_id"].to_numpy(np.int64), anchors["label"].to_numpy(np.int64)
            deep = max(map(len, anchors["positives"]))
            spans = np.full((len(ids), deep, 2), 1, dtype=np.int64)  # without a positive: nothing lies from 1 to 0
            spans[:, :, 1] = 0
            whom, bounds = np.zeros((len(ids), deep), dtype=np.int64), np.zeros((len(ids), deep), dtype=np.int64)
            for i, many in enumerate(anchors["positives"]):
                for p, one in enumerate(many):
                    whom[i, p], bounds[i, p] = one["vec_id"], one["score"]
                    bound = int(one["score"])
                    spans[i, p] = -(-low * bound // 100), high * bound // 100  # scores s with low * bound <= 100 s <= high * bound
            floor = np.where(spans[:, :, 0] <= spans[:, :, 1], spans[:, :, 0], np.iinfo(np.int64).max).min(axis=1)
            ceiling = np.where(spans[:, :, 0] <= spans[:, :, 1], spans[:, :, 1], np.iinfo(np.int64).min).max(axis=1)
            for a in range(0, len(ids), ANCHORS):
                some = slice(a, a + ANCHORS)
                tables = subset_sums(values[some], kind)
                for start in range(0, len(block.ids), ROWS):
                    end = min(len(block.ids), start + ROWS)
                    scores, who = planes_scores(tables, block.indices(start, end)), block.ids[start:end]
                    hits = (scores >= floor[some]) & (scores <= ceiling[some]) & (block.labels[start:end, None] != labels[some])
                    at, which = np.nonzero(hits)
                    order = np.lexsort((who[at], -scores[at, which].astype(np.int64), which))
                    at, which = at[order], which[order]
                    score, row = scores[at, which].astype(np.int64), which + a
                    for p in range(deep):
                        good = np.flatnonzero((score >= spans[row, p, 0]) & (score <= spans[row, p, 1]))
                        good = good[first_places(row[good], most)]
                        r = row[good]
                        found.append((ids[r], whom[r, p], bounds[r, p], who[at[good]], score[good]))
        if not found:
            return pd.DataFrame({c: np.zeros(0, dtype=np.int64) for c in columns})
        out = pd.DataFrame(dict(zip(columns, map(np.concatenate, zip(*found, strict=True)), strict=True)))
        out = out.sort_values(["anchor_id", "positive_id", "negative_score", "negative_id"], ascending=[True, True, False, True], kind="stable")
        return out[out.groupby(["anchor_id", "positive_id"]).cumcount() < most]

    return compare


def mine(base: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, chunk: int = 65_536, block: int = 1024) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of base (vec_id, embedding, label).

    Components are floor(256 x). An anchor's positives are its `positives` other rows of the same label with the highest inner
    product, ties by smaller vec_id. For each positive the first `negatives` rows of other labels are returned, highest score
    first, ties by vec_id, whose score is from low to high per cent of the positive's. Scores are exact: a candidate's components are
    kept as bit planes, an anchor's as the sums of all subsets of eight dimensions; a byte of a plane looks up its sum.

    Every anchor meets every row, in blocks of about `chunk` rows and `block` anchors that are dealt by a hash of vec_id, so no
    label fills a task; a task returns `positives` rows, and then `negatives` for each positive, of every anchor. Rows with a
    null vec_id, label, vector or component take no part, nor do non-finite components or those of 2^54 and more. A
    repeated vec_id counts once: the row with the smallest label, then the smallest planes. Shorter vectors count as if zeros followed, and scores
    that need more than 64 bits wrap. Anchors without a positive, and positives without a negative, give no rows; nor does an empty table.
    """
    spark = base.sparkSession
    rows, planes, octets = packed_rows(base)
    if rows is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    chosen = rows.filter(anchors)
    total, asked = rows.count(), chosen.count()
    chunk = min(chunk, max(1024, -(-total // (2 * spark.sparkContext.defaultParallelism))))
    blocks = max(1, -(-total // chunk)), max(1, -(-asked // block))
    near = _meet(rows, chosen, blocks, _positives(planes, octets, positives), "anchor_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id"))
    best = near.withColumn("r", place).filter(F.col("r") <= positives).groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("vec_id", "score")).alias("positives"))
    asking = stored(chosen.join(best, "vec_id"), "positives")
    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    met = _meet(rows, asking, blocks, _negatives(planes, octets, negatives, low, high), schema)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    out = met.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
