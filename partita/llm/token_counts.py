"""Edit-aware token counts: segment trees over runs of pre-tokens; an edit re-encodes what it touches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partita.llm.common import slices
from partita.llm.word_tokens import WordEncoder, encoder, words_of

#: Characters of a leaf when it is built, and from which it is cut again.
LEAF, FULL = 256, 1024

_EDGE = re.compile("[ \t\n\r\x0b\x0c]")


def _runs(text: str, size: int) -> list[str]:
    """Parts of text of about `size` characters, each cut where a blank begins: no pre-token is cut."""
    out, at, n = [], 0, len(text)
    while n - at > size:
        cut = _EDGE.search(text, at + size)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


class TokenTree:
    """The token count of a text that is edited. Leaves are runs of pre-tokens; nodes sum characters and tokens below."""

    def __init__(self, text: str, enc: WordEncoder) -> None:
        self.enc, self.encoded = enc, 0
        leaves: list[str] = []
        tokens: list[int] = []
        for part in slices(text) if len(text) > 1_000_000 else [text]:
            some = _runs(part, LEAF)
            leaves += some
            tokens += [len(raw) // 4 for raw in enc.encode_many([words_of(x) for x in some])]
        self._build(leaves, tokens)

    @classmethod
    def of(cls, leaves: list[str], tokens: list[int], enc: WordEncoder) -> TokenTree:
        """A tree from its stored leaves: nothing is encoded."""
        tree = cls.__new__(cls)
        tree.enc, tree.encoded = enc, 0
        tree._build(list(leaves), list(tokens))
        return tree

    def counts(self) -> list[int]:
        """Tokens of each leaf."""
        return self.tokens[self.width : self.width + len(self.leaves)]

    def _build(self, leaves: list[str], tokens: list[int]) -> None:
        width = 1 << (len(leaves) - 1).bit_length()
        pad = [0] * (width - len(leaves))
        self.leaves, self.width = leaves, width
        self.chars = [0] * width + [len(x) for x in leaves] + pad
        self.tokens = [0] * width + tokens + pad
        for i in range(width - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def _count(self, text: str) -> int:
        self.encoded += len(text)
        return len(self.enc.encode_many([words_of(text)])[0]) // 4

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character at a position (the last one at the end), and the position in it."""
        node = 1
        while node < self.width:
            node *= 2
            if at >= self.chars[node] and self.chars[node + 1]:
                at -= self.chars[node]
                node += 1
        return node - self.width, at

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        node = leaf + self.width
        more = len(text) - self.chars[node], tokens - self.tokens[node]
        self.leaves[leaf] = text
        while node:
            self.chars[node] += more[0]
            self.tokens[node] += more[1]
            node //= 2

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replaces characters start to stop (clipped to the text) by new.

        The region goes from the blank before the pre-token before the edit to the blank after the one behind it;
        its old and new forms are encoded, nothing else is. Leaves that the edit joins become one.
        """
        size = self.chars[1]
        start = min(max(start, 0), size)
        stop = min(max(stop, start), size)
        first, a = self._find(start)
        last, b = self._find(stop)
        while first > 0 and not _EDGE.search(self.leaves[first], 0, a):  # the pre-token before begins in an earlier leaf
            first -= 1
            a += len(self.leaves[first])
        while last + 1 < len(self.leaves) and not _EDGE.search(self.leaves[last], b):
            last += 1
        old = "".join(self.leaves[first : last + 1])
        b = stop - start + a
        left = a
        while left > 0 and not _EDGE.match(old[left - 1]):
            left -= 1
        right = _EDGE.search(old, b)
        right = right.start() if right else len(old)
        before, after = old[left:right], old[left:a] + new + old[b:right]
        text = old[:left] + after + old[right:]
        tokens = sum(self.tokens[self.width + first : self.width + last + 1]) - self._count(before) + self._count(after)
        self._set(first, text, tokens)
        for leaf in range(first + 1, last + 1):
            self._set(leaf, "", 0)
        if len(text) > max(FULL, 2 * LEAF) and len(runs := _runs(text, LEAF)) > 1:
            inner = [self._count(x) for x in runs]
            at = self.width
            self._build(self.leaves[:first] + runs + self.leaves[first + 1 :], self.tokens[at : at + first] + inner + self.tokens[at + first + 1 : at + len(self.leaves)])


_TREES = "doc_id long, leaves array<string>, leaf_tokens array<int>, tokens long"


def build_trees(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, leaves, leaf_tokens, tokens) for every row of docs (doc_id, text): the trees to keep, as their leaves.

    Written as a table they serve any number of edit batches (edit_trees). Inner nodes are sums of the leaves, so they are made
    again when a tree is read; no text is encoded for that. A null text is one empty leaf.
    """

    def run(batches):
        enc = encoder(tokenizer)
        for b in batches:
            out, held = [], 0
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                tree = TokenTree(text if isinstance(text, str) else "", enc)
                out.append((doc_id, tree.leaves, tree.counts(), tree.total))
                held += tree.chars[1]
                if held > 4_000_000:
                    yield pd.DataFrame(out, columns=["doc_id", "leaves", "leaf_tokens", "tokens"])
                    out, held = [], 0
            yield pd.DataFrame(out, columns=["doc_id", "leaves", "leaf_tokens", "tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, _TREES)


def _number(x) -> int:
    return 0 if x is None or pd.isna(x) else int(x)


def edit_trees(trees: DataFrame, edits: DataFrame, tokenizer: str) -> DataFrame:
    """trees (build_trees() rows) after edits, with (tokens_before, edits, reencoded_chars); the rules are those of count_edited().

    Trees without an edit pass through as they are. Edited ones encode the touched regions only; written, the result is the
    input of the next batch of edits.
    """
    one = F.struct(*[F.col(c).cast(kind).alias(c) for c, kind in (("seq", "long"), ("start", "long"), ("stop", "long"), ("replacement", "string"))])
    by_doc = edits.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.sort_array(F.collect_list(one)).alias("changes"))
    rows = trees.select("doc_id", "leaves", "leaf_tokens", "tokens").join(by_doc, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    names = ["doc_id", "leaves", "leaf_tokens", "tokens", "tokens_before", "edits", "reencoded_chars"]

    def run(batches):
        enc = encoder(tokenizer)
        for b in batches:
            out = []
            for doc_id, leaves, counts, total, changes in b.itertuples(index=False):
                tree = TokenTree.of(leaves, counts, enc)
                for e in changes:
                    tree.edit(_number(e["start"]), _number(e["stop"]), e["replacement"] or "")
                out.append((doc_id, tree.leaves, tree.counts(), tree.total, total, len(changes), tree.encoded))
            yield pd.DataFrame(out, columns=names)

    edited = rows.filter("changes is not null").mapInPandas(run, _TREES + ", tokens_before long, edits int, reencoded_chars long")
    same = rows.filter("changes is null").select("doc_id", "leaves", "leaf_tokens", "tokens", F.col("tokens").alias("tokens_before"), F.lit(0).alias("edits"), F.lit(0).cast("long").alias("reencoded_chars"))
    return edited.unionByName(same)


def count_edited(docs: DataFrame, edits: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, tokens_before, tokens_after, chars_after, edits, reencoded_chars) for every row of docs (doc_id, text).

    edits (doc_id, seq, start, stop, replacement) apply in the order of seq (then of the other columns), each to the
    text as the ones before left it: characters start to stop are replaced. Positions outside the text are clipped,
    a null position is the start, a null replacement is ''. A null text is empty and can be edited. Edits of unknown
    or null doc_ids do nothing; rows that repeat a doc_id get the same edits. Very long texts are encoded in parts.
    An edit list belongs to one document and is read with it. Columns with clashing names are ignored. An empty
    table gives no rows.
    """
    one = F.struct(*[F.col(c).cast(kind).alias(c) for c, kind in (("seq", "long"), ("start", "long"), ("stop", "long"), ("replacement", "string"))])
    by_doc = edits.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.sort_array(F.collect_list(one)).alias("edits"))
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return count_with_edits(rows.join(by_doc, rows["doc_id"] == by_doc["_id"], "left").select("doc_id", "text", "edits"), tokenizer)


def count_with_edits(rows: DataFrame, tokenizer: str) -> DataFrame:
    """count_edited() where the edits are already an array column of structs (seq, start, stop, replacement) in order."""

    def run(batches):
        enc = encoder(tokenizer)
        for b in batches:
            out = []
            for doc_id, text, edits in b.itertuples(index=False):
                tree = TokenTree(text if isinstance(text, str) else "", enc)
                before, n = tree.total, 0
                for e in edits if edits is not None else ():
                    tree.edit(_number(e["start"]), _number(e["stop"]), e["replacement"] or "")
                    n += 1
                out.append((doc_id, before, tree.total, tree.chars[1], n, tree.encoded))
            yield pd.DataFrame(out, columns=["doc_id", "tokens_before", "tokens_after", "chars_after", "edits", "reencoded_chars"])

    return rows.mapInPandas(run, "doc_id long, tokens_before long, tokens_after long, chars_after long, edits int, reencoded_chars long")
