"""Edit-aware token counts: a segment tree of pre-token sums for each document.

A text is cut into segments of about SEGMENT characters at places where the splitting pattern always has a limit (see
bpe.pieces); a leaf holds a segment's length in characters and its number of tokens, an inner node the sums of its two
children, as one array in heap order. An edit (start, removed, inserted) finds its leaves from the root, re-encodes the
text of the touched leaves with one leaf of context on either side, and replaces those leaves, splitting the new
text at safe boundaries again; sums are updated on the way to the root (all of them if the number of leaves changes).

Cases: a null text is empty and has one leaf without tokens; an edit beyond the end appends; null edits leave the text
as it is; repeated rows are treated alike; columns named like a result column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from marlspike.llm import bpe
from marlspike.llm.common import map_arrow, without

SEGMENT = 512


class Tree:
    """Leaves (characters, tokens) of a text, and the sums above them in heap order (node i has children 2i and 2i + 1)."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.chars, self.tokens = chars, tokens
        self._build()

    def _build(self) -> None:
        self.width = 1 << max(0, (len(self.chars) - 1).bit_length())
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        self.sums[self.width : self.width + len(self.chars)] = np.stack([self.chars, self.tokens], axis=1)
        level = self.width
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2

    @classmethod
    def of(cls, text: str, count) -> Tree:
        parts = list(bpe.pieces(text, SEGMENT))
        return cls([len(p) for p in parts], [count(p) for p in parts])

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1][1])

    def leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, or the last one, and where the leaf starts."""
        node, start = 1, 0
        while node < self.width:
            left = int(self.sums[2 * node][0])
            node, start = (2 * node, start) if char < start + left else (2 * node + 1, start + left)
        leaf = node - self.width
        if leaf >= len(self.chars):
            leaf = len(self.chars) - 1
            start = int(self.sums[1][0]) - self.chars[leaf]
        return leaf, start

    def edit(self, text: str, start: int, removed: int, inserted: str, count) -> tuple[str, int]:
        """The text after the edit, and the number of characters that were encoded again."""
        start = min(max(start, 0), len(text))
        stop = min(start + max(removed, 0), len(text))
        changed = text[:start] + inserted + text[stop:]
        first, from_char = self.leaf_at(start)
        last, last_start = self.leaf_at(max(start, stop - 1))
        to_char = last_start + self.chars[last]
        if first > 0:
            first -= 1
            from_char -= self.chars[first]
        if last + 1 < len(self.chars):
            last += 1
            to_char += self.chars[last]
        again = changed[from_char : to_char + len(changed) - len(text)]
        parts = list(bpe.pieces(again, SEGMENT)) if again else []
        if not parts and last - first + 1 == len(self.chars):
            parts = [""]
        chars, tokens = [len(p) for p in parts], [count(p) for p in parts]
        same = len(parts) == last - first + 1
        self.chars[first : last + 1], self.tokens[first : last + 1] = chars, tokens
        if same:
            for leaf in range(first, last + 1):
                node = self.width + leaf
                step = np.array([self.chars[leaf], self.tokens[leaf]]) - self.sums[node]
                while node:
                    self.sums[node] += step
                    node //= 2
        else:
            self._build()
        return changed, len(again)


TREE = T.StructType([T.StructField("chars", T.ArrayType(T.IntegerType())), T.StructField("tokens", T.ArrayType(T.IntegerType()))])
TREE_ARROW = pa.struct([("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))])


def _counter(encoding):
    return lambda text: len(encoding.encode_to_numpy(text, disallowed_special=()))


def build_trees(df: DataFrame, rank_file: str, pattern: str, text: str = "text") -> DataFrame:
    """df with n_tokens and tree (the leaves; inner sums follow from them)."""
    df = without(df, "n_tokens", "tree")
    ranks = bpe._ranks(df, rank_file)
    schema = T.StructType([*df.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("tree", TREE)])

    def run(batches):
        count = _counter(bpe._encoding(ranks.value, pattern))
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                rows = batch.slice(first, 512)
                trees = [Tree.of(x or "", count) for x in rows.column(text).to_pylist()]
                added = [pa.array([t.n_tokens for t in trees], pa.int64()), pa.array([{"chars": t.chars, "tokens": t.tokens} for t in trees], TREE_ARROW)]
                yield pa.RecordBatch.from_arrays([*rows.columns, *added], names=schema.names)

    return map_arrow(df, run, schema)


def apply_edits(df: DataFrame, rank_file: str, pattern: str, text: str = "text", edits: str = "edits") -> DataFrame:
    """df (text, tree, edits: array of struct (start, removed, inserted), in order of application) with edited_text,
    edited_tokens, edited_tree and encoded_chars, the characters that were encoded again."""
    df = without(df, "edited_text", "edited_tokens", "edited_tree", "encoded_chars")
    ranks = bpe._ranks(df, rank_file)
    added = [("edited_text", T.StringType()), ("edited_tokens", T.LongType()), ("edited_tree", TREE), ("encoded_chars", T.LongType())]
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in added)])

    def run(batches):
        count = _counter(bpe._encoding(ranks.value, pattern))
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                rows = batch.slice(first, 512)
                out: list[tuple] = []
                for whole, leaves, changes in zip(rows.column(text).to_pylist(), rows.column("tree").to_pylist(), rows.column(edits).to_pylist(), strict=True):
                    tree, now, again = Tree(leaves["chars"], leaves["tokens"]), whole or "", 0
                    for change in changes or []:
                        if change is not None:
                            now, n = tree.edit(now, change["start"] or 0, change["removed"] or 0, change["inserted"] or "", count)
                            again += n
                    out.append((now, tree.n_tokens, {"chars": tree.chars, "tokens": tree.tokens}, again))
                columns = [pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.string(), pa.int64(), TREE_ARROW, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*rows.columns, *columns], names=schema.names)

    return map_arrow(df, run, schema)
