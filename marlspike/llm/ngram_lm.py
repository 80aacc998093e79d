"""Language-model scores from an Elias-Fano n-gram trie.

Level 1 holds the words of the training texts as sorted 64-bit hashes, with their counts as differences of a running sum;
level 2 holds, for each word as context, its successors; each further level, for each entry of the level above that was
seen CONTEXT_COUNT times or more, the words that follow it. All are monotone sequences in Elias-Fano form: words by their
hash; pointers to each context's range; successor ids relative to their context, added to the last value of the range
before, so that the whole level ascends. Beside the successors stand their smoothed probabilities, (count - DISCOUNT) /
count of the context, as 16-bit logarithms. A query finds the word's id, the context's range, and the successor within it;
the place where it was found is the context of the next word one level deeper.

p(w | c) = max(n(c, w) - DISCOUNT, 0) / n(c) + DISCOUNT * kinds(c) / n(c) * p(w | c without its first word), and for no context
p(w) = (n(w) + 0.1) / (N + 0.1 (V + 1)); the shorter context alone where the longer one has no successors stored.
Sentences are texts: a start context before, an end token after the words.

Levels are cut into shards by the highest bits of the first context word's hash, files in the shared folder, which workers
map into memory (stores other than local or mounted paths are copied to an unlinked file first): an n-gram and all its
prefixes lie in one shard, so that one gathering of the longest n-grams builds every level. The at most 4 x shards
contexts with over a 4 x shards-th of all tokens, the start among them, have their n-grams dealt over all shards by the
second word. Counts are summed in each task before they are shuffled; n-grams travel as sorted, compressed blocks, and a
shard is built from runs of its contexts, one after the other. A query looks each different n-gram of some hundred thousand
tokens up once, in the order of shards, contexts and words. No shard, word or n-gram
goes through the driver: it holds each shard's number of words, and numbers of kinds of the few frequent contexts.

Words are told apart by 64-bit hashes alone. Cases: a null text is empty (the end token alone); rows without an id are
scored and not learned from; repeated rows count as often as they stand; without training rows all scores are those of
p(w) with N = V = 0; an empty table gives an empty result; columns named like a result column are replaced.
"""

from __future__ import annotations

import functools
import json
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlspike.llm import textvec
from marlspike.llm.common import discard, fresh_path, map_arrow, table, without

DISCOUNT, ADD = 0.75, 0.1
#: Words of the longest n-grams, and how often a context of two or more words must have been seen to have a level of its own.
ORDER, CONTEXT_COUNT = 3, 2
#: Training tokens that a shard should hold; each slice of texts is looked up in every shard, so small ones cost time by their number.
SHARD_TOKENS = 16_000_000
#: Runs of contexts into which a shard is cut while it is built, one in memory at a time.
PARTS = 8
#: Shards of small corpora.
LEAST_SHARDS = 16
#: Distinct words, or n-grams, that a task gathers before it hands them on.
GATHER = 1 << 20
#: Bytes of text that are hashed at once.
SLICE = 1 << 21
#: Tokens that are scored at once.
SCORED = 1 << 19
END = np.uint64(0x5851F42D4C957F2D)
START = np.uint64(0x14057B7EF767814F)
#: Logarithms are kept in steps of 1 / STEPS, from 0 to -16.
STEPS = 4095
U1, U64 = np.uint64(1), np.uint64(64)
#: The place of the k-th one in byte v, at 8 v + k.
_IN_BYTE = np.array([next((i for i in range(8) if v >> i & 1 and bin(v & ((1 << i) - 1)).count("1") == k), 0) for v in range(256) for k in range(8)], np.uint8)
#: The lowest and the highest bit of each byte.
_BYTES, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
#: The number behind each stored logarithm.
_POWERS = 10.0 ** (-np.arange(1 << 16, dtype=np.float64) / STEPS)


class EliasFano:
    """A sequence of ascending unsigned integers: high parts as a bit vector, low parts packed; lookups on arrays.

    Bit high(i) + i + 1 of the vector stands for value i, so that values of one high part lie side by side behind its zero.
    """

    def __init__(self, n: int, low_bits: int, upper: np.ndarray, ranks: np.ndarray, zeros: np.ndarray, low: np.ndarray):
        self.n, self.low_bits, self.upper, self.ranks, self.zeros, self.low = n, low_bits, upper, ranks, zeros, low
        self.most: int | None = None

    @classmethod
    def build(cls, values: np.ndarray, finds: bool = False) -> EliasFano:
        """finds: whether find() will be called, which needs the ranks of zeros too."""
        values = values.astype(np.uint64, copy=False)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        words = -(-((top >> low_bits) + n + 2) // 64) + 2
        bits = np.zeros(words * 8, np.uint8)
        low = np.zeros((n * low_bits + 63) // 64 + 2, np.uint64)
        for begin in range(0, n, GATHER):
            piece = values[begin : begin + GATHER]
            at = (piece >> np.uint64(low_bits)).astype(np.int64) + np.arange(begin + 1, begin + 1 + len(piece))
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
            if low_bits:
                part = piece & np.uint64((1 << low_bits) - 1)
                bit = np.arange(begin, begin + len(piece), dtype=np.uint64) * np.uint64(low_bits)
                word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
                np.bitwise_or.at(low, word, part << shift)
                over = shift + np.uint64(low_bits) > U64
                np.bitwise_or.at(low, word[over] + 1, part[over] >> (U64 - shift[over]))
        upper = bits.view(np.uint64)
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(upper), dtype=np.int64)])
        zeros = np.arange(words + 1) * 64 - ranks if finds else ranks[:0]
        narrow = np.uint32 if words < 1 << 26 else np.int64
        return cls(n, low_bits, upper, ranks.astype(narrow), zeros.astype(narrow), low)

    def arrays(self) -> dict[str, np.ndarray]:
        return {"upper": self.upper, "ranks": self.ranks, "zeros": self.zeros, "low": self.low}

    def _select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        """Positions of the k-th (from 0) one or zero in the upper bits."""
        ranks = self.zeros if zeros else self.ranks
        k = k.astype(ranks.dtype)
        word = np.searchsorted(ranks, k, side="right") - 1
        rest = (k - ranks[word]).astype(np.uint64)
        bits = self.upper[word]
        if zeros:
            bits = ~bits
        # ones up to each byte, side by side in one word; the byte sought is the first with more than rest
        upto = bits - ((bits >> U1) & np.uint64(0x5555555555555555))
        upto = (upto & np.uint64(0x3333333333333333)) + ((upto >> np.uint64(2)) & np.uint64(0x3333333333333333))
        upto = ((upto + (upto >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _BYTES
        at = np.bitwise_count(((rest * _BYTES | _TOPS) - upto) & _TOPS).astype(np.uint64) << np.uint64(3)
        rest -= ((upto << np.uint64(8)) >> at) & np.uint64(255)
        return (word << 6) + at.astype(np.int64) + _IN_BYTE[((((bits >> at) & np.uint64(255)) << np.uint64(3)) | rest).astype(np.int64)]

    def _window(self, at: np.ndarray) -> np.ndarray:
        """The 64 upper bits from each position on."""
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        return (self.upper[word] >> shift) | ((self.upper[word + 1] << U1) << (np.uint64(63) - shift))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low_bits
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        return ((self.low[word] >> shift) | ((self.low[word + 1] << U1) << (np.uint64(63) - shift))) & np.uint64((1 << self.low_bits) - 1)

    def _value(self, i: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((at - i - 1).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def access(self, i: np.ndarray) -> np.ndarray:
        return self._value(i, self._select(i, False)) if self.n else np.zeros(len(i), np.uint64)

    def ends(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at i and at i + 1 (the last one again behind the end)."""
        if not self.n:
            return np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        at = self._select(i, False)
        rest = self._window(at + 1)
        after = at + 1 + np.bitwise_count((rest & (~rest + U1)) - U1)
        more = i + 1 < self.n
        if len(far := np.flatnonzero((rest == 0) & more)):
            after[far] = self._select(i[far] + 1, False)
        value = self._value(i, at).astype(np.int64)
        return value, np.where(more, self._value(np.minimum(i + 1, self.n - 1), after).astype(np.int64), value)

    def find(self, value: np.ndarray, begin: np.ndarray | int, end: np.ndarray | int) -> np.ndarray:
        """The index of value within [begin, end), or -1."""
        found = np.full(len(value), -1, np.int64)
        if not self.n or not len(value):
            return found
        high = (value >> np.uint64(self.low_bits)).astype(np.int64)
        if self.most is None:
            self.most = int(self._select(np.array([self.n - 1]), False)[0]) - self.n
        # a high part beyond the last one has no zero of its own
        possible = (high >= 0) & (high <= self.most)
        high = np.clip(high, 0, self.most)
        at = self._select(high, True) + 1
        same = self._window(at)
        size = np.bitwise_count((~same & (same + U1)) - U1).astype(np.int64)
        if len(wide := np.flatnonzero(size == 64)):
            size[wide] = self._select(high[wide] + 1, True) - at[wide]
        lo = at - high - 1
        hi = np.where(possible, np.minimum(lo + size, end), lo)
        lo = np.maximum(lo, begin)
        live = np.flatnonzero(lo < hi)
        lo, hi, want = lo[live], hi[live], value[live] & np.uint64((1 << self.low_bits) - 1)
        while len(live):
            middle = (lo + hi) >> 1
            low = self._low(middle)
            hit = low == want
            found[live[hit]] = middle[hit]
            less = low < want
            lo, hi = np.where(less, middle + 1, lo), np.where(less, hi, middle)
            on = np.flatnonzero(~hit & (lo < hi))
            live, lo, hi, want = live[on], lo[on], hi[on], want[on]
        return found


def _save(folder: str, name: str, sequences: dict[str, EliasFano], plain: dict[str, np.ndarray]) -> str:
    """One file: a line of JSON, then the arrays, each at a multiple of 64 bytes."""
    arrays = {f"{n}.{k}": a for n, s in sequences.items() for k, a in s.arrays().items()} | plain
    table_of, at = {}, 0
    for k, a in arrays.items():
        table_of[k] = [str(a.dtype), len(a), at]
        at += -(-a.nbytes // 64) * 64
    head = json.dumps({"arrays": table_of, "sequences": {n: [s.n, s.low_bits] for n, s in sequences.items()}}).encode()
    head = len(head).to_bytes(8, "little") + head
    head += b" " * (-len(head) % 64)
    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    path = f"{name}-{uuid.uuid4().hex}.trie"
    with store.open_output_stream(f"{root}/{path}", compression=None) as out:
        out.write(head)
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).tobytes())
            out.write(b"\0" * (-a.nbytes % 64))
    return path


@functools.lru_cache(maxsize=1 << 15)  # a process may map 65,530 pieces on Linux
def _open(folder: str, path: str) -> tuple[dict[str, EliasFano], dict[str, np.ndarray]]:
    """The file's levels, mapped into memory."""
    store, root = pafs.FileSystem.from_uri(folder)
    if isinstance(store, pafs.LocalFileSystem):
        data = np.memmap(f"{root}/{path}", np.uint8, "r")
    else:
        with tempfile.NamedTemporaryFile() as copy, store.open_input_stream(f"{root}/{path}", compression=None) as stream:
            while piece := stream.read(8 << 20):
                copy.write(piece)
            copy.flush()
            data = np.memmap(copy.name, np.uint8, "r")  # stays readable when the file is unlinked
    size = int.from_bytes(data[:8].tobytes(), "little")
    head = json.loads(data[8 : 8 + size].tobytes())
    start = -(-(8 + size) // 64) * 64
    arrays = {k: np.asarray(data[start + at : start + at + n * np.dtype(kind).itemsize]).view(kind) for k, (kind, n, at) in head["arrays"].items()}
    sequences = {n: EliasFano(*facts, *(arrays[f"{n}.{k}"] for k in ("upper", "ranks", "zeros", "low"))) for n, facts in head["sequences"].items()}
    return sequences, arrays


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of an ordered array, and where each begins."""
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[starts], starts


def _by_shard(shard: np.ndarray, shards: int) -> np.ndarray:
    """Places in the order of their shards; short numbers are sorted by digits."""
    return np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")


class Vocabulary:
    """Words by hash over all shards: ids ascend with the hash, so that a shard's ids are a run from its offset."""

    def __init__(self, folder: str, paths: list[str | None], sizes: list[int]):
        self.folder, self.paths, self.bits = folder, paths, (len(paths) - 1).bit_length()
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def shard_of(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1 where unseen) and counts of sorted hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        touched, starts = _runs(self.shard_of(hashes))
        for s, a, b in zip(touched.tolist(), starts, np.append(starts[1:], len(hashes)), strict=False):
            if path := self.paths[s]:
                words = _open(self.folder, path)[0]
                at = words["words"].find(hashes[a:b], 0, words["words"].n)
                hit = np.flatnonzero(at >= 0)
                below, upto = words["counts"].ends(np.maximum(at[hit] - 1, 0))
                below, upto = np.where(at[hit] > 0, below, 0), np.where(at[hit] > 0, upto, below)
                ids[a + hit], counts[a + hit] = at[hit] + self.offsets[s], upto - below
        return ids, counts


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's words and its end token, and the rows' offsets."""
    h, at = textvec.words(data, offsets)
    rows = len(at) - 1
    out = np.empty(len(h) + rows, np.uint64)
    limits = at + np.arange(rows + 1)
    out[np.arange(len(h)) + textvec.row_of(at)] = h
    out[limits[1:] - 1] = END
    return out, limits


def _parts(column: pa.Array):
    data, offsets = textvec.text_buffers(column)
    for first, last in textvec.slices(offsets, SLICE):
        part = offsets[first : last + 1]
        yield first, last, *_tokens(data[part[0] : part[-1]], part - part[0])


def _together(batches, text: str, least: int):
    """Tokens and limits of whole rows, at least so many tokens at once where there are more; and the rows."""
    waiting, size = [], 0

    def out():
        tokens, limits, rows = (list(x) for x in zip(*waiting, strict=True))
        waiting.clear()
        return np.concatenate(tokens), np.concatenate([np.zeros(1, np.int64), *limits]), rows

    for batch in batches:
        kept = batch.select([c for c in batch.schema.names if c != text])
        for first, last, part, at in _parts(batch.column(text)):
            waiting.append((part, at[1:] + size, kept.slice(first, last - first)))
            size += len(part)
            if size >= least:
                yield out()
                size = 0
    if waiting:
        yield out()


class _Counts:
    """Keys and counts gathered over batches, as sorted arrays."""

    def __init__(self):
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> bool:
        self.waiting.append(np.unique(keys, return_counts=True))
        self.size += len(self.waiting[-1][0])
        return self.size >= GATHER and (len(self.waiting) < 2 or self.merge() >= GATHER // 2)

    def merge(self) -> int:
        keys, counts = (np.concatenate([w[k] for w in self.waiting]) for k in (0, 1))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.waiting = [(keys[first], np.add.reduceat(counts, first) if len(keys) else counts)]
        self.size = len(first)
        return self.size

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.waiting) > 1:
            self.merge()
        out = self.waiting[0] if self.waiting else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.waiting, self.size = [], 0
        return out


class Model:
    """What scoring needs on each worker: names of the shards' files and some numbers."""

    def __init__(self, folder: str, vocabulary: Vocabulary, tokens: int, kinds: int, texts: int, order: int = ORDER):
        self.folder, self.vocabulary, self.tokens, self.kinds, self.texts, self.order = folder, vocabulary, tokens, kinds, texts, order
        self.frequent = np.zeros(0, np.int64)
        self.frequent_counts = np.zeros(0, np.int64)
        self.frequent_kinds = np.zeros(0, np.int64)
        self.levels: list[str | None] = [None] * len(vocabulary.paths)

    @property
    def start(self) -> int:
        """The id of the start context, one beyond the words'."""
        return int(self.vocabulary.offsets[-1])

    def pair_shard(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        shard = np.searchsorted(self.vocabulary.offsets, context, side="right") - 1
        return np.where(np.isin(context, self.frequent), word % len(self.levels), shard)

    def local(self, shard: int | np.ndarray, context: np.ndarray) -> np.ndarray:
        """Numbers of contexts within a shard: its own words, then the frequent ones."""
        own = context - self.vocabulary.offsets[shard]
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, context), len(self.frequent) - 1)
            size = self.vocabulary.offsets[np.add(shard, 1)] - self.vocabulary.offsets[shard]
            own = np.where(self.frequent[at] == context, size + at, own)
        return own

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return (count + ADD) / (self.tokens + ADD * (self.kinds + 1))


def _count_words(docs: DataFrame, text: str) -> DataFrame:
    def run(batches):
        gathered = _Counts()

        def out():
            keys, counts = gathered.take()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["word", "n"])

        for batch in batches:
            for _, _, tokens, _ in _parts(batch.column(text)):
                if gathered.add(tokens):
                    yield out()
        if gathered.waiting:
            yield out()

    return map_arrow(docs.select(text), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _build_vocabulary(words: DataFrame, folder: str, shards: int) -> tuple[Vocabulary, int]:
    bits = (shards - 1).bit_length()
    shard = F.shiftrightunsigned("word", 64 - bits).cast("int") if bits else F.lit(0)
    # hashes are unsigned
    dealt = words.withColumn("shard", shard).repartition(shards, "shard").sortWithinPartitions("shard", F.col("word").bitwiseXOR(F.lit(-(1 << 63))))

    def run(batches):
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        at = None

        def out():
            hashes, counts = (np.concatenate([w[k] for w in waiting]) for k in (0, 1))
            path = _save(folder, f"words-{at}", {"words": EliasFano.build(hashes.view(np.uint64), finds=True), "counts": EliasFano.build(np.cumsum(counts))}, {})
            return pa.RecordBatch.from_pydict({"shard": pa.array([at], pa.int32()), "path": [path], "size": [len(hashes)], "tokens": [int(counts.sum())]})

        for batch in batches:
            numbers = batch.column("shard").to_numpy()
            for s in np.unique(numbers):
                if at is not None and s != at:
                    yield out()
                    waiting = []
                at = int(s)
                mine = numbers == s
                waiting.append((batch.column("word").to_numpy()[mine], batch.column("n").to_numpy()[mine]))
        if waiting:
            yield out()

    built = table(map_arrow(dealt, run, "shard int, path string, size long, tokens long"), "lm-vocabulary").collect()
    paths, sizes = [None] * shards, [0] * shards
    for r in built:
        paths[r["shard"]], sizes[r["shard"]] = r["path"], r["size"]
    return Vocabulary(folder, paths, sizes), sum(r["tokens"] for r in built)


def _ids(vocabulary: Vocabulary, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words, place = np.unique(tokens, return_inverse=True)
    ids, counts = vocabulary.look_up(words)
    return ids[place], counts[place]


def _contexts(ids: np.ndarray, limits: np.ndarray, start: int) -> np.ndarray:
    context = np.empty_like(ids)
    context[1:] = ids[:-1]
    context[limits[:-1]] = start
    return context


def _sorted_rows(columns: list[np.ndarray], bits: int) -> np.ndarray:
    """The order of rows by their columns, whose values have so many bits; columns that fit are packed into one word."""
    keys, width = [columns[0].astype(np.uint64)], bits
    for c in columns[1:]:
        if width + bits <= 64:
            keys[-1] = (keys[-1] << np.uint64(bits)) | c.astype(np.uint64)
            width += bits
        else:
            keys.append(c.astype(np.uint64))
            width = bits
    return np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")


def _summed(columns: list[np.ndarray], counts: np.ndarray, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Different rows in order, and their counts."""
    order = _sorted_rows(columns, bits)
    columns, counts = [c[order] for c in columns], counts[order]
    if not len(counts):
        return columns, counts
    new = np.ones(len(counts), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    first = np.flatnonzero(new)
    return [c[first] for c in columns], np.add.reduceat(counts, first)


def _planes(values: np.ndarray, width: int) -> bytes:
    """The lowest width bytes of the values, all first bytes before all second ones."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width].tobytes()


def _from_planes(raw: np.ndarray, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = raw.reshape(width, n).T
    return out.view(np.uint64).reshape(-1)


class _Level:
    """A level as its runs of contexts come in, in order."""

    def __init__(self):
        self.values, self.shares, self.kinds, self.weights, self.end = [], [], [], [], np.uint64(0)

    def add(self, contexts: np.ndarray, words: np.ndarray, counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """Rows in order of context and word; totals has a count for each context. The number of kinds of each context."""
        kinds = np.bincount(contexts, minlength=len(totals))
        if len(words):
            # relative ids: each context's values start behind the last value of the context before
            last = np.flatnonzero(np.append(contexts[1:] != contexts[:-1], True))
            ends = np.cumsum(words[last] + U1) + self.end
            base = np.append(self.end, ends[:-1])
            self.values.append(np.repeat(base, np.diff(last, prepend=-1)) + words)
            self.end = ends[-1]
            share = np.maximum(counts - DISCOUNT, 1e-9) / totals[contexts]
            self.shares.append(np.clip(np.round(-np.log10(share) * STEPS), 0, 65535).astype(np.uint16))
        return kinds

    def weigh(self, kinds: np.ndarray, totals: np.ndarray) -> None:
        self.kinds.append(kinds.astype(np.uint32))
        weight = np.clip(np.round(-np.log10(DISCOUNT * np.maximum(kinds, 1) / np.maximum(totals, 1)) * STEPS), 0, 65534)
        self.weights.append(np.where(kinds > 0, weight, 65535).astype(np.uint16))

    def sequences(self) -> dict[str, EliasFano]:
        pointers = np.concatenate([[0], np.cumsum(np.concatenate(self.kinds), dtype=np.int64)])
        values, self.values = np.concatenate(self.values), []
        return {"pointers": EliasFano.build(pointers), "successors": EliasFano.build(values, finds=True)}


def _build_levels(docs: DataFrame, text: str, model: Model) -> DataFrame:
    """Writes each shard's levels from 2 on: a row for each shard with path, and the frequent contexts' kinds there."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    shards, order = len(model.levels), model.order
    # ids travel as id + 1: 0 stands for no word
    bits = (model.start + 1).bit_length()
    width = -(-bits // 8)

    def gather(batches):
        m = sent.value
        sizes = np.diff(m.vocabulary.offsets) + len(m.frequent)
        for tokens, limits, _ in _together(batches, text, GATHER):
            ids = _ids(m.vocabulary, tokens)[0]
            del tokens
            columns = [_contexts(ids, limits, m.start) + 1, ids + 1]
            row = textvec.row_of(limits)
            for gap in range(1, order - 1):
                after = np.zeros(len(ids), np.int64)
                after[:-gap] = np.where(row[gap:] == row[:-gap], ids[gap:] + 1, 0)
                columns.append(after)
            del row
            columns, counts = _summed(columns, np.ones(len(ids), np.int64), bits)
            shard = m.pair_shard(columns[0] - 1, columns[1] - 1)
            # a run of contexts within the shard's ascends with their numbers there
            part = shard * PARTS + m.local(shard, columns[0] - 1) * PARTS // sizes[shard]
            dealt = _by_shard(part, shards * PARTS)
            touched, starts = _runs(part[dealt])
            wides, blocks, grams = [], [], np.diff(starts, append=len(dealt))
            for mine in np.split(dealt, starts[1:]):
                wides.append(-(-int(counts[mine].max()).bit_length() // 8))
                raw = b"".join([_planes(np.diff(columns[0][mine], prepend=0), width), *(_planes(c[mine], width) for c in columns[1:]), _planes(counts[mine], wides[-1])])
                blocks.append(pa.compress(raw, "zstd", asbytes=True))
            yield pa.RecordBatch.from_pydict({"shard": pa.array((touched // PARTS).astype(np.int32)), "part": pa.array((touched % PARTS).astype(np.int32)), "grams": pa.array(grams), "wide": pa.array(wides, pa.int32()), "block": pa.array(blocks, pa.binary())})

    def build(batches):
        m = sent.value
        waiting: list[tuple[list[np.ndarray], np.ndarray]] = []
        at = part = None
        own, context_totals, frequent_kinds, levels = 0, None, None, {}

        def begin():
            nonlocal own, context_totals, frequent_kinds, levels
            own = int(m.vocabulary.offsets[at + 1] - m.vocabulary.offsets[at])
            words = _open(m.folder, m.vocabulary.paths[at])[0]["counts"] if m.vocabulary.paths[at] else None
            context_totals = np.zeros(own + len(m.frequent), np.int64)
            if own:
                context_totals[:own] = np.diff(words.access(np.arange(own)).astype(np.int64), prepend=0)
            context_totals[own:] = m.frequent_counts
            frequent_kinds, levels = np.zeros(len(context_totals), np.int64), {k: _Level() for k in range(2, order + 1)}

        def run():
            columns = [np.concatenate([w[0][k] for w in waiting]) for k in range(order)]
            counts = np.concatenate([w[1] for w in waiting])
            waiting.clear()
            columns[0] = m.local(at, columns[0].astype(np.int64) - 1)
            columns, counts = _summed(columns, counts, bits)
            # entries of each level: runs of rows that are alike up to its word
            context, totals = columns[0], context_totals
            for k in range(2, order + 1):
                word = columns[k - 1]
                if k > 2:
                    there = word > 0
                    columns, context, counts, word = [c[there] for c in columns], context[there], counts[there], word[there]
                new = np.ones(len(word), bool)
                new[1:] = (context[1:] != context[:-1]) | (word[1:] != word[:-1])
                first = np.flatnonzero(new)
                summed = np.add.reduceat(counts, first) if len(first) else counts
                kinds = levels[k].add(context[first], word[first].astype(np.uint64) - U1, summed, totals)
                if k == 2:
                    np.add(frequent_kinds, kinds, out=frequent_kinds)
                else:
                    levels[k].weigh(kinds, totals)
                # contexts of the next level: entries seen often enough
                entry = np.cumsum(new) - 1
                often = (summed >= CONTEXT_COUNT)[entry]
                columns, context, counts = [c[often] for c in columns], entry[often], counts[often]
                totals = np.zeros(len(first), np.int64)
                if k < order:
                    follows = columns[k] > 0
                    totals += np.bincount(context[follows], counts[follows], len(first)).astype(np.int64)

        def out():
            sequences, plain = {}, {}
            levels[2].kinds.append(frequent_kinds)
            for k, level in levels.items():
                if level.values:
                    sequences |= {f"{name}{k}": sequence for name, sequence in level.sequences().items()}
                    plain[f"shares{k}"] = np.concatenate(level.shares)
                    if k > 2:
                        plain[f"weights{k}"] = np.concatenate(level.weights)
            path = _save(m.folder, f"grams-{at}", sequences, plain)
            return pa.RecordBatch.from_pydict({"shard": pa.array([at], pa.int32()), "path": [path], "kinds": pa.array([frequent_kinds[own:].tolist()], pa.list_(pa.int64()))})

        for batch in batches:
            for i in range(batch.num_rows):
                shard, of, n, wide = (batch.column(c)[i].as_py() for c in ("shard", "part", "grams", "wide"))
                if waiting and (shard, of) != (at, part):
                    run()
                if shard != at:
                    if at is not None:
                        yield out()
                    at = shard
                    begin()
                part = of
                raw = np.frombuffer(pa.decompress(batch.column("block")[i].as_buffer(), (order * width + wide) * n, "zstd"), np.uint8)
                columns = [_from_planes(raw[k * width * n : (k + 1) * width * n], n, width) for k in range(order)]
                columns[0] = np.cumsum(columns[0])
                if bits <= 32:
                    columns = [c.astype(np.uint32) for c in columns]
                waiting.append((columns, _from_planes(raw[order * width * n :], n, wide).astype(np.int64)))
        if waiting:
            run()
            yield out()

    blocks = map_arrow(docs.select(text), gather, "shard int, part int, grams long, wide int, block binary")
    dealt = blocks.repartition(shards, "shard").sortWithinPartitions("shard", "part")
    return table(map_arrow(dealt, build, "shard int, path string, kinds array<long>"), "lm-levels")


def fit(docs: DataFrame, text: str = "text", order: int = ORDER, shard_tokens: int = SHARD_TOKENS) -> Model:
    """The trie of all rows of docs, with n-grams of order words (2 or more); counts and files are written in the shared folder."""
    if order < 2:
        raise ValueError("n-grams have two words at least")
    spark = docs.sparkSession
    folder = fresh_path(spark, "lm-trie")
    words = table(_count_words(docs, text), "lm-words")
    kinds, tokens = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = LEAST_SHARDS
    while shards * shard_tokens < tokens:
        shards *= 2
    vocabulary, tokens = _build_vocabulary(words, folder, shards)
    ends = words.where(F.col("word") == int(END.view(np.int64))).agg(F.sum("n")).first()[0] or 0
    model = Model(folder, vocabulary, tokens, kinds, ends, order)
    if not kinds:
        return model
    # contexts with over a (4 x shards)-th of all tokens: fewer than 4 x shards, whatever the input
    often = words.where((F.col("n") > tokens / (4 * shards)) & (F.col("word") != int(END.view(np.int64)))).collect()
    discard(words)
    hashes = np.sort(np.array([r["word"] for r in often], np.int64).view(np.uint64))
    ids, counts = vocabulary.look_up(hashes)
    model.frequent, model.frequent_counts = np.append(ids, model.start), np.append(counts, ends)
    by_id = np.argsort(model.frequent)
    model.frequent, model.frequent_counts = model.frequent[by_id], model.frequent_counts[by_id]
    model.frequent_kinds = np.zeros(len(model.frequent), np.int64)
    levels = _build_levels(docs, text, model)
    # a path for each shard; the words seen behind a frequent context lie in many shards and are summed there
    for r in levels.select("shard", "path").collect():
        model.levels[r["shard"]] = r["path"]
    for r in levels.select(F.posexplode("kinds").alias("at", "n")).where("n > 0").groupBy("at").agg(F.sum("n").alias("n")).collect():
        model.frequent_kinds[r["at"]] = r["n"]
    return model


def _successors(model: Model, k: int, shard: np.ndarray, own: np.ndarray, total: np.ndarray | None, first: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (-1: unseen) looked up behind contexts on level k: contexts in the order of their shards, with their numbers there and
    their counts (on level 2); each one's words lie together, from first on. The weight of each context's shorter context, and the share and
    the place (-1 if not there) of each word."""
    weight, share, place = np.ones(len(own)), np.zeros(len(words)), np.full(len(words), -1, np.int64)
    touched, starts = _runs(shard)
    for s, a, b in zip(touched.tolist(), starts.tolist(), [*starts[1:].tolist(), len(own)], strict=False):
        size = int(model.vocabulary.offsets[s + 1] - model.vocabulary.offsets[s])
        path, local = model.levels[s], own[a:b]
        if not path:
            # no n-gram fell to this shard, but words behind frequent contexts, unseen there, may be looked for in it
            often = np.flatnonzero(local >= size)
            weight[a + often] = DISCOUNT * model.frequent_kinds[local[often] - size] / total[a + often]
            continue
        sequences, arrays = _open(model.folder, path)
        if f"pointers{k}" not in sequences:
            continue
        begin, end = sequences[f"pointers{k}"].ends(local)
        if k == 2:
            kinds, often = end - begin, np.flatnonzero(local >= size)
            kinds[often] = model.frequent_kinds[local[often] - size]
            weight[a:b] = DISCOUNT * kinds / total[a:b]
        else:
            stored = arrays[f"weights{k}"][local]
            weight[a:b] = np.where(stored < 65535, _POWERS[stored], 1.0)
        base = np.zeros(b - a, np.uint64)
        some = np.flatnonzero((begin > 0) & (begin < end))
        base[some] = sequences[f"successors{k}"].access(begin[some] - 1) + U1
        behind = np.repeat(np.arange(b - a), np.diff(first[a : b + 1]))
        known = np.flatnonzero((words[first[a] : first[b]] >= 0) & (begin < end)[behind])
        behind, known = behind[known], known + first[a]
        at = sequences[f"successors{k}"].find(base[behind] + words[known].astype(np.uint64), begin[behind], end[behind])
        hit = np.flatnonzero(at >= 0)
        share[known[hit]], place[known[hit]] = _POWERS[arrays[f"shares{k}"][at[hit]]], at[hit]
    return weight, share, place


def _probabilities(model: Model, ids: np.ndarray, counts: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """p of each token after the words before it."""
    p = model.unigram(counts)
    inner = np.ones(len(ids), bool)
    inner[limits[:-1]] = False
    bits = (model.start + 1).bit_length()
    # where each token was found on the level before, as the context of the token behind it
    place = home = np.zeros(0, np.int64)
    for k in range(2, model.order + 1):
        if k == 2:
            own = _contexts(ids, limits, model.start)
            total = np.where(inner, np.roll(counts, 1), model.texts)
            seen = np.flatnonzero((own >= 0) & (total > 0))
            own, total = own[seen], total[seen]
            shard = model.pair_shard(own, ids[seen])
            own = model.local(shard, own)
        else:
            seen = np.flatnonzero((place[:-1] >= 0) & inner[1:]) + 1
            shard, own = home[seen - 1], place[seen - 1]
        if not len(seen):
            break
        # each context and word is looked up once, in order, so that lookups go through a shard's file from its head to its end
        width = int(own.max()) + 1
        contexts, words = shard * width + own, ids[seen] + 1
        del shard, own, place, home
        if int(contexts.max()).bit_length() + bits <= 64:
            order = np.argsort((contexts << bits | words).view(np.uint64))
        else:
            order = np.lexsort((words, contexts))
        contexts, words, seen = contexts[order], words[order], seen[order]
        other = np.concatenate([[True], contexts[1:] != contexts[:-1]])
        new = other | np.concatenate([[True], words[1:] != words[:-1]])
        row = np.flatnonzero(new)
        first = np.flatnonzero(other[row])
        shard, own = np.divmod(contexts[row[first]], width)
        weight, share, found = _successors(model, k, shard, own, total[order[row[first]]] if k == 2 else None, np.append(first, len(row)), words[row] - 1)
        del contexts, words, order
        at, of = np.cumsum(new) - 1, np.cumsum(other) - 1
        p[seen] = share[at] + weight[of] * p[seen]
        place, home = np.full(len(ids), -1, np.int64), np.full(len(ids), -1, np.int64)
        place[seen], home[seen] = found[at], shard[of]
    return p


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without text, with n_tokens, n_known, train_tokens (long), base_score and score (log10 of the probability)."""
    docs = without(docs, "n_tokens", "n_known", "train_tokens", "base_score", "score")
    kept = [c for c in docs.columns if c != text]
    added = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    schema = T.StructType([*[docs.schema[c] for c in kept], *(T.StructField(n, t) for n, t in added)])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for tokens, limits, parts in _together(batches, text, SCORED):
            ids, counts = _ids(m.vocabulary, tokens)
            del tokens
            sums = [np.add.reduceat(x, limits[:-1]) for x in ((counts > 0).astype(np.int64), np.log10(m.unigram(counts)))]
            sums.append(np.add.reduceat(np.log10(_probabilities(m, ids, counts, limits)), limits[:-1]))
            columns = [pa.array(np.diff(limits)), pa.array(sums[0]), pa.array(np.full(len(limits) - 1, m.tokens, np.int64)), pa.array(sums[1]), pa.array(sums[2])]
            del ids, counts
            at = 0
            for rows in parts:
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in kept], *[c.slice(at, rows.num_rows) for c in columns]], names=schema.names)
                at += rows.num_rows

    return map_arrow(docs, run, schema)
