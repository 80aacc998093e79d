"""Substring de-duplication: words that stand in a window which also starts in a document with a smaller id are removed.

Super-k-mers. The minimiser of a window is its run of GRAM words with the least hash, the leftmost of equal ones. Consecutive
windows of a text that share a minimiser travel as one packed string to the bucket of that minimiser; equal windows have equal
minimisers, so that a bucket sees every copy of its windows and sorts them exactly, as text.

Hot groups. A task sends each different string twice at most while its id doesn't fall, however many documents hold it. Runs of
words that stand in more than HOT different strings rank behind all others, so that windows around a common line are dealt
by their other words and those within it are the same string everywhere; the list has a fixed bound (HOT_LISTED). A bucket
that is too large all the same hands its windows on one by one, dealt by their own digests, which is as exact.

Cases. A null text has no words. Rows without an id keep all of their words and take none from others, as a comparison
with null decides nothing. Rows of one id are one document: none of them takes words from another. A text of fewer words than
the window keeps all of them. Ids are integers. Strings are told apart by their 128-bit BLAKE2b digests, windows in buckets by
their text.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlspike.llm.common import map_arrow, table, tasks_for, without
from marlspike.llm.textvec import SPACE, UNCHANGED, mix, slices, span_hashes, text_buffers, word_spans

WINDOW = 50
#: Words of a minimiser.
GRAM = 3
#: Different strings behind one minimiser from which on it ranks last, and how many such minimisers are listed at most (8 bytes each).
HOT, HOT_LISTED = 1024, 1 << 16
#: Strings that a task remembers as sent.
REMEMBERED = 1 << 17
#: Bytes of the windows of one bucket that are sorted in memory; larger buckets hand theirs on.
BUCKET_BYTES = 1 << 26
#: Characters of text behind one task of the shuffle of strings, and bytes of a piece of text that is cut at once.
TASK_CHARS, PIECE = 1 << 25, 1 << 19
#: Strings, of the first ones of a table, from which the shared dictionary of their compression is made, and its bytes.
DICTIONARY_TEXTS, DICTIONARY_BYTES = 256, 64 << 10


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of width keys."""
    have, out = 1, keys
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return out if have == width else np.minimum(out[: len(out) - (width - have)], out[width - have :])


def _is_hot(grams: np.ndarray, hot: np.ndarray) -> np.ndarray:
    place = np.searchsorted(hot, grams)
    return hot[np.minimum(place, len(hot) - 1)] == grams


def minimisers(hashes: np.ndarray, window: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of the minimiser of each window of these words, and the hash of the run of words at each place."""
    gram = min(GRAM, window)
    n = len(hashes) - gram + 1
    grams = np.zeros(n, np.uint64)
    for k in range(gram):
        grams = mix(grams + hashes[k : k + n] * np.uint64(2 * k + 0x9E3779B97F4A7C15))
    # upper hash bits, behind the mark of hot ones and before the place: of equal ones the leftmost
    keys = (grams >> np.uint64(1)) & ~np.uint64((1 << 22) - 1) | np.arange(n, dtype=np.uint64)
    if len(hot):
        keys[_is_hot(grams, hot)] |= np.uint64(1 << 63)
    return (_least(keys, window - gram + 1) & np.uint64((1 << 22) - 1)).astype(np.int64), grams


class Piece:
    """Super-k-mers of a piece of text: row, first word (in the row), number of windows, bucket, and the packed words."""

    def __init__(self, data, first, last, row, word_in_row, window, hot):
        hashes = span_hashes(data, first, last, UNCHANGED)
        at, grams = minimisers(hashes, window, hot)
        starts = np.flatnonzero(row[: len(at)] == row[window - 1 :])  # windows within one row
        at = at[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
        heads = np.flatnonzero(new)
        self.windows = np.diff(np.append(heads, len(starts)))
        begin = starts[heads]
        self.row, self.start, self.bucket = row[begin], word_in_row[begin], grams[at[heads]].view(np.int64)
        # one blank behind each word that has a limit behind it
        inside = ~SPACE[data]
        kept = inside.copy()
        kept[last[last < len(data)]] = True
        self._text = np.where(inside, data, np.uint8(32))[kept].tobytes()
        before = np.zeros(len(data) + 1, np.int64)
        np.cumsum(kept, out=before[1:])
        end = begin + self.windows + window - 2
        self._bounds = list(zip(before[first[begin]].tolist(), before[last[end]].tolist()))

    def __len__(self):
        return len(self.windows)

    def strings(self) -> Iterator[bytes]:
        return (self._text[a:b] for a, b in self._bounds)


def pieces(texts: pa.Array, window: int, hot: np.ndarray) -> Iterator[tuple[Piece, int]]:
    """Pieces of whole rows, or of a long row, with the number of the first row; the pieces of a row share window - 1 words."""
    data, offsets = text_buffers(texts)
    for a, b in slices(offsets, PIECE):
        part = data[offsets[a] : offsets[b]]
        rows = offsets[a : b + 1] - offsets[a]
        first, last = word_spans(part, rows)
        if len(first) < window:
            continue
        if len(part) <= PIECE:
            at = np.searchsorted(first, rows)
            row = np.repeat(np.arange(b - a), np.diff(at))
            yield Piece(part, first, last, row, np.arange(len(first)) - at[row], window, hot), a
            continue
        begin = 0  # one long row
        while begin + window <= len(first):
            end = max(int(np.searchsorted(last, first[begin] + PIECE)), begin + 2 * window)
            f, e = first[begin:end], last[begin:end]
            yield Piece(part[f[0] : e[-1]], f - f[0], e - f[0], np.zeros(len(f), np.int64), np.arange(begin, begin + len(f)), window, hot), a
            begin += len(f) - window + 1


def _digest(x: bytes) -> bytes:
    return blake2b(x, digest_size=16).digest()


class _Sent:
    """Which strings a task has sent: a string again if the id falls, or once for a second id."""

    def __init__(self):
        self.least, self.twice = {}, set()

    def send(self, digest: bytes, doc: int) -> int:
        """2: the string for the first time, 1: the id alone, 0: nothing."""
        have = self.least.get(digest)
        if have is None:
            if len(self.least) >= REMEMBERED:
                self.least.clear()
                self.twice.clear()
            self.least[digest] = doc
            return 2
        if doc == have or (doc > have and digest in self.twice):
            return 0
        self.twice.add(digest)
        self.least[digest] = min(doc, have)
        return 1


_TRAVEL = "bucket long, digest binary, doc long, packed binary"


def _strings(docs: DataFrame, window: int, hot, dictionary=None) -> DataFrame:
    """What travels: the strings of documents, each with its bucket and an id, but for what the task has sent before; packed only with a dictionary."""

    def run(batches):
        packer = zstandard.ZstdCompressor(3, dict_data=zstandard.ZstdCompressionDict(dictionary.value), write_checksum=False) if dictionary else None
        sent = _Sent()
        for batch in batches:
            ids = batch.column("doc").to_pylist()
            for piece, base in pieces(batch.column("text"), window, hot.value):
                out = ([], [], [], [])
                for row, bucket, string in zip(piece.row.tolist(), piece.bucket.tolist(), piece.strings()):
                    digest, doc = _digest(string), ids[base + row]
                    if how := sent.send(digest, doc):
                        for column, value in zip(out, (bucket, digest, doc, packer.compress(string) if packer and how == 2 else None)):
                            column.append(value)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], names=["bucket", "digest", "doc", "packed"])

    return map_arrow(docs, run, _TRAVEL)


def hot_minimisers(docs: DataFrame, window: int) -> np.ndarray:
    """Hashes of the runs of words with over HOT different strings behind them, ascending: the HOT_LISTED most frequent, if more.

    The list only decides which way a window travels, not what becomes of it.
    """
    nothing = docs.sparkSession.sparkContext.broadcast(np.zeros(0, np.uint64))
    counts = _strings(docs, window, nothing).groupBy("bucket").count().where(F.col("count") > HOT)
    listed = [r["bucket"] for r in counts.orderBy(F.desc("count"), "bucket").limit(HOT_LISTED).collect()]
    return np.sort(np.array(listed, np.int64).view(np.uint64))


def _dictionary(docs: DataFrame) -> bytes:
    """A dictionary for the compression of short strings, made from some texts; whichever they are, what is unpacked is the same."""
    texts = [t.encode()[:4096] for (t,) in docs.where("length(text) > 0").select(F.substring("text", 1, 4096).alias("text")).limit(DICTIONARY_TEXTS).collect()]
    return b" ".join(texts)[:DICTIONARY_BYTES]


def _windows_of(string: bytes, window: int) -> Iterator[bytes]:
    blanks = np.flatnonzero(np.frombuffer(string, np.uint8) == 32)
    begin = np.concatenate([[0], blanks + 1])[: len(blanks) + 2 - window]
    end = np.append(blanks, len(string))[window - 1 :]
    return (string[a:b] for a, b in zip(begin.tolist(), end.tolist()))


def _flags(at: set[int], n: int) -> bytes:
    bits = np.zeros(n, np.uint8)
    bits[list(at)] = 1
    return bits.tobytes()


_VERDICT = "digest binary, least long, flags binary, place int, window binary"


def _judged(travelled: DataFrame, window: int, dictionary) -> DataFrame:
    """Verdicts of the buckets, whose rows come sorted by bucket, digest and id.

    A row for a string that several documents hold, with their least id; one for a string that has windows with a smaller owner in
    other strings, with a flag for each window. Buckets that are too large give a row for each of their windows instead.
    """

    def run(batches):
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary.value)).decompress
        out: list[tuple] = []

        def windows(held):
            return ((w, doc, s, i) for s, (_, doc, packed) in enumerate(held) for i, w in enumerate(_windows_of(unpack(packed), window)))

        def end_of_bucket(held):
            if len(held) < 2:
                return
            flagged: dict[int, set[int]] = {}
            sizes: dict[int, int] = {}
            last, owner = None, None
            for w, doc, s, i in sorted(windows(held)):
                sizes[s] = max(sizes.get(s, 0), i + 1)
                if w != last:
                    last, owner = w, doc
                elif doc > owner:
                    flagged.setdefault(s, set()).add(i)
            out.extend((held[s][0], held[s][1], _flags(at, sizes[s]), None, None) for s, at in flagged.items())

        def hand_on(held):
            out.extend((held[s][0], doc, None, i, _digest(w)) for w, doc, s, i in windows(held))

        bucket, digest, least, packed, several = None, None, None, None, False
        held: list[tuple] = []  # the different strings of the bucket: digest, least id, packed
        weight, large = 0, False

        def end_of_string():
            nonlocal held, weight, large
            if digest is None:
                return
            if several:
                out.append((digest, least, None, None, None))
            held.append((digest, least, packed))
            weight += window * zstandard.frame_content_size(packed)
            if large or weight > BUCKET_BYTES:
                large = True
                hand_on(held)
                held = []

        def flush():
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.binary()))], names=["digest", "least", "flags", "place", "window"])

        for batch in batches:
            for b, d, doc, p in zip(*[batch.column(c).to_pylist() for c in ("bucket", "digest", "doc", "packed")]):
                if d != digest or b != bucket:
                    end_of_string()
                    digest, least, packed, several = d, doc, None, False
                if b != bucket:
                    end_of_bucket(held)
                    bucket, held, weight, large = b, [], 0, False
                several = several or doc != least
                packed = packed or p
                if len(out) >= 4096:
                    yield flush()
        end_of_string()
        end_of_bucket(held)
        if out:
            yield flush()

    return map_arrow(travelled, run, _VERDICT)


def _owned_elsewhere(verdicts: DataFrame) -> DataFrame:
    """Verdicts of the windows that large buckets handed on: the least id of each window by its digest."""
    apart = verdicts.where("window is not null")
    owners = apart.groupBy("window").agg(F.min("least").alias("owner"))
    lost = apart.join(owners, "window").where("least > owner").select("digest", "least", "place").distinct()
    return lost.groupBy("digest", "least").agg(F.collect_list("place").alias("places"))


_HELD = "digest binary, doc long, text_key long, start int, windows int"


def _occurrences(docs: DataFrame, window: int, hot) -> DataFrame:
    """Where each string stands: id and key of the text, first word, number of windows."""

    def run(batches):
        for batch in batches:
            ids, keys = batch.column("doc"), batch.column("text_key")
            for piece, base in pieces(batch.column("text"), window, hot.value):
                if len(piece):
                    rows = pa.array(piece.row + base)
                    yield pa.RecordBatch.from_arrays([pa.array([_digest(x) for x in piece.strings()], pa.binary()), ids.take(rows), keys.take(rows), pa.array(piece.start.astype(np.int32)), pa.array(piece.windows.astype(np.int32))], names=["digest", "doc", "text_key", "start", "windows"])

    return map_arrow(docs, run, _HELD)


def repeated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc, text_key, lost: for the documents that lose words, the pieces with repeated windows: first word, windows, and which of them (null: all).

    docs: doc (long), text, text_key.
    """
    spark = docs.sparkSession
    known = docs.where("doc is not null")
    hot = spark.sparkContext.broadcast(hot_minimisers(known.select("doc", "text"), window))
    dictionary = spark.sparkContext.broadcast(_dictionary(known))
    parts = tasks_for(spark, known.agg(F.sum(F.length("text"))).first()[0] or 0, TASK_CHARS)
    travelled = _strings(known.select("doc", "text"), window, hot, dictionary).repartition(parts, "bucket").sortWithinPartitions("bucket", "digest", "doc")
    verdicts = table(_judged(travelled, window, dictionary), "substrings")
    whole = verdicts.where("window is null").select("digest", "least", "flags", F.lit(None).cast("array<int>").alias("places"))
    apart = _owned_elsewhere(verdicts).select("digest", "least", F.lit(None).cast("binary").alias("flags"), "places")
    held = _occurrences(known.select("doc", "text", "text_key"), window, hot)
    hits = held.join(whole.unionByName(apart), "digest").where("doc > least or (doc = least and (flags is not null or places is not null))")
    own = F.col("doc") == F.col("least")
    lost = F.struct("start", "windows", F.when(own, F.col("flags")).alias("flags"), F.when(own, F.col("places")).alias("places"))
    found = hits.groupBy("doc", "text_key").agg(F.collect_set(lost).alias("lost"))
    return found


def _covered(n: int, lost: list[dict], window: int) -> np.ndarray:
    """Which of n words stand in a repeated window."""
    steps = np.zeros(n + 1, np.int64)
    for x in lost:
        if x["flags"] is not None:
            at = np.flatnonzero(np.frombuffer(x["flags"], np.uint8))
        elif x["places"] is not None:
            at = np.array(x["places"], np.int64)
        else:
            at = np.arange(x["windows"])
        np.add.at(steps, x["start"] + at, 1)
        np.add.at(steps, x["start"] + at + window, -1)
    return np.cumsum(steps[:n]) > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with n_words, n_removed and kept_text, the words that stay joined by one blank; text itself goes, columns of these names are replaced."""
    docs = without(docs, "n_words", "n_removed", "kept_text")
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("text_key"), "text", F.struct(*others).alias("others"))
    found = repeated(rows.select("doc", "text_key", "text"), window)

    def pack(batches):
        packer = zstandard.ZstdCompressor(3)
        for batch in batches:
            packed = [packer.compress((x or "").encode()) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc", "text_key", "others")], pa.array(packed, pa.binary())], names=["doc", "text_key", "others", "packed"])

    def remove(batches):
        for batch in batches:
            sizes, removed, texts = [], [], []
            for packed, lost in zip(batch.column("packed").to_pylist(), batch.column("lost").to_pylist()):
                words = zstandard.decompress(packed).split()
                gone = _covered(len(words), lost, window) if lost else None
                sizes.append(len(words))
                removed.append(int(gone.sum()) if lost else 0)
                texts.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if lost else words).decode())
            yield pa.RecordBatch.from_arrays([batch.column("others"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], names=["others", "n_words", "n_removed", "kept_text"])

    kind = rows.schema["others"]
    packed = map_arrow(rows, pack, T.StructType([rows.schema["doc"], rows.schema["text_key"], kind, T.StructField("packed", T.BinaryType())]))
    joined = packed.join(found, ["doc", "text_key"], "left").select("others", "packed", "lost")
    out = map_arrow(joined, remove, T.StructType([kind, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())]))
    return out.select(*[F.col("others")[c].alias(c) for c in others], "n_words", "n_removed", "kept_text")


