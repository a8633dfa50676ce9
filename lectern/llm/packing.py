"""Packing of tokenised documents into fixed-length sequences by non-negative least squares over length patterns.

The plan depends only on the histogram of piece lengths, at most ``CAPACITY``
numbers. Patterns of up to four lengths that (nearly) fill a sequence are
enumerated: for each length, the partners at fixed quantiles of what still fits, and
the greatest that fits last. Their repeat counts are fitted to the histogram by
non-negative least squares and rounded up, the largest first, as far as pieces are left;
only what then remains is packed best-fit decreasing, whole groups of equal sequences
at a time. Pieces find their place by their rank among the pieces of the same length.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import textkit
from lectern.llm.tables import sized, written

CAPACITY = 2048
END_ID = 0
#: Each worker remembers the ids of so many white-space-free chunks of text.
CACHE_CHUNKS = 500_000
#: Patterns kept of each length, and the shares of the tokens at which partners are looked for.
PATTERNS_PER_LENGTH, SHARES = 6, (0.05, 0.15, 0.3, 0.45, 0.6, 0.75, 0.9)
#: Patterns leave at most one part in so many of a sequence empty.
MAX_WASTE = 128
FIT_STEPS = 1500
#: Fitted counts below this are taken for 0.
LEAST_COUNT = 0.05
#: Ranks are counted in this many parts of each length at least, and of about so many rows.
MIN_PARTS, ROWS_PER_PART = 64, 200_000

_PIECES = "doc_id long, piece int, start long, length long, ids binary"


class ChunkIds(dict):
    """Token ids, as little-endian 32-bit bytes, by chunk of text without white space; the tokenizer never joins chunks."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHE_CHUNKS:
            self.clear()
        ids = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        if len(chunk) <= 64:
            self[chunk] = ids
        return ids


#: The tokenizer always cuts between a word and the signs after it; an apostrophe may belong to what follows.
_WORD_AND_SIGNS = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)")


class LatinIds(ChunkIds):
    """Chunks of Latin-1 characters, which normalisation only lower-cases one by one, go straight to the tokenizer's own split and merges."""

    def __init__(self, tokenizer):
        super().__init__(tokenizer)
        self.split, self.merge = tokenizer.pre_tokenizer.pre_tokenize_str, tokenizer.model.tokenize
        #: How the split writes each letter outside ASCII; words of letters stay whole.
        self.letters = {k: "".join(x for x, _ in self.split(chr(k))) for k in range(0xA0, 0x100) if chr(k).isalpha()}

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) > 64 or max(chunk) > "\xff" or "|" in chunk[:-1]:  # the last may hold an added token's string
            return super().__missing__(chunk)
        if len(self) >= CACHE_CHUNKS:
            self.clear()
        low = chunk.lower()
        if low != chunk:
            ids = self[low]
        elif found := _WORD_AND_SIGNS.fullmatch(low):
            ids = self[found[1]] + self[found[2]]
        else:
            parts = [low.translate(self.letters)] if low.isalpha() else [x for x, _ in self.split(low)]
            found = [t.id for x in parts for t in self.merge(x)]
            ids = struct.pack(f"<{len(found)}I", *found)
        self[chunk] = ids
        return ids


def tokenizer_of(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Python counts these as white space, the tokenizer does not.
_ODD_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")


def text_ids(text: str, chunks: ChunkIds) -> bytes:
    """All ids of a text, then the end id."""
    if any(c in text for c in _ODD_SPACE):
        body = np.array(chunks.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    else:
        body = b"".join(map(chunks.__getitem__, text.split()))
    return body + END_ID.to_bytes(4, "little")


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = LatinIds(tokenizer_of(path))
        for batch in batches:
            for rows, _, _ in textkit.slices(batch, "text"):
                out: list[list] = [[] for _ in range(5)]
                for doc, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()):
                    ids = text_ids(text or "", chunks)
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        for x, v in zip(out, (doc, piece, at // 4, len(part) // 4, part)):
                            x.append(v)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids"])

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Documents (doc_id, text) to their pieces (doc_id, piece, start, length, ids): token ids and one end id, cut only beyond ``capacity``.

    ids holds little-endian unsigned 32-bit numbers. A null, empty or blank text is the end id alone. Each row is a document of its own, also with a
    null or repeated doc_id; other columns are ignored."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(tokenizer_path, capacity), _PIECES)


def patterns(histogram: np.ndarray, capacity: int, per_length: int = PATTERNS_PER_LENGTH) -> np.ndarray:
    """Patterns of one to four lengths that occur, those of each first length that fill a sequence most; unused places are 0."""
    have = np.flatnonzero(histogram[: capacity + 1])
    have = have[have > 0]
    if not len(have):
        return np.zeros((0, 4), np.int64)
    at_most = np.zeros(capacity + 1, np.int64)  # the greatest length that occurs up to each size
    at_most[have] = have
    at_most = np.maximum.accumulate(at_most)
    tokens = np.cumsum(histogram[have] * have)
    below = np.r_[0, tokens][np.searchsorted(have, np.arange(capacity + 1), "right")]  # tokens in pieces up to each size

    def partner(room: np.ndarray, share: float) -> np.ndarray:
        """The length below which that share of the tokens lies, of those in pieces that fit; 0 if none does."""
        at = np.searchsorted(tokens, below[room] * share, "right")
        return np.where(below[room] > 0, np.minimum(have[np.minimum(at, len(have) - 1)], at_most[room]), 0)

    zero, found = 0 * have, []
    rest = capacity - have
    found.append((have, zero, zero, zero))
    found.append((have, at_most[rest], zero, zero))
    for share in SHARES:
        second = partner(rest, share)
        left = rest - second
        found.append((have, second, at_most[left], zero))
        for again in SHARES[1::2]:
            third = partner(left, again)
            found.append((have, second, third, at_most[left - third]))
    every = np.stack([np.stack(x, 1) for x in found], 1)  # length, way, place
    waste = capacity - every.sum(2)
    best = np.argsort(waste, axis=1, kind="stable")[:, :per_length]
    rows = np.take_along_axis(every, best[:, :, None], 1).reshape(-1, 4)
    return np.unique(-np.sort(-rows[capacity - rows.sum(1) <= capacity // MAX_WASTE], 1), axis=0)


def fit_counts(rows: np.ndarray, histogram: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram|, A the lengths in each pattern: accelerated projected gradient."""
    if not len(rows):
        return np.zeros(0)
    used = rows > 0
    times = lambda x: np.bincount(rows[used], np.repeat(x, 4).reshape(rows.shape)[used], len(histogram))
    back = lambda r: (r[rows] * used).sum(1)
    v = np.ones(len(rows))
    for _ in range(30):  # the largest eigenvalue of A'A
        v = back(times(v))
        v /= np.linalg.norm(v)
    step = 1 / np.linalg.norm(back(times(v)))
    target = histogram.astype(np.float64)
    x, y, t = np.zeros(len(rows)), np.zeros(len(rows)), 1.0
    for _ in range(steps):
        new = np.maximum(y - step * back(times(y) - target), 0)
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y, x = new + (last - 1) / t * (new - x), new
    return x


def best_fit_decreasing(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Packs counts of lengths, whole groups of equal sequences at a time: (lengths, repeats)."""
    rooms: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]
    for length in np.flatnonzero(histogram)[::-1].tolist():
        left, room = int(histogram[length]), length
        while left:
            while room <= capacity and not rooms[room]:
                room += 1
            if room > capacity:
                many = capacity // length
                for size in [many] * (left >= many) + [left % many] * (left % many > 0):
                    key, n = (length,) * size, left // many if size == many else 1
                    into = rooms[capacity - size * length]
                    into[key] = into.get(key, 0) + n
                break
            key, n = rooms[room].popitem()
            placed = min(n, left)
            if n > placed:
                rooms[room][key] = n - placed
            new, into = (*key, length), rooms[room - length]
            into[new] = into.get(new, 0) + placed
            left -= placed
            room = length
    return [(k, n) for group in rooms for k, n in group.items()]


def fitted(histogram: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Patterns of lengths with their fitted and rounded repeats, and the histogram of what is left."""
    rows, left, out = patterns(histogram, capacity), histogram.astype(np.int64).copy(), []
    counts = np.ceil(fit_counts(rows, histogram) - LEAST_COUNT).astype(np.int64)
    for k in np.lexsort((-counts, -rows[:, 0])).tolist():
        lengths = [x for x in rows[k].tolist() if x]
        n = min([int(counts[k]), *(int(left[x]) // lengths.count(x) for x in set(lengths))])
        if n > 0:
            out.append((tuple(lengths), n))
            for x in lengths:
                left[x] -= n
    return out, left


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with their repeats, which use up the histogram exactly: the fitted ones, then the rest best-fit decreasing."""
    out, left = fitted(histogram, capacity)
    return out + best_fit_decreasing(left, capacity)


class Places:
    """Where the piece of a given length and rank goes."""

    def __init__(self, planned: list[tuple[tuple[int, ...], int]], capacity: int):
        slots: dict[int, list[tuple[int, int, int, list[int]]]] = {}
        used, base = {}, 0
        for lengths, n in planned:
            offsets: dict[int, list[int]] = {}
            at = 0
            for x in lengths:
                offsets.setdefault(x, []).append(at)
                at += x
            for x, places in offsets.items():
                slots.setdefault(x, []).append((used.get(x, 0), base, len(places), places))
                used[x] = used.get(x, 0) + n * len(places)
            base += n
        self.of = {}
        for x, rows in slots.items():
            wide = max(r[2] for r in rows)
            table = np.zeros((len(rows), wide), np.int64)
            for i, r in enumerate(rows):
                table[i, : r[2]] = r[3]
            self.of[x] = (np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), table)

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for x in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == x)
            first, base, times, table = self.of[x]
            row = np.searchsorted(first, ranks[at], "right") - 1
            nth = ranks[at] - first[row]
            sequence[at], offset[at] = base[row] + nth // times[row], table[row, nth % times[row]]
        return sequence, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, any other columns); the pieces of a sequence leave no gaps.

    ``pieces`` is used twice, so give a written table. An empty table gives an empty result. Columns named sequence_id or offset are replaced, all
    others are passed on. At most ``capacity`` counts reach the driver."""
    pieces = pieces.drop("sequence_id", "offset")
    parts = max(MIN_PARTS, pieces.count() // ROWS_PER_PART)
    keyed = pieces.withColumn("_pack_part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    counts = written(keyed.groupBy("length", "_pack_part").agg(F.count("*").alias("_pack_n")), "counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("_pack_n").alias("n")).collect():
        histogram[row["length"]] = row["n"]
    places = Places(plan(histogram, capacity), capacity)
    before = counts.select("length", "_pack_part", (F.sum("_pack_n").over(Window.partitionBy("length").orderBy("_pack_part")) - F.col("_pack_n")).alias("_pack_before"))
    in_part = F.row_number().over(Window.partitionBy("length", "_pack_part").orderBy("doc_id", "piece")) - 1
    ranked = keyed.withColumn("_pack_rank", in_part).join(before, ["length", "_pack_part"]).withColumn("_pack_rank", F.col("_pack_rank") + F.col("_pack_before"))
    names = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.find(batch.column("length").to_numpy(), batch.column("_pack_rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.select(*names, "_pack_rank").mapInArrow(run, schema)


_PLACE = ("offset", "doc_id", "piece", "start", "length")


def _by_sequence(packed: DataFrame) -> DataFrame:
    """sequence_id and its pieces with their ids, in order."""
    return packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct(*_PLACE, "ids"))).alias("p"))


def sequences(packed: DataFrame) -> DataFrame:
    """Packed pieces with ids to one row per sequence: sequence_id, ids, and the pieces in order (offset, doc_id, piece, start, length)."""
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda all_, x: F.concat(all_, x["ids"]))
    return _by_sequence(packed).select("sequence_id", joined.alias("ids"), F.transform("p", lambda x: F.struct(*[x[c].alias(c) for c in _PLACE])).alias("pieces"))


def _small(ids: bytes) -> bytes:
    """Ids in two bytes each where they fit, compressed; the first byte tells how wide they are."""
    numbers = np.frombuffer(ids, "<u4")
    wide = 2 if not len(numbers) or numbers.max() < 1 << 16 else 4
    return bytes([wide]) + struct.pack("<I", wide * len(numbers)) + pa.compress(numbers.astype(f"<u{wide}"), codec="zstd", asbytes=True)


def _large(small: bytes) -> bytes:
    size = struct.unpack_from("<I", small, 1)[0]
    numbers = np.frombuffer(pa.decompress(small[5:], size, codec="zstd", asbytes=True), f"<u{small[0]}") if size else np.zeros(0)
    return numbers.astype("<u4").tobytes()


def _small_pieces(path: str, capacity: int):
    pieces = _pieces(path, capacity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids = pa.array([_small(x) for x in batch.column("ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], batch.schema.names)

    return run


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, 500):
            rows = batch.slice(first, 500)
            lists = rows.column("p")
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            parts = lists.flatten()
            ids = [_large(x) for x in parts.field("ids").to_pylist()]
            whole = pa.array([b"".join(ids[a:b]) for a, b in zip(ends.tolist(), ends[1:].tolist())], pa.binary())
            places = pa.StructArray.from_arrays([parts.field(c) for c in _PLACE], list(_PLACE))
            yield pa.RecordBatch.from_arrays([rows.column("sequence_id"), whole, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), places)], ["sequence_id", "ids", "pieces"])


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Documents (doc_id, text) to packed ``sequences``. Only lengths and keys are sorted and ranked; ids move once, compressed, to their sequence.

    Beyond the bound for broadcasts they move once before, to the places of their pieces."""
    small = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_small_pieces(tokenizer_path, capacity), _PIECES)
    pieces = written(small.withColumn("key", F.monotonically_increasing_id()), "pieces")
    placed = pack(pieces.drop("ids"), capacity)
    grouped = _by_sequence(pieces.select("key", "ids").join(sized(placed), "key"))
    return grouped.mapInArrow(_assembled, "sequence_id long, ids binary, pieces array<struct<offset:bigint,doc_id:bigint,piece:int,start:bigint,length:bigint>>")


def placements(packed_sequences: DataFrame) -> DataFrame:
    """The pieces of ``sequences``, read back from them: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    each = packed_sequences.select("sequence_id", "ids", F.explode("pieces").alias("p"))
    ids = F.substring("ids", (4 * F.col("p.offset") + 1).cast("int"), (4 * F.col("p.length")).cast("int"))
    return each.select("p.doc_id", "p.piece", "p.start", "p.length", F.crc32(ids).alias("ids_crc32"), "sequence_id", "p.offset")
