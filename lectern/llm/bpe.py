"""Byte-level BPE encoding and decoding through a table of distinct words.

Merges never cross a word, so Spark splits the texts into words with the tokenizer's
own pattern, counts the distinct ones and encodes each of them once. The ids then go
back to the places of the words, in order. Words are joined by place in two ways, which give the
same: the most frequent ones, at most ``TABLE_WORDS`` and ``TABLE_BYTES``, are sent to
all executors and looked up for a whole batch of words at a time; the occurrences of
the rest, few each, are shuffled to the table by word and back to their text by its
hashes and their place. Decoding joins each id with its piece of bytes; that table has
the size of the vocabulary.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import textkit
from lectern.llm.tables import written

#: Bounds of the table of frequent words that all executors hold.
TABLE_WORDS, TABLE_BYTES = 1_000_000, 32 << 20
#: Ids are put together for about so many words, and pieces for so many ids, at a time.
SLICE_WORDS = 1 << 16
#: Rows of a batch that are filled or encoded at a time.
SLICE_ROWS = 500
#: Ids of rare words are sent to all executors up to so many texts and bytes; beyond that texts and ids are shuffled to each other.
FILL_TEXTS, FILL_BYTES = 20_000, 4 << 20
#: Words are counted in slices of about so many bytes before the counts are summed.
COUNT_BYTES = 2 << 20

#: White space as the tokenizer counts it (fixed values).
_SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The split of byte-level tokenizers, with that white space.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}++| ?\p{{N}}++| ?[^{_SPACE}\p{{L}}\p{{N}}]++|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def tokenizer_of(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def added_strings(path: str) -> list[str]:
    """Strings that the tokenizer takes for one token wherever they stand."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("added tokens that take white space or look at their neighbours are not supported")
    return [t["content"] for t in added]


def _literal(s: str) -> str:
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):X}}}" for c in s)


#: Stands between the words of a text on their way to Python workers.
_BETWEEN = "\x00"


def is_odd(text: Column) -> Column:
    """Whether a text has characters that this JVM's Unicode tables do not know, which the tokenizer's may, or the one that stands between words."""
    # all of Latin below U+0300 is known
    return F.when(text.rlike(r"[\x00\x{300}-\x{10FFFF}]"), text.rlike(r"[\p{Cn}\x00]")).otherwise(F.lit(False))


def split_words(text: Column, added: list[str]) -> Column:
    """The words of a text in order; joined, they are the text. An added string is a word, and words do not cross it."""
    plain = lambda t: F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0))
    words = plain(text)
    for string in added:
        parts = F.split(text, _literal(string), -1)
        apart = F.flatten(F.transform(parts, lambda p, k: F.when(k == 0, plain(p)).otherwise(F.concat(F.array(F.lit(string)), plain(p)))))  # noqa: B023
        words = F.when(F.contains(text, F.lit(string)), apart).otherwise(words)
    return words


def byte_of_char() -> dict[str, int]:
    """The characters in which byte-level vocabularies write bytes: printable Latin-1 ones stand for themselves, the others for those from U+0100 on, in order."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word, a span of bytes, by which it is known: equal in both only if the words are, up to a chance of 2^-128."""
    first, second = (textkit.span_hashes(data, starts, ends, k) for k in (0, 1))
    length = (ends - starts).astype(np.uint64)  # zero bytes do not count in a span's hash
    return textkit.mix64(first, 3) ^ textkit.mix64(length, 4), textkit.mix64(second, 5) + textkit.mix64(length, 6)


def _encoded_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, kind, added = tokenizer_of(path), _kind(tokenizer_of(path)), set(added_strings(path))
        chars = {b: c for c, b in byte_of_char().items()}
        merge = tokenizer.model.tokenize

        def ids_of(word: str) -> bytes:
            # a word needs no further split, so its bytes go straight to the merges
            ids = [tokenizer.token_to_id(word)] if word in added else [t.id for t in merge(word.encode().decode("latin-1").translate(chars))]
            return np.array(ids, kind).tobytes()

        for batch in batches:
            for first in range(0, batch.num_rows, SLICE_ROWS):
                rows = batch.slice(first, SLICE_ROWS)
                column = rows.column("word")
                ids = pa.array([ids_of(w) for w in column.to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([column, rows.column("n"), ids], ["word", "n", "ids"])

    return run


def _kind(tokenizer) -> str:
    """Ids move in two bytes each where the vocabulary allows it."""
    return "<u2" if tokenizer.get_vocab_size(True) <= 1 << 16 else "<u4"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each slice of texts, and how often they stand there."""
    for batch in batches:
        for _, data, offsets in textkit.slices(batch, "joined", COUNT_BYTES):
            starts, ends, _ = _words_of(data, offsets, np.zeros(len(offsets) - 1, bool))
            if not len(starts):
                continue
            a, b = word_hashes(data, starts, ends)
            code = pa.array(a).dictionary_encode().indices.to_numpy()
            n = np.bincount(code)
            first = np.empty(len(n), np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            odd = np.flatnonzero(b != b[first][code])  # other words of the same first hash
            np.subtract.at(n, code[odd], 1)
            at, n = np.r_[first, odd], np.r_[n, np.ones(len(odd), np.int64)]
            lengths = (ends - starts)[at]
            words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.r_[0, np.cumsum(lengths)]), pa.py_buffer(_gathered(data, starts[at], lengths).tobytes()))
            yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(n)], ["word", "n"])


def word_table(texts: DataFrame, path: str) -> DataFrame:
    """Texts (joined) to their distinct words, the number of occurrences, and the ids as bytes: word, n, ids."""
    counts = texts.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return written(counts.mapInArrow(_encoded_words(path), "word string, n long, ids binary"), "words")


def _level(n: Column) -> Column:
    """Counts of 256 and more are taken together in steps of an eighth of a power of two, so that there are few levels."""
    return F.when(n < 256, n).otherwise(256 + F.floor(8 * F.log2(n / 256)))


class Lookup:
    """The frequent words by their hashes, and where their ids lie in one array."""

    def __init__(self, table: pa.Table, kind: str):
        hashes = [(np.zeros(0, np.uint64),) * 2]
        for words in table.column("word").chunks:
            data, offsets = textkit.raw(textkit.texts_of(words))
            hashes.append(word_hashes(data, offsets[:-1], offsets[1:]))
        keys, more = (np.concatenate(x) for x in zip(*hashes))
        order = np.argsort(keys)
        ids = table.column("ids").to_pylist()
        ids = [ids[k] for k in order.tolist()]
        self.keys, self.more, self.kind = keys[order], more[order], kind
        self.pool = np.frombuffer(b"".join(ids), kind)
        self.lengths = np.array([len(x) // np.dtype(kind).itemsize for x in ids], np.int32)
        self.starts = (np.cumsum(self.lengths) - self.lengths).astype(np.int32)
        # about one key for each value of the leading bits
        self.bits = np.uint64(64 - max(1, len(keys).bit_length()))
        self.first = np.searchsorted(self.keys >> self.bits, np.arange((1 << int(64 - self.bits)) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place of each word in the table, or -1."""
        a, b = word_hashes(data, starts, ends)
        lead = (a >> self.bits).astype(np.int64)
        place, end, found = self.first[lead], self.first[lead + 1], np.full(len(a), -1, np.int32)
        open_ = np.flatnonzero(place < end)
        while len(open_):
            at = place[open_]
            hit = (self.keys[at] == a[open_]) & (self.more[at] == b[open_])
            found[open_[hit]] = at[hit]
            open_ = open_[~hit]
            place[open_] += 1
            open_ = open_[place[open_] < end[open_]]
        return found


def _gathered(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ranges of the pool end to end."""
    shift = starts - (np.cumsum(lengths) - lengths)
    return pool[np.repeat(shift, lengths) + np.arange(int(lengths.sum()))]


def _flat(column: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """All items of a column of lists without nulls, and len + 1 offsets into them."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]


_ZSTD = pa.Codec("zstd", compression_level=3)


def _small(data: bytes) -> bytes:
    """Compressed, with the length in front."""
    return struct.pack("<I", len(data)) + (_ZSTD.compress(data, asbytes=True) if data else b"")


def _whole(small: bytes) -> bytes:
    size = struct.unpack_from("<I", small)[0]
    return _ZSTD.decompress(small[4:], size, asbytes=True) if size else b""


def _row_slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last
        first = last


def _words_of(data: np.ndarray, offsets: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of joined texts, and len + 1 offsets into them. An odd text is taken for one word."""
    cut = data == 0
    for row in np.flatnonzero(odd):
        cut[offsets[row] : offsets[row + 1]] = False
    some = np.flatnonzero(np.diff(offsets) > 0)
    begins = np.zeros(len(data) + 1, bool)
    begins[1:] = cut
    begins[offsets[some]] = True
    stops = np.zeros(len(data) + 1, bool)
    stops[:-1] = cut
    stops[offsets[some + 1]] = True
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops), np.searchsorted(starts, offsets)


def _rare(lookup):
    """Each text's words that are not in the table of frequent ones, numbered in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in textkit.slices(batch, "joined"):
                starts, ends, here = _words_of(data, offsets, np.zeros(len(offsets) - 1, bool))
                at = np.flatnonzero(lookup.value.find(data, starts, ends) < 0)
                row = np.searchsorted(here, at, "right") - 1
                place = np.arange(len(at)) - np.searchsorted(row, row)
                keys = [rows.column(k).take(pa.array(row)) for k in ("key_a", "key_b")]
                words = pa.array([data[a:b].tobytes().decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())], pa.string())
                yield pa.RecordBatch.from_arrays([*keys, pa.array(place, pa.int32()), words], ["key_a", "key_b", "place", "word"])

    return run


def _partial(lookup, path: str):
    """Ids of the frequent words end to end, and at which of them each other word stands. Odd texts are encoded whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, tokenizer = lookup.value, None
        for batch in batches:
            for rows, data, offsets in textkit.slices(batch, "joined"):
                odd = rows.column("odd").to_numpy(zero_copy_only=False)
                begin, end, here = _words_of(data, offsets, odd)
                at = table.find(data, begin, end)
                pool, known = table.pool, at >= 0
                starts, lengths = (np.where(known, x[np.maximum(at, 0)], 0).astype(np.int64) if len(x) else np.zeros(len(at), np.int64) for x in (table.starts, table.lengths))
                for row in np.flatnonzero(odd):
                    tokenizer = tokenizer or tokenizer_of(path)
                    k = here[row]
                    ids = np.array(tokenizer.encode(data[begin[k] : end[k]].tobytes().decode(), add_special_tokens=False).ids, table.kind)
                    starts[k], lengths[k], known[k] = len(pool), len(ids), True
                    pool = np.concatenate([pool, ids])
                ends = np.r_[0, np.cumsum(lengths)]
                ids = _gathered(pool, starts, lengths)
                size, tokens = ids.itemsize, ends[here]
                gaps = np.flatnonzero(~known)
                per_row = np.searchsorted(gaps, here)
                places = ends[gaps] - np.repeat(tokens[:-1], np.diff(per_row))
                ids, at = ids.tobytes(), (tokens * size).tolist()
                binary = pa.array([_small(ids[a:b]) for a, b in zip(at, at[1:])], pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(per_row, pa.int32()), pa.array(places, pa.int32()))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("key_a"), rows.column("key_b"), binary, lists], ["doc_id", "key_a", "key_b", "ids", "gaps"])

    return run


def _filled(kind: str):
    """Puts the ids of the other words where they belong, and turns bytes to numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.dtype(kind).itemsize
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(start, SLICE_ROWS)
                fills = batch.column("fills")
                gaps, at = _flat(batch.column("gaps"))
                gaps, out = gaps.to_numpy() * size, []
                for row, ids in enumerate(map(_whole, batch.column("ids").to_pylist())):
                    if at[row] < at[row + 1]:
                        parts, last = [], 0
                        for gap, fill in zip(gaps[at[row] : at[row + 1]].tolist(), fills[row].as_py(), strict=True):
                            parts += (ids[last:gap], fill)
                            last = gap
                        ids = b"".join([*parts, ids[last:]])
                    out.append(ids)
                ends = np.cumsum([0, *(len(x) // size for x in out)])
                for first, last in _row_slices(ends, SLICE_WORDS):
                    flat = np.frombuffer(b"".join(out[first:last]), kind).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends[first : last + 1] - ends[first], pa.int32()), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), lists], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, path: str, table_words: int = TABLE_WORDS, table_bytes: int = TABLE_BYTES, fill_texts: int = FILL_TEXTS) -> DataFrame:
    """Documents (doc_id, text) to doc_id and ids, array<int>: those of the tokenizer file at ``path`` without the special tokens it adds around a text.

    The file is read on all machines; it holds a byte-level BPE. A null or empty text has no ids. Each row is a text of its own, also with a null or
    repeated doc_id; equal texts have equal ids. An empty table stays empty. Other columns are ignored, whatever their names. A text with characters
    of a later Unicode version than the JVM's is encoded whole where it stands, as only the tokenizer can split it."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    return _in_parts(docs, path, table_words, table_bytes, fill_texts).mapInArrow(_filled(_kind(tokenizer_of(path))), f"doc_id {doc_type}, ids array<int>")


def _in_parts(docs: DataFrame, path: str, table_words: int, table_bytes: int, fill_texts: int) -> DataFrame:
    """doc_id, the ids of frequent words as bytes, where each rare word stands among them (gaps), and the ids of those (fills)."""
    added, kind = added_strings(path), _kind(tokenizer_of(path))
    spark, doc_type = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce("text", F.lit(""))
    odd = is_odd(text)
    split = docs.select("doc_id", text.alias("text"), odd.alias("odd"))
    in_order = F.array_join(split_words(F.col("text"), added), _BETWEEN)
    table = word_table(split.where("NOT odd").select(in_order.alias("joined")), path)
    levels = table.groupBy(_level(F.col("n")).alias("level")).agg(F.count("*").alias("words"), F.sum(F.octet_length("word") + F.octet_length("ids") + 16).alias("bytes")).collect()
    least, words, size = None, 0, 0
    for row in sorted(levels, key=lambda r: -r["level"]):
        words, size = words + row["words"], size + row["bytes"]
        if words > table_words or size > table_bytes:
            break
        least = row["level"]
    frequent = F.lit(False) if least is None else _level(F.col("n")) >= least
    lookup = spark.sparkContext.broadcast(Lookup(table.where(frequent).select("word", "ids").toArrow(), kind))
    # a text is known by two hashes; only texts with rare words, which have few copies, are joined by them
    joined = F.when(F.col("odd"), F.col("text")).otherwise(in_order).alias("joined")
    keyed = split.select("doc_id", "odd", joined, F.xxhash64("text").alias("key_a"), F.xxhash64(F.lit(1), "text").alias("key_b"))
    partial = keyed.mapInArrow(_partial(lookup, path), f"doc_id {doc_type}, key_a long, key_b long, ids binary, gaps array<int>")
    if len(levels) and least != min(r["level"] for r in levels):
        rare = keyed.where("NOT odd").select("key_a", "key_b", "joined").mapInArrow(_rare(lookup), "key_a long, key_b long, place int, word string")
        found = rare.join(table.where(~frequent).select("word", "ids"), "word").groupBy("key_a", "key_b").agg(F.array_sort(F.collect_set(F.struct("place", "ids"))).alias("found"))
        # a table, so that the join can split what it has to
        fills = written(found.select("key_a", "key_b", F.size("found").alias("n_gaps"), F.transform("found", lambda x: x["ids"]).alias("fills")), "fills")
        size = fills.agg(F.count("*").alias("n"), F.sum(F.aggregate("fills", F.lit(0), lambda a, x: a + 16 + F.octet_length(x))).alias("bytes")).first()
        if size["n"] <= fill_texts and (size["bytes"] or 0) <= FILL_BYTES:
            fills = F.broadcast(fills)
        # texts without rare words are dealt out by document, as there may be many copies of one
        n_gaps = F.size("gaps")
        dealt = partial.withColumns({"n_gaps": n_gaps, "key_a": F.when(n_gaps > 0, F.col("key_a")).otherwise(F.xxhash64("doc_id", "ids"))})
        partial = dealt.join(fills, ["key_a", "key_b", "n_gaps"], "left").select("doc_id", "ids", "gaps", "fills")
    else:
        partial = partial.select("doc_id", "ids", "gaps", F.lit(None).cast("array<binary>").alias("fills"))
    return partial


def pieces_of(path: str) -> dict[int, bytes]:
    """The bytes of every id, added tokens included. A token with other characters stands for its own text."""
    known = byte_of_char()
    return {i: bytes(known[c] for c in t) if all(c in known for c in t) else t.encode() for t, i in tokenizer_of(path).get_vocab(True).items()}


def _piece_table(spark: SparkSession, path: str):
    """All pieces end to end, and where each id's lies; the last entry is for numbers that are no id."""
    pieces = pieces_of(path)
    by_id = [pieces.get(i, b"") for i in range(max(pieces) + 1)] + [b""]
    lengths = np.array([len(x) for x in by_id], np.int64)
    return spark.sparkContext.broadcast((np.frombuffer(b"".join(by_id), np.uint8), np.cumsum(lengths) - lengths, lengths))


def _decoded(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, starts, lengths = table.value
        for batch in batches:
            column = batch.column("ids")
            ids, offsets = _flat(column.fill_null([]) if column.null_count else column)
            ids = ids.fill_null(-1).to_numpy().astype(np.int64)
            ids = np.where((ids >= 0) & (ids < len(starts)), ids, len(starts) - 1)
            for first, last in _row_slices(offsets, SLICE_WORDS):
                here = ids[offsets[first] : offsets[last]]
                data, ends = _gathered(pool, starts[here], lengths[here]).tobytes(), np.r_[0, np.cumsum(lengths[here])][offsets[first : last + 1] - offsets[first]].tolist()
                texts = pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])], pa.string())
                rows = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*rows.columns, texts], [*rows.schema.names, "text"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds text to rows with ids, array<int>: the pieces of the ids, special tokens included, joined and read as UTF-8; what is not UTF-8 becomes U+FFFD.

    Null and empty ids give an empty text, numbers that are no id nothing. A column named text is replaced, all others are passed on."""
    encoded = encoded.drop("text")
    table = _piece_table(encoded.sparkSession, path)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields) + ", text string"
    return encoded.mapInArrow(_decoded(table), schema)


def round_trip(docs: DataFrame, path: str, table_words: int = TABLE_WORDS, table_bytes: int = TABLE_BYTES, fill_texts: int = FILL_TEXTS) -> DataFrame:
    """doc_id, ids and text as ``decode(encode(docs))`` gives them, in one pass of Python workers."""
    fill, read = _filled(_kind(tokenizer_of(path))), _decoded(_piece_table(docs.sparkSession, path))
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    return _in_parts(docs, path, table_words, table_bytes, fill_texts).mapInArrow(lambda batches: read(fill(batches)), f"doc_id {doc_type}, ids array<int>, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """What a round trip gives for documents (doc_id, text): doc_id, n_tokens, and SHA-256 of the ids, as decimals joined by commas, and of the decoded text."""
    both = round_trip(docs, path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
