"""MinHash near-duplicate detection over word shingles.

One-permutation hashing: a document's distinct shingle hashes fall into ``BINS``
bins by their high bits and each bin keeps its least value; empty bins borrow
from full ones by a fixed random probe sequence (optimal densification). Bands of
``ROWS`` bins are bucket keys. In a bucket every member is paired with one centre
(a star), so pairs grow with members, not with their square. Each pair is
confirmed on the full shingle sets.

A star can miss a link between two members that are both unlike the centre. So
buckets whose members are not all in one component after the stars are gone over
again in blocks of at most ``BLOCK`` rows: members are compared inside the tasks,
and only the edges of a spanning forest leave them. The members of a bucket of more than ``BLOCK``
are dealt out anew before, to buckets by the rarest shingles of their texts: two sets
that are alike share one of the few rarest of each (prefix filtering; Chaudhuri et al., 2006), while a template
that thousands of unlike texts have is among the frequent ones and brings none together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import textkit
from lectern.llm.components import components
from lectern.llm.tables import sized, written

SHINGLE_WORDS = 5
PERCENT = 85
#: 25 bands of 5 bins: a pair at similarity 0.85 shares no band with probability 4e-7.
BANDS, ROWS = 25, 5
BINS = BANDS * ROWS
#: Rows and shingles of each side of a comparison block on average, and followers of one copy of a centre.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
#: Counters of shingles, by which the rarest of a text are told.
SLOTS = 1 << 18

_PROBES = np.random.default_rng(5).integers(0, BINS, (4096, BINS))
_SIGNATURE = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, n = textkit.shingle_hashes(*textkit.word_hashes(data, offsets), SHINGLE_WORDS)
    ends = np.cumsum(n)
    return [np.unique(hashes[e - k : e]) for e, k in zip(ends.tolist(), n.tolist())]


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """Band keys of each non-empty set, one row per set."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bins = ((flat >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
    slot = owner * BINS + bins.astype(np.int64)
    first = np.r_[True, slot[1:] != slot[:-1]]
    least = np.zeros(len(sets) * BINS, np.uint64)
    full = np.zeros(len(sets) * BINS, bool)
    least[slot[first]], full[slot[first]] = flat[first], True
    least, full = least.reshape(-1, BINS), full.reshape(-1, BINS)
    filled, open_ = least.copy(), ~full
    for probe in _PROBES:
        rows = np.flatnonzero(open_.any(1))
        if not len(rows):
            break
        take = open_[rows] & full[rows][:, probe]
        filled[rows] = np.where(take, least[rows][:, probe], filled[rows])
        open_[rows] &= ~take
    for row in np.flatnonzero(open_.any(1)):  # no probe met the few full bins
        filled[row, open_[row]] = least[row, full[row]][0]
    keys = np.zeros((len(sets), BANDS), np.uint64)
    for k in range(ROWS):
        keys = textkit.mix64(keys ^ filled[:, k::ROWS], k + 1)
    return textkit.mix64(keys + np.arange(BANDS, dtype=np.uint64), 99)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in textkit.slices(batch, "text"):
            sets = shingle_sets(data, offsets)
            some = [s for s in sets if len(s)]
            has = np.array([len(s) > 0 for s in sets], bool)
            bands, sums = np.zeros((len(sets), BANDS), np.uint64), np.zeros((2, len(sets)), np.uint64)
            if some:
                bands[has] = band_keys(some)
                flat, at = np.concatenate(some), np.cumsum([0] + [len(s) for s in some[:-1]])
                for k in (0, 1):
                    sums[k, has] = np.add.reduceat(textkit.mix64(flat, 20 + k), at)
            lists = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * BANDS, pa.array(bands.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), lists],
                ["doc_id", "n_shingles", "set_a", "set_b", "bands"],
            )


def similar(a: int, b: int, common: int, percent: int = PERCENT) -> bool:
    return 100 * common >= percent * (a + b - common)


def _confirm_stars(percent: int):
    """Rows come sorted by (centre, salt), the centre's own text first; a row that is alike gives a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, centre_set = None, None
        for batch in batches:
            for rows, data, offsets in textkit.slices(batch, "text"):
                out: list[tuple[int, int]] = []
                d = rows.to_pydict()
                for centre, salt, leads, doc, own in zip(d["centre"], d["salt"], d["leads"], d["doc_id"], shingle_sets(data, offsets)):
                    if leads:
                        key, centre_set = (centre, salt), own
                    elif key == (centre, salt) and similar(len(own), len(centre_set), len(np.intersect1d(own, centre_set, True)), percent):
                        out.append((centre, doc))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, through products of 0/1 matrices over the shared hashes only."""
    n = len(sets)
    counts = np.zeros((n, n), np.float32)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    column = np.cumsum(np.r_[False, flat[1:] != flat[:-1]])
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    for low in range(0, int(column.max()) + 1 if len(column) else 0, 4096):
        here = slice(*np.searchsorted(column, [low, low + 4096]))
        block = np.zeros((n, 4096), np.float32)
        block[owner[here], column[here] - low] = 1
        counts += block @ block.T
    return counts.astype(np.int64)


def _confirm_blocks(percent: int):
    """Compares the members of one block and returns a spanning forest of the links between components."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        data, offsets = textkit.raw(textkit.texts_of(table.column("text")))
        sets = shingle_sets(data, offsets)
        docs, parent = table.column("doc_id").to_pylist(), table.column("component").to_pylist()
        sizes = np.array([len(s) for s in sets])
        common = common_counts(sets)
        alike = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
        root = {c: c for c in parent}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for i, j in zip(*np.nonzero(np.triu(alike, 1))):
            x, y = find(parent[i]), find(parent[j])
            if x != y:
                root[x] = y
                out.append((docs[i], docs[j]))
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return run


def _split(doc: str, parts: Column) -> Column:
    return F.pmod(F.xxhash64(doc), parts)


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Documents (doc_id, text) to doc_id, n_shingles, component_id (least doc_id reachable) and kept (doc_id = component_id).

    Words are split at ASCII white space and A-Z lower-cased. A text of one to four words is one shingle; a null, empty or blank text
    has none and is linked with nothing. Rows of one doc_id are one document. A row without doc_id is linked with nothing: its
    component_id is null and kept is true. Other columns are ignored."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    signed = written(docs.mapInArrow(_signatures, _SIGNATURE), "signatures")
    # equal sets are one class, known by its least document
    classes = written(
        signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")),
        "classes",
    )
    members = classes.select(F.explode("bands").alias("band"), "rep", "n_shingles")
    buckets = members.groupBy("band").agg(F.count("*").alias("n"), F.min(F.struct("rep", "n_shingles")).alias("c")).where("n > 1")
    buckets = written(buckets, "buckets")  # a table, so that a join can split the rows of a large bucket
    mates = written(
        members.join(buckets, "band").select("band", "rep", "n_shingles", F.col("c.rep").alias("centre"), F.col("c.n_shingles").alias("centre_n")), "mates"
    )
    edges = (
        mates.where(f"rep <> centre AND 100 * least(n_shingles, centre_n) >= {percent} * greatest(n_shingles, centre_n)")
        .select("centre", "rep")
        .distinct()
    )
    edges = written(edges, "stars")
    texts = written(docs.join(sized(mates.select(F.col("rep").alias("doc_id")).distinct()), "doc_id", "left_semi"), "candidates")
    # a centre with many followers is dealt to several tasks; only these few are joined, so that no edges meet by centre before
    busy = edges.groupBy("centre").agg(F.ceil(F.count("*") / BLOCK).alias("parts")).where("parts > 1")
    salted = edges.join(sized(busy), "centre", "left").select("centre", _split("rep", F.coalesce("parts", F.lit(1))).alias("salt"), "rep")
    wanted = salted.select(F.col("rep").alias("doc_id"), "centre", "salt", F.lit(False).alias("leads")).unionAll(
        salted.select(F.col("centre").alias("doc_id"), "centre", "salt", F.lit(True).alias("leads")).distinct()
    )
    links = (
        texts.join(wanted, "doc_id")
        .repartition("centre", "salt")
        .sortWithinPartitions("centre", "salt", F.desc("leads"))
        .mapInArrow(_confirm_stars(percent), "a long, b long")
    )
    first = written(components(links), "components")
    more = _block_links(mates, texts, first, percent)
    renamed = first.select("node", "component")
    second = components(
        more.join(renamed.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
        .join(renamed.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    )
    merged = second.select(F.col("node").alias("component"), F.col("component").alias("merged"))
    # a class that only the second round has linked is not in the first's table
    labels = (
        classes.select("set_a", "set_b", "n_shingles", "rep")
        .join(first.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .withColumn("component", F.coalesce("component", "rep"))
        .join(merged, "component", "left")
        .select("set_a", "set_b", "n_shingles", F.coalesce("merged", "component").alias("component_id"))
    )
    return (
        signed.select("doc_id", "n_shingles", "set_a", "set_b")
        .join(labels, ["set_a", "set_b", "n_shingles"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def _token_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of the texts have a shingle in each slot."""
    counts = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for _, data, offsets in textkit.slices(batch, "text"):
            for own in shingle_sets(data, offsets):
                np.add.at(counts, (own % np.uint64(SLOTS)).astype(np.int64), 1)
    has = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), pa.array(counts[has])], ["slot", "n"])


def prefix(own: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The rarest shingles of a set, so many that it shares one of them with the rarest of every set that is alike. Any order does that is the same for all sets."""
    keep = len(own) - -(-percent * len(own) // 100) + 1
    return own[np.lexsort((own, counts[(own % np.uint64(SLOTS)).astype(np.int64)]))[:keep]]


def _prefixes(counts, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in textkit.slices(batch, "text"):
                parts = [prefix(own, counts.value, percent) for own in shingle_sets(data, offsets)]
                row = pa.array(np.repeat(np.arange(len(parts)), [len(x) for x in parts]))
                kept = [rows.column(c).take(row) for c in ("doc_id", "n_shingles", "component")]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64)), *kept], ["band", "rep", "n_shingles", "component"])

    return run


def _rare_buckets(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Members of large buckets (rep, n_shingles, component) in buckets by the rarest shingles of their texts: what many share, as a template, brings none together."""
    held = texts.join(sized(members.withColumnRenamed("rep", "doc_id")), "doc_id")
    slots = held.select("text").mapInArrow(_token_slots, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # SLOTS rows at most
    counts = np.zeros(SLOTS, np.int32)
    counts[slots["slot"].to_numpy(np.int64)] = np.minimum(slots["n"], 2**31 - 1)
    tokens = written(held.select("doc_id", "n_shingles", "component", "text").mapInArrow(_prefixes(members.sparkSession.sparkContext.broadcast(counts), percent), "band long, rep long, n_shingles long, component long"), "rare")
    torn = tokens.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.mode("component").alias("main")).where("low <> high").select("band", "main")
    return written(tokens.join(sized(torn), "band").select("band", "rep", "n_shingles", "component", (F.col("component") == F.col("main")).alias("is_main")), "torn")


def _block_links(mates: DataFrame, texts: DataFrame, first: DataFrame, percent: int) -> DataFrame:
    """Links between members of a bucket that the stars left in different components."""
    placed = mates.join(first.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    centre = F.max(F.when(F.col("rep") == F.col("centre"), F.col("component")))
    torn = placed.groupBy("band").agg(centre.alias("main"), F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low <> high")
    torn = placed.join(sized(torn.select("band", "main", "n")), "band").select("band", "rep", "n_shingles", "component", (F.col("component") == F.col("main")).alias("is_main"), "n")
    torn = written(torn, "torn")
    large = torn.where(F.col("n") > BLOCK).select("rep", "n_shingles", "component").distinct()
    # the star has compared all of a small bucket with its centre
    meetings = _meetings(torn.where(F.col("n") <= BLOCK).drop("n"), 2)
    if not large.isEmpty():
        meetings = meetings.unionByName(_meetings(_rare_buckets(written(large, "large"), texts, percent), 1))
    return meetings.join(texts, "doc_id").groupBy("band", "kind", "i", "j").applyInArrow(_confirm_blocks(percent), "a long, b long").distinct()


def _meetings(torn: DataFrame, least_mains: int) -> DataFrame:
    """Members of torn buckets (band, rep, n_shingles, component, is_main) in blocks that are compared: band, doc_id, component, kind, i, j.

    The main component meets the others if it has ``least_mains`` members; the others meet each other if they are in several components."""

    def blocks_of(side: Column) -> Column:
        return F.ceil(F.greatest(F.count_if(side) / BLOCK, F.coalesce(F.sum(F.when(side, F.col("n_shingles"))), F.lit(0)) / BLOCK_SHINGLES)).cast("int")

    other = F.when(~F.col("is_main"), F.col("component"))
    asked = torn.groupBy("band").agg(
        blocks_of(F.col("is_main")).alias("mains"),
        blocks_of(~F.col("is_main")).alias("others"),
        (F.count_if("is_main") >= least_mains).alias("with_mains"),
        (F.min(other) < F.max(other)).alias("among_others"),
    )
    parts = sized(asked.where("with_mains OR among_others"))
    # rows of the main component meet only the others; the others also meet each other
    own = _split("rep", F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).cast("int")
    up_to = lambda n, wanted: F.when(F.col(wanted), F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    meets = F.when(F.col("is_main"), F.transform(up_to(F.col("others"), "with_mains"), lambda j: pair("m", F.col("own"), j))).otherwise(
        F.concat(
            F.transform(up_to(F.col("mains"), "with_mains"), lambda i: pair("m", i, F.col("own"))),
            F.transform(up_to(F.col("others"), "among_others"), lambda j: pair("o", F.least(F.col("own"), j), F.greatest(F.col("own"), j))),
        )
    )
    return torn.join(parts, "band").withColumn("own", own).select("band", F.col("rep").alias("doc_id"), "component", F.explode(meets).alias("meet")).select("band", "doc_id", "component", "meet.*")


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents, all columns, without those that ``near_duplicates`` does not keep, and of several rows of one doc_id the one with the least text,
    a null text first. Rows without doc_id stay."""
    docs = docs.join(sized(near_duplicates(docs, percent).where("NOT kept").select("doc_id").distinct()), "doc_id", "left_anti").select(docs.columns)
    twice = sized(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("_rows")).where("_rows > 1").select("doc_id"))
    order = Window.partitionBy("doc_id").orderBy("text", *[F.col(f"`{f.name}`") for f in docs.schema.fields if f.dataType.simpleString() in ("string", "bigint", "int", "double")])
    first = docs.join(twice, "doc_id", "left_semi").withColumn("_place_of_row", F.row_number().over(order)).where("_place_of_row = 1")
    return docs.join(twice, "doc_id", "left_anti").select(docs.columns).unionAll(first.select(docs.columns))
