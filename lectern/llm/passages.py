"""Near-duplicate passages by compact windows over token min-hashes.

Tokens are the hashes of all five-word shingles of a text. For each of ``HASHES``
hash functions the Cartesian tree over the token hashes groups all subsequences with
the same minimum: a node is a compact window (left, centre, right) that stands for
every subsequence between left and right that holds the centre. Only nodes of at
least ``MIN_TOKENS`` tokens matter, about 2 n / MIN_TOKENS of them; their centres are the
minima of the windows of that many tokens, their bounds the nearest smaller centres.

Two passages that share a minimum lie in windows with equal centres. Keys are counted
first; each window of a repeated one is joined with the first text of that key, a star, so
joins grow with windows and not with their square. Of the windows of a text that lead
to the same source, those of all hash functions that meet or nearly meet are joined to one
interval (one agreeing function of three is enough), and only the tokens of these intervals
travel. Between an interval and those of its source, runs of equal tokens are chained
over neighbouring diagonals, and a span is a passage if the full token sets are
alike by Jaccard similarity.

The first text of a centre may hold less than a passage around it, as with a frequent
line, while later ones share a passage. Windows that are in no passage are therefore joined
once more among themselves, by the run of ``SIDE`` tokens after or before the centre: every
passage that is equal in both texts holds one of the two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import textkit
from lectern.llm.tables import sized, written

SHINGLE_WORDS = 5
MIN_WORDS = 50
MIN_TOKENS = MIN_WORDS - SHINGLE_WORDS + 1
#: Hash functions. At similarity 0.8 one of three joins two texts with probability 0.992, and more above; exact passages agree in all.
HASHES = 3
SIMILARITY = 0.8
#: Equal places that two spans of MIN_TOKENS at that similarity have at least.
MIN_COMMON = -(-8 * MIN_TOKENS // 9)
#: Windows are cut to so many tokens on each side of the centre, which is room for the shortest passages around it; longer ones hold more centres.
REACH = 60
#: Intervals so near to each other are one, and runs of equal tokens on diagonals so near to each other may be one passage.
SLACK = 16
#: Where tokens repeat, a run of so many shows a diagonal. A changed word makes 5 unequal places in both texts or nearly so, for which 36 equal ones
#: must stand, so that of r runs of a passage the longest has 36 (r - 1) / r places or more, 18 at least.
SEED = 12
#: Tokens after and before a centre of which a passage of MIN_TOKENS has one or the other.
SIDE = MIN_TOKENS // 2 - 1
#: Texts compared with one copy of a source's intervals.
FOLLOWERS = 256

_MULTIPLIERS = np.random.default_rng(40).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A span holds the centre's place and how far the window reaches before and after it.
_REACH_BITS = 6
_WINDOWS = "key long, doc_id long, span long"
_SLICES = "source long, doc_id long, leads boolean, start long, tokens binary, crowded array<long>"
_FOUND = "doc_id long, start int, n_words int, source_doc_id long, source_start int, similarity double, source_n_words int"
_CHECKED = f"{_FOUND}, side long"


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes in order and tokens per text."""
    hashes, per = textkit.shingle_hashes(*textkit.word_hashes(data, offsets), SHINGLE_WORDS)
    return hashes, per


def _sliding(of: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """The least or greatest of every ``width`` values in a row."""
    have = 1
    while 2 * have <= width:
        values, have = of(values[:-have], values[have:]), 2 * have
    return of(values[: len(values) - (width - have)], values[width - have :]) if width > have else values


def _nearest_smaller(values: np.ndarray, step: int) -> np.ndarray:
    """The index of the nearest smaller value before (step -1) or after (1) each; the outermost values are 0 and smaller than all."""
    n = len(values)
    to = np.clip(np.arange(n) + step, 0, n - 1)
    open_ = np.flatnonzero((values[to] >= values) & (values > 0))
    while len(open_):
        to[open_] = to[to[open_]]
        open_ = open_[values[to[open_]] >= values[open_]]
    return to


def compact_windows(values: np.ndarray, per: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left, centre and right (exclusive) of the nodes of the Cartesian tree of each text that span ``least`` values or more, by centre; of equal minima
    the first is the centre."""
    n = len(values)
    if n < least:
        return (np.zeros(0, np.int64),) * 3
    owner = np.repeat(np.arange(len(per), dtype=np.int32), per)
    # 20 bits of the value, then the place to tell equal ones apart, and never 0
    order = ((values >> np.uint64(32)).astype(np.uint32) & np.uint32(0xFFFFF000)) | (np.arange(n, dtype=np.uint32) & np.uint32(0xFFF))
    order = np.maximum(order, np.uint32(1))
    low = _sliding(np.minimum, order, least)
    low[owner[: n - least + 1] != owner[least - 1 :]] = 0
    edge = np.zeros(least - 1, np.uint32)
    centre = np.flatnonzero(_sliding(np.maximum, np.concatenate([edge, low, edge]), least) == order)
    # the centres of each text stand between two zeros
    new = np.diff(owner[centre], prepend=-1) != 0
    at = np.arange(len(centre)) + np.cumsum(new)
    held = np.zeros(len(centre) + int(new.sum()) + 1, np.uint32)
    held[at] = order[centre]
    place = np.zeros(len(held), np.int64)
    place[at] = centre
    ends = np.cumsum(per)
    left, right = _nearest_smaller(held, -1)[at], _nearest_smaller(held, 1)[at]
    first, last = (ends - per)[owner[centre]], ends[owner[centre]]
    return np.where(held[left] > 0, place[left] + 1, first), centre, np.where(held[right] > 0, place[right], last)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of equal centres in a text the first two: the second shows that the text repeats itself."""
    for batch in batches:
        for rows, data, offsets in textkit.slices(batch, "text"):
            hashes, per = tokens(data, offsets)
            ids, first = rows.column("doc_id").to_numpy(), np.cumsum(per) - per
            for k in range(HASHES):
                values = hashes * _MULTIPLIERS[k]
                left, centre, right = compact_windows(values, per, MIN_TOKENS)
                owner = np.searchsorted(first, centre, "right") - 1
                key = textkit.mix64(values[centre], 80 + k).view(np.int64)
                order = np.lexsort((key, owner))
                same = (key[order][1:] == key[order][:-1]) & (owner[order][1:] == owner[order][:-1])
                third = np.r_[False, False, same[1:] & same[:-1]] if len(order) > 1 else np.zeros(len(order), bool)
                keep = np.sort(order[~third])
                left, centre, right, owner, key = (x[keep] for x in (left, centre, right, owner, key))
                span = (centre - first[owner] << 2 * _REACH_BITS) | (np.minimum(centre - left, REACH) << _REACH_BITS) | np.minimum(right - centre - 1, REACH)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[owner]), pa.array(span)], ["key", "doc_id", "span"])


def _unpacked(span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left, centre and right (exclusive) of packed windows."""
    mask = (1 << _REACH_BITS) - 1
    centre = span >> 2 * _REACH_BITS
    return centre - (span >> _REACH_BITS & mask), centre, centre + (span & mask) + 1


def _further_places(hashes: np.ndarray, per: np.ndarray, row: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts that list a centre's token twice, as at most two are listed, all its other places: index of the centre, place."""
    first = np.cumsum(per) - per
    token = textkit.mix64(hashes[first[row] + centre], 7) ^ textkit.mix64(row.astype(np.uint64), 8)
    kinds, times = np.unique(np.unique(np.stack([token, (first[row] + centre).astype(np.uint64)]), axis=1)[0], return_counts=True)
    twice = np.flatnonzero(np.isin(token, kinds[times > 1]))
    if not len(twice):
        return twice, twice
    texts = np.unique(row[twice])
    at = np.arange(per[texts].sum()) + np.repeat(first[texts] - (np.cumsum(per[texts]) - per[texts]), per[texts])
    every = textkit.mix64(hashes[at], 7) ^ textkit.mix64(np.repeat(texts, per[texts]).astype(np.uint64), 8)
    hit = np.isin(every, token[twice])
    at, every = at[hit], every[hit]
    order = np.argsort(token[twice], kind="stable")
    low, high = (np.searchsorted(token[twice][order], every, side) for side in ("left", "right"))
    n = high - low
    more = twice[order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]]
    return more, np.repeat(at, n) - first[row[more]]


def _intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of each text, joined to intervals by source, with the tokens of each, shortened to 32 bits, and the centres that many texts have."""
    for batch in batches:
        for rows, data, offsets in textkit.slices(batch, "text"):
            hashes, per = tokens(data, offsets)
            lists = rows.column("windows")
            counts = lists.value_lengths().to_numpy()
            row = np.repeat(np.arange(len(per)), counts)
            flat = lists.flatten()
            source, span, crowded = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("source", "span", "crowded"))
            left, centre, right = _unpacked(span)
            keep = centre < per[row]  # a row of the same doc_id may have another text
            row, source, crowded, left, centre, right = (x[keep] for x in (row, source, crowded, left, centre, right))
            more, there = _further_places(hashes, per, row, centre)
            row, source, crowded = np.r_[row, row[more]], np.r_[source, source[more]], np.r_[crowded, np.zeros(len(more), bool)]
            left, right, centre = np.r_[left, there - (centre - left)[more]], np.r_[right, there + (right - centre)[more]], np.r_[centre, there]
            left, right = np.maximum(left, 0), np.minimum(right, per[row])
            if not len(row):
                continue
            order = np.lexsort((left, source, row))
            row, source, crowded, left, centre, right = (x[order] for x in (row, source, crowded, left, centre, right))
            new = np.r_[True, (row[1:] != row[:-1]) | (source[1:] != source[:-1])]
            shift = np.cumsum(new) * (int(right.max()) + SLACK + 1)  # texts and sources one after the other
            reach = np.maximum.accumulate(right + shift)
            new[1:] |= (left + shift)[1:] > reach[:-1] + SLACK
            start = np.flatnonzero(new)
            a, b = left[start], np.maximum.reduceat(right, start)
            size = b - a
            doc = row[start]
            at = np.arange(size.sum()) + np.repeat(a + (np.cumsum(per) - per)[doc] - (np.cumsum(size) - size), size)
            cut = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((4 * np.r_[0, np.cumsum(size)]).astype(np.int32)), pa.py_buffer(hashes[at].astype(np.uint32))])
            per_interval = np.add.reduceat(crowded.astype(np.int64), start)
            places = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per_interval)], pa.int32()), pa.array(centre[crowded]))
            ids = rows.column("doc_id").to_numpy()[doc]
            columns = [pa.array(source[start]), pa.array(ids), pa.array(ids == source[start]), pa.array(a), cut, places]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _SLICES.split(", ")])


class Source:
    """The tokens of a source by value and place."""

    def __init__(self, tokens: np.ndarray, places: np.ndarray | None = None):
        self.tokens, self.at = tokens, np.arange(len(tokens)) if places is None else places
        order = np.argsort(tokens, kind="stable")
        held = tokens[order]
        first = np.flatnonzero(np.r_[True, held[1:] != held[:-1]]) if len(held) else np.zeros(0, np.int64)
        #: The distinct tokens, the places of all in their order, and where those of each begin among them.
        self.values, self.places, self.first = held[first], self.at[order], np.r_[first, len(held)]
        self.rank = np.repeat(np.arange(len(first)), np.diff(self.first))

    def find(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of these tokens stand here, and the bounds of their places."""
        if not len(self.values):
            return (np.zeros(0, np.int64),) * 3
        rank = np.minimum(np.searchsorted(self.values, own), len(self.values) - 1)
        at = np.flatnonzero(self.values[rank] == own)
        return at, self.first[rank[at]], self.first[rank[at] + 1]

    def between(self, low: int, high: int) -> np.ndarray:
        """The tokens of a range of places."""
        return self.tokens[np.searchsorted(self.at, low) : np.searchsorted(self.at, high)]


def _runs(at: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of places that follow each other in both texts: start in the text, start in the source, length."""
    start = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(place) != 1)])
    return at[start], place[start], np.diff(np.r_[start, len(at)])


def _chains(i0: np.ndarray, j0: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs on neighbouring diagonals, in the order of the text: start in the text, start in the source, length, score before and after each, and the last
    run up to which a span from each can reach. A span scores 1 for an equal place and -4 for each other place of either text, so 0 is Jaccard similarity 0.8."""
    diagonal = i0 - j0
    order = np.argsort(diagonal, kind="stable")
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(np.r_[False, np.diff(diagonal[order]) > SLACK])
    for g in np.flatnonzero(np.bincount(group, n) >= MIN_COMMON).tolist():
        here = np.flatnonzero(group == g)
        i, j, size = i0[here], j0[here], n[here]
        ahead, source_ahead = i[1:] - i[:-1] - size[:-1], j[1:] - j[:-1] - size[:-1]
        both = np.maximum(-source_ahead, 0)  # places of the source that two runs take: the first is cut
        after = np.cumsum(size + np.r_[0, -4 * (np.maximum(ahead, 0) + np.maximum(source_ahead, 0)) - 5 * both])
        before = after - size
        best = np.maximum.accumulate(after[::-1])  # of all runs from the last on down to each
        yield i, j, size, before, after, len(i) - 1 - np.searchsorted(best, before)


def _widened(start: int, end: int, low: int, high: int) -> tuple[int, int]:
    """The range made MIN_TOKENS long, inside the bounds."""
    end = min(max(end, start + MIN_TOKENS), high)
    return max(min(start, end - MIN_TOKENS), low), end


def _alike(own: np.ndarray, other: np.ndarray) -> float:
    if len(own) == len(other) and (own == other).all():
        return 1.0
    mine, theirs = np.unique(own), np.unique(other)
    common = len(np.intersect1d(mine, theirs, True))
    return common / (len(mine) + len(theirs) - common)


def _longest(source: Source, own: np.ndarray, offset: int, same: bool, at: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
    """Spans that are alike, from each run on the longest, none beginning in another: start and end in the text, start and end in the source, similarity."""
    for i, j, size, before, after, last in _chains(*_runs(at, place)):
        p = 0
        while p < len(i):
            covered = 0
            for q in [p] if last[p] == p else (np.flatnonzero(after[p : last[p] + 1] >= before[p])[::-1] + p).tolist():
                start, end, source_start, source_end = int(i[p]), int(i[q] + size[q]), int(j[p]), int(j[q] + size[q])
                if end - start < MIN_COMMON:
                    break
                lack = max(MIN_TOKENS - (end - start), 0) + max(MIN_TOKENS - (source_end - source_start), 0)
                if after[q] - before[p] < 4 * lack or source_end <= source_start:
                    continue
                a, b = _widened(start, end, 0, len(own))
                c, d = _widened(source_start, source_end, int(source.at[0]), int(source.at[-1]) + 1)
                if min(b - a, d - c) < MIN_TOKENS or (same and c >= a + offset):
                    continue
                alike = _alike(own[a:b], source.between(c, d))
                if alike >= SIMILARITY:
                    covered = end
                    yield a, b, c, d, alike
                    break
            p += 1
            while p < len(i) and i[p] < covered:
                p += 1


def _nearest(source: Source, below: np.ndarray, low: np.ndarray, high: np.ndarray, want: np.ndarray) -> np.ndarray:
    """The place of each token, of those ``low`` .. ``high``, that is nearest to the wanted one, and ``below`` a bound if there is one."""
    wide = int(source.at[-1]) + 2
    k = np.searchsorted(source.rank * wide + source.places, source.rank[low] * wide + np.clip(want, 0, wide - 1))
    after, before = source.places[np.minimum(k, high - 1)], source.places[np.maximum(k - 1, low)]
    return np.where((np.abs(after - want) <= np.abs(before - want)) & (after < below), after, before)


def _counted(values: np.ndarray) -> np.ndarray:
    """How often each value stands before it."""
    order = np.argsort(values, kind="stable")
    first = np.flatnonzero(np.diff(values[order], prepend=values[order[0]] + values.dtype.type(1)) != 0)
    out = np.empty(len(values), np.int64)
    out[order] = np.arange(len(values)) - np.repeat(first, np.diff(np.r_[first, len(values)]))
    return out


def _with_loops(own: np.ndarray, a: int, b: int, least: int) -> tuple[int, int]:
    """A span and the tokens around it, down to ``least``, that it holds already, as in a loop: its set stays the same."""
    inside = np.isin(own, own[a:b])
    out = np.flatnonzero(~inside)
    k = int(np.searchsorted(out, a))
    return max(int(out[k - 1]) + 1 if k else 0, min(least, a)), int(out[k]) if k < len(out) else len(own)


def confirmed(doc: int, src: int, own: np.ndarray, source: Source, matches: list[dict] = (), offset: int = 0) -> list[tuple]:
    """The passages of a text, or of its interval from ``offset`` on, that a source has too; in the same text, in an earlier place.

    Where a token stands in the source more than once, the place nearest to a diagonal counts. Diagonals come from runs of first places, of last ones, and of
    those with the same number of equal tokens before or after them; the longest is tried first, then those of ``matches`` (places ``at`` and
    ``source_at``); runs inside a passage found before are passed over. A passage takes in the loop that it begins or ends in."""
    at, low, high = source.find(own)
    if len(at) < MIN_COMMON:
        return []
    same, found = doc == src, []
    unique = not same and bool((high - low == 1).all())

    def search(place: np.ndarray) -> None:
        ok = place < at + offset if same else slice(None)
        for a, b, c, d, alike in _longest(source, own, offset, same, at[ok], place[ok]) if len(at[ok]) >= MIN_COMMON else ():
            if not unique:
                a, b = _with_loops(own, a, b, c + 1 - offset if same else 0)
            found.append((doc, a + offset, b - a + SHINGLE_WORDS - 1, src, c, alike, d - c + SHINGLE_WORDS - 1))

    if unique:
        search(source.places[low])
    else:
        below = at + offset if same else np.full(len(at), np.iinfo(np.int64).max)
        ways = [_nearest(source, below, low, high, np.zeros(len(at), np.int64)), _nearest(source, below, low, high, below - 1)]
        if not same:
            before, after = _counted(own[at]), _counted(own[at][::-1])[::-1]
            ways += [source.places[np.minimum(low + before, high - 1)], source.places[np.maximum(high - 1 - after, low)]]
        seeds = [(int(n), int(i) + offset - int(j), int(i)) for way in ways for i, j, n in zip(*_runs(at, way)) if n >= SEED]
        seeds += [(0, m["at"] - m["source_at"], m["at"] - offset) for m in matches]
        tried: set[int] = set()
        for _, diagonal, i in sorted(seeds, key=lambda x: -x[0]):
            if diagonal not in tried and not any(f[1] <= i + offset <= f[1] + f[2] - SHINGLE_WORDS for f in found):
                tried.add(diagonal)
                search(_nearest(source, below, low, high, at + offset - diagonal))
    # of passages inside a longer one only the longer counts
    whole: list[tuple] = []
    for x in sorted(found, key=lambda x: (-x[2], x[1], x[4])):
        if not any(y[1] <= x[1] and x[1] + x[2] <= y[1] + y[2] for y in whole):
            whole.append(x)
    return whole


_FACTORS = textkit.mix64(np.arange(SIDE + 1, dtype=np.uint64), 60) | np.uint64(1)


def _sides(own: np.ndarray, offset: int, centres: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the runs of SIDE tokens after and before centres, with the centre, and the centres."""
    at = np.array(centres, np.int64) - offset
    on, back = at[at + SIDE < len(own)], at[at >= SIDE]
    runs = own[np.concatenate([on, back - SIDE])[:, None] + np.arange(SIDE + 1)]
    keys = textkit.mix64((runs * _FACTORS).sum(1, dtype=np.uint64))
    keys[len(on) :] = textkit.mix64(keys[len(on) :], 61)
    return keys.view(np.int64), np.concatenate([on, back]) + offset


def _joined(parts: list[tuple[int, np.ndarray]]) -> Source:
    return Source(np.concatenate([x for _, x in parts]), np.concatenate([np.arange(a, a + len(x)) for a, x in parts])) if parts else Source(np.zeros(0, np.uint32))


def _checked(found: list[tuple], sides: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Passages, then sides, with the centre as start."""
    side, centre, doc, src = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*sides) if sides else ((),) * 4))
    empty = [None] * len(side)
    columns = [[*(x[k] for x in found), *more] for k, more in enumerate((doc.tolist(), centre.tolist(), empty, src.tolist(), empty, empty, empty))]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip([*columns, [None] * len(found) + side.tolist()], kinds)], [c.split()[0] for c in _CHECKED.split(", ")])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (source, salt), the source's own intervals first. Gives passages, and the sides of all crowded centres of the others."""
    key, parts, source = None, [], None

    def own_repeats() -> list[tuple]:
        """The source's passages in itself, looked for once."""
        if key is None or key[1] or sum(len(x) for _, x in parts) - len(source.values) < MIN_COMMON:
            return []
        return [x for start, own in parts for x in confirmed(key[0], key[0], own, source, (), start)]

    for batch in batches:
        out: list[tuple] = []
        sides: list[tuple[np.ndarray, ...]] = []
        d = batch.to_pydict()
        for src, salt, leads, doc, start, cut, crowded in zip(*(d[c] for c in ("source", "salt", "leads", "doc_id", "start", "tokens", "crowded"))):
            if key != (src, salt):
                if source is None and parts:
                    source = _joined(parts)
                    out += own_repeats()
                key, parts, source = (src, salt), [], None
            own = np.frombuffer(cut, np.uint32)
            if leads:
                parts.append((start, own))
                continue
            if source is None:
                source = _joined(parts)
                out += own_repeats()
            out += confirmed(doc, src, own, source, (), start)
            if crowded:
                keys, centres = _sides(own, start, crowded)
                sides.append((keys, centres, np.full(len(keys), doc), np.full(len(keys), src)))
        yield _checked(out, sides)
    if source is None and parts:
        source = _joined(parts)
        yield _checked(own_repeats(), [])


def _compared(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """Passages and sides from the windows of each text and their sources; a source lists its own windows with itself."""
    slices = docs.join(lists, "doc_id").select("doc_id", "windows", "text").mapInArrow(_intervals, _SLICES)
    degree = lists.select(F.explode(F.array_distinct(F.transform("windows", lambda w: w["source"]))).alias("source")).groupBy("source").agg(F.ceil(F.count("*") / FOLLOWERS).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    salts = F.when(F.col("leads"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id"), parts).cast("int")))
    salted = slices.join(sized(degree.where("parts > 1")), "source", "left").withColumn("salt", F.explode(salts))
    dealt = salted.repartition("source", "salt").sortWithinPartitions("source", "salt", F.desc("leads"), "doc_id", "start")
    return dealt.select("source", "salt", "leads", "doc_id", "start", "tokens", "crowded").mapInArrow(_confirm, _CHECKED)


def _missed_by_stars(checked: DataFrame) -> DataFrame:
    """Windows of crowded centres that are in no passage, with the first text that has the same tokens on one side of the centre, as lists for ``_compared``."""
    sides = checked.where("side IS NOT NULL").select("side", "doc_id", F.col("start").alias("centre"), F.col("source_doc_id").alias("compared"))
    first = sides.groupBy("side").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).where("source < last").select("side", "source")
    first = written(first, "first")  # a table, for the same reason as the keys of windows
    shared = written(sides.join(first, "side"), "sides")
    places = checked.where("side IS NULL").select(F.col("doc_id").alias("d"), F.col("start").alias("begin"), (F.col("start") + F.col("n_words") - SHINGLE_WORDS).alias("last"))
    missed = shared.where("doc_id <> source AND source <> compared").join(places, F.expr("doc_id = d AND centre BETWEEN begin AND last"), "left_anti")
    missed = written(missed.select("side", "doc_id", "centre", "source").distinct(), "missed")
    leads = shared.where("doc_id = source").join(missed.select("side").distinct(), "side", "left_semi").select("side", "doc_id", "centre", "source")
    whole = (F.col("centre").cast("long") * (1 << 2 * _REACH_BITS)) + ((REACH << _REACH_BITS) | REACH)
    return _listed(missed.union(leads).withColumn("span", whole).withColumn("crowded", F.lit(False)))


def _listed(windows: DataFrame) -> DataFrame:
    return written(windows.groupBy("doc_id").agg(F.collect_set(F.struct("source", "span", "crowded")).alias("windows")), "lists")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) to passages of at least 50 words that stand, alike to 0.8, in an earlier place too:
    doc_id, start and n_words (in words), source_doc_id, source_start, similarity and source_n_words, which differs from n_words where words were put in
    or left out.

    Of the places of a passage the one in the document with the least id is the source of the others, so pairs grow with places, not with
    their square; a passage repeated in the first document that has it is listed as well. Texts of fewer than 50 words, null and empty ones have
    none. Rows without doc_id are left out, repeated rows are one document, and other columns are ignored."""
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    windows = written(docs.mapInArrow(_windows, _WINDOWS), "windows")
    # a table, so that the join can split the windows of a key with very many
    first = written(windows.groupBy("key").agg(F.min("doc_id").alias("source"), F.count("*").alias("n")).where("n > 1"), "keys")
    lists = _listed(windows.join(first, "key").select("doc_id", "source", "span", (F.col("n") > 2).alias("crowded")))
    checked = written(_compared(docs, lists), "checked")
    again = _missed_by_stars(checked)
    found = checked.where("side IS NULL").drop("side")
    return (found if again.isEmpty() else found.union(_compared(docs, again).where("side IS NULL").drop("side"))).distinct()
