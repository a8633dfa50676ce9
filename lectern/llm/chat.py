"""Chat formatting by columnar byte assembly.

A conversation becomes one string, turn by turn

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

and a loss mask, the spans of assistant texts in code points. Segment lengths of
a whole batch give offsets by one cumulative sum; headers and contents are then
scattered into one preallocated buffer. Inside roles and texts a backslash is put
after each backslash and after the first byte of each control string, which
breaks the string up; in roles also before a line end. Taking out every backslash
and keeping what follows it restores the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import textkit

OPEN, MIDDLE, CLOSE = b"<|im_start|>", b"\n", b"<|im_end|>\n"
#: Strings that some chat template or tokenizer gives a meaning (fixed values).
CONTROLS = (
    b"<|im_start|>", b"<|im_end|>", b"<|endoftext|>", b"<|startoftext|>", b"<s>", b"</s>", b"[INST]", b"[/INST]", b"<<SYS>>", b"<</SYS>>",
)
LOSS_ROLE = "assistant"
#: Conversations are assembled in runs of about so many bytes.
RUN_BYTES = 4 << 20

_FORMATTED = "conv_id long, formatted string, loss_starts array<int>, loss_ends array<int>"
_HEAD = re.compile(r"<\|im_start\|>((?:[^\\\n]|\\.)*)\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escaped(texts: pa.Array, is_role: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all escaped texts, and offsets."""
    data, offsets = textkit.raw(texts)
    after = data == 0x5C
    last = np.repeat(offsets[1:], np.diff(offsets))  # each byte's end of text
    for control in CONTROLS:
        at = np.flatnonzero(data[: max(len(data) - len(control) + 1, 0)] == control[0])
        for k, byte in enumerate(control[1:], 1):
            at = at[data[at + k] == byte]
        after[at[at + len(control) <= last[at]]] = True
    before = (data == 0x0A) & is_role
    shift = np.r_[0, np.cumsum(after.astype(np.int64) + before)]
    out = np.full(len(data) + int(shift[-1]), 0x5C, np.uint8)
    out[np.arange(len(data)) + shift[:-1] + before] = data
    return out, offsets + shift[offsets]


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _spread(out: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Copies the spans of ``data`` to the places ``at``."""
    sizes = np.diff(offsets)
    out[np.repeat(at - offsets[:-1], sizes) + np.arange(offsets[-1])] = data


def assemble(conv: list, roles: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """Turns in order, whole conversations, to one formatted row each."""
    n = len(conv)
    role, role_off = escaped(roles, True)
    text, text_off = escaped(texts)
    sizes = np.empty((n, 5), np.int64)
    sizes[:, [0, 2, 4]] = len(OPEN), len(MIDDLE), len(CLOSE)
    sizes[:, 1], sizes[:, 3] = np.diff(role_off), np.diff(text_off)
    at = np.r_[0, np.cumsum(sizes.ravel())]
    places, total = at[:-1].reshape(n, 5), int(at[-1])
    out = np.empty(total, np.uint8)
    for k, fixed in ((0, OPEN), (2, MIDDLE), (4, CLOSE)):
        out[(places[:, k, None] + np.arange(len(fixed))).ravel()] = np.tile(np.frombuffer(fixed, np.uint8), n)
    _spread(out, places[:, 1], role, role_off)
    _spread(out, places[:, 3], text, text_off)
    first = np.array([i for i in range(n) if i == 0 or conv[i] != conv[i - 1]], np.int64)
    rows = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(np.r_[places[first, 0], total].astype(np.int64)), pa.py_buffer(out)])
    points = np.r_[0, np.cumsum((out & 0xC0) != 0x80)]  # code points before each byte
    loss = np.flatnonzero([r == LOSS_ROLE for r in roles.to_pylist()])
    owner = np.searchsorted(first, loss, "right") - 1
    base = points[places[first[owner], 0]]
    bounds = np.searchsorted(owner, np.arange(len(first) + 1)).astype(np.int32)
    starts, ends = (pa.ListArray.from_arrays(bounds, pa.array((points[x] - base).astype(np.int32))) for x in (places[loss, 3], places[loss, 4]))
    return pa.RecordBatch.from_arrays([pa.array([conv[i] for i in first], pa.int64()), rows.cast(pa.string()), starts, ends], ["conv_id", "formatted", "loss_starts", "loss_ends"])


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []  # of the conversation that may go on

    def parts(table: pa.Table) -> Iterator[pa.RecordBatch]:
        conv = table.column("conv_id").to_pylist()
        roles, texts = (textkit.texts_of(table.column(c)) for c in ("role", "text"))
        offsets = textkit.raw(texts)[1]
        first = 0
        for i in range(1, len(conv) + 1):
            if i == len(conv) or (conv[i] != conv[i - 1] and offsets[i] - offsets[first] > RUN_BYTES):
                yield assemble(conv[first:i], roles[first:i], texts[first:i])
                first = i

    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv_id").to_pylist()
        cut = len(conv)
        while cut and conv[cut - 1] == conv[-1]:
            cut -= 1
        if held and (cut or held[0].column("conv_id")[0].as_py() != conv[0]):
            yield from parts(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        elif cut:
            yield from parts(pa.Table.from_batches([batch.slice(0, cut)]))
        held.append(batch.slice(cut))
    if held:
        yield from parts(pa.Table.from_batches(held))


def format_chats(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) to one row per conversation: conv_id, formatted, loss_starts, loss_ends (code points).

    Turns stand by turn, null ones first; ties, and so repeated rows, which stay, by role and text. A null role or text is empty. Rows without
    conv_id are one conversation, with a null id. Only exactly ``assistant`` texts are under the mask. Other columns are ignored. A conversation is one value
    and made in one task, so its formatted text must stay below 2 GB; a longer one is an error."""
    rows = turns.select(F.col("conv_id").cast("long"), "turn", "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(_format, _FORMATTED)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation; an error if it is not one."""
    found, at, close = [], 0, CLOSE.decode()
    while at < len(formatted):
        head = _HEAD.match(formatted, at)
        end = formatted.find(close, head.end()) if head else -1  # an escaped text never holds it
        if end < 0:
            raise ValueError(f"no turn at {at}")
        found.append((unescape(head[1]), unescape(formatted[head.end() : end])))
        at = end + len(close)
    return found


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        d = batch.to_pydict()
        for conv, text, starts, ends in zip(d["conv_id"], d["formatted"], d["loss_starts"], d["loss_ends"]):
            turns = parse(text)
            loss = "".join(unescape(text[a:b]) for a, b in zip(starts, ends))
            whole = "".join(f"{r}\n{t}\n" for r, t in turns)
            for x, v in zip(out, (conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text))):
                x.append(v)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names)


def digests(formatted: DataFrame) -> DataFrame:
    """Reads formatted conversations back: turns, their digest, and the text under the mask."""
    return formatted.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
