"""Conversations as marked-up training text, by columnar byte assembly.

Turns are dealt by conversation and sorted. Per Arrow batch, the lengths of all segments
(a turn's opening mark, text and closing mark) give cumulative offsets, and these the
places to which marks and texts are scattered in one preallocated buffer, which becomes
the Arrow column as it is. The loss mask marks the code points of assistant texts.

Template: ``<<SYS>>\\n`` text ``\\n<</SYS>>\\n\\n`` for system, ``<s>[INST] `` text for
user, `` [/INST] `` text `` </s>`` for assistant, ``<<ROLE>>`` role ``\\n`` text for any
other role. A text that holds such a control string, with any number of backslashes
after its first character, gets one more there, and loses it when it is read back; so
no text can pass for a mark, and every text comes back as it was.

A long conversation is cut between turns into parts of some megabytes, which follow one
another in its partition. By default turns are also dealt by ``turn`` div
``turns_per_section``, so that a conversation of many turns is spread over tasks; its
text is then that of its sections and parts in order. ``whole`` keeps each conversation
in one task, which streams through it.

Cases: a null or empty text gives an empty turn, a null role the role ''; turns with one
number follow by role and text, repeated rows are turns each, null turns come first;
rows without conv_id are one conversation; a single very long text is a part of its own;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from .common import SLICE_BYTES, text_buffer

PART_BYTES = 4 << 20

PARTS = "conv_id long, section long, part long, n_turns long, text string, loss_start array<long>, loss_length array<long>"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

MARKS = {"system": ("<<SYS>>\n", "\n<</SYS>>\n\n"), "user": ("<s>[INST] ", ""), "assistant": (" [/INST] ", " </s>")}
_TAILS = r"(/?s>|/?INST\]|</?SYS>>|<ROLE>>)"
ESCAPE = (r"([<\[])(\\*)" + _TAILS, r"\1\2\\\3")
_UNESCAPE = re.compile(r"([<\[])\\(\\*)" + _TAILS)
_MARK = re.compile(r"<s>\[INST\] | \[/INST\] |<<SYS>>\n|<<ROLE>>([^\n]*)\n| </s>|\n<</SYS>>\n\n")
_OPENS = {a: role for role, (a, _) in MARKS.items()}
_CLOSES = {z for _, z in MARKS.values() if z}


def escape(text: str) -> str:
    return re.sub(*ESCAPE, text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def marks(role: str) -> tuple[str, str]:
    if role in MARKS:
        return MARKS[role]
    return "<<ROLE>>" + escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n", ""


def _role(name: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(name))


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    turns, role, at = [], None, 0
    for m in _MARK.finditer(text):
        if role is not None:
            turns.append((role, unescape(text[at:m.start()])))
        mark, at = m[0], m.end()
        role = None if mark in _CLOSES else _OPENS[mark] if mark in _OPENS else _role(m[1])
    if role is not None:
        turns.append((role, unescape(text[at:])))
    return turns


def arranged(turns, by):
    """Turns dealt by the columns ``by``, each conversation's together and in order."""
    return (turns.repartition(*by).sortWithinPartitions("conv_id", "section", "turn", "role", "text")
            .select("conv_id", "section", "role", "text"))


def scatter(out: np.ndarray, to: np.ndarray, source: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """Copies the segments [start, start + length) of ``source`` to the places ``to``."""
    ends = np.cumsum(length)
    within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length, length)
    out[np.repeat(to, length) + within] = source[np.repeat(start, length) + within]


def assemble(rows: pa.Table, first: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Formatted text, loss starts and loss lengths; ``first``: each text's first row, and the end."""
    roles = pc.dictionary_encode(rows.column("role").combine_chunks())
    pairs = [[x.encode() for x in marks(r)] for r in roles.dictionary.to_pylist()]
    role = roles.indices.to_numpy(zero_copy_only=False)
    pool = np.frombuffer(b"".join(x for p in pairs for x in p), np.uint8)
    size = np.array([[len(x) for x in p] for p in pairs], np.int64).reshape(-1, 2)
    chars = np.array([[len(x.decode()) for x in p] for p in pairs], np.int64).reshape(-1, 2)
    at = np.concatenate([[0], np.cumsum(size.ravel())])[:-1].reshape(-1, 2)
    texts = rows.column("text").combine_chunks()
    data, off = text_buffer(texts)
    length = np.diff(off)

    def places(head, body, tail):
        """Where each turn begins, and the end, if its segments are so long."""
        return np.concatenate([[0], np.cumsum(head + body + tail)])

    begin = places(size[role, 0], length, size[role, 1])
    out = np.empty(begin[-1], np.uint8)
    scatter(out, begin[:-1], pool, at[role, 0], size[role, 0])
    scatter(out, begin[:-1] + size[role, 0], data, off[:-1], length)
    scatter(out, begin[1:] - size[role, 1], pool, at[role, 1], size[role, 1])
    text = pa.StringArray.from_buffers(len(first) - 1, pa.py_buffer(begin[first].astype(np.int32)), pa.py_buffer(out))

    length = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = places(chars[role, 0], length, chars[role, 1])
    lossy = np.flatnonzero(role == (roles.dictionary.index("assistant").as_py()))
    owner = np.searchsorted(first, lossy, "right") - 1
    ends = pa.array(np.searchsorted(lossy, first), pa.int32())
    start = begin[lossy] + chars[role[lossy], 0] - begin[first[owner]]
    return text, pa.ListArray.from_arrays(ends, pa.array(start)), pa.ListArray.from_arrays(ends, pa.array(length[lossy]))


def _formatted(batches):
    names = ["conv_id", "section", "part", "n_turns", "text", "loss_start", "loss_length"]
    held, here, size = None, None, 0  # rows of the last part, its conversation and section, their bytes so far

    def emitted(rows):
        keys = list(zip(*(rows.column(c).to_pylist() for c in ("conv_id", "section", "part"))))
        first = [i for i, k in enumerate(keys) if not i or k != keys[i - 1]]
        ends, bytes_to = [*first[1:], len(keys)], np.cumsum(pc.binary_length(rows.column("text")).to_numpy())
        a = 0
        while a < len(first):
            z, before = a + 1, bytes_to[first[a]]
            while z < len(first) and bytes_to[ends[z] - 1] - before <= SLICE_BYTES:
                z += 1
            at = np.array([*first[a:z], ends[z - 1]]) - first[a]
            text, start, length = assemble(rows.slice(first[a], ends[z - 1] - first[a]), at)
            own = [keys[i] for i in first[a:z]]
            yield pa.RecordBatch.from_arrays([*(pa.array([k[c] for k in own], pa.int64()) for c in range(3)), pa.array(np.diff(at), pa.int64()), text, start, length], names=names)
            a = z

    for b in batches:
        text = pc.replace_substring_regex(pc.fill_null(b.column(3), ""), pattern=ESCAPE[0], replacement=ESCAPE[1])
        parts = []
        for key, n in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), pc.binary_length(text).to_pylist()):
            if key != here:
                here, size = key, 0
            parts.append(size // PART_BYTES)
            size += n
        rows = pa.table({"conv_id": b.column(0), "section": b.column(1), "part": pa.array(parts, pa.int64()), "role": pc.fill_null(b.column(2), ""), "text": text})
        if held is not None:
            rows = pa.concat_tables([held, rows])
        if not rows.num_rows:
            continue
        # All but the last part are complete.
        last, z = [rows.column(c)[-1].as_py() for c in ("conv_id", "section", "part")], rows.num_rows
        tail = list(zip(*(rows.column(c).to_pylist() for c in ("conv_id", "section", "part"))))
        while z and list(tail[z - 1]) == last:
            z -= 1
        held = rows.slice(z)
        yield from emitted(rows.slice(0, z))
    if held is not None:
        yield from emitted(held)


def format_chats(turns, whole: bool = False, turns_per_section: int = 1024):
    """(conv_id, section, part, n_turns, text, loss_start, loss_length): the formatted
    texts of all conversations and, in code points, the spans of text under the loss."""
    section = F.lit(0) if whole else F.coalesce(F.floor(F.col("turn") / turns_per_section), F.lit(-1))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), section.cast("long").alias("section"), "turn", "role", "text")
    return arranged(rows, ["conv_id"] if whole else ["conv_id", "section"]).mapInArrow(_formatted, PARTS)


def _digested(batches):
    fields = [x.split()[0] for x in DIGEST.split(", ")]
    here, state = None, None

    def closed():
        n, turns, loss_chars, loss, chars = state
        return pa.RecordBatch.from_pylist([dict(zip(fields, (here[0], n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)))],
                                          pa.schema([(f, pa.string() if f.endswith("sha256") else pa.int64()) for f in fields]))

    done = []
    for b in batches:
        for conv, text, starts, lengths in zip(*(b.column(c).to_pylist() for c in ("conv_id", "text", "loss_start", "loss_length"))):
            if here != (conv,):
                if here:
                    done.append(closed())
                here, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in read_turns(text):
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
            for s, n in zip(starts, lengths):
                said = unescape(text[s:s + n])
                state[2] += len(said)
                state[3].update(said.encode())
            state[4] += len(text)
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
            done = []
    if here:
        yield closed()


def chat_digest(turns):
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read
    back from the formatted texts: turns by the marks, the rest by the loss mask. A
    digest of a whole conversation is sequential, so each is one task's stream."""
    return format_chats(turns, whole=True).mapInArrow(_digested, DIGEST)
