"""Fill-in-the-middle by displacement: every byte of a batch is moved by an offset of its own.

A text is cut after two of its units (a word with the blanks before it, or the blanks at the
end).  One scan over the bytes of a batch finds the ends of all units; the cuts part the batch
into prefixes, middles and suffixes.  All bytes of a part move by the same distance, so the
distances are written as differences at the parts' first bytes, a running sum gives every
byte's shift, and one scatter builds all outputs of the batch.  The way back finds the three
marks of each output, writes the differences at the parts' first bytes in the restored text,
and gathers.  Running sums are taken over ``BLOCK`` bytes at a time, so what a task holds is the
bytes of a batch, its outputs and its unit ends, whatever the texts' lengths.

Numbers that decide come from a hash of seed and id: reruns agree, and no row needs another.

Defined cases: a null text counts as empty; an empty text, or one that holds a mark already,
stays plain; a null id is hashed as the empty string; repeated rows get the same output; an
empty table gives an empty table; other columns pass through, those called as a new column are
replaced (letter case aside).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common
from gridloom.llm.words import blank, bytes_of

SEED = 42
#: Percent of texts that are cut, and of those that put the suffix first.
FIM_PERCENT, SPM_PERCENT = 50, 80
FORMS = ("plain", "psm", "spm")
MARK = 3  # bytes of a mark: <P>, <S> or <M>
#: Bytes of texts worked on together, unless one text alone is longer.
CHUNK_BYTES = 1 << 22
BLOCK = 1 << 20

_letters = np.zeros(256, dtype=bool)
_letters[[ord(c) for c in "PSM"]] = True


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four whole numbers below 2**32 from a hash of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    digest = F.sha2(text.cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)]


def _runs(offsets: np.ndarray):
    """Ranges of rows of about ``CHUNK_BYTES`` bytes."""
    begin, rows = 0, len(offsets) - 1
    while begin < rows:
        end = int(np.searchsorted(offsets, offsets[begin] + CHUNK_BYTES, "right")) - 1
        end = min(max(end, begin + 1), rows)
        yield begin, end
        begin = end


def _shifts(at: np.ndarray, shift: np.ndarray, size: int):
    """``(begin, end, shift of each byte)`` by blocks; part ``k`` begins at ``at[k]``, in order."""
    change = np.diff(shift, prepend=0)
    carried = 0
    for begin in range(0, size, BLOCK):
        end = min(begin + BLOCK, size)
        lo, hi = np.searchsorted(at, [begin, end])
        steps = np.zeros(end - begin, dtype=np.int64)
        np.add.at(steps, at[lo:hi] - begin, change[lo:hi])
        steps[0] += carried
        moved = np.cumsum(steps)
        carried = int(moved[-1])
        yield begin, end, moved


def unit_ends(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places after the units of texts that follow each other."""
    empty = blank[raw]
    stops = np.zeros(len(raw), dtype=bool)
    stops[:-1] = ~empty[:-1] & empty[1:]
    stops[offsets[1:][np.diff(offsets) > 0] - 1] = True
    return np.flatnonzero(stops) + 1


def mark_places(raw: np.ndarray) -> np.ndarray:
    """Where the bytes say <P>, <S> or <M>."""
    if len(raw) < MARK:
        return np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(raw[: -MARK + 1] == ord("<"))
    return at[_letters[raw[at + 1]] & (raw[at + 2] == ord(">"))]


def _whole_marks(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks that lie inside one text, and their texts."""
    at = mark_places(raw)
    row = np.searchsorted(offsets, at, "right") - 1
    inside = at + MARK <= offsets[row + 1]
    return at[inside], row[inside]


def code_points(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points of the parts that begin at ``at``; the last runs to the end."""
    first = np.append((raw & 0xC0) != 0x80, False)
    sums = np.add.reduceat(first, at, dtype=np.int64)
    return np.where(at == np.append(at[1:], len(raw)), 0, sums)


def transform_bytes(raw: np.ndarray, offsets: np.ndarray, draw: np.ndarray, percents: tuple[int, int]):
    """Outputs of texts that follow each other: ``(bytes, offsets, form, n, prefix, middle)``,
    form as a place in ``FORMS``, prefix and middle in code points."""
    start, size = offsets[:-1], np.diff(offsets)
    ends = unit_ends(raw, offsets)
    first = np.searchsorted(ends, start, "right")
    n = np.searchsorted(ends, offsets[1:], "right") - first
    held = np.zeros(len(size), dtype=bool)
    held[_whole_marks(raw, offsets)[1]] = True
    plain = (size == 0) | held | (draw[2] % 100 >= percents[0])
    form = np.where(plain, 0, np.where(draw[3] % 100 < percents[1], 2, 1))
    picks = np.sort(draw[:2] % (n + 1), axis=0)
    padded = np.append(ends, 0)
    cut = np.where(picks > 0, padded[np.where(picks > 0, first + picks - 1, -1)], start)
    out_offsets = np.zeros(len(offsets), dtype=np.int64)
    np.cumsum(np.where(plain, size, size + 3 * MARK), out=out_offsets[1:])
    out_start = out_offsets[:-1]
    before, rest = cut[0] - start, offsets[1:] - cut[1]
    spm = form == 2
    # First bytes of prefix, middle and suffix in the output.
    to_prefix = out_start + np.where(plain, 0, np.where(spm, 2 * MARK + rest, MARK))
    to_middle = out_start + np.where(plain, before, 3 * MARK + before + rest)
    to_suffix = out_start + np.where(plain, cut[1] - start, np.where(spm, MARK, 2 * MARK + before))
    at = np.stack([start, cut[0], cut[1]], axis=1).ravel()
    shift = np.stack([to_prefix - start, to_middle - cut[0], to_suffix - cut[1]], axis=1).ravel()
    out = np.empty(int(out_offsets[-1]), dtype=np.uint8)
    for begin, end, moved in _shifts(at, shift, len(raw)):
        out[np.arange(begin, end) + moved] = raw[begin:end]
    for places, letter in ((to_prefix, b"P"), (to_suffix, b"S"), (to_middle, b"M")):
        for k, byte in enumerate(b"<" + letter + b">"):
            out[places[~plain] - MARK + k] = byte
    chars = code_points(raw, at).reshape(-1, 3)
    return out, out_offsets, form, n, chars[:, 0], chars[:, 1]


def restore_bytes(out: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that gave these outputs, with their offsets."""
    start, end = offsets[:-1], offsets[1:]
    cut = form > 0
    marks, row = _whole_marks(out, offsets)
    marks, row = marks[cut[row]], row[cut[row]]
    if not np.array_equal(row, np.repeat(np.flatnonzero(cut), 3)):
        raise ValueError("an output that is not plain needs its three marks once each")
    marks = marks.reshape(-1, 3)
    size = end - start - np.where(cut, 3 * MARK, 0)
    to = np.zeros(len(offsets), dtype=np.int64)
    np.cumsum(size, out=to[1:])
    # Prefix, middle, suffix: where they begin in the output, and how long they are.
    begins = np.stack([start, end, end], axis=1)
    lengths = np.stack([end - start, np.zeros_like(start), np.zeros_like(start)], axis=1)
    one, two, three = marks[:, 0], marks[:, 1], marks[:, 2]
    spm = form[cut] == 2
    lead, follow = (one + MARK, two - one - MARK), (two + MARK, three - two - MARK)
    begins[cut] = np.stack([np.where(spm, follow[0], lead[0]), three + MARK, np.where(spm, lead[0], follow[0])], axis=1)
    lengths[cut] = np.stack(
        [np.where(spm, follow[1], lead[1]), end[cut] - three - MARK, np.where(spm, lead[1], follow[1])], axis=1
    )
    at = to[:-1, None] + np.cumsum(lengths, axis=1) - lengths
    text = np.empty(int(to[-1]), dtype=np.uint8)
    for lo, hi, moved in _shifts(at.ravel(), (begins - at).ravel(), len(text)):
        text[lo:hi] = out[np.arange(lo, hi) + moved]
    return text, to


def _strings(raw: np.ndarray, offsets: np.ndarray) -> pa.Array:
    if offsets[-1] > np.iinfo(np.int32).max:
        raise ValueError("a batch of texts over 2 GB: lower spark.sql.execution.arrow.maxRecordsPerBatch")
    buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)]
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, buffers)


def _whole(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


_RESULT = "struct<output: string, form: string, n: bigint, prefix_chars: bigint, middle_chars: bigint>"


def _transformer(percents: tuple[int, int]):
    def transform(text: pa.Array, h1: pa.Array, h2: pa.Array, h3: pa.Array, h4: pa.Array) -> pa.Array:
        raw, offsets = bytes_of(text)
        draw = np.stack([h.to_numpy(zero_copy_only=False) for h in (h1, h2, h3, h4)]).astype(np.int64)
        parts: list[list[pa.Array]] = [[], [], [], [], []]
        for begin, end in _runs(offsets):
            lo, hi = offsets[begin], offsets[end]
            out, to, form, n, before, middle = transform_bytes(
                raw[lo:hi], offsets[begin : end + 1] - lo, draw[:, begin:end], percents
            )
            plain = form == 0
            made = (
                _strings(out, to), pa.array(FORMS).take(pa.array(form)), pa.array(n),
                pa.array(before, mask=plain), pa.array(middle, mask=plain),
            )
            for held, part in zip(parts, made, strict=True):
                held.append(part)
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        names = ["output", "form", "n", "prefix_chars", "middle_chars"]
        return pa.StructArray.from_arrays([_whole(p, k) for p, k in zip(parts, kinds, strict=True)], names)

    return transform


def _restore(output: pa.Array, form: pa.Array) -> pa.Array:
    raw, offsets = bytes_of(output)
    codes = np.zeros(len(form), dtype=np.int64)
    for k, name in enumerate(FORMS):
        codes[form.to_numpy(zero_copy_only=False) == name] = k
    parts = []
    for begin, end in _runs(offsets):
        lo, hi = offsets[begin], offsets[end]
        parts.append(_strings(*restore_bytes(raw[lo:hi], offsets[begin : end + 1] - lo, codes[begin:end])))
    return _whole(parts, pa.string())


def _with(frame: DataFrame, made: str, names: list[str]) -> DataFrame:
    """Columns of ``frame`` but those the struct ``made`` replaces, then its fields."""
    taken = {name.lower() for name in [made, *names]}
    held = [F.col(f"`{c}`") for c in frame.columns if c.lower() not in taken]
    return frame.select(*held, *[F.col(made)[name].alias(name) for name in names])


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
    fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT,
) -> DataFrame:
    """All rows with ``output``, ``form``, ``n`` (units), ``prefix_chars`` and ``middle_chars``."""
    common.ship(docs.sparkSession)
    udf = F.arrow_udf(_transformer((fim_percent, spm_percent)), _RESULT)
    made = common.own(docs, "made")
    text = common.text_or_empty(F.col(f"`{text_col}`"))
    rows = docs.withColumn(made, udf(text, *draws(F.col(f"`{id_col}`"), seed)))
    return _with(rows, made, ["output", "form", "n", "prefix_chars", "middle_chars"])


def restore(rows: DataFrame, output_col: str = "output", form_col: str = "form", out: str = "restored") -> DataFrame:
    """All rows with the text that each output was made of, read from output and form alone."""
    common.ship(rows.sparkSession)
    udf = F.arrow_udf(_restore, "string")
    output = common.text_or_empty(F.col(f"`{output_col}`"))
    return rows.withColumn(out, udf(output, F.coalesce(F.col(f"`{form_col}`"), F.lit(FORMS[0]))))
