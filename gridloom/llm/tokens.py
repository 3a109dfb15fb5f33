"""Token ids of public tokenizers, a word at a time.

The tokenizer drops white space and never joins what white space parts, so the ids of a text
are those of its blank-separated pieces in turn.  Pieces repeat: each worker keeps the ids of
those it has met, by their hashes, and asks the tokenizer only for new ones.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common
from gridloom.llm.words import blank, bytes_of, ends_of, hash_bytes

#: Pieces kept per worker, those of them that stay when there is no more room, and texts
#: whose new pieces are asked for at once.
KEPT_PIECES, FIRST_PIECES, TEXTS = 1_000_000, 300_000, 200
#: Runs of marks whose ids are kept per worker.
KEPT_MARKS = 10_000

_workers: dict[str, PieceIds] = {}
_letter = np.zeros(256, dtype=bool)
_letter[list(range(65, 91)) + list(range(97, 123))] = True


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 stands for
    itself, the other bytes in turn for the letters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + k for k, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()
_BYTE_LETTERS_END = chr(_BYTE_LETTERS[10])
#: Composed lower-case Latin letters, digits and ASCII marks without the apostrophe: the tokenizer
#: parts such pieces into runs of letters, single digits and runs of marks.
_LETTERS, _MARKS = "a-z\u00df-\u00f6\u00f8-\u00ff", r"!-&(-/:-@\[-`{-~"
_plain = re.compile(f"[{_LETTERS}0-9{_MARKS}]+")
_parts = re.compile(f"([{_LETTERS}]+)|[0-9]|[{_MARKS}]+")


class PieceIds:
    """16-bit ids of texts (UTF-8), put together from those of their pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary do not fit 16 bits")
        #: A hash table of pieces, 0 where it is free, and the row of each piece; the ids of a row
        #: stand in ``ids`` from ``begin`` of it to that of the next.
        self.slots, self.row = np.zeros(1 << 12, dtype=np.uint64), np.zeros(1 << 12, dtype=np.int32)
        self.rows, self.begin = 0, np.zeros(1, dtype=np.int64)
        self.ids = np.zeros(0, dtype="<u2")
        self.runs: dict[str, list[int]] = {}
        #: A comma or full stop after a letter (a-z, A-Z or one of U+00C0 to U+00FF) is a piece of
        #: its own to the tokenizer.
        self.marks = {c: np.frombuffer(self.ask([bytes([c])])[0], dtype="<u2") for c in b".,"}

    def _of_parts(self, text: str) -> array:
        """Ids of a piece of Latin letters, digits and marks, part by part."""
        out, split = array("H"), self.model.tokenize
        for part in _parts.finditer(text):
            run = part[0]
            if part[1]:
                word = run if run.isascii() else run.encode().decode("latin-1").translate(_BYTE_LETTERS)
                out.extend([t.id for t in split(word)])
                continue
            if run not in self.runs:
                if len(self.runs) >= KEPT_MARKS:
                    self.runs.clear()
                self.runs[run] = [t.id for t in split(run)]
            out.extend(self.runs[run])
        return out

    def ask(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece.  Words of nothing but lower-case letters, composed as the tokenizer
        composes them, go straight to its model, and so do the parts of words with digits and
        marks; all others by one call, where line ends part them as blanks do."""
        out: list[bytes | None] = [None] * len(pieces)
        odd, split = [], self.model.tokenize
        # Line ends stand in no piece: all pieces are translated at once.
        letters = b"\n".join(pieces).decode("latin-1").translate(_BYTE_LETTERS).split(_BYTE_LETTERS_END)
        for k, piece in enumerate(pieces):
            if piece.isalpha() and piece.islower():
                out[k] = array("H", [t.id for t in split(letters[k])]).tobytes()
                continue
            text = piece.decode("utf-8", "replace")
            if text.isalpha() and text.islower() and max(text) < "\u0180":
                # Latin letters: one code point each, and lower case stays as it is.
                out[k] = array("H", [t.id for t in split(letters[k])]).tobytes()
            elif _plain.fullmatch(text) and "<|" not in text:
                out[k] = self._of_parts(text).tobytes()
            else:
                odd.append(k)
        if odd:
            texts = [pieces[k].decode("utf-8", "replace") for k in odd]
            found = self.tokenizer.encode("\n".join(texts), add_special_tokens=False)
            ids = np.array(found.ids, dtype="<u2")
            ends = np.cumsum([len(t) + 1 for t in texts])
            at = np.searchsorted(ends, np.array(found.offsets, dtype=np.int64).reshape(-1, 2)[:, 0], "right")
            cuts = np.searchsorted(at, np.arange(len(odd) + 1))
            for k, a, b in zip(odd, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                out[k] = ids[a:b].tobytes()
        return out

    def _slots_of(self, hashes: np.ndarray) -> np.ndarray:
        """Where the table has each hash, or a free place if it has not."""
        mask = len(self.slots) - 1
        at = (hashes & np.uint64(mask)).astype(np.int64)
        held = self.slots[at]
        on = np.flatnonzero((held != hashes) & (held != 0))
        while len(on):
            at[on] = (at[on] + 1) & mask
            held = self.slots[at[on]]
            on = on[(held != hashes[on]) & (held != 0)]
        return at

    def _enter(self, hashes: np.ndarray, rows: np.ndarray) -> None:
        """Enter distinct hashes that the table does not have."""
        while len(hashes):
            at = self._slots_of(hashes)
            self.slots[at] = hashes  # of those that would have one place the last does
            own = self.slots[at] == hashes
            self.row[at[own]] = rows[own]
            hashes, rows = hashes[~own], rows[~own]

    def _lay_out(self, size: int, keep: int) -> None:
        """A table of another size with the pieces of the first rows."""
        own = (self.slots != 0) & (self.row < keep)
        hashes, rows = self.slots[own], self.row[own]
        self.slots, self.row = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.int32)
        self._enter(hashes, rows)

    def learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        found = self.ask(pieces)
        ends = self.begin[self.rows] + np.cumsum([len(f) // 2 for f in found])
        first, self.rows = self.rows, self.rows + len(found)
        if len(self.begin) <= self.rows:
            self.begin = np.concatenate([self.begin, np.zeros(max(self.rows, 1 << 12), dtype=np.int64)])
        self.begin[first + 1 : self.rows + 1] = ends
        if len(self.ids) < ends[-1]:
            self.ids = np.concatenate([self.ids, np.zeros(max(int(ends[-1]), 1 << 14), dtype="<u2")])
        self.ids[self.begin[first] : ends[-1]] = np.frombuffer(b"".join(found), dtype="<u2")
        size = len(self.slots)
        while size < 2 * self.rows:
            size *= 2
        if size > len(self.slots):
            self._lay_out(size, first)
        self._enter(hashes, np.arange(first, self.rows, dtype=np.int32))

    def room(self) -> None:
        """Forget all but the pieces that came first: they come often."""
        if self.rows > KEPT_PIECES:
            self.rows = FIRST_PIECES
            self._lay_out(len(self.slots), self.rows)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a binary column in turn, and how many each text has."""
        whole, offsets = bytes_of(column)
        texts = len(offsets) - 1
        if not len(whole):
            return np.zeros(0, dtype="<u2"), np.zeros(texts, dtype=np.int64)
        last = np.ones(len(whole), dtype=bool)
        last[:-1] = blank[whole[1:]]
        last[offsets[1:][offsets[1:] > 0] - 1] = True
        opens = np.zeros(len(whole) + 1, dtype=bool)
        opens[offsets] = True
        ended = np.flatnonzero(last & ((whole == 46) | (whole == 44)))
        one, two = whole[np.maximum(ended - 1, 0)], whole[np.maximum(ended - 2, 0)]
        wide = (two == 0xC3) & (one != 0x97) & (one != 0xB7) & (ended > 1) & ~opens[np.maximum(ended - 1, 0)]
        ended = ended[(ended > 0) & ~opens[ended] & (_letter[one] | wide)]
        raw = whole.copy()
        raw[ended] = 32
        hashes, counts, first = hash_bytes(raw, offsets)
        if not len(first):
            return np.zeros(0, dtype="<u2"), np.zeros(texts, dtype=np.int64)
        # The tokenizer's own marks, such as <|endoftext|>, are read in the case they are written in.
        marked = np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124))
        exact = np.unique(np.searchsorted(first, marked, "right") - 1) if len(marked) else marked
        if len(exact):
            ends = ends_of(raw, first[exact], offsets)
            own = [xxhash.xxh64_intdigest(raw[a:b].tobytes(), seed=9) for a, b in zip(first[exact], ends, strict=True)]
            hashes[exact] = np.array(own, dtype=np.uint64)
        hashes[hashes == 0] = 1
        slot = self._slots_of(hashes)
        new = np.flatnonzero(self.slots[slot] != hashes)
        if len(new):
            word, place = np.unique(hashes[new], return_index=True)
            begin = first[new[place]]
            end = ends_of(raw, begin, offsets)
            pieces = [raw[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
            self.learn(word, [p if b"<|" in p else p.lower() for p in pieces])
            slot = self._slots_of(hashes)
        row = self.row[slot]
        size = self.begin[row + 1] - self.begin[row]
        extra = np.zeros(len(first), dtype=np.int64)
        with_mark = np.searchsorted(first, ended, "right") - 1
        extra[with_mark] = 1
        stop = np.cumsum(size + extra)
        out = np.empty(int(stop[-1]), dtype="<u2")
        inside = np.ones(len(out), dtype=bool)
        for c, ids in self.marks.items():
            own = stop[with_mark[whole[ended] == c]] - 1
            out[own], inside[own] = ids[0], False
        from_ = np.repeat(self.begin[row] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        out[inside] = self.ids[from_]
        text_of = np.repeat(np.arange(texts), counts)
        self.room()
        return out, np.bincount(text_of, weights=size + extra, minlength=texts).astype(np.int64)


def with_ids(
    docs: DataFrame, text_col: str, vocabulary: str, end: int | None = None, shift: int = 0
) -> DataFrame:
    """``docs`` without the text, with binary ``ids``: 16-bit ids plus ``shift``, then ``end``."""
    common.ship(docs.sparkSession)
    keep = [c for c in docs.columns if c != text_col]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).cast("binary").alias("ids"))
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Workers serve many tasks: what one has learned the next can use.
        if vocabulary not in _workers:
            _workers[vocabulary] = PieceIds(vocabulary)
        pieces = _workers[vocabulary]
        for batch in batches:
            for begin in range(0, len(batch), TEXTS):
                part = batch.slice(begin, TEXTS)
                ids, counts = pieces.encode(part.column(len(keep)))
                ids = ids + np.uint16(shift)
                if end is not None:
                    ids = np.insert(ids, np.cumsum(counts), np.uint16(end))
                    counts = counts + 1
                offsets = np.concatenate([[0], np.cumsum(counts) * 2])
                binary = pa.Array.from_buffers(
                    pa.large_binary(), len(part), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids.astype("<u2"))]
                ).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], binary], names=batch.schema.names)

    return rows.mapInArrow(encode, rows.schema)
