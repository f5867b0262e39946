"""Fill-in-the-middle by a piece table: cut, permute, restore, without touching the text.

A document is an immutable text buffer; the sentinels are a second one.  A piece
table holds descriptors (buffer, start, end).  Cutting splits a descriptor, an
arrangement permutes the descriptors, the inverse permutation restores them, and
digests are taken by streaming over them.  Only `fill_in_middle` joins the pieces,
when the new text is wanted.

Texts are cut between units: runs of ASCII letters, or one other code point.  The
cuts, the form and whether a text is left plain come from a digest of ``salt`` and
the id, so a document is always cut alike.

Defined results: a null text is empty; an empty text, and one that holds a sentinel
already, is plain; a null id is drawn from the digest of the salt alone; rows that
share an id and differ in text draw the same numbers, each for its own length; very
long texts are counted window by window, so beyond the text itself a task holds a
few megabytes; an empty table gives no rows.  Other columns pass through, whatever
their names: new columns that clash get a trailing underscore.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.tables import Batches, as_bytes, fresh

# The sentinels, and where each stands in their buffer.
SENTINELS = b"<P><S><M>"
MARKS = (b"<P>", b"<S>", b"<M>")
# Pieces before arranging: prefix, middle, suffix, then the three sentinels.
ORDERS = {"psm": (3, 0, 4, 2, 5, 1), "spm": (4, 2, 3, 0, 5, 1)}
TEXT, MARK = 0, 1
WINDOW = 1 << 20  # bytes whose units are found together
BATCH = 16 << 20  # bytes of text in one returned batch


class Piece(NamedTuple):
    buffer: int
    start: int
    end: int


class PieceTable:
    """Descriptors over immutable buffers."""

    def __init__(self, *buffers: bytes):
        self.buffers = [memoryview(b) for b in buffers]
        self.pieces = [Piece(TEXT, 0, len(buffers[TEXT]))]

    def cut(self, number: int, offset: int) -> None:
        """Split descriptor ``number`` after ``offset`` of its bytes; a side may be empty."""
        buffer, start, end = self.pieces[number]
        at = start + offset
        self.pieces[number : number + 1] = [Piece(buffer, start, at), Piece(buffer, at, end)]

    def arrange(self, order: tuple[int, ...]) -> None:
        self.pieces = [self.pieces[i] for i in order]

    def stream(self) -> Iterator[memoryview]:
        for buffer, start, end in self.pieces:
            yield self.buffers[buffer][start:end]

    def digest(self) -> str:
        found = hashlib.sha256()
        for part in self.stream():
            found.update(part)
        return found.hexdigest()

    def content(self) -> bytes:
        return b"".join(self.stream())


def inverse(order: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(order.index(i) for i in range(len(order)))


def _heads(data: np.ndarray) -> np.ndarray:
    """Which bytes begin a code point."""
    return (data & 0xC0) != 0x80


def _letters(data: np.ndarray) -> np.ndarray:
    lower = data | 0x20
    return (lower >= ord("a")) & (lower <= ord("z"))


class Units:
    """The units of a text: how many, and where each begins."""

    def __init__(self, text: bytes):
        self.data = np.frombuffer(text, np.uint8)
        self.counts = [np.count_nonzero(self._starts(at)) for at in range(0, len(self.data), WINDOW)]
        self.n = int(sum(self.counts))

    def _starts(self, at: int) -> np.ndarray:
        window = self.data[at : at + WINDOW]
        letter = _letters(window)
        joined = letter.copy()
        joined[1:] &= letter[:-1]
        joined[0] &= bool(at) and bool(_letters(self.data[at - 1 : at])[0])
        return _heads(window) & ~joined

    def offset(self, unit: int) -> int:
        """Byte at which unit number ``unit`` begins; the length of the text after the last."""
        for number, count in enumerate(self.counts):
            if unit < count:
                return number * WINDOW + int(np.flatnonzero(self._starts(number * WINDOW))[unit])
            unit -= count
        return len(self.data)


def code_points(text: bytes, start: int, end: int) -> int:
    data = np.frombuffer(text, np.uint8)
    return sum(int(np.count_nonzero(_heads(data[at : min(at + WINDOW, end)]))) for at in range(start, end, WINDOW))


class Cut(NamedTuple):
    """What was done to a document; characters are null for a plain one."""

    form: str
    units: int
    prefix_chars: int | None
    middle_chars: int | None
    table: PieceTable


def draws(salt: str, doc_id) -> list[int]:
    """Four numbers of 32 bits for a document."""
    digest = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def cut_document(text: bytes, doc_id, salt: str = "1", plain: int = 10, spm: int = 20) -> Cut:
    """Cut and arrange one document: ``plain`` of 100 stay as they are, ``spm`` of 100 others begin with the suffix."""
    units = Units(text)
    table = PieceTable(text, SENTINELS)
    one, two, three, four = draws(salt, doc_id)
    if not text or three % 100 >= 100 - plain or any(m in text for m in MARKS):
        return Cut("plain", units.n, None, None, table)
    first, last = sorted((one % (units.n + 1), two % (units.n + 1)))
    start, end = units.offset(first), units.offset(last)
    table.cut(0, start)
    table.cut(1, end - start)
    table.pieces += [Piece(MARK, i, i + 3) for i in (0, 3, 6)]
    form = "spm" if four % 100 < spm else "psm"
    table.arrange(ORDERS[form])
    return Cut(form, units.n, code_points(text, 0, start), code_points(text, start, end), table)


def restored(output: bytes, form: str) -> PieceTable:
    """The original text as pieces of the output: cut out what stands between sentinels, undo the order.

    No cut text holds a sentinel, and none can arise across a cut, since sentinels
    begin with ``<`` and hold no other: the first found is the right one.
    """
    table = PieceTable(output)
    if form == "plain":
        return table
    order = ORDERS[form]
    done = 0
    for number, piece in enumerate(order[::2]):
        at = output.index(MARKS[piece - 3], done)
        # The last descriptor holds the rest: split it before and after the sentinel.
        if number:
            table.cut(len(table.pieces) - 1, at - done)
        table.cut(len(table.pieces) - 1, 3)
        done = at + 3
    table.arrange(inverse(order)[:3])
    return table


NEW = ("fim_form", "fim_units", "fim_prefix_chars", "fim_middle_chars", "fim_text", "fim_sha256")
_TYPES = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of rows with about ``BATCH`` bytes of text."""
    first = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= BATCH:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _column(values: list, kind: pa.DataType) -> pa.Array:
    if kind == pa.string() and values and isinstance(values[0], bytes):
        return pa.array(values, pa.binary()).cast(pa.string())
    return pa.array(values, kind)


def new_columns(docs: DataFrame) -> dict[str, str]:
    """The names that `fill_in_middle` gives its columns on ``docs``."""
    return {name: fresh(docs, name) for name in NEW}


def fill_in_middle(docs: DataFrame, salt: str = "1", plain: int = 10, spm: int = 20) -> DataFrame:
    """``docs`` (doc_id, text, ...) with form, units, code points of prefix and middle, the new text and its digest."""
    names = list(new_columns(docs).values())
    kinds = (T.StringType(), T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.StringType())
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds, strict=True))])
    at_id, at_text = docs.columns.index("doc_id"), docs.columns.index("text")

    def kernel(batches: Batches) -> Batches:
        for batch in batches:
            texts, ids = as_bytes(batch.column(at_text)), batch.column(at_id).to_pylist()
            for first, end in _slices(texts):
                rows = []
                for i in range(first, end):
                    cut = cut_document(texts[i], ids[i], salt, plain, spm)
                    rows.append((*cut[:2], cut.prefix_chars, cut.middle_chars, cut.table.content(), cut.table.digest()))
                made = [_column(list(c), k) for c, k in zip(zip(*rows, strict=True), _TYPES, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(first, end - first).columns, *made], names=schema.names)

    return docs.mapInArrow(kernel, schema)


def restore(cut: DataFrame, form: str = "fim_form", text: str = "fim_text") -> DataFrame:
    """``cut`` with its column ``text`` turned back into the original, and ``restored_sha256`` streamed over it."""
    digest = fresh(cut, "restored_sha256")
    schema = T.StructType([*cut.schema.fields, T.StructField(digest, T.StringType())])
    at_form, at_text = cut.columns.index(form), cut.columns.index(text)

    def kernel(batches: Batches) -> Batches:
        for batch in batches:
            texts, forms = as_bytes(batch.column(at_text)), batch.column(at_form).to_pylist()
            for first, end in _slices(texts):
                tables = [restored(texts[i], forms[i]) for i in range(first, end)]
                columns = batch.slice(first, end - first).columns
                columns[at_text] = _column([t.content() for t in tables], pa.string())
                columns.append(pa.array([t.digest() for t in tables], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return cut.mapInArrow(kernel, schema)


def fim_report(docs: DataFrame, salt: str = "1", plain: int = 10, spm: int = 20) -> DataFrame:
    """One row per document: units, form, lengths, digests of the new text and of the text restored from it."""
    cut = fill_in_middle(docs.select("doc_id", "text"), salt, plain, spm).drop("text")
    return restore(cut).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("fim_units").alias("n"),
        F.col("fim_form").alias("form"),
        F.col("fim_prefix_chars").alias("prefix_chars"),
        F.col("fim_middle_chars").alias("middle_chars"),
        F.col("fim_sha256").alias("output_sha256"),
        "restored_sha256",
    )
