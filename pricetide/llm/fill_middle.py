"""Fill-in-middle: texts cut at code points or bytes by an index of the characters that are longer than a byte."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the marked form.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, SUFFIX_FIRST, PREFIX_FIRST = "plain", "spm", "psm"


class Exceptions:
    """The characters of more than one byte in a run of texts: their positions, and the bytes that they have in excess.

    Positions count over all texts, so one sorted index serves them all. Before, between and behind these characters
    bytes and code points differ by a constant, so that a cut is one search and one addition.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        """`data`: the UTF-8 bytes of all texts; `starts`: where each begins, and the end of the last."""
        lead = np.flatnonzero(data >= 0xC0)
        excess = np.cumsum(1 + (data[lead] >= 0xE0).astype(np.int64) + (data[lead] >= 0xF0))
        self.upto = np.concatenate([[0], excess])  # bytes in excess before each of them, and before the end
        self.bytes = lead  # where each of them begins, in bytes
        self.chars = lead - self.upto[:-1]  # and in code points
        self.starts = starts
        self.first = starts - self.upto[np.searchsorted(lead, starts)]  # the first code point of each text

    def lengths(self) -> np.ndarray:
        """Code points of each text."""
        return np.diff(self.first)

    def to_bytes(self, chars: np.ndarray) -> np.ndarray:
        """The byte of each text at which its given code point begins."""
        at = chars + self.first[:-1]
        return at + self.upto[np.searchsorted(self.chars, at)] - self.starts[:-1]

    def to_chars(self, places: np.ndarray) -> np.ndarray:
        """The code point of each text that its given byte is part of."""
        at = places + self.starts[:-1]
        behind = np.searchsorted(self.bytes, at)  # these begin before the byte; the last of them may reach beyond it
        last = np.maximum(behind - 1, 0)
        inside = (behind > 0) & (at < self.bytes[last] + 1 + self.upto[last + 1] - self.upto[last]) if len(self.bytes) else np.zeros(len(at), bool)
        plain = at - self.upto[behind]
        return np.where(inside, self.chars[last] if len(self.bytes) else 0, plain) - self.first[:-1]


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values one after another, and where each begins; a null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[starts[0] : starts[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, starts - (starts[0] if len(starts) else 0)


def _long(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)


def fill_in_middle(docs: DataFrame, cuts: tuple[Column, Column], form: Column, unit: str = "chars") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, prefix_bytes, middle_bytes, output) of every row of `docs`.

    The prefix ends at the smaller of the two `cuts`, the middle at the larger; they are taken modulo the length + 1 of
    the text, in code points or, by `unit` "bytes", in bytes, where a cut inside of a character goes to its begin.
    `form` asks for "psm" (<P>prefix<S>suffix<M>middle), "spm" (<S>suffix<P>prefix<M>middle) or "plain": the text as
    it is, which empty texts and texts that contain a marker always get. Without form, or plain, the four sizes are null.

    `output` is UTF-8, as binary; n counts code points. A null text is an empty one, a null cut is 0, a null form plain.
    Texts are cut whole, whatever their length; repeated rows each; other columns are not read. Text that is not valid
    UTF-8 is cut only where its lead bytes say so, and stays as it is byte by byte.
    """
    if unit not in ("chars", "bytes"):
        raise ValueError("unit is chars or bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield cut(batch)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, starts = _binary(batch.column("text"))
        index = Exceptions(data, starts)
        size = np.diff(starts)
        n = index.lengths()
        length = (n if unit == "chars" else size) + 1
        first, second = (np.mod(_long(batch.column(c)), length) for c in ("first", "second"))
        ends = np.minimum(first, second), np.maximum(first, second)
        chars = ends if unit == "chars" else tuple(map(index.to_chars, ends))
        a, b = map(index.to_bytes, chars)
        forms, outputs = [], []
        whole = memoryview(data)
        for start, end, i, j, asked in zip(starts[:-1].tolist(), starts[1:].tolist(), a.tolist(), b.tolist(), batch.column("form").to_pylist(), strict=True):
            text = bytes(whole[start:end])
            if asked not in (PREFIX_FIRST, SUFFIX_FIRST) or not text or any(marker in text for marker in (PREFIX, SUFFIX, MIDDLE)):
                forms.append(PLAIN)
                outputs.append(text)
                continue
            prefix, middle, suffix = text[:i], text[i:j], text[j:]
            parts = (PREFIX, prefix, SUFFIX, suffix) if asked == PREFIX_FIRST else (SUFFIX, suffix, PREFIX, prefix)
            forms.append(asked)
            outputs.append(b"".join((*parts, MIDDLE, middle)))
        plain = np.array([f == PLAIN for f in forms], bool)
        sizes = [pa.array(v, pa.int64(), mask=plain) for v in (chars[0], chars[1] - chars[0], a, b - a)]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(forms, pa.string()), *sizes, pa.array(outputs, pa.binary())],
            ["doc_id", "n", "form", "prefix_chars", "middle_chars", "prefix_bytes", "middle_bytes", "output"])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), cuts[0].cast("long").alias("first"),
        cuts[1].cast("long").alias("second"), form.cast("string").alias("form"))
    return rows.mapInArrow(
        run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, prefix_bytes long, middle_bytes long, output binary")


def rebuilt(output: bytes, form: str) -> bytes:
    """The text again. A marker stands where it first occurs: the parts have none, and none can begin or end in a part."""
    if form == PLAIN:
        return output
    opening, second = (PREFIX, SUFFIX) if form == PREFIX_FIRST else (SUFFIX, PREFIX)
    left, rest = output[len(opening) :].split(second, 1)
    right, middle = rest.split(MIDDLE, 1)
    prefix, suffix = (left, right) if form == PREFIX_FIRST else (right, left)
    return prefix + middle + suffix


def restore(made: DataFrame) -> DataFrame:
    """The rows of `made` with `text`, binary, rebuilt from `output` and `form` alone; a null output gives an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [rebuilt(o or b"", f) for o, f in zip(batch.column("output").to_pylist(), batch.column("form").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, "text"])

    made = made.drop("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema)
    return made.mapInArrow(run, f"{schema}, text binary")


def drawn_cuts(doc_id: Column, plain_percent: int = 10, suffix_first_percent: int = 20) -> tuple[tuple[Column, Column], Column]:
    """Cuts and form that follow from an id: groups of eight hex digits of the SHA-256 of `1:` and the id in decimals.
    A null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    form = F.when(h[2] % 100 >= 100 - plain_percent, PLAIN).when(h[3] % 100 < suffix_first_percent, SUFFIX_FIRST).otherwise(PREFIX_FIRST)
    return (h[0], h[1]), form
