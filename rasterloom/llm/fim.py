"""Fill-in-middle transformation with a sparse checkpoint index.

Units are a word with the white space before it, or white space at the end of a text. While the units of a text are counted, window
by window over its bytes, the byte and code-point offsets of every ``STRIDE``-th boundary are noted. Each of the two cuts is then found
by binary search among these checkpoints and a rescan of at most ``STRIDE`` units, so no list of units is ever held: beside the text
itself, memory is one window and two offsets for every ``STRIDE`` units.

Cuts and form are drawn from a hash of seed and doc_id, hence a repeated or retried row comes out the same.

Defined results: a null text counts as empty; an empty text, and one that contains a marker, stays as it is (``plain``). White space alone
is one unit. A null doc_id is hashed as the empty string; repeated rows and equal ids get equal draws. A text of any length is cut whole.
Extra columns, whatever their names, are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import raw_texts, released, text_slices

#: Units between two checkpoints; bytes that one step of counting or rescanning looks at.
STRIDE, WINDOW = 512, 1 << 18
#: Markers before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def unit_ends(data: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Ends, as byte offsets, of the units of UTF-8 ``data`` that end after ``start`` and not after ``stop``."""
    blank = _SPACE[data[start : stop + 1]]
    last = stop == len(data)
    ends = start + 1 + np.flatnonzero(~blank[:-1] & blank[1:])
    return np.append(ends, stop) if last and stop > start else ends


def code_points(data: np.ndarray) -> np.ndarray:
    """For each byte, whether a code point begins there."""
    return (data & 0xC0) != 0x80


class UnitIndex:
    """Units of one text: their number and sparse checkpoints (unit, byte, code point)."""

    def __init__(self, data: np.ndarray, stride: int = STRIDE, window: int = WINDOW):
        self.data, self.window = data, window
        units, at_byte, at_point = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        self.n = self.points = 0
        for start in range(0, len(data), window):
            stop = min(len(data), start + window)
            ends = unit_ends(data, start, stop)
            begun = np.cumsum(code_points(data[start:stop]))
            noted = ends[stride - 1 - self.n % stride :: stride]
            units.append(self.n + stride - self.n % stride + stride * np.arange(len(noted)))
            at_byte.append(noted)
            at_point.append(self.points + begun[noted - start - 1])
            self.n += len(ends)
            self.points += int(begun[-1])
        self.units, self.at_byte, self.at_point = map(np.concatenate, (units, at_byte, at_point))

    def locate(self, unit: int) -> tuple[int, int]:
        """Byte and code-point offset of the end of the first ``unit`` units."""
        if unit >= self.n:
            return len(self.data), self.points
        k = int(np.searchsorted(self.units, unit, "right")) - 1
        left, at, points = unit - int(self.units[k]), int(self.at_byte[k]), int(self.at_point[k])
        while left:
            stop = min(len(self.data), at + self.window)
            ends = unit_ends(self.data, at, stop)
            if len(ends) >= left:
                stop, left = int(ends[left - 1]), 0
            else:
                left -= len(ends)
            points += int(np.count_nonzero(code_points(self.data[at:stop])))
            at = stop
        return at, points


def draws(seed: int, doc_id) -> list[int]:
    """The first four 32-bit numbers of the SHA-256 of seed and id."""
    whole = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(whole[i : i + 8], 16) for i in range(0, 32, 8)]


def arrange(data: np.ndarray, h: list[int], percent: int, spm_percent: int, markers: tuple[bytes, bytes, bytes]) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, code points of prefix and middle (None if plain), and the output of one text."""
    index, text = UnitIndex(data), data.tobytes()
    if not text or h[2] % 100 >= percent or any(m in text for m in markers):
        return index.n, PLAIN, None, None, text
    first, second = sorted((h[0] % (index.n + 1), h[1] % (index.n + 1)))
    (a, a_points), (b, b_points) = index.locate(first), index.locate(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = markers
    if h[3] % 100 < spm_percent:
        return index.n, SPM, a_points, b_points - a_points, b"".join((s, suffix, p, prefix, m, middle))
    return index.n, PSM, a_points, b_points - a_points, b"".join((p, prefix, s, suffix, m, middle))


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80, markers: tuple[str, str, str] = MARKERS, text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n (units), form, prefix_chars, middle_chars, output. One scan, no shuffle.

    ``percent`` of the texts are rearranged, ``spm_percent`` of them with the suffix first.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    marks = tuple(m.encode() for m in markers)

    def cut(batches):
        for batch in batches:
            for part in text_slices(batch, text_col):
                body, offsets = raw_texts(part.column(text_col))
                rows = [arrange(body[a:b], draws(seed, i), percent, spm_percent, marks) for i, a, b in zip(part.column("doc_id").to_pylist(), offsets[:-1], offsets[1:])]
                n, form, before, inside, out = zip(*rows)
                columns = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(inside, pa.int64()), pa.array(out, pa.binary()).view(pa.string())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select("doc_id", text_col).mapInArrow(released(cut), f"doc_id {id_type}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored_text(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that ``output`` was made from. It holds no marker of its own, so each is found where it was put."""
    p, s, m = markers
    middle = F.substring_index(output, m, -1)

    def outer(lead: str, between: str) -> tuple[Column, Column]:
        both = F.substring_index(output.substr(F.lit(len(lead) + 1), F.length(output)), m, 1)
        return F.substring_index(both, between, 1), F.substring_index(both, between, -1)

    (psm_prefix, psm_suffix), (spm_suffix, spm_prefix) = outer(p, s), outer(s, p)
    return F.when(form == PSM, F.concat(psm_prefix, middle, psm_suffix)).when(form == SPM, F.concat(spm_prefix, middle, spm_suffix)).otherwise(output)


def fim_report(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    made = fill_in_middle(docs, text_col=text_col)
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored_text(F.col("output"), F.col("form"))).alias("restored_sha256"))
