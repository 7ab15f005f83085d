"""Fill-in-the-middle: a wavelet matrix over character classes counts units and finds both cuts."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from confwarden.llm import words as w

NEWLINE, SPACE, LETTER, DIGIT, STOP, MARK, CONTROL, OTHER = range(8)
LEVELS = 3

#: Which class of character ends a unit.
UNITS = {
    "line": (NEWLINE,),
    "sentence": (NEWLINE, STOP),
    "word": (NEWLINE, SPACE),
    "char": tuple(range(8)),
}
MARKS = ("<P>", "<S>", "<M>")

_CLASS_OF = np.full(256, OTHER, np.uint8)
for _class, _bytes in (
    (CONTROL, range(32)),
    (MARK, range(32, 128)),
    (SPACE, b" \t\r\x0b\f"),
    (NEWLINE, b"\n"),
    (LETTER, [*range(65, 91), *range(97, 123)]),
    (DIGIT, range(48, 58)),
    (STOP, b".!?"),
):
    _CLASS_OF[list(_bytes)] = _class


def character_classes(data):
    """The class of each code point of UTF-8 bytes; outside ASCII it is OTHER."""
    raw = np.frombuffer(data, np.uint8)
    return _CLASS_OF[raw[(raw & 0xC0) != 0x80]]


class BitVector:
    """Bits in 64-bit words with the number of ones before each word."""

    def __init__(self, bits):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def ones(self, at):
        """How many ones stand before each place."""
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << rest) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)


class WaveletMatrix:
    """Rank over a sequence of classes below 8, about two bits a level and character."""

    def __init__(self, classes):
        self.levels = []
        for level in reversed(range(LEVELS)):
            bits = (classes >> level & 1).astype(bool)
            vector = BitVector(bits)
            self.levels.append((vector, len(bits) - int(vector.before[-1])))
            classes = np.concatenate((classes[~bits], classes[bits]))  # a stable partition

    def rank(self, kind, at):
        """How often the class ``kind`` occurs before each place of ``at``."""
        start, end = np.zeros_like(at), at
        for level, (vector, zeros) in zip(reversed(range(LEVELS)), self.levels, strict=True):
            ones = vector.ones(start), vector.ones(end)
            if kind >> level & 1:
                start, end = zeros + ones[0], zeros + ones[1]
            else:
                start, end = start - ones[0], end - ones[1]
        return end - start

    def boundaries(self, kinds, at):
        """How many characters of any of the classes stand before each place: ranks, summed."""
        return sum(self.rank(kind, at) for kind in kinds)

    def reach(self, kinds, begin, end, wanted):
        """The first place at which ``wanted`` boundaries lie behind ``begin``, else ``end``.

        Bisection on the ranks, for all texts of the sequence at once.
        """
        low, high = begin.copy(), end.copy()
        before = self.boundaries(kinds, begin)
        while (low < high).any():
            middle = (low + high) >> 1
            enough = self.boundaries(kinds, middle) - before >= wanted
            high = np.where(enough, middle, high)
            low = np.where(enough, low, np.minimum(middle + 1, high))
        return low


def _draws(seed, doc_id):
    """Four unsigned 32-bit integers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def _cut(kinds, seed, rate, spm, marks):
    prefix_mark, suffix_mark, middle_mark = marks

    def run(batches):
        for batch in w.slices(batches, 1):
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            classes = character_classes("".join(texts).encode())
            end = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
            begin = np.concatenate((np.zeros(1, np.int64), end[:-1]))
            matrix = WaveletMatrix(classes)
            units = matrix.boundaries(kinds, end) - matrix.boundaries(kinds, begin)
            filled = end > begin
            ended = np.zeros(len(end), bool)
            ended[filled] = np.isin(classes[end[filled] - 1], kinds)
            units += filled & ~ended
            draws = [_draws(seed, i) for i in ids]
            picks = np.array([[h[0] % (n + 1), h[1] % (n + 1)] for h, n in zip(draws, units.tolist(), strict=True)])
            picks = np.sort(picks.reshape(-1, 2).astype(np.int64), axis=1)
            first, second = (matrix.reach(kinds, begin, end, picks[:, i]) - begin for i in (0, 1))
            rows = []
            for text, h, a, b in zip(texts, draws, first.tolist(), second.tolist(), strict=True):
                if not text or any(m in text for m in marks) or h[2] % 100 >= rate:
                    rows.append(("plain", None, None, text))
                    continue
                prefix, middle, suffix = text[:a], text[a:b], text[b:]
                if h[3] % 100 < spm:
                    form, out = "spm", (suffix_mark, suffix, prefix_mark, prefix, middle_mark, middle)
                else:
                    form, out = "psm", (prefix_mark, prefix, suffix_mark, suffix, middle_mark, middle)
                rows.append((form, a, b - a, "".join(out)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            types = (pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(units),
                    *(pa.array(c, t) for c, t in zip(columns, types, strict=True)),
                    *batch.columns[2:],
                ],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", *batch.schema.names[2:]],
            )

    return run


def fill_in_middle(
    docs, unit="line", seed=7, rate=100, spm=50, marks=MARKS, carry=(), id_col="doc_id", text_col="text"
):
    """``doc_id, n, form, prefix_chars, middle_chars, output`` (and ``carry``) of each row of ``docs``.

    A text is cut into ``n`` units, each ending with a character of the classes in
    ``UNITS[unit]`` or at the end of the text.  Hashes of the seed and the id draw two numbers of
    units, after which the prefix and the middle end; all draws depend on them alone, so a
    rerun gives the same rows.  ``rate`` per cent of the texts are transformed, of these ``spm``
    per cent suffix first; ``output`` has the marks (three different ones that start with a
    character they have nowhere else) before the parts.

    The classes of the texts of a slice of rows make one wavelet matrix; sums of its ranks count
    units, bisection on them finds the cuts, also in texts of any length.

    Null texts are empty.  An empty text, or one that contains a mark, stays ``plain``: the
    output is the text and the numbers of characters are null.  A null id is hashed as an empty
    one and stays null; rows that repeat get the same cuts.  No rows give no rows.
    """
    names = {c: f"carried_{i}" for i, c in enumerate(carry)}
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(n) for c, n in names.items()]
    )
    kept = "".join(f", {n} {rows.schema[n].dataType.simpleString()}" for n in names.values())
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string" + kept
    out = rows.mapInArrow(_cut(UNITS[unit], seed, rate, spm, marks), schema)
    return out.withColumnsRenamed({n: c for c, n in names.items()})


def restore(form, output, marks=MARKS):
    """The text, as a column, from the columns of its form and output.

    No part contains a mark, so the first place of each is where it was put.
    """
    form, output = (F.col(c) if isinstance(c, str) else c for c in (form, output))
    prefix, suffix, middle = marks

    def between(first, last):
        start = F.locate(first, output) + len(first)
        return F.substring(output, start, F.locate(last, output) - start)

    tail = F.substring(output, F.locate(middle, output) + len(middle), F.length(output))
    psm = F.concat(between(prefix, suffix), tail, between(suffix, middle))
    spm = F.concat(between(prefix, middle), tail, between(suffix, prefix))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
