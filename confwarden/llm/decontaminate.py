"""Benchmark decontamination: SimHash of item-sized windows, multi-index search, exact check."""

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from confwarden.llm import words as w
from confwarden.session import land, work_folder

BITS = 64
MATCH = "doc_id long, item_id long, first_word long, end_word long, similarity double"


def item_words(text):
    """Letters and digits only, A-Z lower-cased: punctuation and case hide no passage."""
    return w.hashes(text.translate(w.ALNUM).split())


def simhash(shingles):
    """64 bits: the sign of each bit's balance over all shingles, repeated ones counting again."""
    bits = np.unpackbits(np.ascontiguousarray(shingles).view(np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(bits)).view(np.uint64)[0]


def weighted_similarity(a, b):
    """Weighted Jaccard similarity of two counters of shingles."""
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


class HammingIndex:
    """Fingerprints by blocks: two that differ in ``radius`` bits or less agree in one block."""

    def __init__(self, radius):
        self.radius = radius
        self.edges = np.linspace(0, BITS, radius + 2).round().astype(int)
        self.blocks = [defaultdict(list) for _ in range(radius + 1)]
        self.prints = []

    def _keys(self, fingerprint):
        value = int(fingerprint)
        for i, (a, b) in enumerate(zip(self.edges[:-1], self.edges[1:], strict=True)):
            yield i, value >> int(a) & (1 << int(b - a)) - 1

    def add(self, fingerprint):
        for i, key in self._keys(fingerprint):
            self.blocks[i][key].append(len(self.prints))
        self.prints.append(int(fingerprint))

    def within(self, fingerprint):
        """All fingerprints within the radius, by their number."""
        some = {n for i, key in self._keys(fingerprint) for n in self.blocks[i].get(key, ())}
        return [n for n in some if (self.prints[n] ^ int(fingerprint)).bit_count() <= self.radius]


class Block:
    """Some benchmark items, prepared for search: shingles, and an index for each length."""

    def __init__(self, items, k, radius, least):
        self.k, self.least = k, least
        self.index, self.items = {}, defaultdict(list)
        owners = defaultdict(set)
        for item_id, text in items:
            h = item_words(text)
            if not len(h):
                continue
            size = min(k, len(h))
            grams = w.windows(h, size)
            self.index.setdefault(len(h), HammingIndex(radius)).add(simhash(grams))
            self.items[len(h)].append((item_id, Counter(grams.tolist())))
            for g in grams.tolist():
                owners[size, g].add(len(h))
        self.known = {}
        for size in sorted({s for s, _ in owners}):
            mine = sorted(g for s, g in owners if s == size)
            self.known[size] = np.array(mine, np.uint64), [sorted(owners[size, g]) for g in mine]
        self.filters = {s: self._filter(grams) for s, (grams, _) in self.known.items()}

    @staticmethod
    def _filter(grams):
        """A table that tells most other shingles apart at once."""
        bits = min(26, max(16, (len(grams) * 64).bit_length()))
        table = np.zeros(1 << bits, bool)
        table[grams >> np.uint64(64 - bits)] = True
        return np.uint64(64 - bits), table

    def matches(self, text):
        """``(item_id, first word, end word, similarity)``: the best window of each item found.

        Windows of which too few shingles occur in any item cannot be similar enough to one
        and are not fingerprinted; all others of the items' sizes are.
        """
        h = item_words(text)
        best = {}
        for size, (grams, owners) in self.known.items():
            if len(h) < size:
                continue
            mine = w.windows(h, size)
            shift, table = self.filters[size]
            hit = np.flatnonzero(table[mine >> shift])
            at = np.minimum(np.searchsorted(grams, mine[hit]), len(grams) - 1)
            same = grams[at] == mine[hit]
            hit, at = hit[same], at[same]
            if not len(hit):
                continue
            known = np.zeros(len(mine) + 1, np.int64)
            known[hit + 1] = 1
            known = np.cumsum(known)
            by_length = defaultdict(list)
            for p, a in zip(hit.tolist(), at.tolist(), strict=True):
                for length in owners[a]:
                    by_length[length].append(p)
            for length, places in by_length.items():
                span = min(length, len(h)) - size + 1  # shingles of a window
                last = len(mine) - span
                starts = np.unique(np.concatenate([np.arange(max(0, p - span + 1), min(p, last) + 1) for p in places]))
                starts = starts[known[starts + span] - known[starts] >= self.least * span]
                for s in starts.tolist():
                    window = mine[s : s + span]
                    for n in self.index[length].within(simhash(window)):
                        item_id, counts = self.items[length][n]
                        score = weighted_similarity(Counter(window.tolist()), counts)
                        key = (score, -s, -(s + span + size - 1))
                        if score >= self.least and key > best.get((length, n), (item_id, (0,)))[1]:
                            best[length, n] = item_id, key
        return sorted(
            ((item_id, -a, -b, round(score, 6)) for item_id, (score, a, b) in best.values()),
            key=lambda m: (m[0] is None, m),
        )


def _search(shared):
    def run(batches):
        block = Block(*shared.value)
        for batch in w.slices(batches, 1):
            found = [
                (i, *m) for i, text in enumerate(w.texts(batch.column(1))) for m in block.matches(text)
            ]
            rows, *columns = zip(*found, strict=True) if found else [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                [x.split()[0] for x in MATCH.split(", ")],
            )

    return run


def _blocks(items, block_bytes):
    block, size = [], 0
    for r in items.toLocalIterator():
        block.append((r.item_id, (r.text or "").encode()))
        size += len(block[-1][1]) + 64
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminated(spark, docs, benchmark, k=5, least=0.8, radius=18, block_bytes=1 << 23, id_col="doc_id", text_col="text"):
    """``doc_id, item_id, first_word, end_word, similarity`` of each benchmark item in a text.

    A window of as many words as an item has (the whole text, if that is shorter) matches the
    item if the weighted Jaccard similarity of their ``k``-word shingles is ``least`` or more;
    the best window of each pair of document and item is reported, the first of equals.
    Windows get a 64-bit SimHash; an index of ``radius`` + 1 blocks finds every item of that
    length within ``radius`` bits, and the similarity is then computed exactly.  A pair at the
    least similarity of 0.8 differs in about 10 bits, with a deviation of 3.

    The benchmark is the query set: it goes to tasks in blocks of ``block_bytes`` of text, one
    pass over the documents each, so what is broadcast is bounded whatever its size.  Items
    with fewer than ``k`` words have their sequence as one shingle; null and empty items and
    texts match nothing.  Repeated items and rows are reported like any others.
    """
    docs = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    parts = []
    for block in _blocks(items, block_bytes):
        if parts:  # more than one block: keep results, not blocks
            parts[-1] = land(parts[-1], work_folder(spark, "matches"))
        shared = spark.sparkContext.broadcast((block, k, radius, least))
        parts.append(docs.mapInArrow(_search(shared), MATCH))
    if not parts:
        return spark.createDataFrame([], MATCH)
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def drop_contaminated(spark, docs, benchmark, k=5, least=0.8, radius=18, block_bytes=1 << 23, text_col="text"):
    """The rows of ``docs`` in which ``contaminated`` finds no item, all columns, unmoved."""
    at = docs.columns.index(text_col)

    def without(shared):
        def run(batches):
            block = Block(*shared.value)
            for batch in w.slices(batches, at):
                clean = [not block.matches(text) for text in w.texts(batch.column(at))]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    out = docs
    for i, block in enumerate(_blocks(items, block_bytes)):
        if i:
            out = land(out, work_folder(spark, "clean"))
        out = out.mapInArrow(without(spark.sparkContext.broadcast((block, k, radius, least))), docs.schema)
    return out
