"""Spelling variants: a trie of letter-group counts, searched with one surplus and one deficit."""

from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from confwarden.llm import words as w
from confwarden.session import land, work_folder

#: Latin-1 bytes of the letters A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased; blanks for others.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 192 else 32 for b in range(256))

FLUSH = 400_000
#: Node pairs, and bytes of compared words, that a task handles at once.
PAIRS = 1 << 18
COMPARED = 1 << 23

HOME, SAME, LONGER = range(3)  # a word where it belongs; as a visitor of its own length, of the next


# Words ----------------------------------------------------------------------------------
def letter_runs(text):
    """The runs of letters of a text, lower-cased, as Latin-1 bytes; other characters part them."""
    return text.encode("latin-1", "replace").translate(LETTERS).split()


def _count(least, noise):
    """Partial counts of the words of texts, flushed at a fixed size."""

    def run(batches):
        counts = Counter()

        def flush():
            out = [pa.array([x.decode("latin-1") for x in counts], pa.string()), pa.array(list(counts.values()), pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(out, ["word", "n"])

        for batch in w.slices(batches, 1):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for x, n in Counter(letter_runs(text)).items():
                    if len(x) < least:
                        continue
                    if noise:
                        h = crc32(x if x.isascii() else x.decode("latin-1").encode(), start)
                        if h % noise == 0:
                            at = h % len(x)
                            x = x[:at] + x[at + 1 :]
                            if len(x) < least:
                                continue
                    counts[x] += n
                if len(counts) >= FLUSH:
                    yield flush()
        yield flush()

    return run


def word_counts(docs, least_chars=7, least_n=2, noise=0, id_col="doc_id", text_col="text"):
    """``word, n``: words of ``least_chars`` letters or more that occur ``least_n`` times or more.

    A word is a run of the letters A-Z, a-z, U+00C0 to U+00FF, A-Z lower-cased.  With ``noise``,
    a run whose CRC-32 together with the id it divides loses one letter, before all counting.
    Null texts have no words; a null id is hashed as an empty one.
    """
    counted = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_count(least_chars, noise), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


# The trie -------------------------------------------------------------------------------
def _letters(batches):
    total = np.zeros(256, np.int64)
    for batch in batches:
        joined = "".join(batch.column(0).to_pylist()).encode("latin-1")
        total += np.bincount(np.frombuffer(joined, np.uint8), minlength=256)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["letter", "n"])


def letter_levels(words, levels=20):
    """The level of each Latin-1 byte: letters dealt to groups of even counts, common ones first."""
    counts = words.select("word").mapInArrow(_letters, "letter int, n long").groupBy("letter").agg(F.sum("n").alias("n"))
    mass, group = [0] * levels, {}
    for r in counts.orderBy(F.desc("n"), "letter").collect():
        group[r.letter] = mass.index(min(mass))
        mass[group[r.letter]] += r.n
    rank = {g: i for i, g in enumerate(sorted(range(levels), key=lambda g: -mass[g]))}
    level = np.zeros(256, np.int64)
    for letter, g in group.items():
        level[letter] = rank[g]
    return level


def count_vectors(words, level, levels):
    """How many letters of each group each word (Latin-1 bytes) has."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    row = np.repeat(np.arange(len(words)), sizes)
    flat = level[np.frombuffer(b"".join(words), np.uint8)]
    return np.bincount(row * levels + flat, minlength=len(words) * levels).reshape(-1, levels).astype(np.int32), sizes


def descend(counts, at, key, side, state, level):
    """One level down the trie, to every child that the budget allows.

    Row ``at`` of ``counts`` stands at the node ``key``.  ``state`` counts what is spent: a
    visitor may go one above its own count once, and then, if it seeks its own length, one below
    once.  The surplus comes first, so two words of one length meet in one direction only.
    """
    own = counts[at, level]
    more = np.flatnonzero((side != HOME) & (state == 0))
    less = np.flatnonzero((side == SAME) & (state == 1) & (own > 0))
    rows = np.concatenate((np.arange(len(at)), more, less))
    value = np.concatenate((own, own[more] + 1, own[less] - 1))
    state = np.concatenate((state, state[more] + 1, state[less] + 1))
    return at[rows], np.column_stack((key[rows], value.astype(np.int32))), side[rows], state.astype(np.int8)


def _binary(key):
    """The rows of an integer matrix as an Arrow column of binaries."""
    flat = np.ascontiguousarray(key, np.int32)
    width = pa.binary(flat.shape[1] * 4)
    return pa.Array.from_buffers(width, len(flat), [None, pa.py_buffer(flat)]).cast(pa.binary())


NODE = "key binary, side tinyint, state tinyint, word string, n long"


def _placed(batch, words, at, key, side, state):
    taken = pa.array(at, pa.int64())
    columns = [_binary(key), pa.array(side.astype(np.int8)), pa.array(state)]
    return pa.RecordBatch.from_arrays([*columns, *(c.take(taken) for c in words)], ["key", "side", "state", "word", "n"])


def _place(level, levels, depth):
    """Each word at its own node of the given depth, and at all nodes it has to visit."""

    def run(batches):
        for batch in w.slices(batches, 0, most=1 << 20):
            words = [x.encode("latin-1") for x in batch.column(0).to_pylist()]
            counts, sizes = count_vectors(words, level, levels)
            n = len(words)
            at = np.tile(np.arange(n), 3)
            side = np.repeat(np.array([HOME, SAME, LONGER], np.int8), n)
            key = (sizes[at] + (side == LONGER)).astype(np.int32)[:, None]
            state = np.zeros(3 * n, np.int8)
            for d in range(depth):
                at, key, side, state = descend(counts, at, key, side, state, d)
            yield _placed(batch, batch.columns[:2], at, key, side, state)

    return run


def _deeper(level, levels, depth):
    """The rows of nodes of the given depth, one level further down."""

    def run(batches):
        for batch in w.slices(batches, 3, most=1 << 20):
            words = [x.encode("latin-1") for x in batch.column(3).to_pylist()]
            counts, _ = count_vectors(words, level, levels)
            key = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32).reshape(len(words), depth + 1)
            side, state = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            yield _placed(batch, batch.columns[3:5], *descend(counts, np.arange(len(words)), key, side, state, depth))

    return run


class Trie:
    """Sorted count vectors; the nodes of a depth are the runs of rows equal up to it."""

    def __init__(self, counts):
        self.order = np.lexsort(counts.T[::-1]) if counts.shape[1] else np.arange(len(counts))
        rows = counts[self.order]
        changed = np.logical_or.accumulate(rows[1:] != rows[:-1], axis=1)
        self.starts = [np.zeros(1, np.int64)]
        self.value, self.parent = [], []
        for d in range(counts.shape[1]):
            start = np.concatenate((np.zeros(1, np.int64), np.flatnonzero(changed[:, d]) + 1))
            self.value.append(rows[start, d].astype(np.int64))
            self.parent.append(np.searchsorted(self.starts[-1], start, side="right") - 1)
            self.starts.append(start)
        self.size = len(rows)

    def children(self, d, node):
        """First child and number of children of each node of depth ``d``."""
        first = np.searchsorted(self.parent[d], node)
        return first, np.searchsorted(self.parent[d], node, side="right") - first

    def leaves(self, node):
        start = self.starts[-1]
        end = np.append(start[1:], self.size)
        return start[node], end[node] - start[node]


def _spread(first, count):
    """The rows ``first`` .. ``first + count - 1`` of each range, and the range of each."""
    owner = np.repeat(np.arange(len(first)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[owner]


def search(visitors, homes, state, same_length):
    """Pairs of leaves within the budget, in blocks, depth first; both tries from their roots."""
    depth = len(homes.value)
    width = [int(max(v.max(), h.max())) + 3 for v, h in zip(visitors.value, homes.value, strict=True)]
    known = [p * k + v for p, v, k in zip(homes.parent, homes.value, width, strict=True)]
    root = np.zeros(1, np.int64)
    stack = [(0, root, root, np.full(1, state, np.int8))]
    while stack:
        d, a, b, spent = stack.pop()
        if len(a) > PAIRS:
            stack.append((d, a[PAIRS:], b[PAIRS:], spent[PAIRS:]))
            a, b, spent = a[:PAIRS], b[:PAIRS], spent[:PAIRS]
        if d == depth:
            yield a, b, spent
            continue
        owner, child = _spread(*visitors.children(d, a))
        target = b[owner] * width[d] + visitors.value[d][child]
        spent = spent[owner]
        found = []
        for change, may in ((0, None), (1, spent == 0), (-1, spent == 1 if same_length else None)):
            if change < 0 and not same_length:
                continue
            pick = np.arange(len(child)) if may is None else np.flatnonzero(may)
            wanted = target[pick] + change
            at = np.minimum(np.searchsorted(known[d], wanted), len(known[d]) - 1)
            hit = known[d][at] == wanted
            found.append((child[pick[hit]], at[hit], spent[pick[hit]] + (change != 0)))
        stack.append((d + 1, *(np.concatenate(x) for x in zip(*found, strict=True))))


def one_apart(short, long):
    """Which rows differ by one letter: replaced if the widths are equal, else inserted."""
    if short.shape[1] == long.shape[1]:
        return (short != long).sum(axis=1) == 1
    n = short.shape[1]
    ahead, behind = short == long[:, :-1], short == long[:, 1:]
    leading = np.where(ahead.all(axis=1), n, np.argmin(ahead, axis=1)) if n else np.zeros(len(short), np.int64)
    trailing = np.where(behind.all(axis=1), n, np.argmin(behind[:, ::-1], axis=1)) if n else leading
    return leading + trailing >= n


def _matrix(words):
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def near_pairs(words, side, state, counts):
    """Verified pairs ``(row of one, row of the other)`` among the rows of one node, each once.

    ``counts`` are the count vectors from the node's depth on.
    """
    homes = np.flatnonzero(side == HOME)
    if not len(homes):
        return
    home_words, home_trie = _matrix([words[i] for i in homes]), Trie(counts[homes])
    for kind in (SAME, LONGER):
        for spent in range(3):
            mine = np.flatnonzero((side == kind) & (state == spent))
            if not len(mine):
                continue
            own_words, own_trie = _matrix([words[i] for i in mine]), Trie(counts[mine])
            block = max(1, COMPARED // max(1, home_words.shape[1]))
            for a, b, ended in search(own_trie, home_trie, spent, kind == SAME):
                (a0, na), (b0, nb) = own_trie.leaves(a), home_trie.leaves(b)
                ends = np.cumsum(na * nb)
                for low in range(0, int(ends[-1]) if len(ends) else 0, block):
                    number = np.arange(low, min(low + block, int(ends[-1])))
                    pair = np.searchsorted(ends, number, side="right")
                    number -= (ends - na * nb)[pair]
                    x = own_trie.order[a0[pair] + number // nb[pair]]
                    y = home_trie.order[b0[pair] + number % nb[pair]]
                    near = np.flatnonzero(one_apart(own_words[x], home_words[y]))
                    x, y, pair = x[near], y[near], pair[near]
                    if kind == SAME and len(x):  # equal vectors meet in both directions
                        at = np.argmax(own_words[x] != home_words[y], axis=1)
                        once = (ended[pair] > 0) | (own_words[x, at] < home_words[y, at])
                        x, y = x[once], y[once]
                    yield mine[x], homes[y]


def _nearest(level, levels):
    """``word, near, best_n, best``: what one node (or block of one) adds to each word."""

    def run(key, table):
        depth = len(key[0].as_py()) // 4 - 1
        names = table.column("word").to_pylist()
        words = [x.encode("latin-1") for x in names]
        n = table.column("n").to_numpy()
        side, state = (table.column(c).to_numpy() for c in ("side", "state"))
        counts, _ = count_vectors(words, level, levels)
        rank = np.empty(len(words), np.int64)  # equal words have equal numbers, in code-point order
        number = {x: i for i, x in enumerate(sorted(set(words)))}
        rank[:] = [number[x] for x in words]
        near = np.zeros(len(number), np.int64)
        best = np.full(len(number), -1, np.int64)
        size = np.zeros(len(number), np.int64)
        size[rank] = n
        # Larger is better: a larger count, then a word that sorts earlier.
        merit = np.empty(len(number), np.int64)
        merit[np.lexsort((-np.arange(len(number)), size))] = np.arange(len(number))
        for a, b in near_pairs(words, side, state, counts[:, depth:]):
            a, b = rank[a], rank[b]
            for x, y in ((a, b), (b, a)):
                np.add.at(near, x, 1)
                np.maximum.at(best, x, merit[y])
        of_merit = np.argsort(merit)
        found = np.flatnonzero(near)
        chosen = of_merit[best[found]]
        ordered = sorted(number)
        text = lambda at: pa.array([ordered[i].decode("latin-1") for i in at], pa.string())
        return pa.table({"word": text(found), "near": near[found], "best_n": size[chosen], "best": text(chosen)})

    return run


def near_words(spark, words, levels=20, depth=2, most=400_000):
    """``word, n_near, best, best_n``: for each word with near ones how many, and the most frequent.

    ``words``: distinct ``word, n``.  Two words are near if they differ by one letter that is
    inserted, deleted or replaced.  Words stand in a trie: by length, then level by level by how
    many letters of each of ``levels`` groups they have.  A near word lies where one count is one
    higher (surplus) and, at equal length, one other is one lower (deficit), or where all are
    equal.  The trie's first ``depth`` levels are spread over the cluster: each word goes to its
    own node and to the nodes it must visit; below, tasks search depth first and compare
    the words of the leaves they reach.  Nodes of more than ``most`` rows are taken a level
    deeper until none is left; what is larger at the last level is dealt as pairs of blocks.
    """
    level = letter_levels(words, levels)
    placed = words.select("word", "n").mapInArrow(_place(level, levels, depth), NODE)
    placed = land(placed, work_folder(spark, "placed"))
    parts, found = [], "word string, near long, best_n long, best string"
    while True:
        sizes = placed.groupBy("key").agg(F.count("*").alias("rows"))
        large = land(sizes.where(F.col("rows") > most), work_folder(spark, "large-nodes"))
        if large.isEmpty():
            parts.append(placed.groupBy("key").applyInArrow(_nearest(level, levels), found))
            break
        small = placed.join(large, "key", "left_anti")
        parts.append(small.groupBy("key").applyInArrow(_nearest(level, levels), found))
        rest = placed.join(large, "key")
        if depth == levels:
            blocks = F.ceil(F.col("rows") * 2 / most).cast("int")
            own = F.pmod(F.xxhash64("word"), blocks).cast("int")
            every = F.explode(F.sequence(F.lit(0), blocks - 1))
            home = rest.where(F.col("side") == HOME).withColumns({"home_block": own, "visit_block": every})
            visit = rest.where(F.col("side") != HOME).withColumns({"home_block": every, "visit_block": own})
            dealt = home.unionByName(visit).drop("rows").groupBy("key", "home_block", "visit_block")
            parts.append(dealt.applyInArrow(_nearest(level, levels), found))
            break
        placed = land(rest.drop("rows").mapInArrow(_deeper(level, levels, depth), NODE), work_folder(spark, "placed"))
        depth += 1
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    top = F.min(F.struct((-F.col("best_n")).alias("n"), "best"))
    return (
        out.groupBy("word")
        .agg(F.sum("near").alias("n_near"), top.alias("top"))
        .select("word", "n_near", F.col("top.best").alias("best"), (-F.col("top.n")).alias("best_n"))
    )


def _roots(spark, links):
    """``word, root``: the last word of each chain of ``word, form``, by doubling what is known."""
    known = land(links.select("word", F.col("form").alias("root")), work_folder(spark, "roots"))
    while True:
        on = known.select(F.col("word").alias("via"), F.col("root").alias("further"))
        step = known.join(on, known["root"] == on["via"], "left")
        step = step.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        step = land(step, work_folder(spark, "roots"))
        known = step.drop("moved")
        if step.where("moved").isEmpty():
            return known


def spelling_variants(spark, words, ratio=10, **search):
    """``word, form, root, n, n_near, form_n`` of each row of ``words`` (distinct ``word, n``).

    ``form`` is the near word (see ``near_words``) of the largest n, of equals the first in
    code-point order, if that n is ``ratio`` times the word's or more; else null.  ``root`` is
    where the forms lead from the word, itself without one; n grows with each step, so chains are
    as long as the logarithm of the largest n.  No words give no rows.
    """
    words = land(words.select("word", F.col("n").cast("long")), work_folder(spark, "words"))
    joined = words.join(near_words(spark, words, **search), "word", "left")
    better = F.col("best_n") >= ratio * F.col("n")
    formed = joined.select(
        "word",
        F.when(better, F.col("best")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(better, F.col("best_n")).alias("form_n"),
    )
    formed = land(formed, work_folder(spark, "forms"))
    roots = _roots(spark, formed.where("form IS NOT NULL").select("word", "form"))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
