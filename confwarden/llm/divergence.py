"""Quality rules: Jensen-Shannon distance of a document to the references of its language."""

import json
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from confwarden.llm import words as w
from confwarden.session import land, work_folder

#: Character classes, in the order of the histograms.
CLASSES = ("lower", "upper", "digit", "space", "punctuation", "symbol", "other")
PUNCTUATION = b".,;:!?'\"()-"
_SPACE = b" \t\n\r\x0b\f"
_SYMBOLS = b"#*$%&|<>"

_CLASS_OF = np.full(256, 5, np.uint8)
for _index, _bytes in (
    (0, range(97, 123)),
    (1, range(65, 91)),
    (2, range(48, 58)),
    (3, _SPACE),
    (4, PUNCTUATION),
    (6, range(192, 256)),
):
    _CLASS_OF[list(_bytes)] = _index
_CLASS_OF[128:192] = 7  # the rest of a character that has been counted
_CONTINUATION = bytes(range(128, 192))

FLUSH = 200_000
#: References that a task holds unpacked at once.
HELD = 1000
#: Lengths in words at which chance is measured, and how many draws each.
LENGTHS = (10, 20, 30, 50, 80, 120, 200, 400, 1000, 10_000)
DRAWS = 100


def histogram(text):
    """Characters of each class; a character outside ASCII is of class other."""
    return np.bincount(_CLASS_OF[np.frombuffer(text, np.uint8)], minlength=8)[:7]


def common_form(text):
    """Words as the common-word histograms count them: letters and digits, lower-cased."""
    return text.translate(w.ALNUM).split()


def distance(p, q):
    """Jensen-Shannon distance (base 2, 0 to 1) of two histograms."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return math.sqrt(max(0.0, parts.sum() / 2))


def repeated_words(words, k=5):
    """Words inside runs of ``k`` words that occur at least twice in the text."""
    n = len(words) - k + 1
    if n < 2:
        return 0
    ids = {}
    ids = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    rank = ids
    for step in range(1, k):  # exact: ranks of runs of step words, extended by one word
        pair = rank[: len(words) - step] * np.int64(len(words)) + ids[step:]
        _, rank, count = np.unique(pair, return_inverse=True, return_counts=True)
        if count.max() < 2:
            return 0
    covered = np.zeros(len(words) + 1, np.int64)
    start = np.flatnonzero(count[rank] > 1)
    np.add.at(covered, start, 1)
    np.add.at(covered, start + k, -1)
    return int((np.cumsum(covered) > 0).sum())


def base_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text (UTF-8)."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text.translate(None, _SPACE + _CONTINUATION)),
        len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def _count(batches):
    """Partial counts by language: kind 0 words, 1 character classes, 2 all words.

    What is held is flushed at a fixed size, so a task's memory does not grow with its input.
    """
    counts, held = defaultdict(Counter), 0

    def flush():
        rows = [(l, k, x, n) for (l, k), c in counts.items() for x, n in c.items()]
        counts.clear()
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        types = (pa.string(), pa.int32(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["lang", "kind", "item", "n"]
        )

    for batch in w.slices(batches, 1):
        for lang, text in zip(batch.column(0).to_pylist(), w.texts(batch.column(1)), strict=True):
            words = common_form(text)
            mine = counts[lang, 0]
            before = len(mine)
            mine.update(words)
            held += len(mine) - before
            counts[lang, 2][b""] += len(words)
            counts[lang, 1].update({b"%d" % i: int(n) for i, n in enumerate(histogram(text)) if n})
            if held >= FLUSH:
                yield flush()
                held = 0
    yield flush()


def _pack(batches):
    """The parts of each reference as one short binary, ordered so that equal ones are equal."""
    for batch in batches:
        packed = []
        for parts in batch.column(1).to_pylist():
            rows = sorted((p["kind"], p["item"].decode("latin-1"), p["n"]) for p in parts)
            packed.append(zlib.compress(json.dumps(rows).encode()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["lang", "reference"])


def language_references(docs, share=0.002, least_words=1000, lang_col="lang", text_col="text"):
    """``lang, reference`` of each language: its common words and its character classes.

    Counts cover every row.  A common word makes up ``share`` of its language's words at
    least, so a language has at most 1 / share of them; a language has a reference if it has
    ``least_words`` words, whatever else ``docs`` holds.  The references stay a table.  A language
    with fewer words has none: 1,000 words give a word of the least share two occurrences.
    """
    spark = docs.sparkSession
    counts = land(
        docs.where(F.col(lang_col).isNotNull())
        .select(F.col(lang_col).cast("string"), F.col(text_col))
        .mapInArrow(_count, "lang string, kind int, item binary, n long")
        .groupBy("lang", "kind", "item")
        .agg(F.sum("n").alias("n")),
        work_folder(spark, "counts"),
    )
    # A small table of its own: Spark sees its size and need not deal the counts by language.
    totals = counts.where((F.col("kind") == 2) & (F.col("n") >= least_words))
    totals = land(totals.select("lang", F.col("n").alias("total")), work_folder(spark, "totals"))
    kept = counts.join(totals, "lang").where((F.col("kind") != 0) | (F.col("n") >= share * F.col("total")))
    parts = kept.groupBy("lang").agg(F.collect_list(F.struct("kind", "item", "n")).alias("parts"))
    return land(parts.mapInArrow(_pack, "lang string, reference binary"), work_folder(spark, "references"))


class Reference:
    """A reference in the form in which documents are held against it."""

    def __init__(self, packed):
        rows = json.loads(zlib.decompress(packed))
        words = {x.encode("latin-1"): n for kind, x, n in rows if kind == 0}
        self.index = {x: i for i, x in enumerate(words)}
        self.counts = np.array([*words.values(), 0], float)
        self.counts[-1] = sum(n for kind, _, n in rows if kind == 2) - self.counts.sum()
        self.classes = np.zeros(7)
        for kind, x, n in rows:
            if kind == 1:
                self.classes[int(x)] = n
        self.curve = None

    def distances(self, chars, total, n):
        """Character and word distance of a document of ``n`` words."""
        own = np.zeros(len(self.counts))
        for x in total.keys() & self.index.keys():
            own[self.index[x]] = total[x]
        own[-1] = n - own.sum()
        return (
            distance(chars, self.classes) if chars.sum() and self.classes.sum() else 0.0,
            distance(own, self.counts) if n and self.counts.sum() else 0.0,
        )

    def chance(self, n, deviations=3):
        """How far a text of ``n`` words drawn from the reference itself hardly ever is from it.

        The mean and ``deviations`` standard deviations of the word distance of such draws,
        between ``LENGTHS`` by the logarithm of the length.  The draws are those of a fixed
        seed, so every task comes to the same.
        """
        if not self.counts.sum():
            return 0.0
        if self.curve is None:
            rng, share = np.random.default_rng(1), self.counts / self.counts.sum()
            far = [[distance(x, self.counts) for x in rng.multinomial(k, share, DRAWS)] for k in LENGTHS]
            self.curve = [np.mean(x) + deviations * np.std(x) for x in far]
        return float(np.interp(math.log(max(n, 1)), np.log(LENGTHS), self.curve))


def _references(block, held):
    """The references of a block by language, unpacked when first asked for."""

    def of(lang):
        packed = block.get(lang)
        if packed is None:
            return None
        if lang not in held:
            if len(held) >= HELD:
                held.clear()
            held[lang] = Reference(packed)
        return held[lang]

    return of


def _nearest(block, of, own):
    """The reference of a block that is nearest to a text, by the sum of its distances."""
    each = ((*of(lang).distances(*own), lang) for lang in sorted(block))
    return min(each, key=lambda d: (d[0] + d[1], d), default=None)


def _near_rows(shared):
    """``key, char_d, word_d, allowed``: the nearest reference of the block for each text."""

    def run(batches):
        block, rules = shared.value
        of = _references(block, {})
        for batch in w.slices(batches, 1):
            rows = []
            for text in w.texts(batch.column(1)):
                words = common_form(text)
                found = _nearest(block, of, (histogram(text), Counter(words), len(words)))
                allowed = of(found[2]).chance(len(words)) if found else None
                rows.append((*found[:2], allowed) if found else (None, None, None))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.float64()) for c in columns)], ["key", "char_d", "word_d", "allowed"]
            )

    return run


def _judge(shared):
    """Verdicts from id, text, language, and the nearest reference's distances where these are known."""

    def run(batches):
        block, rules = shared.value
        of = _references(block, {})
        for batch in w.slices(batches, 1):
            rows = []
            langs, *near = (c.to_pylist() for c in batch.columns[2:])
            for text, lang, char_d, word_d, allowed in zip(w.texts(batch.column(1)), langs, *near, strict=True):
                base, words = base_counts(text), common_form(text)
                if char_d is None:
                    own = histogram(text), Counter(words), len(words)
                    if lang is None:
                        found = _nearest(block, of, own)
                        char_d, word_d, lang = found or (0.0, 0.0, None)
                    elif of(lang):
                        char_d, word_d = of(lang).distances(*own)
                    else:
                        char_d, word_d, lang = 0.0, 0.0, None
                    allowed = of(lang).chance(len(words)) if lang is not None else 0.0
                failed = base[0] < rules["least_base_words"] or 100 * base[4] > rules["repeat_percent"] * base[0]
                far = (base[1] >= rules["least_chars"] and char_d > rules["most_char_distance"]) or (
                    len(words) >= rules["least_words"] and word_d > max(rules["most_word_distance"], allowed + rules["slack"])
                )
                rows.append((*base, round(char_d, 6), round(word_d, 6), failed, not (failed or far)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
            types = [pa.int64()] * 5 + [pa.float64()] * 2 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                [x.split()[0] for x in SCHEMA.split(", ")],
            )

    return run


def _judged(docs, references, rules, run, columns, schema, lang_col, text_col, block_bytes):
    """What ``run(shared)`` makes of all rows: the given ``columns``, language and distances.

    The references go to tasks in blocks of about ``block_bytes``, whatever their number, and a
    language's block follows from its name; so texts stay where they are, each is held against
    its own block, and texts of one language are in as many tasks as the table has.  A
    text of unknown language is held against every block, once a block, and the nearest counts.
    """
    spark = docs.sparkSession
    lang = F.col(lang_col).cast("string")
    total = references.agg(F.sum(F.length("reference") + F.length("lang"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    none = [F.lit(None).cast("double").alias(x) for x in ("char_d", "word_d", "allowed")]

    def block_of(column):
        return F.pmod(F.xxhash64(column), F.lit(blocks))

    def shared(i):
        mine = references.where(block_of("lang") == i).collect()
        return spark.sparkContext.broadcast(({r.lang: bytes(r.reference) for r in mine}, rules))

    if blocks == 1:
        return docs.select(*columns, lang.alias("lang"), *none).mapInArrow(run(shared(0)), schema)
    key = F.sha2(F.col(text_col).cast("binary"), 256)
    unknown = docs.where(F.col(lang_col).isNull())
    texts = unknown.where(F.col(text_col).isNotNull()).select(key.alias("key"), F.col(text_col).alias("text"))
    found, out = None, []
    near = "key string, char_d double, word_d double, allowed double"
    for i in range(blocks):
        block = shared(i)
        known = docs.where(F.col(lang_col).isNotNull() & (block_of(lang) == i))
        out.append(land(known.select(*columns, lang.alias("lang"), *none).mapInArrow(run(block), schema), work_folder(spark, "judged")))
        mine = land(texts.mapInArrow(_near_rows(block), near).where("char_d IS NOT NULL").distinct(), work_folder(spark, "near"))
        found = mine if found is None else found.union(mine)
        block.unpersist()
    least = F.min(F.struct((F.col("char_d") + F.col("word_d")).alias("sum"), "char_d", "word_d", "allowed")).alias("d")
    found = land(found.groupBy("key").agg(least).select("key", "d.*"), work_folder(spark, "nearest"))
    packed = unknown.select(F.struct(*columns).alias("row"), key.alias("key"))
    beside = packed.join(found, "key", "left").select("row.*", F.lit(None).cast("string").alias("lang"), "char_d", "word_d", "allowed")
    empty = spark.sparkContext.broadcast(({}, rules))
    out.append(beside.mapInArrow(run(empty), schema))
    result = out[0]
    for part in out[1:]:
        result = result.union(part)
    return result


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "char_distance double, word_distance double, base_failed boolean, kept boolean"
)


#: least_base_words and repeat_percent bind the base rules, the others the distances.
DEFAULTS = {
    "least_base_words": 10,
    "repeat_percent": 20,
    "least_chars": 200,
    "least_words": 30,
    "most_char_distance": 0.30,
    "most_word_distance": 0.35,
    "slack": 0.05,
}


def quality_verdicts(
    docs, references=None, id_col="doc_id", lang_col="lang", text_col="text", block_bytes=1 << 24, **rules
):
    """Counts, distances and verdict of each document; one row per row of ``docs``.

    Two histograms of a document, of character classes and of the common words of its language
    with one bin for all other words, are held against the references of its language (see
    ``language_references``) by Jensen-Shannon distance, 0 to 1.  A document fails above a
    limit.  It is not held against a histogram for which it is shorter than ``least_chars`` (in
    words) or ``least_words``; the limit for words is at least ``slack`` above what chance
    gives a text of that length (``Reference.chance``).  A null language is
    compared with every reference and the nearest counts; a language without a reference is
    judged by the base rules alone, its distances are 0.  Null and empty texts have no words and
    fail by ``least_base_words``.  Rows that repeat are judged alike, a null id stays null.
    """
    found = language_references(docs, lang_col=lang_col, text_col=text_col) if references is None else references
    columns = [F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")]
    return _judged(docs, found, {**DEFAULTS, **rules}, _judge, columns, SCHEMA, lang_col, text_col, block_bytes)


def keep_quality(
    docs, references=None, id_col="doc_id", lang_col="lang", text_col="text", block_bytes=1 << 24, **rules
):
    """The rows of ``docs`` that ``quality_verdicts`` keeps, with all their columns."""
    found = language_references(docs, lang_col=lang_col, text_col=text_col) if references is None else references
    names, text_at = docs.columns, docs.columns.index(text_col)

    def keep(shared):
        judge = _judge(shared)

        def run(batches):
            for batch in w.slices(batches, text_at):
                own = pa.RecordBatch.from_arrays(
                    [pa.nulls(batch.num_rows, pa.int64()), batch.column(text_at), *batch.columns[len(names) :]],
                    ["id", "text", "lang", "char_d", "word_d", "allowed"],
                )
                kept = [verdict.column("kept") for verdict in judge([own])]
                yield pa.RecordBatch.from_arrays(batch.columns[: len(names)], names).filter(pa.concat_arrays(kept))

        return run

    columns = [F.col(c).alias(f"own_{i}") for i, c in enumerate(names)]
    return _judged(docs, found, {**DEFAULTS, **rules}, keep, columns, docs.schema, lang_col, text_col, block_bytes)
