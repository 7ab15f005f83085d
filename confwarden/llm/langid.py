"""Language identification of mixed texts by expectation-maximisation over n-gram likelihoods."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from confwarden.llm import words as w

BUCKETS = 1 << 15
MAX_N = 3
UNKNOWN = "und"

_letters = None


def letters():
    """Which code points are letters; made once in each worker."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def features(text):
    """Hashed n-grams (1 to 3 letters, words padded by one blank) and their counts.

    Empty where the text is null or has no letter.  A run of other characters is one blank.
    """
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[codes]
    if not is_letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keep = is_letter | np.concatenate(([True], is_letter[:-1]))
    codes = np.where(is_letter, codes, 32)[keep]
    codes = np.concatenate((np.array([32], codes.dtype), codes, np.array([32], codes.dtype)))
    grams, wide = [], codes.astype(np.uint64)
    for n in range(1, MAX_N + 1):
        size = len(codes) - n + 1
        gram = np.zeros(size, np.uint64)
        for i in range(n):
            gram = gram * np.uint64(0x110001) + wide[i : i + size]
        grams.append(w.mix(gram + np.uint64(n) * np.uint64(1 << 62)))
    bucket = (np.concatenate(grams) & np.uint64(BUCKETS - 1)).astype(np.int64)
    counts = np.bincount(bucket, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def _train(batches):
    """Counts by language, summed over the task; a row for each language and filled bucket."""
    sums = {}
    for batch in w.slices(batches, 1):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            at, n = features(text)
            if lang not in sums:
                sums[lang] = np.zeros(BUCKETS, np.int64)
            sums[lang][at] += n
    for lang, counts in sums.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())],
            ["lang", "bucket", "n"],
        )


def _packed(key, table):
    """The counts of one language as one dense binary: a row for each bucket at most."""
    counts = np.zeros(BUCKETS, np.int64)
    counts[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "counts": pa.array([counts.tobytes()], pa.binary())})


def fit(
    docs,
    rows_per_language=2000,
    most_languages=400,
    smoothing=0.5,
    id_col="doc_id",
    lang_col="lang",
    text_col="text",
):
    """N-gram distributions by language: ``(names, log-free probabilities[bucket, language])``.

    Fitted on a bounded sample: about ``rows_per_language`` rows of each label, taken by a hash of
    the id and read whole.  The counts are hashed to a fixed number of buckets and come to the
    driver as one dense array for each language.  The model has a column for each language
    and goes to every task, so more than ``most_languages`` labels raise ``ValueError``
    and no language is left out unsaid.  Null labels teach nothing; null texts are empty.
    """
    labelled = docs.where(F.col(lang_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")
    )
    sizes = labelled.groupBy("lang").count().limit(most_languages + 1).collect()
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages are labelled")
    rates = {r.lang: rows_per_language / r["count"] for r in sorted(sizes)}
    if not rates:
        return [], np.zeros((BUCKETS, 0))
    spread = F.pmod(F.xxhash64(F.coalesce("id", F.lit(""))), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chosen = F.coalesce(*[F.when(F.col("lang") == name, spread < rate) for name, rate in rates.items()], F.lit(False))
    counts = (
        labelled.where(chosen)
        .select("lang", "text")
        .mapInArrow(_train, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .groupBy("lang")
        .applyInArrow(_packed, "lang string, counts binary")
        .collect()
    )
    names = sorted(r.lang for r in counts)
    table = np.full((BUCKETS, len(names)), smoothing)
    for r in counts:
        table[:, names.index(r.lang)] += np.frombuffer(r.counts, np.int64)
    return names, table / table.sum(axis=0)


def proportions(likelihoods, counts, rounds=30, settled=1e-4):
    """Maximum-likelihood proportions of the columns, and the log likelihood, by EM."""
    total = counts.sum()
    share = np.full(likelihoods.shape[1], 1 / likelihoods.shape[1])
    for _ in range(rounds):
        mixed = likelihoods @ share
        new = share * ((counts / mixed) @ likelihoods) / total
        done = np.abs(new - share).max() < settled
        share = new
        if done:
            break
    return share, float(counts @ np.log(likelihoods @ share))


def language_set(likelihoods, counts, penalty=2.0):
    """The languages of a text and their proportions.

    Starts from the likeliest single language and adds the one that raises the log likelihood
    most, as long as it gains more than ``penalty`` times the logarithm of the number of n-grams.
    Each step tries only the languages that explain the worst-explained n-grams better.
    """
    single = counts @ np.log(likelihoods)
    chosen, best = [int(single.argmax())], float(single.max())
    share = np.ones(1)
    price = penalty * np.log(counts.sum() + 1)
    while len(chosen) < likelihoods.shape[1]:
        now = likelihoods[:, chosen] @ share
        # The slope of the log likelihood as a little of a language is mixed in.
        slope = (counts / now) @ likelihoods / counts.sum() - 1
        slope[chosen] = -1
        pick = int(slope.argmax())
        if slope[pick] <= 0:
            break
        new_share, new = proportions(likelihoods[:, [*chosen, pick]], counts)
        if new - best <= price:
            break
        chosen, share, best = [*chosen, pick], new_share, new
    return chosen, share


def _predict(model, penalty):
    names, table = model.value

    def run(batches):
        for batch in w.slices(batches, 1):
            rows = []
            for text in batch.column(1).to_pylist():
                at, counts = features(text)
                if not len(at) or not names:
                    rows.append((UNKNOWN, 0.0, []))
                    continue
                chosen, share = language_set(table[at], counts, penalty)
                order = sorted(range(len(chosen)), key=lambda i: (-share[i], names[chosen[i]]))
                mix = [(names[chosen[i]], round(float(share[i]), 4)) for i in order]
                rows.append((*mix[0], mix))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([r[0] for r in rows], pa.string()),
                    pa.array([min(1.0, r[1]) for r in rows], pa.float64()),
                    pa.array([",".join(f"{n}:{s:.4f}" for n, s in r[2]) for r in rows], pa.string()),
                ],
                ["doc_id", "lang_pred", "score", "languages"],
            )

    return run


def identify(docs, model, penalty=2.0, id_col="doc_id", text_col="text"):
    """``doc_id, lang_pred, score, languages`` for each row of ``docs``, from its text alone.

    Expectation-maximisation estimates the proportions in which the languages' n-gram
    distributions mix to the text; the set of languages grows while the penalised likelihood
    does.  ``lang_pred`` is the one with the largest proportion (ties by name), ``score`` that
    proportion, ``languages`` all of them.  A text that is null or has no letter is ``und``
    with score 0, and so is every text if no language was learned.  ``model``: from ``fit``.
    """
    value = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(
        _predict(value, penalty), "doc_id long, lang_pred string, score double, languages string"
    )


def held_out(id_col="doc_id"):
    """The fold that is never learned from."""
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def held_out_predictions(spark, docs):
    """Learn from documents outside the held-out fold, predict for all of them.

    A null id is of no fold: held_out is false, and nothing is learned from it.
    """
    model = fit(docs.where(~held_out() & F.col("doc_id").isNotNull()))
    return identify(docs, model).withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
