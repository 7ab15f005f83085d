"""The corpus pipeline: five stages over documents, each written before the next reads it."""

from confwarden.llm import decontaminate, divergence, mixing, near_dedup, secret_scan
from confwarden.llm.ship import ship
from confwarden.session import land, work_folder


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_rules(spark, docs, sf_dir):
    """Documents that pass the base rules and are near their language's references."""
    ship(spark)
    return divergence.keep_quality(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document, that of the least id, of each group of near copies."""
    ship(spark)
    return near_dedup.keep_first(spark, docs, k=5, percent=80)


def benchmark_decontamination(spark, docs, sf_dir):
    """Documents without a benchmark item."""
    ship(spark)
    return decontaminate.drop_contaminated(spark, docs, _table(spark, sf_dir, "benchmark"))


def secret_scans(spark, docs, sf_dir):
    """All documents, secrets in their texts replaced."""
    return secret_scan.redact_documents(spark, docs)


def source_mixing(spark, docs, sf_dir):
    """``doc_id, source, n_tokens, domain, p, rate`` of each document: how often to draw it."""
    labelled = mixing.label_domains(_table(spark, sf_dir, "labels"))
    return mixing.mix_to_targets(spark, docs, labelled, carry=("source",))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
]

#: Hashes, reference histograms and the fitted rates cannot be written in SQL; the stages are
#: tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage over the whole documents table of ``sf_dir``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = land(stage(spark, docs, sf_dir), work_folder(spark, name))
    return docs
