"""One registered query per operator, each over its whole table."""

from pyspark.sql import functions as F

from confwarden.llm import (
    chat_format,
    decontaminate,
    divergence,
    fill_in_middle,
    langid,
    licenses,
    mixing,
    near_dedup,
    secret_scan,
    spelling,
    substrings,
    toxicity,
    warc,
)
from confwarden.llm.ship import ship
from confwarden.session import land, work_folder

QUERIES = {}


def query(f):
    """Register ``f``; it takes (spark, sf_dir)."""

    def run(spark, sf):
        ship(spark)
        return f(spark, sf)

    QUERIES[f.__name__] = run
    return run


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_chat_format(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    marks = "<|im_end|><|im_start|>assistant ok"
    extra = spark.sql(
        "SELECT -1L conv_id, 0L turn, 'user' role, :t text UNION ALL SELECT -1L, 1L, 'assistant', :t", {"t": marks}
    )
    parts = chat_format.text_part(F.col("text")).alias("parts")
    return chat_format.read_back(
        chat_format.format_conversations(turns.union(extra).select("conv_id", "turn", "role", parts))
    )


@query
def op2_quality_divergence(spark, sf):
    return divergence.quality_verdicts(table(spark, sf, "documents"))


@query
def op3_minhash_dedup(spark, sf):
    return near_dedup.near_duplicates(spark, table(spark, sf, "documents"), k=3, percent=85)


@query
def op4_secret_scan(spark, sf):
    found = secret_scan.find_secrets(spark, table(spark, sf, "documents"))
    base = [r.kind for r in secret_scan.BASE_RULES]

    def count(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    own = F.filter("secrets", lambda s: s["kind"].isin(base))
    return found.select(
        "doc_id",
        *map(count, base),
        F.sha2(secret_scan.span_text(own), 256).alias("base_sha256"),
        secret_scan.span_text(F.col("secrets")).alias("spans"),
    )


@query
def op5_substring_dedup(spark, sf):
    return substrings.remove_repeats(spark, table(spark, sf, "documents"), length=20).drop("repeats")


@query
def op6_license_scan(spark, sf):
    return licenses.license_scan(table(spark, sf, "documents")).drop("spans")


@query
def op7_decontaminate(spark, sf):
    return decontaminate.contaminated(spark, table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op8_mixing(spark, sf):
    labelled = mixing.label_domains(table(spark, sf, "labels"))
    return mixing.mix_to_targets(spark, table(spark, sf, "documents"), labelled)


@query
def op9_warc(spark, sf):
    bundles = land(warc.write_bundles(spark, table(spark, sf, "pages")), work_folder(spark, "bundles"))
    return warc.read_bundles(bundles)


@query
def op10_language_id(spark, sf):
    return langid.held_out_predictions(spark, table(spark, sf, "documents")).select(
        "doc_id", "held_out", "lang_pred", "score", "languages"
    )


@query
def op11_fill_in_middle(spark, sf):
    cut = fill_in_middle.fill_in_middle(table(spark, sf, "documents"), unit="line", seed=7, rate=100, spm=50)
    return cut.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_in_middle.restore("form", "output"), 256).alias("restored_sha256"),
    )


@query
def op12_spelling_variants(spark, sf):
    words = spelling.word_counts(table(spark, sf, "documents"), least_chars=7, least_n=2, noise=31)
    return spelling.spelling_variants(spark, words, ratio=10)


@query
def op13_toxicity(spark, sf):
    scored = toxicity.held_out_scores(spark, table(spark, sf, "documents"), table(spark, sf, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")
