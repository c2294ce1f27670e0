"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, html, infill, jaccard, lines, maxent, media, mixing, neighbours, packing, quality, secrets, substrings
from .common import table


def vocabulary() -> str:
    """The public vocabulary file that the contracts name."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract_main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return neighbours.nearest(vectors, vectors.where("id % 100 = 0"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.systematic_mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.to_transport_streams(table(spark, sf_dir, "documents"))
    found = media.parse_transport_streams(stored, payload=False)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "units")


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lines.drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", F.col("ln_lines").alias("n_lines"), F.col("ln_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), vocabulary())
    return packing.hierarchical_pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    held = quality.held_out(F.col("doc_id")).alias("held_out")
    return scored.select("doc_id", held, F.col("qc_score").alias("score"), F.col("qc_predicted").alias("predicted"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.link_credentials(table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == secrets.KINDS.index(k))).cast("long")
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(secrets.digest(F.col("base")), 256).alias("base_sha256"), secrets.digest(F.concat("base", "linked")).alias("spans"),
    )


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.drop_repeated_passages(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", F.col("words").alias("n_words"), F.col("removed").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


def op11_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return centroids.cluster(vectors).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256"))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    chars = [F.length(c).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")]
    return cut.select("doc_id", "n", "form", *chars, F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    columns = "doc_id, ln_lines AS n_lines, ln_dropped AS n_dropped, sha256(kept) AS kept_sha256"
    return {
        "op3_mixing": mixing.SYSTEMATIC_MIX_SQL.replace("{documents}", "documents"),
        "op12_centroids": centroids.clusters_sql().replace("{embeddings}", "embeddings"),
        "op13_infill": infill.FILL_IN_MIDDLE_SQL.replace("{documents}", "documents"),
        "op6_lines": lines.LINES_SQL.replace("{documents}", "documents").replace("{columns}", columns),
    }
