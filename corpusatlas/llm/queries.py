"""Registered queries of the operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusatlas.llm import conversation_trie, decontaminate, language, main_text, near_dedup, pieces, quality, repeated_words, secrets, site_lines, substring_dedup, vector_codes, warc


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.found_secrets(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))

    def of(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id", *(of(kind).alias(f"n_{kind}") for kind in secrets.BASE),
        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
    )


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text.extracted(_table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("bigint"))


def model_file() -> str:
    """The public piece model; set `spark.corpusatlas.pieceModel` to use another one."""
    session = SparkSession.getActiveSession()
    named = session.conf.get("spark.corpusatlas.pieceModel", None) if session else None
    if named:
        return named
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether decoding them gives the text back."""
    vocabulary = pieces.Vocabulary.load(model_file())
    rows = pieces.encoded(_table(spark, sf_dir, "documents"), vocabulary)
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), "ids", "round_trip")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        decontaminate.item_digest("items").alias("items_sha256"), "contaminated",
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeated(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's three-word shingles and similarity of 0.85."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", language.held_out())
    model = language.fit(docs.where("not held_out"))
    found = language.predicted(docs, model)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's source is its site."""
    cleaned = site_lines.without_boilerplate(_table(spark, sf_dir, "documents"))
    return cleaned.select(
        "doc_id", "source", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), "text"
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes, errors and the digest of the codebooks they index."""
    found, books = vector_codes.compressed(_table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_repeated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_words.without_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_main_text, op3_sentencepiece, op4_decontaminate, op5_substring_dedup, op6_near_dedup, op7_language_id, op8_quality_rules, op9_warc,
        op10_line_dedup, op11_vector_codes, op12_conversation_trie,
        op13_repeated_words,
    )
}
ORACLES: dict[str, str] = {
    "op1_secret_scan": secrets.oracle(), "op4_decontaminate": decontaminate.ORACLE_SQL, "op6_near_dedup": near_dedup.oracle(words=3, percent=85),
    "op9_warc": warc.ORACLE_SQL,
    "op10_line_dedup": site_lines.ORACLE_SQL,
    "op11_vector_codes": vector_codes.ORACLE_SQL, "op12_conversation_trie": conversation_trie.ORACLE_SQL,
    "op13_repeated_words": repeated_words.ORACLE_SQL,
}
