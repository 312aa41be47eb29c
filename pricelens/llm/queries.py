"""One query per operator over its whole table, with production parameters."""

from pyspark.sql import DataFrame, functions as F

from pricelens.llm import (
    alignment, exact, language, lines, mixing, packing, pages, quality, simhash, suffix, tokens, urls, whitening,
)
from pricelens.llm.common import table, tokenizer_path

# Token limit of a sequence, and of a document before it counts as over the limit.
SEQUENCE_TOKENS = 4096
# The rules on hosts and paths that every page is judged by.
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]

# Wanted shares of the tokens of each labelled domain.
MIXTURE = {"good": 0.85, "poor": 0.12, "toxic": 0.03}


def held_out(key="doc_id"):
    """Rows that language identification never learns from."""
    return F.crc32(F.col(key).cast("string")) % 3 == 1


def domains(spark, sf) -> DataFrame:
    """The labelled table as one domain of each document."""
    name = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return table(spark, sf, "labels").select("doc_id", name.alias("label"))


def op1_mixing(spark, sf) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), domains(spark, sf), MIXTURE)


def op2_quality_rules(spark, sf) -> DataFrame:
    found = quality.judge(table(spark, sf, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )


def op3_language_id(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = language.fit(docs.where(~held_out()))
    found = language.identify(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op4_token_counts(spark, sf) -> DataFrame:
    return tokens.count_tokens(table(spark, sf, "documents"), tokenizer_path("piece_bpe_32k.model"), limit=SEQUENCE_TOKENS)


def op5_exact_dedup(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents")
    return exact.deduplicate(docs, exact.arrivals(spark, f"{sf}/documents.parquet"))


def op6_suffix_dedup(spark, sf) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf, "documents"))


def op7_best_fit_packing(spark, sf) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"), tokenizer_path("word_bpe_49k.json"), limit=SEQUENCE_TOKENS)


def op8_url_filters(spark, sf) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf, "pages"), rules)


def op9_html_extraction(spark, sf) -> DataFrame:
    return pages.extract(table(spark, sf, "pages"))


def op10_simhash(spark, sf) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))


def op11_embedding_whitening(spark, sf) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings"))


def op12_cross_tokenizer_alignment(spark, sf) -> DataFrame:
    return alignment.align(table(spark, sf, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_line_dedup(spark, sf) -> DataFrame:
    return lines.drop_lines(table(spark, sf, "documents"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_quality_rules": op2_quality_rules,
    "op3_language_id": op3_language_id,
    "op4_token_counts": op4_token_counts,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_url_filters": op8_url_filters,
    "op9_html_extraction": op9_html_extraction,
    "op10_simhash": op10_simhash,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_cross_tokenizer_alignment": op12_cross_tokenizer_alignment,
    "op13_line_dedup": op13_line_dedup,
}
