"""One query for each corpus operator, with production parameters, over whole tables."""

from __future__ import annotations

from surveyloom.llm import (
    alignment,
    bag_minhash,
    grid_order,
    language,
    line_dedup,
    merkle,
    mixing,
    packing,
    pii,
    quality,
    sentence_spans,
    topk,
    url_filters,
)
from surveyloom.llm.common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filters(spark, sf):
    return url_filters.judge(table(spark, sf, "pages").select("page_id", "url")).drop("url")


def op2_language(spark, sf):
    docs = table(spark, sf, "documents")
    model = language.train(docs.where(~language.held_out()))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "lang_runs")


def op3_pii(spark, sf):
    return pii.digest(pii.find(table(spark, sf, "documents").select("doc_id", "text")))


def op4_line_dedup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


def op5_minhash_near_dedup(spark, sf):
    return bag_minhash.near_classes(table(spark, sf, "documents").select("doc_id", "text"))


def op6_substring_dedup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return sentence_spans.dedup_spans(docs)


def op7_top_k(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op8_embedding_dedup(spark, sf):
    return grid_order.near_vectors(table(spark, sf, "embeddings"))


def op9_source_mixing(spark, sf):
    return mixing.mix(table(spark, sf, "documents")).drop("source")


def op10_packing(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return packing.digest(packing.pack(docs, tokenizer_path()))


def op11_merkle_manifest(spark, sf):
    return merkle.digest(table(spark, sf, "documents"))


def op12_quality_rules(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return quality.judge(docs).select(*quality.RESULT)


def op13_cross_tokenizer_alignment(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return alignment.linked(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


ALL = {
    f.__name__: f
    for f in (
        op1_url_filters,
        op2_language,
        op3_pii,
        op4_line_dedup,
        op5_minhash_near_dedup,
        op6_substring_dedup,
        op7_top_k,
        op8_embedding_dedup,
        op9_source_mixing,
        op10_packing,
        op11_merkle_manifest,
        op12_quality_rules,
        op13_cross_tokenizer_alignment,
    )
}
SQL = {
    "op1_url_filters": url_filters.SQL,
    "op4_line_dedup": line_dedup.SQL,
    "op7_top_k": topk.SQL,
    "op8_embedding_dedup": grid_order.SQL,
    "op9_source_mixing": mixing.SQL,
    "op11_merkle_manifest": merkle.SQL,
    "op12_quality_rules": quality.SQL,
}
