"""The registered queries of this subpackage, over whole tables, and the SQL that those must agree with that SQL can express."""

from __future__ import annotations

from . import bytepairs, codes, collocations, decontaminate, langid, line_dedup, media, minhash, pieces, pii, repair, toxicity, url_filter
from .common import table


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is; the operators take its path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark, sf_dir):
    return pieces.op1(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op4_pii(spark, sf_dir):
    return pii.op4(table(spark, sf_dir, "documents"))


def op9_repair_tokens(spark, sf_dir):
    return repair.op9(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op2_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.RULES)


def op3_media(spark, sf_dir):
    return media.op3(spark, table(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    return toxicity.op5(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_langid(spark, sf_dir):
    return langid.op6(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark, sf_dir):
    return line_dedup.op7(table(spark, sf_dir, "documents"))


def op8_decontamination(spark, sf_dir):
    return decontaminate.op8(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_minhash(spark, sf_dir):
    return minhash.op10(table(spark, sf_dir, "documents"))


def op11_collocations(spark, sf_dir):
    return collocations.op11(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark, sf_dir):
    return codes.op12(table(spark, sf_dir, "embeddings"))


def op13_byte_bpe(spark, sf_dir):
    return bytepairs.op13(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sentencepiece, op2_url_filter, op3_media, op4_pii, op5_toxicity, op6_langid, op7_line_dedup, op8_decontamination, op9_repair_tokens, op10_minhash,
        op11_collocations, op12_vector_codes, op13_byte_bpe,
    )
}

ORACLES = {
    "op2_url_filter": url_filter.ORACLE, "op7_line_dedup": line_dedup.ORACLE, "op8_decontamination": decontaminate.ORACLE, "op10_minhash": minhash.ORACLE,
    "op11_collocations": collocations.ORACLE, "op12_vector_codes": codes.ORACLE,
}
