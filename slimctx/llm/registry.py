"""The registered queries of the subpackage and their DuckDB oracles."""

from __future__ import annotations

from slimctx.llm import (chat_format, decontaminate, embedding_dedup, host_rules, jaccard_join,
                         language_id, line_dedup, merkle, sentencepiece_sample, substring_dedup,
                         token_align, url_filter, warc)
from slimctx.llm.common import table


def _op(fn, name):
    def run(spark, sf_dir):
        return fn(table(spark, sf_dir, name))
    run.__doc__ = fn.__doc__
    return run


QUERIES = {
    "op1_chat_format": chat_format.op1_query,
    "op2_decontaminate": decontaminate.op2_query,
    "op3_substring_dedup": _op(substring_dedup.op3_query, "documents"),
    "op4_url_filter": _op(url_filter.op4_query, "pages"),
    "op5_sentencepiece": _op(sentencepiece_sample.op5_query, "documents"),
    "op6_language_id": _op(language_id.op6_query, "documents"),
    "op7_jaccard_join": _op(jaccard_join.op7_query, "documents"),
    "op8_line_dedup": _op(line_dedup.op8_query, "documents"),
    "op9_warc": _op(warc.op9_query, "pages"),
    "op10_embedding_dedup": _op(embedding_dedup.op10_query, "embeddings"),
    "op11_merkle": _op(merkle.op11_query, "documents"),
    "op12_token_align": _op(token_align.op12_query, "documents"),
    "op13_host_rules": _op(host_rules.op13_query, "documents"),
}

ORACLE_SQL = {
    "op1_chat_format": chat_format.OP1_SQL,
    "op2_decontaminate": decontaminate.OP2_SQL,
    "op4_url_filter": url_filter.OP4_SQL,
    "op7_jaccard_join": jaccard_join.OP7_SQL,
    "op8_line_dedup": line_dedup.OP8_SQL,
    "op9_warc": warc.OP9_SQL,
    "op10_embedding_dedup": embedding_dedup.OP10_SQL,
    "op11_merkle": merkle.OP11_SQL,
    "op13_host_rules": host_rules.OP13_SQL,
}
