"""Queries of this subpackage: name -> (query, equivalent SQL or None)."""

from __future__ import annotations

from rivertrace.llm import (
    byte_bpe, chat_format, conversation_repair, decontamination, language_id, line_dedup, quality, sharding, simhash_dedup, span_dedup, spelling,
    spotsigs, url_filter,
)

QUERIES = {
    **byte_bpe.QUERIES, **chat_format.QUERIES, **conversation_repair.QUERIES, **decontamination.QUERIES, **language_id.QUERIES, **line_dedup.QUERIES,
    **quality.QUERIES, **sharding.QUERIES, **simhash_dedup.QUERIES, **span_dedup.QUERIES, **spelling.QUERIES, **spotsigs.QUERIES, **url_filter.QUERIES,
}
