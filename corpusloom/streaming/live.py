"""Corpus operators on a stream of documents; all of them work row by row and keep no state."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import corpus


def stream_sentences(docs: DataFrame) -> DataFrame:
    """``doc_id, sid, forms`` of documents as they arrive."""
    return corpus.nested(corpus.sentences_of(docs))
