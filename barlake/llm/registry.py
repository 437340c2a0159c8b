"""Queries and SQL checks of the corpus operators, and the pipeline."""

from __future__ import annotations

import corpus_pipeline
from barlake.llm import (
    alignment,
    bpe,
    decontaminate,
    lexical,
    licenses,
    packing,
    paragraphs,
    resample,
    simhash,
    suffixes,
    topk,
    toxicity,
    warc,
)

MODULES = (
    licenses, paragraphs, resample, topk, toxicity, bpe, warc, suffixes, decontaminate, simhash, packing, alignment,
    lexical,
)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
