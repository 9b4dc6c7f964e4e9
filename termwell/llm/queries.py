"""All queries of the subpackage; importing it registers them."""

from __future__ import annotations

import corpus_pipeline
from termwell.llm import (  # noqa: F401
    collocations,
    decontaminate,
    fim,
    language,
    licences,
    minhash,
    mixing,
    neighbours,
    pii,
    quality,
    sharding,
    substrings,
    warc,
)
from termwell.llm.registry import REGISTRY, query

query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)


def load_llm_queries():
    return REGISTRY
