"""All queries of this package."""

from featloom.llm import ball, blocks, bpe, exact, forest, packing, quality, redirects, rtree, runs, suffixes, token_frames, toxicity  # noqa: F401
from featloom.llm.base import ORACLES, QUERIES, query

import corpus_pipeline

query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)

__all__ = ["ORACLES", "QUERIES"]
