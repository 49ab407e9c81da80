"""The queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from normscape.llm import exact_dedup, language_id, language_model, licenses, merkle, near_dedup, packing, periodic_runs, secrets, segmentation, substring_dedup, token_files, vector_search

_MODULES = (language_id, licenses, exact_dedup, near_dedup, packing, vector_search, secrets, substring_dedup, language_model, segmentation, merkle, token_files, periodic_runs)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
