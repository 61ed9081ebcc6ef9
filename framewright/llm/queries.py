"""Registry of the training-data queries."""

from __future__ import annotations

from framewright.llm import queries_relations, queries_sampling, queries_text
from framewright.plans.registry import Registry

LLM = Registry()
for _module in (queries_sampling, queries_relations, queries_text):
    LLM.queries.update(_module.R.queries)
    LLM.oracles.update(_module.R.oracles)
