"""All core queries in one registry."""

from __future__ import annotations

from framewright.plans import arrays, fields, filters, joins, keys, rewards, sampling, scoring
from framewright.plans.registry import Registry

CORE = Registry()
for _module in (scoring, fields, filters, joins, keys, arrays, rewards, sampling):
    CORE.queries.update(_module.R.queries)
    CORE.oracles.update(_module.R.oracles)
