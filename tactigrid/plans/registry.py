"""All registered queries of the library's own operators."""

from __future__ import annotations

from tactigrid.plans import core, extra, more

QUERIES = core.QUERIES | more.QUERIES | extra.QUERIES
ORACLES = core.ORACLES | more.ORACLES | extra.ORACLES
