"""The registered queries of the library, without the llm folder."""

from __future__ import annotations

from bioloom.plans import analysis, curation, features

FLAGSHIP = "cleaning_summary"
QUERIES: dict = {**features.QUERIES, **curation.QUERIES, **analysis.QUERIES}
ORACLES: dict = {**features.ORACLES, **curation.ORACLES, **analysis.ORACLES}
