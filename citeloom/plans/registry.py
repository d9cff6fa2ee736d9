"""All registered queries of the library's own operators and their SQL."""

from __future__ import annotations

from citeloom.plans import answers, association, channels, curation, evaluation, fits, loads, more, pages, retrieval

FAMILIES = (association, pages, curation, retrieval, channels, evaluation, more, loads, answers, fits)
QUERIES = {k: v for f in FAMILIES for k, v in f.QUERIES.items()}
ORACLE = {k: v for f in FAMILIES for k, v in f.ORACLE.items()}
