"""citeloom: Spark jobs for citation-linked document corpora."""
