"""Knowledge-corpus analytics on Spark: ingest, search, graph, evaluation, streaming."""
