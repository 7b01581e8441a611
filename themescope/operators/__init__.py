"""DataFrame operators: ingest, clustering, neighbours, reports, drift."""
