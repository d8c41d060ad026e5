"""DataFrame operators: curation, deduplication, retrieval, catalogue, maintenance, jobs and conversations."""
