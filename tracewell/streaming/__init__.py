"""Ingestion as a stream or a batch; both share the adapters' decode expressions."""
