"""Schemas, readers, adapters and sinks."""
