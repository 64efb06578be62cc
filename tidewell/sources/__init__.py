"""Readers, payload parsers and keyed sinks."""
