"""Registered queries over the driver tables, each with its SQL twin."""

from tidewell.plans import documents, editions, events, fetches, flow, payloads, tables  # noqa: F401
