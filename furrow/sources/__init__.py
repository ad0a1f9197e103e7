"""Readers, landed-feed parsers, upserts and sinks."""
