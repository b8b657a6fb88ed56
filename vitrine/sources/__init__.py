"""Scans, sinks and the slate log derived from order tables."""
