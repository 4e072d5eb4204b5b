"""Whole plans: fingerprint matching, traces, and the queries over the supplied tables."""
