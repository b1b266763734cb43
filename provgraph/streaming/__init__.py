"""Run boundaries as a keyed stream."""
