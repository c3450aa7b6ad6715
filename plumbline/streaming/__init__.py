"""Profiles of streams: mergeable state, written batch by batch."""
