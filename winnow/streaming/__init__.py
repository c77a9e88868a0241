"""Streaming runs of the funnel."""
