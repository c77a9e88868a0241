"""Source readers. Each takes a DataFrame of fetched payloads (a column `body`, and what the source adds) and
returns postings; fetching itself is an adapter outside the engine. Register more with `register`."""

from winnow.sources.registry import SOURCES, read_all, register

__all__ = ["SOURCES", "read_all", "register"]
