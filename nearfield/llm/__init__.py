"""Training-data operators: filtering, deduplication, mixing and packing of text corpora."""

from nearfield.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
