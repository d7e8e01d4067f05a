"""Queries over the given tables, one or more per operator, with the same answer in plain SQL."""

from maskweave.registry import activity, catalog, detection, lineage, masking, streams, tokens
from maskweave.registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "activity", "catalog", "detection", "lineage", "masking", "streams", "tokens"]
