"""Queries composed from the operators of the engine; importing the modules fills the registry."""

from trackforge.plans import chain, decisions, islands, joins, match, measures, scalars, starts, streams, tables, windows
from trackforge.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "decisions", "islands", "joins", "match", "measures", "scalars", "starts", "streams", "tables", "windows"]
