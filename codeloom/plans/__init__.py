"""The registered queries; importing a module of this package registers its queries."""

from codeloom.plans import clones, context, control, cyphers, dense, extract, extras, lookup, metrics, ranking, relations, smells, streams, text, vectors
from codeloom.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "clones", "context", "control", "cyphers", "dense", "extract", "extras", "lookup", "metrics", "ranking", "relations", "smells", "streams", "text", "vectors"]
