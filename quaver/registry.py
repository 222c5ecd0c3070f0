"""All queries of the library and the SQL they are held against."""

from quaver.plans.oracles import ORACLES
from quaver.plans.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
