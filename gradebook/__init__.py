"""Academic-records analytics and batch maintenance on Spark DataFrames."""

from gradebook.sources.tables import Gradebook, load

__all__ = ["Gradebook", "load"]
