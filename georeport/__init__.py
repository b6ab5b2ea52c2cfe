"""Report geoparsing on Spark: posts in, located events out."""

from georeport.params import Params

__all__ = ["Params"]
