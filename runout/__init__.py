"""Supply planning on Spark: which materials run out before a new order can arrive."""

from runout.params import Params
from runout.session import tune

__all__ = ["Params", "tune"]
