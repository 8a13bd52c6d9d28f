"""Analytics of ordered events on Spark."""

from .schema import MISSING, REST, StreamSchema
from .stream import Stream

__all__ = ["MISSING", "REST", "Stream", "StreamSchema"]
