"""entitynet: Spark-native analytics for networks of legal entities and people."""

from entitynet.session import cut, session

__all__ = ["cut", "session"]
