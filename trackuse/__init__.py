"""Site use of tracked animals, as Spark DataFrame operators."""

from trackuse.config import Config

__all__ = ["Config"]
