"""factloom: structured, checked facts out of tables and streams of web pages, on Spark."""

from factloom.config import EngineConfig

__all__ = ["EngineConfig"]
