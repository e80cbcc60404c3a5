"""Narrow operators over files as they arrive."""
from leafmill.streaming.incremental import run_incrementally

__all__ = ["run_incrementally"]
