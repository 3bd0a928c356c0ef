"""Named queries of the engine with the SQL that checks them."""

from . import app, audio, corpus, evaluation, files, history, streams, text  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
