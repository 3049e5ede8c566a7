"""quillon: an analytics engine on PySpark: a SQL front, a plan builder, operators, sources and streaming."""

from quillon.plans.rel import Rel
from quillon.session import Engine, session

__all__ = ["Engine", "Rel", "session"]
