"""Sequence overlap and string-graph assembly as DataFrame queries."""

from .plans.config import AssemblyConfig
from .plans.pipeline import AssemblyResult, assemble

__all__ = ["AssemblyConfig", "AssemblyResult", "assemble"]
