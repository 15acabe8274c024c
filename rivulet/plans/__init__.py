"""Pipelines: descriptions composed into lazy DataFrames."""

from rivulet.plans.params import Param, ParamError
from rivulet.plans.pipeline import (
    Composition,
    Context,
    Pipeline,
    PipelineError,
    register_step,
)

__all__ = [
    "Composition",
    "Context",
    "Param",
    "ParamError",
    "Pipeline",
    "PipelineError",
    "register_step",
]
