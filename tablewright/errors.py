"""Errors an operation can raise. They carry plain-language messages."""

from __future__ import annotations


class OperationError(ValueError):
    """The operation cannot be carried out as asked (unknown column, wrong kind of data, ...)."""


class StepFailed(Exception):
    """A step after the first could not be carried out.

    ``result`` is the :class:`~tablewright.plans.runner.PlanResult` of the steps before it, so finished
    work is kept; ``step`` counts from 1 and ``reason`` is the message of the failing step.
    """

    def __init__(self, result, step: int, reason: str):
        super().__init__(f"Step {step} failed: {reason}")
        self.result = result
        self.step = step
        self.reason = reason
