"""What operators ask of the data while a plan is built.

A plan is built twice: once on the plain tables, and once on tables that count rows as they pass. The second time nothing is asked
anew: the same code gets the answers of the first time, so that no counted row passes before the result is made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field
from typing import TypeVar

T = TypeVar("T")


@dataclass
class Script:
    answers: list = field(default_factory=list)
    at: int | None = None  # the answer to be given next, once they are given again


_current: ContextVar[Script | None] = ContextVar("script", default=None)


def asked(question: Callable[[], T]) -> T:
    """The answer to a question about the data, or the one it had when the plan was first built."""
    script = _current.get()
    if script is None:
        return question()
    if script.at is None:
        # Questions within the question are part of its answer.
        token = _current.set(None)
        try:
            script.answers.append(question())
        finally:
            _current.reset(token)
        return script.answers[-1]
    script.at += 1
    return script.answers[script.at - 1]


@contextmanager
def noted() -> Iterator[Script]:
    """Answers given inside are kept."""
    script = Script()
    token = _current.set(script)
    try:
        yield script
    finally:
        _current.reset(token)


@contextmanager
def repeated(script: Script) -> Iterator[None]:
    """Questions inside get the answers kept."""
    script.at = 0
    token = _current.set(script)
    try:
        yield
    finally:
        _current.reset(token)
