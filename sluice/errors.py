"""Errors of flows. Spark reports a failed job on the driver; `raised` turns that into the library's errors."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager


class FlowError(Exception):
    """Any failure of a flow."""


class IOFlowError(FlowError):
    """A source or sink failed."""


class InternalFlowError(FlowError):
    """A failure that isn't the data's."""


class JdbcFlowError(FlowError):
    """A database failed."""


class OutOfOrderError(FlowError):
    """Rows came in another order than was promised."""


class QueueFlowError(FlowError):
    """A queue delivered an error marker."""


class FlowTimeout(FlowError):
    """A flow wasn't done in time."""


class ValidationError(FlowError):
    """Data break a rule."""


class ExcessiveResourcesError(FlowError):
    """A limit on size was passed."""


class HttpFlowError(IOFlowError):
    """A server answered with another status than 200."""

    def __init__(self, status: int, url: str) -> None:
        super().__init__(f"{url} answered {status}")
        self.status = status


#: Words that the library's own raise_error() messages begin with, and their errors.
MARKS = {"OUT_OF_ORDER": OutOfOrderError, "VALIDATION": ValidationError, "EXCESSIVE": ExcessiveResourcesError, "FLOW": FlowError}


@contextmanager
def raised() -> Iterator[None]:
    """Raises the library's error for a Spark failure inside."""
    try:
        yield
    except FlowError:
        raise
    except Exception as e:
        text = str(e)
        for mark, kind in MARKS.items():
            if f"[{mark}]" in text:
                raise kind(text.split(f"[{mark}]", 1)[1].strip().splitlines()[0]) from e
        if "MALFORMED_RECORD" in text or "malformed" in text.lower():
            raise ValidationError(text.splitlines()[0]) from e
        if "java.sql" in text or "SQLException" in text:
            raise JdbcFlowError(text.splitlines()[0]) from e
        if "PATH_NOT_FOUND" in text or "FileNotFound" in text:
            raise IOFlowError(text.splitlines()[0]) from e
        raise InternalFlowError(text.splitlines()[0] if text else repr(e)) from e
