"""Errors; the texts of the first three are fixed."""

from __future__ import annotations

import json


class BrindleError(Exception):
    def to_json(self) -> str:
        """The kind of error and its arguments; :func:`from_json` makes an equal one."""
        return json.dumps({"error": type(self).__name__, "detail": getattr(self, "detail", None) or (str(self) if self.args and not isinstance(self, (EmptyDataError, NotSortedError)) else None)})


class EmptyDataError(BrindleError, ValueError):
    def __init__(self) -> None:
        super().__init__("input data is empty")


class NotSortedError(BrindleError, ValueError):
    def __init__(self) -> None:
        super().__init__("input data is not sorted")


class InvalidKeyError(BrindleError, ValueError):
    def __init__(self, detail: str) -> None:
        super().__init__(f"invalid key: {detail}")
        self.detail = detail


class CorruptionError(BrindleError, ValueError):
    """A file or an input that must be sorted is not as it should be."""


class ConcurrentWriteError(BrindleError, RuntimeError):
    """Another writer has published this version."""


def from_json(text: str) -> BrindleError:
    """The error that :meth:`BrindleError.to_json` wrote."""
    told = json.loads(text)
    kind = {c.__name__: c for c in (EmptyDataError, NotSortedError, InvalidKeyError, CorruptionError, ConcurrentWriteError)}[told["error"]]
    return kind() if told["detail"] is None else kind(told["detail"])
