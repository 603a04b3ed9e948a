"""Errors of reading, converting and rendering objects; in tables they are (code, message) columns."""

from __future__ import annotations


class ObjectError(ValueError):
    """code names the kind of failure; the message is for people."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def fail(code: str, message: str) -> ObjectError:
    return ObjectError(code, message)
