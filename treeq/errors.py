"""Errors with a code. Nothing that the engine doesn't understand passes silently."""

from __future__ import annotations


class EngineError(ValueError):
    code = "other"


class ParseError(EngineError):
    """The query text can't be read."""

    code = "parse"


class ShapeError(EngineError):
    """A clause, operator, field or value that isn't allowed where it stands."""

    code = "shape"


class PermissionDenied(EngineError):
    code = "permission_denied"


class NoContext(EngineError):
    code = "no_context"


class ProfileBlocked(EngineError):
    code = "profile_blocked"


class NotFound(EngineError):
    """A model, relation, source or callback that isn't registered."""

    code = "not_found"


class Conflict(EngineError):
    """A write that would break a key."""

    code = "conflict"


#: The codes that callers of other languages are told; all else is "other".
PUBLIC = ("permission_denied", "no_context", "profile_blocked", "not_found")


def public_code(error: BaseException) -> str:
    code = getattr(error, "code", "other")
    return code if code in PUBLIC else "other"
