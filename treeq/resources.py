"""Paths and addresses of stored files."""

from __future__ import annotations

import re

from treeq.errors import ShapeError


def content_path(digest: str, suffix: str = "") -> str:
    """Where a file of this digest lies: two levels of folders from its first digits."""
    if not re.fullmatch(r"[0-9a-f]{8,}", digest):
        raise ShapeError("a digest is eight or more lowercase hex digits")
    if suffix and not re.fullmatch(r"\.?[A-Za-z0-9]+", suffix):
        raise ShapeError("a suffix is letters and digits")
    return f"{digest[:2]}/{digest[2:4]}/{digest}" + (f".{suffix.lstrip('.')}" if suffix else "")


def resource_url(base: str, path: str) -> str:
    """base and path with one slash between; absolute addresses stay as they are."""
    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://", path) or path.startswith("//"):
        return path
    return f"{base.rstrip('/')}/{path.lstrip('/')}"
