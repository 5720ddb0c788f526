"""Gated reads and root lists. These guard single files and stay on the driver."""

from __future__ import annotations

import hashlib
import os
from datetime import UTC, datetime

from ..operators import policy


class GateError(Exception):
    """A read that isn't allowed; kind: io, outside_allowlist or ignored_path."""

    def __init__(self, kind: str, path: str):
        super().__init__(f"{kind}: {path}")
        self.kind, self.path = kind, path


def allowed(path: str, roots: list[str], layers: list | None = None) -> str:
    """The real path, if it lies under a root and policy lets it and all above it be read."""
    try:
        real = os.path.realpath(path, strict=True)
    except OSError as e:
        raise GateError("io", path) from e
    if not any(real == r or real.startswith(r.rstrip("/") + "/") for r in map(os.path.realpath, roots)):
        raise GateError("outside_allowlist", real)
    if policy.classify_tree(layers or [policy.default_rules()], real, os.path.isdir(real)) != policy.INDEXED:
        raise GateError("ignored_path", real)
    return real


def read(path: str, roots: list[str], caller: str | None = None, layers: list | None = None) -> tuple[bytes, dict]:
    """(content, audit row) of a file that may be read; the caller appends the row to read_audit."""
    real = allowed(path, roots, layers)
    try:
        with open(real, "rb") as f:
            content = f.read()
    except OSError as e:
        raise GateError("io", real) from e
    row = {"path": real, "content_hash": hashlib.sha256(content).hexdigest(), "timestamp": datetime.now(UTC), "caller": caller}
    return content, row


def parse_roots(text: str) -> list[tuple[str, bool]]:
    """(root, enabled) of each line; # begins a comment, ! disables."""
    out = []
    for line in text.splitlines():
        name = line.strip()
        if name and not name.startswith("#"):
            out.append((name.lstrip("!").strip(), not name.startswith("!")))
    return out


def format_roots(roots: list[tuple[str, bool]]) -> str:
    return "".join(("" if on else "!") + root + "\n" for root, on in roots)


def roots_changed(old: list[tuple[str, bool]], new: list[tuple[str, bool]]) -> tuple[set[str], set[str]]:
    """(added, removed) among the enabled roots."""
    a, b = {r for r, on in old if on}, {r for r, on in new if on}
    return b - a, a - b
