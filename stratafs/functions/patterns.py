"""Driver-side helpers for user input: globs, search terms, durations, home paths."""

from __future__ import annotations

import os
import re

from .text import FOLD


def glob_to_like(glob: str, home: str | None = None) -> str:
    r"""A LIKE pattern (escape \) for a glob of * and ?; one without wildcards matches anywhere."""
    home = home or os.environ.get("HOME", ".")
    out = "".join({"*": "%", "?": "_", "%": r"\%", "_": r"\_", "~": home}.get(c, c) for c in glob)
    return out if "%" in out or "_" in out else f"%{out}%"


def search_terms(query: str) -> list[list[str]]:
    """The phrases of a query: its words at white space, each as tokens that must follow one another."""
    return [t for word in query.split() if (t := re.findall(r"[^\W_]+", word.lower().translate(FOLD)))]


def quoted_terms(query: str) -> str:
    """A query as quoted phrases, inner quotes doubled."""
    return " ".join('"' + word.replace('"', '""') + '"' for word in query.split())


def duration_seconds(text: str) -> int:
    """Nd, Nh, or N seconds."""
    found = re.fullmatch(r"(\d+)([dh]?)", text.strip())
    if not found:
        raise ValueError(f"not a duration: {text!r}")
    return int(found[1]) * {"d": 86_400, "h": 3_600, "": 1}[found[2]]


def escape_glob(path: str) -> str:
    """A path as a glob that matches it alone."""
    return re.sub(r"([*?\[\]{}!\\])", r"[\1]", path)


def expand_home(path: str, home: str | None = None) -> str:
    home = home or os.environ.get("HOME", ".")
    return home + path[1:] if path == "~" or path.startswith("~/") else path


def contract_home(path: str, home: str | None = None) -> str:
    home = home or os.environ.get("HOME", ".")
    return "~" + path[len(home) :] if home and path.startswith(home) else path
