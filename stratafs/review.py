"""Review files: decisions read back from edited reports. Tab-separated, so paths may hold spaces."""

from __future__ import annotations

from .functions.patterns import contract_home, escape_glob, expand_home

ACTIONS = ("catalog", "ignore", "keep", "redundant")


def parse(text: str, home: str | None = None) -> list[tuple[str, str]]:
    """(action, path) of each line; comments, blanks and unknown actions are passed over."""
    out = []
    for line in text.splitlines():
        if line.strip() and not line.lstrip().startswith("#"):
            parts = [p.strip() for p in (line.split("\t") if "\t" in line else line.split(None, 2))]
            if len(parts) > 1 and parts[0] in ACTIONS and parts[1]:
                out.append((parts[0], expand_home(parts[1], home)))
    return out


def apply_to_rules(rules: str, decisions: list[tuple[str, str]], home: str | None = None) -> tuple[str, int]:
    """An ignore file with patterns added for the ignored and cataloged paths, and how many were."""
    wanted = {a: [escape_glob(contract_home(p, home)) for x, p in decisions if x == a] for a in ("ignore", "catalog")}
    lines = rules.splitlines()
    section = next((i for i, x in enumerate(lines) if x.strip() == "[catalog]"), None)
    if wanted["catalog"]:
        if section is None:
            lines += ["[catalog]"]
            section = len(lines) - 1
        end = next((i for i in range(section + 1, len(lines)) if lines[i].strip().startswith("[") and lines[i].strip().endswith("]")), len(lines))
        lines[end:end] = wanted["catalog"]
    if wanted["ignore"]:  # before any section, where patterns are those to ignore
        first = next((i for i, x in enumerate(lines) if x.strip().startswith("[") and x.strip().endswith("]")), len(lines))
        lines[first:first] = wanted["ignore"]
    return "\n".join(lines) + ("\n" if lines else ""), sum(map(len, wanted.values()))


def backup_summary(decisions: list[tuple[str, str]]) -> list[str]:
    """What would be deleted; nothing is."""
    gone = [p for a, p in decisions if a == "redundant"]
    kept = sum(a == "keep" for a, _ in decisions)
    head = [f"{len(gone)} file(s) marked redundant; nothing is deleted:"] if gone else ["No files marked redundant."]
    return head + [f"  would delete: {p}" for p in gone] + ([f"{kept} file(s) kept."] if kept else [])
