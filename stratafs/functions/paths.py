"""Column expressions over paths: their parts, types, sizes and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Media types by extension.
MIME = {
    "md": "text/markdown", "markdown": "text/markdown", "rs": "text/x-rust", "py": "text/x-python", "txt": "text/plain",
    "json": "application/json", "yaml": "application/yaml", "yml": "application/yaml", "toml": "application/toml",
    "html": "text/html", "htm": "text/html", "css": "text/css", "js": "text/javascript", "ts": "text/typescript",
    "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg",
}
OTHER_MIME = "application/octet-stream"
#: Extensions of media.
AUDIO = ("mp3", "flac", "ogg", "m4a", "aac", "wav", "opus", "wma", "aiff")
VIDEO = ("mp4", "mkv", "avi", "mov", "wmv", "webm", "flv", "m4v", "ts")
IMAGE = ("jpg", "jpeg", "png", "gif", "bmp", "tiff", "webp", "heic", "raw", "cr2", "nef")
#: Directories that can be made anew, and what shows how.
REGENERABLE = ("target", "node_modules", ".cache", "__pycache__", "build", "dist", ".gradle", ".m2", "venv", ".venv", "vendor")
MANIFESTS = ("Cargo.toml", "package.json", "build.gradle", "go.mod", "pyproject.toml", "Makefile")
PASSING_DIRS = ("downloads", "tmp", "temp")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    """The directory that holds an absolute path; / for what lies right under it."""
    return F.regexp_replace(path, r"(?<=.)/[^/]*$|(?<=^/)[^/]*$", "")


def extension(path: Column) -> Column:
    """In lower case, without its dot; null where the name has no dot behind its first character."""
    name = basename(path)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1)))


def stem(path: Column) -> Column:
    name = basename(path)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)


def extension_label(path: Column) -> Column:
    return F.coalesce(F.concat(F.lit("."), extension(path)), F.lit("(none)"))


def ancestors(path: Column) -> Column:
    """The directories above a path, from the root's first one down."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def proper_ancestors(path: Column) -> Column:
    return F.when(F.size(F.split(path, "/")) > 2, ancestors(path)).otherwise(F.array().cast("array<string>"))


def suffix_of_depth(path: Column, depth: Column) -> Column:
    """The last `depth` names of a path."""
    return F.array_join(F.slice(F.split(path, "/"), -depth, depth), "/")


def mime(path: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for pair in MIME.items() for x in pair))
    return F.coalesce(F.element_at(pairs, F.coalesce(extension(path), F.lit("?"))), F.lit(OTHER_MIME))


def media_family(ext: Column) -> Column:
    low = F.lower(ext)
    return F.when(low.isin(*AUDIO), "audio").when(low.isin(*VIDEO), "video").when(low.isin(*IMAGE), "image")


def format_bytes(n: Column) -> Column:
    """B, KB, MB or GB, by 1024, with one decimal above bytes; halves go to the even digit."""
    unit = lambda power, name: F.format_string(f"%.1f {name}", F.bround(n / float(1024**power), 1))
    return F.when(n >= 1024**3, unit(3, "GB")).when(n >= 1024**2, unit(2, "MB")).when(n >= 1024, unit(1, "KB")).otherwise(F.format_string("%d B", n))


def format_mtime(seconds: Column) -> Column:
    """The UTC day of epoch seconds; what lies before 1970 shows as its first day."""
    return F.date_format(F.timestamp_seconds(F.greatest(seconds, F.lit(0))), "yyyy-MM-dd")


def canonical_score(path: Column, tier: Column) -> Column:
    """How fit a path is to be the one kept of its copies; tier is what policy makes of it."""
    above = F.transform(F.reverse(proper_ancestors(path)), lambda d: F.lower(F.element_at(F.split(d, "/"), -1)))
    telling = F.get(F.filter(above, lambda d: d.isin(*REGENERABLE, *PASSING_DIRS)), 0)
    place = F.when(telling.isin(*REGENERABLE), 40).when(telling.isin(*PASSING_DIRS), 30).otherwise(0)
    name = F.lower(basename(path))
    spare = F.when(reduce(lambda a, b: a | b, (F.contains(name, F.lit(x)) for x in ("backup", "copy", "old"))), 20).otherwise(0)
    policy = F.when(tier == "cataloged", 50).when(tier == "ignored", 80).otherwise(0)
    return F.lit(100) - policy - place - spare - F.size(F.split(path, "/"))


def regenerable_reason(name: Column, manifest: Column) -> Column:
    """Why a directory of that name can be made anew; manifest: the first build file beside it, if any."""
    there = F.concat(F.lit(" ("), manifest, F.lit(" in parent)"))
    say = lambda words: F.concat(F.lit(words), there)
    named = (
        F.when(name == "target", say("cargo build output")).when(name == "node_modules", say("npm dependency cache"))
        .when(name == ".gradle", say("gradle cache")).when(name == ".m2", say("maven cache"))
        .when(name == "vendor", say("vendored dependencies"))
        .when(name.isin("venv", ".venv"), F.coalesce(say("python venv"), F.lit("python venv")))
        .when(name == "__pycache__", F.lit("python bytecode cache")).otherwise(say("build output"))
    )
    return F.when(name.isin(*REGENERABLE), named)


def xdg_or_trash(path: Column, home: str) -> Column:
    """Why a directory is a cache or a trash can, or null."""
    inside = lambda top: (path == top) | path.startswith(top + "/")
    return F.when(inside(f"{home}/.cache"), F.lit("XDG cache directory")).when(inside(f"{home}/.local/share/Trash"), F.lit("trash directory"))
