"""Column expressions over names, paths, globs and image references."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F

# Image schemes, the shape of a tag that is a hash, and of a
# bare name-version string.
IMAGE_SCHEMES = "^(docker://)?(oras://)?(library://)?(shub://)?"
HASH_TAG = "^[0-9a-f]{12,}$"
NAME_DASH_VERSION = r"^(.*?)-(\d.*)$"


def basename(path: Column) -> Column:
    """The last component of a path; a trailing slash names the same thing."""
    return F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1)


def short_process(process: Column) -> Column:
    """The step name without its workflow path."""
    return F.substring_index(F.coalesce(process, F.lit("")), ":", -1)


def glob_regex(globs) -> str | None:
    """One anchored regular expression for a few shell globs, None for none."""
    parts = [fnmatch.translate(g).removesuffix(r"\Z").removesuffix(r"\z") for g in globs]
    return "^(?:" + "|".join(parts) + r")\z" if parts else None


def ignored(name: Column, globs) -> Column:
    """Whether a file name is one of the bookkeeping names to leave out."""
    regex = glob_regex(globs)
    return name.rlike(regex) if regex else F.lit(False)


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def let(value: Column, body) -> Column:
    """`body` over a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def image_parts(image: Column) -> Column:
    """
    struct(name, version, components) of an image reference; version is NULL
    when the reference confirms none (no tag, `latest`, or a content hash).
    """
    bare = F.substring_index(F.regexp_replace(F.trim(F.coalesce(image, F.lit(""))), IMAGE_SCHEMES, ""), "@", 1)
    last = let(bare, lambda text: F.when(
        text.rlike(r"\.(img|sif)$"), F.regexp_replace(basename(text), r"\.[^.]*$", "")
    ).otherwise(F.substring_index(text, "/", -1)))

    def split(last: Column) -> Column:
        tagged, dashed = last.contains(":"), last.rlike(NAME_DASH_VERSION)
        name = (F.when(tagged, F.regexp_replace(last, ":[^:]*$", ""))
                .when(dashed, F.regexp_extract(last, NAME_DASH_VERSION, 1)).otherwise(last))
        said = F.when(tagged, F.substring_index(last, ":", -1)).when(
            dashed, F.regexp_extract(last, NAME_DASH_VERSION, 2))
        return F.struct(name.alias("name"), said.alias("said"))

    def parts(found: Column) -> Column:
        name, said = found["name"], found["said"]
        version = F.when((said != "latest") & ~F.substring_index(said, "-", 1).rlike(HASH_TAG), said)
        words = F.array_remove(F.array_distinct(F.concat(F.array(name), F.split(name, "[_-]+"))), "")
        return F.struct(name.alias("name"), version.alias("version"), words.alias("components"))

    return let(let(last, split), parts)


def version_agrees(wanted: Column, have: Column) -> Column:
    """"1.21" holds for "1.21" and "1.21--build" but not for "1.2" or "1.210"."""
    rest = F.substring(have, F.length(wanted) + F.lit(1), F.length(have))
    return have.startswith(wanted) & ~rest.rlike("^[0-9]")


def dotted_prefixes(name: Column) -> Column:
    """The name itself and everything before each of its dots: a.b.c -> a, a.b, a.b.c."""
    parts = F.split(name, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def ancestors(path: Column) -> Column:
    """Every parent folder of a path, nearest first, with its depth: a/b/c -> a/b, a."""
    parts = F.split(path, "/")
    return F.transform(
        F.when(F.size(parts) > 1, F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1))).otherwise(
            F.array().cast("array<int>")),
        lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("folder")))
