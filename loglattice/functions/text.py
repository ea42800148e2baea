"""Small text expressions: tokens of templates, names of directories and workspaces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WILDCARD = "<*>"


def template_tokens(content: Column, delimiters: str = "|=,") -> Column:
    """Tokens of a line: delimiters count as spaces, the ends are trimmed, single spaces separate."""
    spaced = F.translate(content, delimiters, " " * len(delimiters))
    return F.split(F.regexp_replace(spaced, r"(?U)^\s+|\s+\z", ""), " ", -1)


def dir_name(name: Column) -> Column:
    """A name of a directory: lower case, other characters than a-z, 0-9 and - become -, `unknown` if none is left."""
    clean = F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9-]", "-"), F.lit("-"))
    return F.when(clean == "", F.lit("unknown")).otherwise(clean)


def topic_slug(topic: Column) -> Column:
    """The name of a workspace; null if nothing is left of the topic."""
    slug = F.trim(F.regexp_replace(F.lower(topic), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(slug != "", slug)
