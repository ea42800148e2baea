"""From lines to reports in one job: entries, templates, labels, matches, and the files of a workspace."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from loglattice.operators import labels, multiline, reports, templates
from loglattice.plans.stages import materialise

KEYS = ["file_name", "start_line"]


@dataclass(frozen=True)
class Workspace:
    """What a run finds: entries, templates, labelled templates, and entries with their templates."""

    entries: DataFrame
    templates: DataFrame
    labelled: DataFrame
    matched: DataFrame


def analyse_lines(lines: DataFrame, given_labels: DataFrame | None = None, **discovery) -> Workspace:
    """Runs all steps over lines (file_name, line_no, content); without labels the rule-based ones are used."""
    return analyse_entries(multiline.merge_multiline(lines), given_labels, **discovery)


def analyse_entries(entries: DataFrame, given_labels: DataFrame | None = None, **discovery) -> Workspace:
    entries = materialise(entries)
    found = materialise(templates.discover_templates(entries, **discovery))
    labelled = materialise(labels.apply_labels(found, given_labels if given_labels is not None else labels.default_labels(found)))
    return Workspace(entries, found, labelled, materialise(templates.match_templates(entries, found, KEYS)))


def build_workspace(lines: DataFrame, path: str, topic: str, given_labels: DataFrame | None = None, merge: bool = True) -> Workspace:
    """analyse_lines, and its reports written for the topic in place of an earlier run's. Without `merge` every line is an
    entry of its own."""
    slug = re.sub("[^a-z0-9]+", "-", topic.lower()).strip("-")
    if not slug:
        raise ValueError(f"{topic!r} leaves no name for a workspace")
    done = analyse_lines(lines, given_labels) if merge else analyse_entries(lines.withColumnRenamed("line_no", "start_line"), given_labels)
    reports.write_reports(done.matched, done.labelled, path, slug)
    return done
