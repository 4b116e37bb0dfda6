"""Queries over the given tables, grouped by subject."""

from importlib import import_module

SUBJECTS = ["urls", "copy", "visibility", "runs", "scorecard", "calendar", "checks", "evidence", "capture", "worklists"]


def load_all():
    from .registry import RUN, SQL

    for subject in SUBJECTS:
        import_module(f"{__name__}.{subject}")
    return RUN, SQL
