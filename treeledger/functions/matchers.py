"""Path matchers and ordered filter rules as predicates."""

from __future__ import annotations

import posixpath
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import ancestors, glob_regex


def match_set(path: Column, paths: list[str], include: bool = True) -> Column:
    return path.isin(paths) if include else ~path.isin(paths)


def match_prefix(path: Column, paths: list[str]) -> Column:
    """The path or any ancestor is listed; reaches the Parquet scan as equality and prefix filters."""
    listed = [posixpath.normpath(p) for p in paths]
    if any(not p or p.startswith("/") for p in [*paths, *listed]):
        raise ValueError("patterns are relative and not empty")
    return reduce(lambda a, b: a | b, [(path == p) | path.startswith(p + "/") for p in listed], F.lit(False))


def match_any(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def first_match(path: Column, is_dir: Column, rules: list[tuple[str, str]]) -> Column:
    """Whether the first rule that matches includes the path; null without one. Directories match with a
    slash appended."""
    subject, chain = F.when(is_dir, F.concat(path, F.lit("/"))).otherwise(path), None
    for action, pattern in rules:
        if action not in ("include", "exclude"):
            raise ValueError(action)
        hit = subject.rlike(glob_regex(pattern))
        chain = F.when(hit, action == "include") if chain is None else chain.when(hit, action == "include")
    return F.lit(None).cast("boolean") if chain is None else chain


def included(path: Column, is_dir: Column, rules: list[tuple[str, str]]) -> Column:
    """The first rule that matches decides; without one the path is included."""
    return F.coalesce(first_match(path, is_dir, rules), F.lit(True))


def included_with_parents(path: Column, is_dir: Column, rules: list[tuple[str, str]]) -> Column:
    """As ``included``, but an excluded directory hides all below it."""
    parents = F.slice(ancestors(path), F.lit(1), F.size(ancestors(path)) - 1)
    return included(path, is_dir, rules) & F.forall(parents, lambda p: included(p, F.lit(True), rules))
