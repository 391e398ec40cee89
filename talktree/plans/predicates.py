"""Query plans to column predicates."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from talktree.functions.text import canonical_role, contains, is_generated_note
from talktree.plans.query import Query, role_values

TRUE = F.lit


def every(parts: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def some(parts: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def conversation_time(create: str = "create_time", update: str = "update_time") -> Column:
    """The time that dates are held against and lists are sorted by."""
    return F.coalesce(F.col(update), F.col(create), F.lit(0.0))


def in_dates(q: Query, time: Column) -> Column:
    parts = [time >= q.after] if q.after is not None else []
    return every(parts + ([time < q.before] if q.before is not None else []))


def positive(q: Query, norm: Column, extra: Iterable[str] = ()) -> Column:
    """All the wanted fragments, or any of them in OR mode."""
    wanted = [contains(norm, f, q.match_mode) for f in (*extra, *q.phrases, *q.terms) if f]
    if not wanted:
        return F.lit(True)
    return some(wanted) if q.or_mode else every(wanted)


def excluded(q: Query, norm: Column) -> Column:
    """Whether any excluded fragment is there."""
    return some(contains(norm, f, q.match_mode) for f in q.exclude)


def message_text(q: Query, norm: Column, text: Column, kind: Column) -> Column:
    """A message's own text fits: wanted and required fragments, no excluded ones, no generated note."""
    required = every(contains(norm, f, q.match_mode) for f in q.required_phrases if f)
    return positive(q, norm) & required & ~excluded(q, norm) & ~is_generated_note(kind, text)


def title_text(q: Query, norm: Column, source_norm: Column) -> Column:
    """A title fits as a hit of its own."""
    required = every(contains(norm, f, q.match_mode) for f in (q.required_title, *q.required_phrases) if f)
    return positive(q, norm, [q.title] if q.title else []) & required & in_source(q, source_norm) & ~excluded(q, norm)


def in_source(q: Query, source_norm: Column) -> Column:
    return contains(source_norm, q.source) if q.source else F.lit(True)


def has_role(q: Query, role: Column) -> Column:
    return canonical_role(role).isin(*role_values(q.role)) if q.role else F.lit(True)


def message_filters(q: Query, role: Column, title_norm: Column, source_norm: Column, time: Column) -> Column:
    """What a message's role and conversation must be; an excluded title takes its messages along."""
    titles = every(contains(title_norm, t, q.match_mode) for t in (q.title, q.required_title) if t)
    return has_role(q, role) & in_source(q, source_norm) & in_dates(q, time) & titles & ~excluded(q, title_norm)
