"""Container, application and attempt identifiers.

Grammar: ``container_<clusterTs>_<appSeq>_<attempt>_<containerSeq>`` (an epoch part such as ``e17``
may follow ``container``), ``application_<clusterTs>_<appSeq>``,
``appattempt_<clusterTs>_<appSeq>_<attempt>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

APP_MASTER_SUFFIX = "000001"


def _part(id_: Column, index: int) -> Column:
    return F.try_element_at(F.split(id_, "_"), F.lit(index))


def _has_parts(id_: Column, count: int) -> Column:
    return F.size(F.split(id_, "_")) >= count


def container_to_app(container: Column) -> Column:
    """Application id of a container id, null when the id has too few parts."""
    return F.when(
        _has_parts(container, 5),
        F.concat(F.lit("application_"), _part(container, -4), F.lit("_"), _part(container, -3)),
    )


def attempt_to_app(attempt: Column) -> Column:
    return F.when(
        _has_parts(attempt, 4),
        F.concat(F.lit("application_"), _part(attempt, -3), F.lit("_"), _part(attempt, -2)),
    )


def attempt_to_short_app(attempt: Column) -> Column:
    return F.when(
        _has_parts(attempt, 4), F.concat(_part(attempt, -3), F.lit("_"), _part(attempt, -2))
    )


def short_attempt(attempt: Column) -> Column:
    return _part(attempt, -1)


def container_to_short_app(container: Column) -> Column:
    return F.when(
        _has_parts(container, 5), F.concat(_part(container, -4), F.lit("_"), _part(container, -3))
    )


def short_container(container: Column) -> Column:
    return F.when(
        _has_parts(container, 2), F.concat(_part(container, -2), F.lit("_"), _part(container, -1))
    ).otherwise(container)


def short_app(app: Column) -> Column:
    return F.when(
        _has_parts(app, 3), F.concat(_part(app, 2), F.lit("_"), _part(app, 3))
    ).otherwise(app)


def short_tags(tags: Column) -> Column:
    """Shorten the `container` and `app` entries of a tag map, keep the rest."""
    return F.transform_values(
        tags,
        lambda k, v: F.when(k == "container", short_container(v))
        .when(k == "app", short_app(v))
        .otherwise(v),
    )


def is_app_master(container: Column) -> Column:
    return container.endswith(APP_MASTER_SUFFIX)


def tag_key(tags: Column) -> Column:
    """Order-free string form of a tag map, usable as a grouping key."""
    return F.to_json(F.array_sort(F.map_entries(tags)))


def tags_of_key(key: Column) -> Column:
    """Tag map of its `tag_key`."""
    return F.map_from_entries(F.from_json(key, "ARRAY<STRUCT<key STRING, value STRING>>"))
