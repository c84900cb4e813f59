"""State names of containers, applications and attempts, with their numeric codes."""

from __future__ import annotations

import json
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# State name -> code, per kind of entity.
CONTAINER = {
    "NEW": 1, "LOCALIZING": 2, "LOCALIZED": 3, "RUNNING": 4, "KILLING": 5,
    "EXITED_WITH_SUCCESS": 6, "DONE": 7, "LOCALIZATION_FAILED": 8,
    "CONTAINER_CLEANEDUP_AFTER_KILL": 9, "EXITED_WITH_FAILURE": 10,
}
APP = {
    "NEW": 1, "NEW_SAVING": 2, "SUBMITTED": 3, "ACCEPTED": 4, "RUNNING": 5, "FINAL_SAVING": 6,
    "FINISHING": 7, "FINISHED": 8, "FAILED": 9, "KILLING": 10, "KILLED": 11,
}
APP_ATTEMPT = {
    "NEW": 1, "SUBMITTED": 2, "SCHEDULED": 3, "ALLOCATED": 4, "LAUNCHED": 5, "FAILED": 6,
    "RUNNING": 7, "FINISHING": 8, "FINISHED": 9, "KILLED": 10, "ALLOCATED_SAVING": 11,
    "LAUNCHED_UNMANAGED_SAVING": 12, "FINAL_SAVING": 13,
}
RM_CONTAINER = {
    "NEW": 1, "RESERVED": 2, "ALLOCATED": 3, "ACQUIRED": 4, "RUNNING": 5, "COMPLETED": 6,
    "EXPIRED": 7, "RELEASED": 8, "KILLED": 9,
}
# An application is over when its code is above this value (FINISHING ... KILLED).
APP_FINISHED_ABOVE = 6.5

TABLES = {
    "container": CONTAINER,
    "app": APP,
    "app_attempt": APP_ATTEMPT,
    "rm_container": RM_CONTAINER,
}


def state_code(kind: str, state: Column) -> Column:
    """Code of a state name as DOUBLE, null for an unknown name."""
    codes = F.create_map(*[F.lit(x) for x in chain(*TABLES[kind].items())])
    return F.try_element_at(codes, state).cast("double")


def any_state_code(kind: Column, state: Column) -> Column:
    """`state_code` for a kind that differs from row to row."""
    codes = {f"{k}:{name}": code for k, table in TABLES.items() for name, code in table.items()}
    table = F.from_json(F.lit(json.dumps(codes)), "MAP<STRING, DOUBLE>")
    return F.try_element_at(table, F.concat(kind, F.lit(":"), state))
