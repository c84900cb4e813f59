"""Rules shipped with the library.

The patterns, names, types, tags and offsets are fixed values: they define the results.
"""

from __future__ import annotations

from clusterlens.sources.rules import Group, Rule, RuleSet

TWO_HOURS_BACK = -7200000

EXECUTOR = (
    Rule(
        r".*Running task.* in stage (?<stageID>[0-9]+\.[0-9]).*TID (?<TID>[0-9]+).*",
        (
            Group("stage", "instant", "stageID", ("stageID",)),
            Group("task", "period", "1", ("TID",)),
        ),
        TWO_HOURS_BACK,
    ),
    Rule(
        r".*Finished task.*in (?<stageID>stage [0-9]+\.[0-9]).*TID (?<TID>[0-9]+).*\s(?<byte>[0-9]+).*",
        (
            Group("stage", "instant", "1", ("stageID",)),
            Group("task", "period", "1", ("TID",), is_finish=True),
            Group("byte.transferred", "instant", "byte", is_finish=True),
        ),
        TWO_HOURS_BACK,
    ),
    Rule(
        r".*Executor killed task.*in (?<stageID>stage [0-9]+\.[0-9]).*TID (?<TID>[0-9]+).*",
        (Group("task", "period", "1", ("TID",), is_finish=True),),
        TWO_HOURS_BACK,
    ),
    Rule(
        r".*stored as (?:values|bytes) in memory.*estimated size (?<byte>[0-9]+\.[0-9]+.*),.*",
        (Group("byte.stored", "instant", "byte", is_finish=True),),
        TWO_HOURS_BACK,
    ),
    Rule(
        r".*Task (?<TID>[0-9]+) force spilling in-memory map to disk.*(?<byte>[0-9]+\.[0-9]+.*) memory",
        (Group("byte.spill", "instant", "byte", ("TID",), is_finish=True),),
        TWO_HOURS_BACK,
    ),
    Rule(
        r".*spilling in-memory map of (?<byte>[0-9]+\.[0-9]+.*) to disk.*",
        (Group("byte.spill", "instant", "byte"),),
        TWO_HOURS_BACK,
    ),
    Rule(
        r".*have map outputs for shuffle.*",
        (Group("shuffle", "period", "1.0"),),
        TWO_HOURS_BACK,
    ),
    Rule(
        r".*Started.*remote fetches in.*",
        (Group("shuffle", "period", "1.0", is_finish=True),),
        TWO_HOURS_BACK,
    ),
)

MAP_REDUCE = (
    Rule(
        r".*Down to the last merge-pass.*size: (?<byte>[0-9]+)",
        (Group("merge", "instant", "byte"),),
        TWO_HOURS_BACK,
    ),
    Rule(
        r".*kvstart = [0-9]+.*length = (?<kbyte>[0-9]+)/(?<vbyte>[0-9]+)",
        (Group("spill.key", "instant", "kbyte"), Group("spill.value", "instant", "vbyte")),
        TWO_HOURS_BACK,
    ),
    Rule(
        r".*(?<fetcherId>fetcher#[0-9]+) about to.*len: (?<byte>[0-9]+) to.*",
        (Group("fetcher", "instant", "byte", ("fetcherId",)),),
        TWO_HOURS_BACK,
    ),
    Rule(
        r".*freed by (?<fetcherId>fetcher#[0-9]+) in.*",
        (Group("fetcher", "period", "1.0", ("fetcherId",), is_finish=True),),
        TWO_HOURS_BACK,
    ),
)

CONTAINER_ID = "container_[0-9]+_[0-9]+_[0-9]+_[0-9]+"

MANAGER = (
    Rule(
        rf".*Container (?<container>{CONTAINER_ID}).*transitioned.*to (?<state>.*)",
        (Group("state", "instant", "1", ("container", "state")),),
    ),
    Rule(
        rf".*Start request for (?<container>{CONTAINER_ID}).*",
        (Group("state", "instant", "1", ("container",)),),
    ),
    Rule(
        r".*(?<app>application_[0-9]+_[0-9]+) State change from.*to (?<state>.*)",
        (Group("app.state", "instant", "1", ("app", "state")),),
    ),
    Rule(
        r".*(?<appAttempt>appattempt_[0-9]+_[0-9]+_[0-9]+).*State change from.*to (?<state>.*)",
        (Group("app.attempt.state", "instant", "1", ("appAttempt", "state")),),
    ),
    Rule(
        rf".*(?<container>{CONTAINER_ID}) Container Transitioned.*to (?<state>.*)",
        (Group("rm.container.state", "instant", "1", ("container", "state")),),
    ),
)

DEFAULT = RuleSet(container=EXECUTOR + MAP_REDUCE, manager=MANAGER)
