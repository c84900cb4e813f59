import pytest

from clusterlens.operators import extract, states
from clusterlens.plans import flows
from clusterlens.sources import bundled
from clusterlens.sources.rules import Group, Rule, RuleSet, load_rules, scan_pattern

C2 = "container_1502222838299_0001_01_000002"
APP = "application_1502222838299_0001"
LINES = [
    "2021-03-04 08:15:00.250 WARN Executor: Running task 3.1 (speculative) in stage 7.2 (TID 41)",
    "2021-03-04 08:15:09.125 INFO Executor: Finished task 12.0 after retry in stage 7.2 (TID 40). wrote 88 and 20480 bytes",
]


def lines(spark, texts):
    return spark.createDataFrame(
        [(C2, t, i) for i, t in enumerate(texts)], "container_id STRING, line STRING, seq BIGINT"
    )


def test_executor_lines(spark, rows):
    facts = extract.apply_rules(lines(spark, LINES), bundled.EXECUTOR)
    got = [
        (r.seq, f"{r.type}:{r.name}", r.value, r.is_finish, r.ts.strftime("%H:%M:%S.%f")[:12], r.tags)
        for r in facts.orderBy("seq", "rule_id", "group_id").toLocalIterator()
    ]
    ids = {"container": C2, "app": APP}
    assert got == [
        (0, "instant:stage", 7.2, False, "06:15:00.250", {"stageID": "7.2", **ids}),
        (0, "period:task", 1.0, False, "06:15:00.250", {"TID": "41", **ids}),
        (1, "instant:stage", 1.0, False, "06:15:09.125", {"stageID": "stage_7.2", **ids}),
        (1, "period:task", 1.0, True, "06:15:09.125", {"TID": "40", **ids}),
        (1, "instant:byte.transferred", 20480.0, True, "06:15:09.125", ids),
    ]


def test_greedy_prefix_eats_digits(spark):
    text = "17/07/25 23:57:16 INFO Task 7 force spilling in-memory map to disk and it will release 12.3 MB memory"
    fact = extract.apply_rules(lines(spark, [text]), bundled.EXECUTOR).first()
    assert (fact.name, fact.value, fact.tags["TID"]) == ("byte.spill", pytest.approx(2411724.8), "7")


def test_all_matching_rules_and_bad_facts(spark, rows):
    rules = [
        Rule(r".*x=(?<x>\S+).*", (Group("x", "instant", "x"), Group("y", "instant", "missing"))),
        Rule(r".*x=.*", (Group("one", "event", "1", ("nothing",)), Group("two", "event", "2"))),
    ]
    texts = ["2020-01-01 00:00:00 x=5", "2020-01-01 00:00:00 x=none", "no time x=5", "2020-01-01 00:00:00 y"]
    facts = extract.apply_rules(lines(spark, texts), rules)
    assert rows(facts, "seq", "name", "type", "value") == [
        (0, "two", "event", 2.0),
        (0, "x", "instant", 5.0),
        (1, "two", "event", 2.0),
    ]


def test_facts_and_rejects_are_all_groups(spark, rows):
    rule = Rule(r".*x=(?<x>\S+).*", (Group("x", "instant", "x"), Group("y", "instant", "missing")))
    df = lines(spark, ["2020-01-01 00:00:00 x=5", "2020-01-01 00:00:00 x=KB", "no time x=5"])
    rejects = extract.rejected_facts(df, [rule])
    assert rows(rejects, "seq", "group_id", "reason") == [
        (0, 1, "value"), (1, 0, "value"), (1, 1, "value"), (2, 0, "time"), (2, 1, "time"),
    ]
    assert extract.apply_rules(df, [rule]).count() + rejects.count() == 3 * 2


def test_manager_roles(spark, rows):
    texts = [
        f"2017-07-25 23:57:16,1 INFO Container {C2} transitioned from A to RUNNING now",
        f"2017-07-25 23:57:16,1 INFO Container {C2} transitioned from A to NOWHERE",
        f"2017-07-25 23:57:16,1 INFO Start request for {C2} by user u",
        f"2017-07-25 23:57:16,1 INFO {APP} State change from A to FINISHED",
        "2017-07-25 23:57:16,1 INFO appattempt_1502222838299_0001_000001 State change from A to FINISHED",
        f"2017-07-25 23:57:16,1 INFO {C2} Container Transitioned from A to ACQUIRED",
        f"2017-07-25 23:57:16,1 INFO {C2} Container Transitioned from A to NOWHERE",
    ]
    df = lines(spark, texts).drop("container_id")
    nm = extract.apply_manager_rules(df, bundled.MANAGER, "nm")
    assert rows(nm, "seq", "name", "container_id", "app_id", "value") == [
        (0, "state", C2, APP, 4.0),
        (3, "app.state", None, APP, 1.0),
        (4, "app.attempt.state", None, None, 1.0),
        (5, "rm.container.state", C2, APP, 1.0),
        (6, "rm.container.state", C2, APP, 1.0),
    ]
    rm = extract.apply_manager_rules(df, bundled.MANAGER, "rm")
    got = {(r.seq, r.name): (r.value, r.app_id, r.tags) for r in rm.toLocalIterator()}
    attempt = {"app": APP, "app.attempt": "appattempt_1502222838299_0001_000001"}
    both = {"app": APP, "container": C2}
    assert got == {
        (0, "state"): (1.0, APP, both),
        (1, "state"): (1.0, APP, both),
        (2, "state"): (1.0, APP, both),
        (3, "app.state"): (8.0, APP, {"app": APP}),
        (4, "app.attempt.state"): (9.0, APP, attempt),
        (5, "rm.container.state"): (4.0, APP, both),
    }


def test_state_events(spark, rows):
    texts = [
        f"2017-07-25 23:57:16,1 INFO x: Start request for {C2} by user u",
        f"2017-07-25 23:57:17,1 INFO x: Container {C2} transitioned from A to RUNNING",
        "2017-07-25 23:57:17,1 INFO other",
    ]
    assert rows(states.state_events(lines(spark, texts)), "container_id", "state", "seq") == [
        (C2, "NEW", 0),
        (C2, "RUNNING", 1),
    ]


@pytest.mark.parametrize(
    ("regex", "names", "literal"),
    [
        (r".*Running (?<a>x)(?:y)(z)(?<b>w).*", {"a": 1, "b": 3}, "Running "),
        (r"a|bc", {}, None),
        (r"[(](?<a>.)\(x\)", {"a": 1}, "(x)"),
        (r"abc?d+e{2}f", {}, "ab"),
        (r"(?i)abc", {}, None),
        (r"(?<=q)(?<n>\d+) end", {"n": 1}, " end"),
    ],
)
def test_scan_pattern(regex, names, literal):
    assert scan_pattern(regex) == (names, literal)


XML = """<rules>
 <rule><regex>.*go (?&lt;id&gt;[0-9]+).*</regex><dateOffset>-1000</dateOffset>
  <group><name>go</name><type>period</type><tags><tag>id</tag></tags><value>1</value></group>
  <group><name>size</name><type>instant</type><tag>id</tag><isFinish>true</isFinish><value>id</value></group>
  <group><type>instant</type><value>1</value></group>
 </rule>
 <rule><dateOffset>5</dateOffset><group><name>x</name><type>instant</type><value>1</value></group></rule>
 <rule><regex>.*state.*</regex><group><name>state</name><type>instant</type><tag>a</tag><tag>b</tag></group></rule>
</rules>"""


def test_load_rules(spark, tmp_path):
    path = tmp_path / "rules.xml"
    path.write_text(XML)
    assert load_rules(spark, str(path)) == [
        Rule(
            ".*go (?<id>[0-9]+).*",
            (
                Group("go", "period", "1", ("id",)),
                Group("size", "instant", "id", ("id",), is_finish=True),
            ),
            -1000,
        ),
        Rule(".*state.*", (Group("state", "instant", None, ("a", "b")),)),
    ]


def test_rule_without_value_is_refused(spark, tmp_path):
    path = tmp_path / "rules.xml"
    path.write_text("<rules><rule><regex>x</regex><group><name>n</name><type>instant</type></group></rule></rules>")
    with pytest.raises(ValueError, match="no <value>"):
        load_rules(spark, str(path))


def test_rule_set_union():
    own = Rule("x", (Group("n", "instant", "1"),))
    merged = bundled.DEFAULT.with_container([own]).with_manager([own])
    assert merged.container[-1] is own and merged.manager[-1] is own
    assert RuleSet() == RuleSet((), ())


def test_routing(spark, rows):
    records = [
        (None, "any"),
        ("container_1-log", "container_1 is finished."),
        ("testlog-log", "1500000000000"),
        ("container_1-metric", "csv"),
        ("container_1-log", "container_1 2017-"),
        ("container_1-log", "nobody 2017-"),
        ("nodemanager-log", "x"),
        ("resourcemanager-log", "x"),
        ("other", "x"),
    ]
    df = spark.createDataFrame(records, "key STRING, value STRING")
    routed = extract.route(df)
    assert [r.route for r in routed.toLocalIterator()] == [
        "drop", "container_finish", "probe", "metric", "container_log", "container_log",
        "nm_log", "rm_log", "unrecognized",
    ]
    assert rows(extract.rejects(routed), "key", "value") == [
        ("container_1-log", "nobody 2017-"), ("other", "x"),
    ]
    assert rows(extract.container_finishes(routed), "container_id") == [("container_1",)]


def test_all_roles_are_read_in_one_scan(spark, tmp_path):
    records = [
        ("container_5_0003_01_000002-log", "container_5_0003_01_000002 2020-01-01 10:00:00 INFO Executor: Running task 1.0 in stage 0.0 (TID 7)"),
        ("nodemanager-log", "2020-01-01 10:00:01 INFO ContainerImpl: Container container_5_0003_01_000002 transitioned from NEW to RUNNING"),
        ("resourcemanager-log", "2020-01-01 10:00:02 INFO RMAppImpl: application_5_0003 State change from NEW to FINISHED"),
        ("container_5_0003_01_000002-log", "nobody 2020-01-01 10:00:00 x"),
    ]
    path = str(tmp_path / "records")
    spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(records)], "seq BIGINT, key STRING, value STRING").write.parquet(path)
    routed = extract.route(spark.read.parquet(path))
    facts = flows.facts(routed, bundled.DEFAULT)
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
    apart = extract.apply_rules(extract.split_container_line(routed.where("route = 'container_log'")).where("line is not null"), bundled.DEFAULT.container)
    for role in ("nm", "rm"):
        lines = routed.where(f"route = '{role}_log'").selectExpr("seq", "value AS line")
        apart = apart.unionByName(extract.apply_manager_rules(lines, bundled.MANAGER, role))
    got, want = (sorted(map(str, df.collect())) for df in (facts, apart))
    assert got == want and len(got) >= 4


def test_facts_and_rejects_of_one_pass(spark):
    rule = Rule(r".*x=(?<x>\S*) y=(?<y>\S*)", (Group("x", "instant", "x", ("y",)), Group("y", "instant", "y")))
    lines = ["2020-01-01 00:00:00 x=1 y=2", "2020-01-01 00:00:00 x=a y=3", "bad x=1 y=2", "2020-01-01 00:00:00 x=4 y=\x1f5", "x", ""]
    df = spark.createDataFrame([(i, "c", x, "container") for i, x in enumerate(lines)], "seq BIGINT, container_id STRING, line STRING, role STRING")
    both = extract.apply_rule_set(df, RuleSet((rule,), ()), keep="all")
    facts = sorted((r.seq, r.name, r.value, r.tags.get("y")) for r in both.where("reason is null").collect())
    assert facts == [(0, "x", 1.0, "2"), (0, "y", 2.0, None), (1, "y", 3.0, None), (3, "x", 4.0, "\x1f5"), (3, "y", 5.0, None)]
    assert sorted((r.seq, r.name, r.reason) for r in both.where("reason is not null").collect()) == [(1, "x", "value"), (2, "x", "time"), (2, "y", "time")]
    alone = extract.apply_rules(df, [rule])
    assert sorted(map(str, alone.collect())) == sorted(map(str, both.where("reason is null").drop("reason").collect()))
