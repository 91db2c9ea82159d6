"""Faults of documents by path."""

import copy
import json

from chronoweave.sources import documents

GOOD = {
    "project": "p", "timezone": "Australia/Sydney", "days": {"d1": "2026-05-01"}, "registers": ["wide", "close"],
    "cameras": [{"name": "A", "prefix": "A0", "operator": "ana", "clock": "timecode", "clock_offset_s": -1.5}, {"name": "B", "path_contains": "card", "stamp": "end"}],
    "people": [{"id": "x"}], "deliverable_types": [{"id": "reel", "count": 3, "duration_s": [10, 20.5]}],
    "sessions": [{"id": "s1", "day": "d1", "start": "09:00", "end": "10:30", "cameras": ["A", "B"], "feeds": "reel", "people": ["x"], "capture": [{"operator": "ana", "registers": ["wide"], "feeds": ["reel"]}]}],
}


def change(path, value):
    doc = copy.deepcopy(GOOD)
    *way, last = path
    at = doc
    for p in way:
        at = at[p]
    if value is None:
        del at[last]
    else:
        at[last] = value
    return doc


CASES = [
    (("project",), None, ("project", "is required")),
    (("days",), None, ("days", "is required")),
    (("colour",), 1, ("colour", "is an unknown key")),
    (("timezone",), "not a zone", ("timezone", "'not a zone' is no zone name")),
    (("days",), [1], ("days", "is no mapping")),
    (("days", "d1"), "soon", ("days.d1", "'soon' is no date (YYYY-MM-DD)")),
    (("cameras", 0, "name"), None, ("cameras[0].name", "is required")),
    (("cameras", 1, "name"), "A", ("cameras[1].name", "'A' is listed more than once")),
    (("cameras", 1, "zoom"), 1, ("cameras[1].zoom", "is an unknown key")),
    (("cameras", 0, "prefix"), None, ("cameras[0]", "needs one of prefix, path_contains")),
    (("cameras", 0, "clock"), "sundial", ("cameras[0].clock", "'sundial' is no clock rule")),
    (("cameras", 1, "stamp"), "middle", ("cameras[1].stamp", "'middle' is no start or end")),
    (("cameras", 0, "clock_offset_s"), "late", ("cameras[0].clock_offset_s", "is no number")),
    (("cameras", 0, "clock_offset_s"), True, ("cameras[0].clock_offset_s", "is no number")),
    (("cameras", 1), "B", ("cameras[1]", "is no mapping")),
    (("people", 0, "id"), None, ("people[0].id", "is required")),
    (("people", 0, "shoe"), 44, ("people[0].shoe", "is an unknown key")),
    (("deliverable_types", 0, "count"), None, ("deliverable_types[0].count", "is required")),
    (("deliverable_types", 0, "count"), -1, ("deliverable_types[0].count", "'-1' is too small")),
    (("deliverable_types", 0, "count"), 2.5, ("deliverable_types[0].count", "is no whole")),
    (("deliverable_types", 0, "duration_s"), 7, ("deliverable_types[0].duration_s", "is no list")),
    (("sessions", 0, "day"), "d9", ("sessions[0].day", "'d9' is not a known day")),
    (("sessions", 0, "start"), "9 am", ("sessions[0].start", "'9 am' is no time (HH:MM)")),
    (("sessions", 0, "end"), "25:00", ("sessions[0].end", "'25:00' is no time (HH:MM)")),
    (("sessions", 0, "end"), "08:59", ("sessions[0].end", "'08:59' does not come after")),
    (("sessions", 0, "cameras", 1), "Z", ("sessions[0].cameras[1]", "'Z' is not a known camera name")),
    (("sessions", 0, "feeds"), "film", ("sessions[0].feeds", "'film' is not a known deliverable type")),
    (("sessions", 0, "people", 0), "y", ("sessions[0].people[0]", "'y' is not a known person id")),
    (("sessions", 0, "capture", 0, "operator"), "bob", ("sessions[0].capture[0].operator", "'bob' is not a known operator of a camera")),
    (("sessions", 0, "capture", 0, "registers", 0), "odd", ("sessions[0].capture[0].registers[0]", "'odd' is not a known register")),
    (("sessions", 0, "capture", 0, "lens"), 1, ("sessions[0].capture[0].lens", "is an unknown key")),
]


def test_every_fault_names_its_path(spark):
    docs = [(i, json.dumps(change(path, value))) for i, (path, value, _) in enumerate(CASES)] + [(900, json.dumps(GOOD)), (901, "{"), (902, None)]
    got = {}
    for r in documents.faults(spark.createDataFrame(docs, "doc int, text string"), documents.SCHEDULE).collect():
        got.setdefault(r["doc"], set()).add((r["path"], r["what"]))
    for i, (_, _, want) in enumerate(CASES):
        assert want in got.get(i, ()), (want, got.get(i))
    assert 900 not in got and got[901] == got[902] == {("", "is no JSON")}
    assert documents.faults(spark.createDataFrame([], "doc int, text string"), documents.SCHEDULE).count() == 0


def test_places_are_those_of_the_document(spark):
    """Keys with dots or brackets, or none, are unknown members and no places of other rules; JSON in texts is text."""
    odd = {**GOOD, "days.*": "soon", "sessions[*].start": "9 am", "": {}}
    same = {**GOOD, "sessions": [{"id": i, "day": "d1", "start": "09:00"} for i in ('{"a":1}', {"a": 1}, "[2]", [2], "[2]")]}
    docs = [(1, json.dumps(odd)), (2, json.dumps(same)), (3, json.dumps({**GOOD, "registers": [["odd"], "wide", "close"], "sessions": [{"id": "s", "day": "d1", "start": "09:00", "registers": ['["odd"]', "wide"]}]}))]
    found = documents.faults(spark.createDataFrame(docs, "doc int, text string"), documents.SCHEDULE)
    assert sorted(map(tuple, found.collect())) == [
        (1, "", "is an unknown key"), (1, "days.*", "is an unknown key"), (1, "sessions[*].start", "is an unknown key"),
        (2, "sessions[2].id", "'[2]' is listed more than once"), (2, "sessions[4].id", "'[2]' is listed more than once"),
        (3, "sessions[0].registers[0]", "'[\"odd\"]' is not a known register"),
    ]


def test_rules_are_told_over_rows(spark):
    """Outermost lists are dealt into rows, a document is parsed once, and no filter tells its faults a second time."""
    docs = spark.createDataFrame([(1, json.dumps(GOOD))], "doc int, text string")
    plan = documents.faults(docs, documents.SCHEDULE)._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" in plan and plan.count("parseJson") == 1 and "Filter (size" not in plan
