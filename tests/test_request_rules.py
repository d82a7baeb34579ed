"""The table of request rules: the check on the driver and the columns say the same, for all kinds of values of all fields."""

import json

import pytest

from lotwise.functions import request_rules as R

VALUES = [
    None, "", " ", 0, 1, -1, 7, 12.9, -0.5, -1.0, -3.7, 1e20, 10**25, -(10**25), True, False, "7", " +7 ", "-7", "-0", "1_000", "_1", "12.7", "1e3", "٣", "x", "a b", "date", " price ", "0.25", " 1 ", "ASC", [], [1], ["APT", "x_1"], ["__"], ["a-b"], [1.5], [True], [None], [[1]],
    list(range(30)), list(range(31)), {}, {"a": 1}, "k" * 100, "k" * 101, " a\n\t b ", " ".join(["w"] * 60), "é", ["é", "日本"], [""], ["TERRA"], ["APT", "TERRA"],
]


@pytest.fixture(scope="module")
def bodies():
    fields = list(R.FILTERS)
    out = [{"filters": {f: v}} for f in fields for v in VALUES]
    out += [{"searches": [{"propertyTypeGroup": g, "maxPages": m, "filters": {"propertyTypeCode": ["APT"], "minPrice": 5, "maxPrice": 3}}]} for g in ("N", "H", " L ", "X", "", None, 1) for m in VALUES]
    out += [{"searches": v} for v in VALUES] + [{"searches": [v, v]} for v in VALUES] + [{"filters": v} for v in VALUES] + VALUES
    out += [{"searches": [{"propertyTypeGroup": g} for g in groups]} for groups in ("NH", "NN", "HLH", "NNN")]
    out += [{"searches": [{"propertyTypeGroup": "L", "filters": {low: a, high: b}}]} for low, high in R.RANGES for a, b in ((1, 2), (2, 1), (0, 0), (1, 0), ("9", "10"), (None, 3), (10**25, 10**24))]
    return out


def test_both_forms_agree(spark, bodies):
    rows = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "id int, body string")
    got: dict = {}
    for r in R.searches_of(rows, "id").collect():
        got.setdefault(r.id, {})[r.place] = r
    for i, body in enumerate(bodies):
        searches, problems = R.check_request(body)
        ours = sorted(f"{place}.{p}" for place, r in got[i].items() for p in r.problems)
        assert ours == sorted(problems), body
        if not problems:
            for place, s in enumerate(searches):
                r = got[i][place]
                assert (r.grp, r.most) == (s["grp"], s["most"])
                filters = {k: int(v) if R.FILTERS[k].kind == "number" else v for k, v in r.filters.asDict().items() if v is not None}
                assert filters == s["filters"], body


def test_text_that_is_no_json_is_a_reject_of_its_own(spark):
    rows = spark.createDataFrame([(1, "{"), (2, None), (3, '{"filters": {"minPrice": 1e400, "sort": "worst", "keyword": 3}}'), (4, "{}")], "id int, body string")
    good, bad = R.split_requests(R.searches_of(rows, "id"), "id")
    assert [(r.id, r.grp, r.most) for r in good.collect()] == [(4, "N", 1)]
    assert sorted((r.id, r.field, r.reason) for r in bad.collect()) == [(1, "request", "object"), (2, "request", "object"), (3, "keyword", "type"), (3, "minPrice", "number"), (3, "sort", "choice")]


def test_one_bad_search_rejects_its_request(spark):
    body = {"searches": [{"propertyTypeGroup": "N"}, {"propertyTypeGroup": "H", "filters": {"minPsf": -1}}]}
    good, bad = R.split_requests(R.searches_of(spark.createDataFrame([(1, json.dumps(body))], "id int, body string"), "id"), "id")
    assert good.count() == 0 and [(r.place, r.field, r.reason) for r in bad.collect()] == [(1, "minPsf", "negative")]
