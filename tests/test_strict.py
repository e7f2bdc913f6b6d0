"""Strict response bodies, filter null rules, string ids, and fixtures that leave given texts whole."""

import pytest

from srcindex.functions.where import where_to_column
from srcindex.operators import review
from srcindex.sources import tables as T

SF = "/root/testdata/sf0.001"


def test_only_one_object_with_a_string_is_read(spark):
    bodies = {"ok": '{"response":"a\\nb"}', "blank": ' {"response": "x"} ', "more": '{"response":"x","done":true}', "empty": '{"response":""}',
              "n": '{"response":5}', "o": '{"response":{"a":1}}', "l": '{"response":["x"]}', "null": '{"response":null}', "absent": "{}", "cut": '{"response":"a',
              "tail": '{"response":"abc"} x', "two": '{"response":"a"}{"response":"b"}', "array": '[{"response":"a"}]', "text": "abc", "none": None,
              "comma": '{"response":"a"},{"response":"b"}', "bracket": '{"response":"a"}],["x"'}
    good, bad = review.parse_responses(spark.createDataFrame([(k, "style", b) for k, b in bodies.items()], "request_id string, kind string, body string"))
    assert {r.request_id: r.response for r in good.collect()} == {"ok": "a\nb", "blank": "x", "more": "x", "empty": ""}
    assert {r.request_id for r in bad.collect()} == bodies.keys() - {"ok", "blank", "more", "empty"}


def test_absent_keys_pass_ne_and_nin(spark):
    d = spark.createDataFrame([(1, "A"), (2, None), (3, "B")], "i int, class_name string")
    ids = lambda w: sorted(r.i for r in d.where(where_to_column(w)).collect())
    assert ids({"class_name": {"$ne": "A"}}) == [2, 3]
    assert ids({"class_name": {"$nin": ["A", "B"]}}) == [2]
    assert ids({"class_name": {"$in": ["A"]}}) == [1] and ids({"class_name": "B"}) == [3]


@pytest.mark.parametrize("bad", [{}, {"$and": []}, {"$or": {}}, {"a": {"$like": "x"}}, {"a": {}}, None])
def test_bad_filters_are_named(bad):
    with pytest.raises(ValueError):
        where_to_column(bad)


def test_given_texts_stay_whole(spark):
    given = {r.item_id: r.text for r in T.read_table(spark, SF, "benchmark").collect()}
    requests = {r.request_id: r.code for r in T.review_requests(spark, SF).collect()}
    assert {k: v for k, v in requests.items() if k >= 0} == given and any(k < 0 for k in requests)
    answers = {(r.request_id, r.answer) for r in T.turn_requests(spark, SF).collect()}
    good, _ = review.parse_responses(T.response_bodies(spark, SF))
    assert {(r.request_id, r.response) for r in good.where("kind = 'style'").collect()} == answers


def test_prompt_templates_are_pinned():
    assert "{code}" in review.STYLE_TEMPLATE and "{similar}" in review.DUPLICATION_TEMPLATE and "{duplication}" in review.SUMMARY_TEMPLATE
