"""Review tables equal plain Python formatting of the same templates."""

from pyspark.sql import functions as F

from srcindex.operators import review as R


def test_style_and_duplication_prompts(spark):
    req = spark.createDataFrame([(1, "  x = 1\n"), (2, " \n\t"), (3, "y = 2")], "request_id long, code string")
    valid, rejects = R.split_requests(req)
    assert [r.request_id for r in rejects.collect()] == [2]
    style = {r.request_id: r.prompt for r in R.style_prompts(valid).collect()}
    assert style[1] == R.STYLE_TEMPLATE.format(code="x = 1")
    long_doc = "z" * 1200
    nb = spark.createDataFrame([(1, 1, 10, 0.1), (1, 2, 11, 0.55), (1, 3, 12, 0.56), (3, 1, 12, 0.9)],
                               "request_id long, rank int, entry_id long, distance double")
    docs = spark.createDataFrame([(10, "  a()  "), (11, long_doc), (12, "c")], "entry_id long, document string")
    sim = {r.request_id: r.similar_code for r in R.similar_snippets(nb, docs, 0.55).collect()}
    expect = ("[Code 1]\n```\na()\n```\n\n[Code 2]\n```\n" + "z" * 1000 + "...\n```")
    assert sim == {1: expect}
    dup = {r.request_id: r.prompt for r in R.duplication_prompts(valid, R.similar_snippets(nb, docs, 0.55)).collect()}
    assert dup[3] == "" and dup[1] == R.DUPLICATION_TEMPLATE.format(code="x = 1", similar=expect)
    table = R.prompt_table(valid, R.similar_snippets(nb, docs, 0.55))
    assert sorted((r.request_id, r.kind) for r in table.collect()) == [(1, "duplication"), (1, "style"), (3, "style")]


def test_payloads_responses_and_assembly(spark):
    import json
    prompts = spark.createDataFrame([(1, "style", 'say "hi"\n')], "request_id long, kind string, prompt string")
    payload = json.loads(R.model_payloads(prompts).collect()[0].payload)
    assert payload == {"model": R.MODEL_NAME, "prompt": 'say "hi"\n', **R.MODEL_OPTIONS}
    bodies = spark.createDataFrame(
        [(1, "style", '{"response": "S1"}'), (1, "duplication", '{"response": "D1"}'),
         (1, "summary", '{"response": "M1"}'), (2, "style", '{"response": "S2"}'),
         (3, "style", '{"respo')], "request_id long, kind string, body string")
    good, bad = R.parse_responses(bodies)
    assert [(r.request_id, r.kind) for r in bad.collect()] == [(3, "style")]
    req = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "request_id long, code string")
    out = {r.request_id: (r.duplication_review, r.style_review, r.summary)
           for r in R.assemble_reviews(req, good, bad).collect()}
    assert out == {1: ("D1", "S1", "M1"), 2: (R.NO_DUPLICATION, "S2", "S2"),
                   4: (R.NO_DUPLICATION, R.NO_STYLE, R.NO_SUMMARY)}
    summ = R.summary_prompts(good).collect()
    assert summ[0].prompt == R.SUMMARY_TEMPLATE.format(duplication="D1", style="S1").strip()
