"""Grammar, learning and held-out accuracy of the toxicity operator."""

import zlib

import numpy as np

from srcindex.llm import toxicity as T
from srcindex.llm.common import table


def strength(text):
    lex = T.Lexicon([*T.INSULTS, *T.THREATS, "grob*"])
    return {lex.entries[k]: v for k, v in lex.strengths(text).items()}


def test_grammar_weighs_clauses():
    assert strength("what an idiot") == {"idiot": 1.0}
    assert strength("You are an IDIOT.") == {"idiot": T.AIMED} == strength("idiot you")
    assert strength("you are not an idiot") == {"idiot": T.NEGATED * T.AIMED}
    assert strength("it was reported: idiot") == {"idiot": T.REPORTED}
    assert strength("not this. an idiot") == {"idiot": 1.0}  # negation and target end with the clause
    assert strength("i will kill you") == {"kill": T.AIMED}
    assert strength("grobian, grobe and ungrob") == {"grob*": 2.0}
    assert strength("idiotic moronic 🙂\n\n idiot2idiot") == {"idiot": 2.0}
    assert strength("") == strength("a" * 200_000) == {}


def test_composition_equals_running_in_turn():
    a, b = T._marker("N", 2, 0.25), T._aimed(3)
    both, (x, y), z = a.then(b), (a.start, b.start), a.then(b).start
    for s in "NOITOIOOOIHTNIH":
        x, mid, w = a.step(x, s)
        y, out, v = b.step(y, mid)
        z, out2, u = both.step(z, s)
        assert (out, w * v) == (out2, u) and z == (x, y)


def test_regression_recovers_signs():
    rng = np.random.default_rng(0)
    x = rng.random((500, 2))
    y = (x[:, 0] - x[:, 1] + 0.1 * rng.standard_normal(500) > 0).astype(float)
    w = T.fit([[(0, a), (1, b), (2, 1.0)] for a, b in x], y, 3)
    assert w[0] > 1 and w[1] < -1 and np.isfinite(w).all()
    assert np.isfinite(T.fit([[(0, 1.0), (1, 1.0)]] * 5 + [[(1, 1.0)]] * 5, np.array([1.0] * 5 + [0.0] * 5), 2)).all()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    label = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    rows = [r for r in T.op7_toxicity(spark, sf).collect() if r.doc_id in label]
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [r for r in rows if r.held_out]
    toxic, clean = [r for r in held if label[r.doc_id]], [r for r in held if not label[r.doc_id]]
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic) and sum(r.predicted for r in clean) <= 0.01 * len(clean)


def test_odd_rows(spark):
    d = spark.createDataFrame([(1, None, 3), (2, "", 3), (None, "you idiot", 3), (2, "x", 3)], "doc_id long, text string, toxicity int")
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, None, 0)], "doc_id long, toxic int, text int")
    got = {(r.doc_id, r.text): r.toxicity_score for r in T.score(d, T.train(d, labels), keep=("doc_id", "text", "toxicity")).collect()}
    assert len(got) == 4 and got[1, None] == got[2, ""] == got[2, "x"] < 0.5 < got[None, "you idiot"]
    assert T.score(d.limit(0), T.train(d.limit(0), labels.limit(0))).collect() == []
