import hashlib
import random
import re
import tracemalloc

from srcindex.llm import pii
from srcindex.llm.common import table

E = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
I = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
C = re.compile(r"[0-9]([\x20-]?[0-9])+")
P = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    """Rule spans by the written contract."""
    n = lambda s: re.sub("[^0-9]", "", s)
    out = [(0, m.start(), m.end()) for m in E.finditer(text)]
    out += [(1, m.start(), m.end()) for m in I.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(2, m.start(), m.end()) for m in C.finditer(text) if 16 <= len(n(m.group())) <= 19 and pii.luhn(n(m.group()))]
    out += [(3, m.start(), m.end()) for m in P.finditer(text) if 8 <= len(n(m.group())) <= 15]
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(out))


def test_rules_on_random_strings():
    rng = random.Random(4)
    bits = [*"0123456789", "4539 1488 0343 6467", "4539148803436467", "@", "@", ".", ".", "-", "+", "+", "(", ")", " ", " ", "a", "b.c", "é", "٣", "\n", "255", "256", "1.2.3.4", "%", "x@y.z"]
    for _ in range(6000):
        t = "".join(rng.choices(bits, k=rng.randint(0, 24)))
        assert ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted((k, a, b) for a, b, k in pii.rule_matches(t))) == plain(t), repr(t)


def test_long_texts_are_linear():
    for t in ("a" * 200_000, "1" * 200_000, "a." * 100_000 + "@", "@" * 100_000, "1." * 100_000, "+1 " * 60_000):
        pii.rule_matches(t)
        pii.islands(t)


def test_documents_rules_and_additions(spark):
    texts = {r.doc_id: r.text for r in table(spark, "/root/testdata/sf0.001", "documents").collect()}
    for r in pii.op3_pii(spark, "/root/testdata/sf0.001").collect():
        want = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))


def test_field_finds_what_rules_miss_and_leaves_numbers_alone(spark):
    rng = random.Random(9)
    docs, luhns = [], []
    while len(luhns) < 60:
        d = "".join(rng.choices("0123456789", k=16))
        if pii.luhn(d):
            luhns.append(" ".join(d[i:i + 4] for i in range(0, 16, 4)))
    for k in range(60):
        docs.append((k, f"the card {luhns[k]} then write to u{k}.x@mail{k}.example.org or call +1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)} "
                        f"from 10.{k}.3.{k + 4} on page {k} of 2024", 1))
    docs += [(100, "call (415) 555-2671 now", 1), (101, "card " + luhns[0].replace(" ", "."), 1), (102, "version 2.0 of 1999 has 300 pages in 12 parts", 1), (103, None, 1), (104, "", 1)]
    got = {r.doc_id: r.spans for r in pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string, spans int")).collect()}
    added = {k: [(s.kind, s.start, s.stop) for s in v if not s.base] for k, v in got.items()}
    assert added[100] == [("phone", 5, 19)]
    assert added[101] == [("card", 5, 24)]
    assert added[102] == added[103] == added[104] == []
    assert sum(map(len, (added[k] for k in range(60)))) == 0


def test_gradient_matches_differences():
    text, gold = "x +1 415 555 2671 a@b.co", [(2, 17, 3), (18, 24, 0)]
    at, arcs = pii.lattice(text)
    rng = random.Random(1)
    weights = {f: rng.uniform(-1, 1) for here in arcs for _, _, fs in here for f in fs}

    def likelihood(w):
        forth = [0.0]
        for j, here in enumerate(arcs):
            total = forth[j]
            for i, _, fs in here:
                total = pii._log_add(total, forth[i] + sum(w[f] for f in fs))
            forth.append(total)
        return sum(sum(w[f] for f in fs) for j, here in enumerate(arcs) for i, y, fs in here if (at[i], at[j + 1], y) in gold) - forth[-1]

    grad = pii.gradient(weights, at, arcs, gold)
    for f in weights:
        up = (likelihood(weights | {f: weights[f] + 1e-5}) - likelihood(weights | {f: weights[f] - 1e-5})) / 2e-5
        assert abs(up - grad.get(f, 0.0)) < 1e-5


def test_empty_table(spark):
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_decoder_against_enumeration():
    rng = random.Random(6)
    names = [(y, f) for y in range(4) for f in ("dots", "no-dots", "tld", "odd-tld", "clean", "marks", "edge-left", "edge-right", "one", "octets", "no-octets", "short", "long", "more-left",
             "more-right", "luhn", "no-luhn", "length", "odd-length", "fours", "uneven", "one-mark", "mixed", "plus", "no-plus", "grouped", "solid", "plain", "usual", "odd-marks", "own-left", "like-ip")]
    bits = ["12", "345", "6789", "1234567", "@", ".", "-", "+", "(", ")", " ", "a", "bc", "\t", "\n", "é", "٣", "1.2.3.4"]

    def ways(arcs, j):
        """Scores of all labellings of the first j atoms."""
        if not j:
            return [(0.0, ())]
        out = [(v, segs) for v, segs in ways(arcs, j - 1)]
        for i, y, fs in arcs[j - 1]:
            out += [(v + sum(weights.get(f, 0.0) for f in fs), (*segs, (i, j, y))) for v, segs in ways(arcs, i)]
        return out

    for _ in range(400):
        weights = {f: rng.uniform(-2, 2) for f in names}
        text = "".join(rng.choices(bits, k=rng.randint(0, 9)))
        at, arcs = pii.lattice(text, "x", "7")
        top = max(v for v, _ in ways(arcs, len(arcs)))
        got = pii.best_segments(pii.scorer(weights), text, "x", "7")
        place = {a: i for i, a in enumerate(at)}
        arc = {(i, j + 1, y): fs for j, here in enumerate(arcs) for i, y, fs in here}
        assert abs(top - sum(weights.get(f, 0.0) for a, b, y in got for f in arc[place[a], place[b], y])) < 1e-9, repr(text)
        assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))


def test_long_islands_take_little_memory():
    rng = random.Random(2)
    score = pii.scorer({(3, "grouped"): 1.0, (2, "luhn"): 2.0, (3, "odd-length"): -3.0})
    peaks = []
    for n in (2_000, 8_000):
        text = " ".join(str(rng.randint(10, 9999)) for _ in range(n))
        assert pii.islands(text) == [(0, len(text))]
        tracemalloc.start()
        pii.best_segments(score, text)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 12 << 20  # the cache of the scorer; the lattice took over 4 KB an atom


def test_repeated_rows_are_scanned_each(spark):
    rows = [(1, "mail a.b@c.org or +1 415 555 2671")] * 3 + [(2, "mail a.b@c.org or +1 415 555 2671")]
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and len({str(r.spans) for r in got}) == 1 and len(got[0].spans) == 2
