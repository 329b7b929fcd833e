from collections import defaultdict

import duckdb
import pytest
from tests.llm.data import corpus, empty, frame

from hearthline.llm import line_dedup as k


def dedup(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r["doc_id"]: r["text"] for r in k.drop_recurring_lines(df).collect()}


def test_first_occurrence_stays(spark):
    got = dedup(spark, ["a b c\nunique one", "x\na b c", "a  b c\ny"])
    assert got == {0: "a b c\nunique one", 1: "x", 2: "y"}


def test_repeats_in_one_document_stay(spark):
    assert dedup(spark, ["a\na\na", "b"]) == {0: "a\na\na", 1: "b"}


def test_digits_are_variable(spark):
    got = dedup(spark, ["user 17 logged in", "user 4242 logged in\nother"])
    assert got == {0: "user 17 logged in", 1: "other"}


def varied(line, *words):
    """The line with each of some words in five other forms."""
    out = []
    for i in range(5):
        w = line.split()
        out.append(" ".join(f"{t}{'abcde'[i]}" if t in words else t for t in w))
    return out


def left(spark, lines):
    """Documents of one line whose line stays."""
    return [i for i, t in dedup(spark, lines).items() if t]


def test_a_segment_may_vary_in_long_lines(spark):
    line = "one two three four five six seven eight nine ten eleven twelve"
    assert left(spark, varied(line, "seven")) == [0]
    assert left(spark, varied(line, "one")) == [0, 1, 2, 3, 4]  # leading tokens are fixed
    assert left(spark, varied(line, "four", "twelve")) == [0, 1, 2, 3, 4]  # two segments


def test_fields_of_short_lines(spark):
    assert left(spark, varied("user alice logged in", "alice")) == [0]
    assert left(spark, varied("user alice logged in", "alice", "in")) == [0, 1, 2, 3, 4]
    assert left(spark, varied("one two three", "three")) == [0, 1, 2, 3, 4]  # under four tokens all are fixed


def test_two_fields_of_long_lines(spark):
    line = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen"
    assert left(spark, varied(line, "four", "seventeen")) == [0]
    assert left(spark, varied(line, "four", "nine", "seventeen")) == [0, 1, 2, 3, 4]  # three segments


def test_unlike_sentences_are_no_template(spark):
    tea = ["She likes green tea", "She likes black tea", "She hates green tea"]
    assert left(spark, [*tea, "Paris is near France", "Paris is in France"]) == [0, 1, 2, 3, 4]
    some = varied("user alice logged in", "alice")
    assert left(spark, some[:4]) == [0, 1, 2, 3] and left(spark, some[:4] + some[:1]) == [0, 1, 2, 3]  # a repeated line is no fifth filling
    df = spark.createDataFrame(list(enumerate(some[:3])), "doc_id long, text string")
    assert [r["text"] for r in k.drop_recurring_lines(df, field_values=3).orderBy("doc_id").collect()] == [some[0], "", ""]


def slow_templates(line, deep_from=10, wild_from=4, two_from=16):
    import re
    from itertools import combinations

    w = ["<*>" if re.search("[0-9]", t) else t for t in line.split()]
    n = len(w)
    d = 2 if n >= deep_from else 1
    cut = [d + (n - d) * i // 4 for i in range(5)]
    for k in [0] + [2] * (n >= two_from) + [1] * (wild_from <= n < two_from):
        for wild in combinations(range(4), k):
            fill = tuple(tuple(w[cut[j] : cut[j + 1]]) for j in wild)
            yield (n, wild, tuple(t if i < d or next(j for j in range(4) if cut[j] <= i < cut[j + 1]) not in wild else "*" for i, t in enumerate(w))), fill


def test_against_brute_force(spark):
    import random

    rng = random.Random(3)
    base = [" ".join(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 9, 10, 14, 16, 20, 41]))) for _ in range(60)]
    texts = []
    for _ in range(60):
        lines = []
        for _ in range(8):
            w = rng.choice(base).split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(["x", "y", "7z", "u", "v", "t", "s"])
            lines.append(" ".join(w))
        texts.append("\n".join(lines))
    first, docs, fills = {}, defaultdict(set), defaultdict(set)
    for i, t in enumerate(texts):
        for j, line in enumerate(t.split("\n")):
            for key, fill in slow_templates(line):
                first.setdefault(key, (i, j))
                docs[key].add(i)
                fills[key].add(fill)
    recurs = lambda key: len(docs[key]) > 1 and (not key[1] or len(fills[key]) >= k.FIELD_VALUES)
    want = {i: "\n".join(x for j, x in enumerate(t.split("\n")) if not any(recurs(t) and first[t] < (i, j) for t, _ in slow_templates(x))) for i, t in enumerate(texts)}
    assert dedup(spark, texts) == want and sum(len(t) for t in want.values()) < 0.8 * sum(map(len, texts))
    assert any(recurs(t) and t[1] for t in first)


def test_edges(spark):
    out = {r["doc_id"]: r for r in k.drop_recurring_lines(frame(spark), counts=True).where("doc_id is not null").collect()}
    assert out[60]["text"] is None and out[60]["n_lines"] == 0
    assert out[61]["text"] == "" and out[62]["text"] == "  \n\t "
    assert out[3]["text"] == "" and out[2]["text"] == corpus()[2][1]
    assert out[64]["text"] == "word " * 3000
    assert k.drop_recurring_lines(frame(spark)).count() == len(corpus())
    assert k.drop_recurring_lines(empty(spark)).count() == 0
    assert k.drop_recurring_lines(frame(spark)).columns == frame(spark).columns


def test_null_id_stays(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (2, "a b")], "doc_id long, text string")
    assert sorted(map(tuple, k.drop_recurring_lines(df).collect()), key=str) == [(1, "a b"), (2, ""), (None, "a b")]


def test_more_documents_asked_for(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["p q", "p q", "r s", "r s", "r s"])], "doc_id long, text string")
    got = [r["text"] for r in k.drop_recurring_lines(df, min_docs=3).orderBy("doc_id").collect()]
    assert got == ["p q", "p q", "r s", "", ""]


@pytest.mark.parametrize("seed", [1, 2])
def test_sql_agrees(spark, seed):
    rows = [r for r in corpus(80, seed) if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [r[:2] for r in rows])
    want = sorted(con.execute(k.oracle_sql()).fetchall())
    got = sorted(map(tuple, k.drop_recurring_lines(frame(spark, rows), counts=True).select("doc_id", "text", "n_lines", "n_dropped").collect()), key=lambda r: r[0])
    assert got == want


def test_no_line_is_lost_but_by_a_template(spark):
    rows = [r for r in corpus() if r[0] is not None and r[1]]
    out = defaultdict(list)
    for r in k.drop_recurring_lines(frame(spark, rows), wild_from=10**6, two_from=10**6).collect():
        out[r["doc_id"]].append(r["text"])
    everything = {line.strip() for r in rows for line in r[1].split("\n")}
    assert {line.strip() for texts in out.values() for t in texts for line in t.split("\n")} >= {x for x in everything if sum(x in r[1] for r in rows) == 1 and x}
