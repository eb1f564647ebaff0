"""Ranks and sums over ranges, the rotation with its cursor, fixed slots, and the first JSON value of an answer, against plain loops."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.answers import first_json, verdicts
from tidemark.operators import rounds


def test_ranks_and_sums_over_ranges(spark):
    r = random.Random(1)
    rows = [(i, r.choice([None, 0, 3, 7])) for i in r.sample(range(10_000), 700)]
    got = rounds.ranked(spark.createDataFrame(rows, "k int, c int").repartition(6), ["k"], "nth", total="c").collect()
    want, total = {}, 0
    for n, (k, c) in enumerate(sorted(rows, key=lambda x: x[0])):
        want[k] = (n, total)
        total += c or 0
    assert {x["k"]: (x["nth"], x["before"]) for x in got} == want
    assert rounds.ranked(spark.createDataFrame([], "k int"), ["k"], "nth").count() == 0


@pytest.mark.parametrize(("n", "cursor", "budget"), [(9, 4, 10), (9, 0, 0), (9, 8, 10_000), (5, 23, 7), (1, 3, -1), (0, 2, 5)])
def test_rotation_is_a_plain_loop(spark, n, cursor, budget):
    r = random.Random(n + cursor)
    costs = [r.choice([1, 2, 5, 9]) for _ in range(n)]
    taken, spent, then = [], 0, 0
    for turn in range(n):
        at = (cursor + turn) % n
        if turn and spent > budget:
            then = at
            break
        taken.append(at)
        spent += costs[at]
    told, after = rounds.resume(spark.createDataFrame(list(enumerate(costs)), "place int, cost int"), cursor, budget)
    assert sorted(x["place"] for x in told.filter("taken").collect()) == sorted(taken) and after == then


def test_known_rows_are_sorted_in_the_slots_that_they_had(spark):
    r = random.Random(3)
    rows = [(s if r.random() > 0.05 else None, r.random() > 0.3, r.randrange(50), i) for i, s in enumerate(r.sample(range(900), 300))]
    known = sorted((x for x in rows if x[1] and x[0] is not None), key=lambda x: (-x[2], x[3]))
    free = sorted(x[0] for x in known)
    want = [(s, *x[1:]) for s, x in zip(free, known, strict=True)] + [x for x in rows if not x[1] or x[0] is None]
    df = spark.createDataFrame(rows, "slot int, known boolean, days int, n int")
    got = [tuple(x) for x in rounds.sort_in_place(df, "slot", F.col("known"), [F.col("days").desc(), F.col("n")]).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def plain_first(text):
    depth, quoted, escaped, start = 0, False, False, None
    for i, c in enumerate(text):
        if quoted:
            quoted, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
        elif c == '"' and depth:
            quoted = True
        elif c in "[{":
            start, depth = (i if not depth else start), depth + 1
        elif c in "]}" and depth:
            depth -= 1
            if not depth:
                return text[start : i + 1]
    return None


def nested(r, depth=3):
    kind = r.choice("sndl" if depth else "sn")
    if kind == "s":
        return "".join(r.choice('ab "\\]}[{é\n') for _ in range(r.randrange(8)))
    if kind == "n":
        return r.choice([None, True, 3])
    some = [nested(r, depth - 1) for _ in range(r.randrange(4))]
    return some if kind == "l" else {f"k{i}{r.choice(['', '}', chr(34)])}": x for i, x in enumerate(some)}


def test_first_json_of_random_nestings_in_prose(spark):
    r = random.Random(7)
    texts = [None, "", "no value", "]}", '"[', "[1", '{"a": "]"', "a ] b } [2] [3]"]
    for _ in range(300):
        value = json.dumps(r.choice([[nested(r)], {"a": nested(r)}]), ensure_ascii=r.random() > 0.5)
        texts.append(r.choice(["", 'He said "so": ', "```json\n", "} ] "]) + (value if r.random() > 0.2 else value[: r.randrange(len(value))]) + r.choice(["", "\n```", " end. {}"]))
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", first_json(F.col("t")).alias("x")).collect()
    assert {x["i"]: x["x"] for x in got} == {i: plain_first(t) if t else None for i, t in enumerate(texts)}
    whole = [x["x"] for x in got if x["x"] is not None]
    assert len(whole) > 150 and sum(isinstance(json.loads(x), list | dict) for x in whole if x != "[2]") >= 150


def test_verdicts_alone_wrapped_or_unreadable(spark):
    one = {"i": 2, "opportunite": True, "secteur": "Sante", "type": "AMI", "resume": " x ", "pertinent": False, "deadline": "2026-01-01"}
    said = ["Voici : " + json.dumps([one, {"secteur": "no number"}]), json.dumps({"resultats": [one | {"pertinent": "oui"}]}), "Rien.", '{"i": 1}', None, json.dumps([one])[:-3]]
    got = verdicts(spark.createDataFrame(list(enumerate(said)), "batch int, answer string"), "batch", "answer").collect()
    assert [(x["batch"], x["i"], x["sector"], x["type"], x["summary"], x["opportunity"]) for x in sorted(got)] == [(0, 2, "Sante", "AMI", "x", True), (1, 2, "Sante", "AMI", "x", True)]
    assert {x["batch"]: x["relevant"] for x in got} == {0: False, 1: None}
