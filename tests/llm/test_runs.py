"""Periodic runs against all periods of all stretches."""

import hashlib
import random
import re
import zlib

import pytest

from tidemark.llm import queries as Q
from tidemark.llm.runs import collapsed, lyndon, periodic_runs, runs, runs_of

SF = "/root/testdata/sf0.001"


def plain_runs(t):
    """Every stretch of every period, those whose period is not the smallest left out."""
    found = []
    for p in range(1, len(t) // 4 + 1):
        i = 0
        while i + p < len(t):
            start = i
            while i + p < len(t) and t[i] == t[i + p]:
                i += 1
            length = i + p - start
            if i > start and length >= max(6, 4 * p):
                part = t[start : start + length]
                if all(part[q:] != part[:-q] for q in range(1, p)):
                    found.append((start, length, p))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def sequence(r):
    t = [r.randrange(r.choice([1, 2, 2, 3, 5])) for _ in range(r.randint(0, 90))]
    for _ in range(r.randint(0, 4)):
        if len(t) > 2:
            at, p = r.randrange(len(t)), r.randint(1, 8)
            part = t[at : at + p]
            t[at:at] = part * r.randint(2, 9) + part[: r.randint(0, p)]
    return t


def test_runs_are_those_of_all_periods():
    r = random.Random(5)
    seen = 0
    for _ in range(1500):
        t = sequence(r)
        want = plain_runs(t)
        seen += len(want)
        assert runs(t) == want
        assert runs_of([["x"], [f"w{v}" for v in t], [], ["a", "b"]]) == [[], want, [], []]
    assert seen > 1500


def test_lyndon_arrays_name_the_next_smaller_suffix_and_what_is_shared():
    r = random.Random(6)
    for _ in range(300):
        t = sequence(r)
        after, shared = lyndon(t)
        for i in range(len(t)):
            j = next((j for j in range(i + 1, len(t)) if t[j:] < t[i:]), len(t))
            m = 0
            while j + m < len(t) and t[i + m] == t[j + m]:
                m += 1
            assert (after[i], shared[i]) == (j, m)


class Counted(list):
    """A list that counts how often it is read."""

    reads = 0

    def __getitem__(self, i):
        Counted.reads += 1
        return super().__getitem__(i)


@pytest.mark.parametrize("name", ["letters", "pairs", "fibonacci", "blocks", "stairs", "nested", "halves"])
def test_reads_grow_with_the_length(name):
    def fibonacci(n):
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]

    r = random.Random(1)
    make = {
        "letters": lambda n: [0] * n, "pairs": lambda n: [0, 1] * (n // 2), "fibonacci": fibonacci, "blocks": lambda n: ([0] * 50 + [1]) * (n // 51),
        "stairs": lambda n: [x for k in range(1, int((2 * n) ** 0.5)) for x in [0] * k + [1]], "nested": lambda n: (([0, 1] * 20 + [2]) * 20 + [3]) * (n // 821), "halves": lambda n: [r.randrange(900) for _ in range(n // 5)] * 5,
    }[name]
    used = []
    for n in (20_000, 80_000):
        t = Counted(make(n))
        Counted.reads = 0
        lyndon(t)
        used.append(Counted.reads / len(t))
    assert used[1] < 1.3 * used[0] + 1 and used[1] < 12


def want(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n and doc_id is not None:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    told = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(told), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_op13_is_the_contracts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    short = {r["doc_id"]: want(*r) for r in docs if len((r["text"] or "").split()) <= 3000}
    got = {r["doc_id"]: tuple(r) for r in Q.op13_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs) and len(short) > 150
    assert {i: got[i] for i in short} == short
    assert sum(v[1] > 0 for v in short.values()) > 5


def test_odd_rows_of_runs(spark):
    long = "a b c " * 40_000
    rows = [(1, None), (1, ""), (None, "x " * 9), (2, " \n\t"), (3, long), (3, long), (4, "\x1c é " * 8), (5, "a b " * 7), (None, None)]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n_runs int, start string")
    got = periodic_runs(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_runs"], r["length"], r["period"]) for r in got) == sorted(
        [("1", 0, None, None), ("1", 0, None, None), ("None", 1, 9, 1), ("2", 0, None, None), ("3", 1, 120_000, 3), ("3", 1, 120_000, 3), ("4", 1, 16, 2), ("5", 1, 7, 1), ("None", 0, None, None)]
    )
    assert periodic_runs(docs.limit(0)).count() == 0


def test_collapsing_keeps_the_first_period_of_each_run():
    t = list("xabababababyzzzzzzz")
    assert "".join(collapsed(t, runs_of([t])[0])) == "xabyz"
