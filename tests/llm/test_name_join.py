"""The name join against all pairs, the automaton against the plain recurrence."""

import random
import zlib
from collections import defaultdict

import pytest

from weft.llm import name_join as N
from weft.llm import queries
from weft.llm.common import table


def osa(a, b):
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not (i and j)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def misspelt(name, i):
    h = zlib.crc32(str(i).encode())
    if h % 2 == 0 and len(name) >= 2:
        k = h % (len(name) - 1)
        name = name[:k] + name[k + 1] + name[k] + name[k + 2 :]
    return name


def brute(clients, vendors, bound=2):
    out = defaultdict(lambda: [0, None, 0])
    for v, name in vendors:
        if v is None or not name:
            continue
        w = lower(misspelt(name, v))
        for c, x in clients:
            if not x or abs(len(x) - len(w)) > bound:
                continue
            d = osa(w, lower(x))
            if d <= bound:
                r = out[v, d]
                r[0] += 1
                if c is not None:
                    r[1] = c if r[1] is None else min(r[1], c)
                    r[2] += zlib.crc32(str(c).encode())
    return sorted((*k, *v) for k, v in out.items())


def edited(rng, name, times, letters):
    for _ in range(times):
        k, kind = rng.randrange(len(name) + 1), rng.randrange(4)
        if kind == 0:
            name = name[:k] + rng.choice(letters) + name[k:]
        elif kind == 1:
            name = name[:k] + name[k + 1 :]
        elif kind == 2:
            name = name[:k] + rng.choice(letters) + name[k + 1 :]
        elif 0 < k < len(name):
            name = name[: k - 1] + name[k] + name[k - 1] + name[k + 1 :]
    return name


@pytest.mark.parametrize("bound", [1, 2])
def test_automaton_equals_the_recurrence(bound):
    rng = random.Random(bound)
    for _ in range(3000):
        w = "".join(rng.choices("ab", k=rng.randrange(9)))
        x = edited(rng, w, rng.randrange(4), "abc")
        u = N.Universal(bound)
        state = u.read(x, u.masks(w))
        got = u.distance(state, len(w) - len(x)) if state >= 0 else None
        want = osa(w, x)
        assert got == (want if want <= bound else None), (w, x)
        assert N.alignment(w, x) == want
        assert (state >= 0 and u.near(state, len(w) - len(x))) == (min(osa(w[:k], x) for k in range(len(w) + 1)) <= bound)


def test_states_do_not_grow_with_names():
    u, rng = N.Universal(2), random.Random(0)
    for _ in range(2000):
        w = "".join(rng.choices("abc", k=30))
        u.read(edited(rng, w, 2, "abc"), u.masks(w))
    n = len(u.states)
    for _ in range(2000):
        w = "".join(rng.choices("abcdé", k=300))
        u.read(edited(rng, w, 2, "abcdé"), u.masks(w))
    assert len(u.states) <= n + 20 < 400


@pytest.fixture
def people(spark):
    def make(clients, vendors):
        c = spark.createDataFrame([(i, n, "x", 1.0) for i, n in clients], "client_id bigint, name string, query string, distance double")
        v = spark.createDataFrame([(i, n, "y", 2) for i, n in vendors], "vendor_id bigint, name string, word string, n bigint")
        return c, v

    return make


@pytest.mark.parametrize("cell", [N.CELL, 3])
def test_join_equals_all_pairs(spark, people, cell, monkeypatch):
    """Short and long names, hot beginnings, non-ASCII letters, nulls, empty names, repeated rows, clashing columns."""
    monkeypatch.setattr(N, "CELL", cell)
    rng = random.Random(7)
    base = ["".join(rng.choices("aAbé😀", k=rng.randrange(1, 9))) for _ in range(40)] + ["Joelma Dal" + "".join(rng.choices("abc", k=6)) for _ in range(30)] + ["".join(rng.choices("abcdef", k=60)) for _ in range(5)]
    clients = [(i, edited(rng, n, rng.randrange(3), "abé")) for i, n in enumerate(base * 3)]
    vendors = [(i, edited(rng, n, rng.randrange(3), "abé")) for i, n in enumerate(base)]
    clients += [(900, None), (901, ""), (None, base[0]), (3, base[3]), (3, base[3])]
    vendors += [(500, None), (501, ""), (None, base[1]), (7, base[7]), (7, base[7]), (502, "a"), (503, "ab"), (504, "X" * 20_000)]
    got = sorted(map(tuple, N.join(*people(clients, vendors)).collect()))
    assert got == brute(clients, vendors) and len(got) > 100


def test_empty_tables(spark, people):
    c, v = people([(1, "anna")], [(2, "anna")])
    assert N.join(c.limit(0), v).count() == 0 and N.join(c, v.limit(0)).count() == 0


def test_query_equals_all_pairs(spark, sf):
    rows = lambda t, i: [(r[i], r["name"]) for r in table(spark, sf, t).collect()]
    got = sorted(map(tuple, queries.op12_name_join(spark, sf).collect()))
    assert got == brute(rows("clients", "client_id"), rows("vendors", "vendor_id"))
