import random
from collections import Counter, defaultdict
from fractions import Fraction

from hypothesis import given, settings, strategies as st

from inkwell.llm import grouped_split as G

DDL = "chunk_id string, author string, title string, key long, root long, size long"


def brute(rows):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, t in rows:
        keys = [("p", p) for p in G.person_keys(a)] + ([("t", G.title_key(t))] if G.title_key(t) else [])
        for k in keys[1:]:
            up[find(keys[0])] = find(k)
    groups = defaultdict(set)
    for a, t in rows:
        keys = [("p", p) for p in G.person_keys(a)] + ([("t", G.title_key(t))] if G.title_key(t) else [])
        if a is not None and keys:
            groups[find(keys[0])].add(a)
    return {(x, y) for g in groups.values() for x in g for y in g if x < y}


def made(seed, n=400):
    rng = random.Random(seed)
    people = [f"人{i}" for i in range(80)] + [f"Ann{i} Lee" for i in range(20)]
    titles = [f"书{i}" for i in range(150)]
    rows = []
    for i in range(n):
        a = rng.choice(people)
        if rng.random() < 0.1:
            a = rng.choice(["、", "，", "/", "&"]).join([a, rng.choice(people)])
        if rng.random() < 0.1:
            a = rng.choice(["　" + a, a.upper(), a + " ", a.replace("A", "А"), a[:1] + "​" + a[1:]])
        t = rng.choice(titles)
        if rng.random() < 0.1:
            t = f"《{t}》"
        rows.append((f"c{i}", None if rng.random() < 0.05 else a, None if rng.random() < 0.05 else t))
    return rows + [("c0", None, None), ("cx", "", " "), (None, None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], DDL)


def test_ties_against_union_find(spark):
    for seed in range(3):
        rows = made(seed)
        got = {tuple(r) for r in G.tied_authors(frame(spark, rows)).collect()}
        assert got == brute([(a, t) for _, a, t in rows])


def test_splits_keep_groups_together(spark):
    rows = made(9)
    out = [tuple(r) for r in G.split_records(frame(spark, rows)).select("chunk_id", "author", "title", "group", "split").collect()]
    assert Counter(r[:3] for r in out) == Counter(rows)
    by = defaultdict(set)
    for _, a, t, g, s in out:
        by[g].add(s)
        for p in G.person_keys(a):
            by["p" + p].add(s)
        if G.title_key(t):
            by["t" + G.title_key(t)].add(s)
    assert all(len(s) == 1 for s in by.values())


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 3000), min_size=1, max_size=8), st.sampled_from([{"train": 0.8, "dev": 0.1, "test": 0.1}, {"a": 0.5, "b": 0.25, "c": 0.25}, {"a": 0.5, "b": 0.5}, {"all": 1.0}]))
def test_greedy_in_bulk_is_greedy_one_by_one(sizes, shares):
    total = sum(s * c for s, c in sizes.items())
    below = {k: Fraction(v) * total for k, v in shares.items()}
    want = Counter()
    for s in sorted(sizes, reverse=True):
        for _ in range(sizes[s]):
            best = max(shares, key=lambda k: (below[k], -list(shares).index(k)))
            below[best] -= s
            want[s, best] += 1
    plan = G.greedy_by_size(list(sizes.items()), shares)
    got = Counter()
    for size, split, first, last in plan:
        got[size, split] += last - first
    assert got == want
    for size, count in sizes.items():
        ranges = sorted((a, b) for s, _, a, b in plan if s == size)
        assert ranges[0][0] == 0 and ranges[-1][1] == count and all(x[1] == y[0] for x, y in zip(ranges, ranges[1:]))


def test_large_groups_and_many_groups_are_salted(spark, monkeypatch):
    rows = made(2)
    want = {tuple(r) for r in G.tied_authors(frame(spark, rows)).collect()}
    plain = Counter(r["split"] for r in G.split_records(frame(spark, rows)).collect())
    monkeypatch.setattr(G, "PAIRED", 3)
    monkeypatch.setattr(G, "NUMBERED", 7)
    got = [tuple(r) for r in G.tied_authors(frame(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert Counter(r["split"] for r in G.split_records(frame(spark, rows)).collect()) == plain


def test_shares_and_empty(spark):
    rows = [(f"c{i}", f"a{i % 50}", f"t{i % 50}") for i in range(1000)]
    s = {r["split"]: r for r in G.shares_reached(G.split_records(frame(spark, rows))).collect()}
    assert s["train"]["share"] == 0.8 and s["dev"]["share"] == 0.1 and s["test"]["share"] == 0.1
    empty = frame(spark, rows).limit(0)
    assert G.tied_authors(empty).count() == 0 and G.split_records(empty).count() == 0
    assert {r["records"] for r in G.shares_reached(G.split_records(empty)).collect()} == {0}
