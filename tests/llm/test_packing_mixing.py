import bisect
import random
from decimal import Decimal, localcontext
import math
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings, strategies as st

from inkwell.llm import mixing as M, packing as P, tokens as T

DOCS = "doc_id long, text string, source string, size long, no long, tokens string"


def best_fit(items, capacity):
    """Item by item, as stated: the tightest open bin, else a new one."""
    rooms = []
    for s in sorted(items, reverse=True):
        fits = [r for r in rooms if r >= s]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - s)
        else:
            rooms.append(capacity - s)
    return sorted(rooms)


@settings(max_examples=300, deadline=None)
@given(st.integers(5, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=120))))
def test_plan_is_best_fit_decreasing(case):
    capacity, items = case
    plan = P.best_fit_plan(list(Counter(items).items()), capacity)
    fill = Counter()
    placed = Counter()
    for size, first, last, b, per in plan:
        for k in range(first, last):
            fill[b + (k - first) // per] += size
        placed[size] += last - first
    assert placed == Counter(items)
    assert all(v <= capacity for v in fill.values())
    assert sorted(capacity - v for v in fill.values()) == best_fit(items, capacity)


@given(st.lists(st.integers(0, 100), max_size=30), st.integers(0, 100))
def test_tightest(rooms, size):
    t = P.TightestFit(100)
    for k, r in enumerate(rooms):
        t.put(r, k, k + 1)
    assert t.tightest(size) == min((r for r in rooms if r >= size), default=None)


def docs(spark, n=300):
    rows = [(i, ("word " * (i * 37 % 900)) if i % 11 else "他慢慢走远了。" * (i % 300), f"s{i % 4}", 1, 2, "x") for i in range(n)]
    rows += [(91000, None, "s1", 1, 2, "x"), (91001, "", "s1", 1, 2, "x"), (91002, "big " * 5000, "s2", 1, 2, "x"), (91003, "same text", None, 1, 2, "x"), (91004, "same text", "other", 1, 2, "x")]
    return spark.createDataFrame(rows, DOCS)


def test_every_document_is_laid_whole(spark):
    df = docs(spark)
    bins = spark.createDataFrame([("a", 100), ("b", 1000), ("none", None)], "bin_name string, capacity_tokens int")
    pieces = P.packed(df, bins).collect()
    counts = {r["id"]: r["tokens"] for r in T.token_counts(df, "doc_id", "text").collect()}
    for name, cap in (("a", 100), ("b", 1000)):
        mine = [p for p in pieces if p["bin_name"] == name]
        by, fill = defaultdict(list), Counter()
        for p in mine:
            by[p["id"]].append(p)
            if p["container"] is not None:
                fill[p["container"]] += p["tokens"]
        assert set(by) == set(counts)
        for i, ps in by.items():
            ps.sort(key=lambda p: p["piece_no"])
            assert sum(p["tokens"] for p in ps) == counts[i]
            assert all(p["token_start"] == k * cap for k, p in enumerate(ps))
            assert len(ps) == max(1, -(-counts[i] // cap))
        assert max(fill.values()) <= cap
        rest = [n % cap for n in counts.values() if n % cap]
        assert sorted(cap - v for c, v in fill.items() if c[0] == "b") == best_fit(rest, cap)
    left = {r["bin_name"]: r for r in P.unused(P.packed(df, bins), bins).collect()}
    assert left["a"]["unused_tokens"] == left["a"]["containers"] * 100 - sum(counts.values())
    assert P.packed(df.limit(0), bins).count() == 0


@pytest.mark.parametrize("cap", [None, 1, 2, 5])
@pytest.mark.parametrize("mean", [0.0, 0.1, 0.7, 1.9, 4.5])
def test_rate_has_the_wanted_mean(cap, mean):
    rate = M.rate_for(mean, cap)
    if cap is not None and mean >= cap:
        assert rate == math.inf and M.draw(1, 2, rate, cap) == cap
        return
    assert abs(M.cut_mean(rate, cap) - mean) < 1e-6
    n = 20_000
    drawn = sum(M.draw(i, 3, rate, cap) for i in range(n)) / n
    assert abs(drawn - mean) < 0.05 * max(1, mean)


@pytest.mark.parametrize("rate", [0.01, 0.7, 3.0, 45.5, 499.0, 501.0, 3000.0])
def test_draws_invert_the_distribution(rate, monkeypatch):
    with localcontext(prec=60):
        p = (-Decimal(rate)).exp()
        total, k, cdf = p, 0, [p]
        while k < rate + 40 * rate**0.5 + 40:
            k += 1
            p = p * Decimal(rate) / k
            total += p
            cdf.append(total)
    for u in (0, 1, 1 << 20, 1 << 40, 1 << 52, (1 << 52) + 12345, (1 << 53) - (1 << 30), *(random.Random(1).getrandbits(53) for _ in range(300))):
        monkeypatch.setattr(M.xxhash, "xxh3_64_intdigest", lambda _: u << 11)
        want = bisect.bisect_right(cdf, Decimal(u) / (1 << 53))
        assert M.draw(1, 2, rate, None) == want and M.draw(1, 2, rate, 3) == min(3, want)


def test_mixture(spark):
    df = docs(spark, 4000)
    targets = spark.createDataFrame([("s0", 0.5, 3), ("s1", 0.3, None), ("s2", 0.15, 1), ("empty", 0.05, 2)], "source string, target_share double, max_repeats int")
    times = M.drawn(df, targets)
    rows = {r["id"]: r for r in times.collect()}
    assert len(rows) == df.count() == times.count()
    assert rows[91003]["times"] == 0 and rows[91004]["times"] == 0 and max(r["times"] for r in rows.values() if r["source"] == "s2") <= 1
    assert rows == {r["id"]: r for r in M.drawn(df, targets).collect()}
    shares = {r["source"]: r["share"] for r in M.shares_reached(times, targets).collect()}
    assert abs(sum(shares.values()) - 1) < 1e-9 and shares["empty"] == 0
    assert abs(shares["s0"] / shares["s1"] - 0.5 / 0.3) < 0.25
    copies = Counter(r["id"] for r in M.mixture(times).collect())
    assert copies == {i: r["times"] for i, r in rows.items() if r["times"]}
    assert M.drawn(df.limit(0), targets).count() == 0
