"""The basket with refusals against a plain loop; gaps of mistyped and long series."""

import random
import time

from shelfspark.operators import holdings, selection
from shelfspark.plans import ordering


def basket(rows, budget, stop_share):
    """rows: (order, price, key, slot, chain, step), walked in order."""
    left, whole, owned, slots, steps, out = round(budget * 100), round(budget * 100), set(), set(), set(), set()
    for order, price, key, slot, chain, step in sorted(rows, key=lambda r: r[0]):
        if whole - left >= round(whole * stop_share):
            break
        cents = round(price * 100)
        if cents > left or (key is not None and key in owned) or (slot is not None and slot in slots):
            continue
        if chain is not None and step > 1 and (chain, step - 1) not in steps:
            continue
        left -= cents
        owned.add(key)
        slots.add(slot)
        steps.add((chain, step))
        out.add(order)
    return out


def chained(seed, n):
    """Chains of up to six steps with several offers each, some refused for their key or price, and
    a pile of copies that use up the places of one price."""
    rnd, rows, order = random.Random(seed), [], 0
    for i in range(n):
        chain = f"c{i}" if rnd.random() < 0.7 else None
        for step in range(1, rnd.randint(1, 6) + 1):
            if chain and rnd.random() < 0.1:
                continue        # nobody offers this step
            for _ in range(rnd.randint(1, 3)):
                key = rnd.choice(("hot", f"k{rnd.randint(0, n)}", None, f"o{order}"))
                rows.append((order, float(rnd.choice((5, 7, 7, 11, 60))), key, f"s{i}-{step}" if rnd.random() < 0.9 else None, chain, step if chain else None))
                order += 1
    return rows


def test_basket_equals_a_loop(spark, monkeypatch):
    monkeypatch.setattr(selection, "SLACK", 1)
    for seed, budget, share in ((1, 300.0, 1.0), (2, 900.0, 0.99), (3, 5000.0, 0.995)):
        rows = chained(seed, 120)
        df = spark.createDataFrame([("g", *r) for r in rows], "g string, o int, price double, k string, slot string, chain string, step int")
        got = selection.budget_select(df, "g", "price", ["o"], budget, ("k",), share, slot="slot", chain="chain", step="step")
        assert {r.o for r in got.collect()} == basket(rows, budget, share)


def test_dead_chains_do_not_prolong_the_rounds(spark, monkeypatch):
    """A thousand chains whose first step is refused are left out together."""
    monkeypatch.setattr(selection, "SLACK", 1)
    rows = [(0, 5.0, "hot", None, None, None)]
    for i in range(1000):
        rows += [(1 + 3 * i + s, 5.0, "hot" if s == 0 else f"k{i}-{s}", None, f"c{i}", s + 1) for s in range(3)]
    rows += [(5000 + i, 5.0, f"z{i}", None, None, None) for i in range(10)]
    written = []
    materialise = selection.materialise
    monkeypatch.setattr(selection, "materialise", lambda df, label: (written.append(label), materialise(df, label))[1])
    df = spark.createDataFrame([("g", *r) for r in rows], "g string, o int, price double, k string, slot string, chain string, step int")
    got = selection.budget_select(df, "g", "price", ["o"], 40.0, ("k",), slot="slot", chain="chain", step="step")
    assert {r.o for r in got.collect()} == basket(rows, 40.0, 1.0) == {0, *range(5000, 5007)}
    assert len(written) < 10


def test_many_prices_are_listed_in_bounded_rounds(spark, monkeypatch):
    """Three thousand offers, each of its own price, answer three hundred questions: a round lists a
    fixed number of them, and questions whose first offers are refused go on behind these."""
    monkeypatch.setattr(selection, "SLACK", 2)
    monkeypatch.setattr(selection, "LISTED", 100, raising=False)
    rnd = random.Random(7)
    rows = [(i, 5 + rnd.randint(0, 5000) / 100, rnd.choice((f"k{i % 400}", "hot", None)), f"s{i // 10}" if i % 600 < 500 else None,
             f"c{i // 30}" if i % 4000 > 1500 else None, i // 10 % 3 + 1 if i % 4000 > 1500 else None) for i in range(3000)]
    sizes = []
    materialise = selection.materialise

    def counted(df, label):
        stored = materialise(df, label)
        sizes.append(stored.count())
        return stored
    monkeypatch.setattr(selection, "materialise", counted)
    df = spark.createDataFrame([("g", *r) for r in rows], "g string, o int, price double, k string, slot string, chain string, step int")
    got = selection.budget_select(df, "g", "price", ["o"], 2500.0, ("k",), 0.995, slot="slot", chain="chain", step="step")
    assert {r.o for r in got.collect()} == basket(rows, 2500.0, 0.995)
    assert max(sizes) <= 100 and len(sizes) > 2


def ranges(rows, least):
    out = []
    for series in {s for s, _, _ in rows}:
        numbers = {n for s, n, _ in rows if s == series and n is not None}
        if len(numbers) < least:
            continue
        total, before = sum(x for s, _, x in rows if s == series), 0
        for n in sorted(x for x in numbers if x >= 1):
            if n > before + 1:
                out.append((series, before + 1, n - 1, total))
            before = n
    return sorted(out)


def test_gaps_as_ranges(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice("abc"), rnd.choice((None, 0, rnd.randint(1, 60), rnd.randint(900, 2100), 5000)), rnd.randint(0, 5)) for _ in range(200)]
    rows += [("one", 7, 1), ("two", 0, 1), ("two", 1, 1), ("two", 3, 1), ("none", None, 9)]
    df = spark.createDataFrame(rows, "s string, v long, l long")
    got = sorted(tuple(r) for r in holdings.missing_ranges(df, "s", "v", "l").collect())
    assert got == ranges(rows, 2)
    missing = sorted((r.s, r.missing) for r in holdings.missing_volumes(df, "s", "v", "l").collect())
    assert missing == sorted((s, n) for s, low, high, _ in got for n in range(low, high + 1))


def test_a_mistyped_volume_costs_one_row(spark):
    rows = [("a", 1, 1), ("a", 2, 1), ("a", 2_000_000_000, 1)]
    begin = time.time()
    got = holdings.missing_ranges(spark.createDataFrame(rows, "s string, v long, l long"), "s", "v", "l").collect()
    assert [tuple(r) for r in got] == [("a", 3, 1_999_999_999, 3)] and time.time() - begin < 30


def test_repeated_suggestions_and_offers_do_not_multiply(spark):
    """Thirty times the same suggestion and thirty equal offers are one candidate; an offer of
    another price or volume stays, and so does one that a suggestion names by its code."""
    offers = [(f"979{i:010d}", "Blue anvil", "Ann", "Pub", "Saga", "7", "Poche", 9.0) for i in range(30)]
    offers += [("9791000000000", "Blue anvil", "Ann", "Pub", "Saga", "7", "Poche", 8.0), ("9792000000000", "Blue anvil", "Ann", "Pub", "Saga", "8", "Poche", 9.0)]
    asked = [("Blue anvil", None, 5.0, "Album", "lettre", "à étudier", "2026-01-01")] * 30
    asked += [("Blue anvil", offers[9][0], 5.0, "Album", "lettre", "à étudier", "2026-01-01")]
    held = spark.createDataFrame([("9770000000001", "Red", "Bob", "Saga", "1", "BD", "Jeunesse", 3), (offers[0][0], "Other", "Bob", None, None, "BD", "Adulte", 3)],
                                 "identifier string, title string, author string, series string, volume string, category string, audience string, loans long")
    fresh = ordering.fresh_offers(spark.createDataFrame(offers, "isbn string, title string, author string, publisher string, series string, volume string, support string, price double"),
                                  ordering.with_keys(held))
    distinct = ordering.one_of_equals(fresh)
    suggested = spark.createDataFrame(asked, "title string, isbn string, price double, motive string, source string, status string, added string")
    got = ordering.suggested_phase(suggested, fresh, distinct)
    # the first copy is held, so the second stands for them
    assert sorted(r.isbn for r in got.collect()) == [offers[1][0], offers[9][0], "9791000000000", "9792000000000"]
