"""The chunker against a plain fold over the same rules."""

import random

from evidara.operators import windows as W

BLOCKS = "object_id string, block_id string, pos long, block_type string, text string, latex string, linked_id string"


def plain(blocks):
    """blocks of one object in order -> list of windows, each a list of block ids."""
    own = [b for b in blocks if b[3] not in ("page_header", "page_footer") and " ".join((b[4] or b[5] or "").split())]
    ids = {b[1]: i for i, b in enumerate(own)}
    link = {b[1]: b[6] for b in own if b[6] in ids and b[6] != b[1]}

    def anchor(x):
        seen, at = [x], link.get(x)
        while at is not None and at not in seen:
            seen.append(at)
            at = link.get(at)
        return seen[-1] if len(seen) > 1 else None

    home = {b[1]: min(ids[b[1]], ids.get(anchor(b[1]), ids[b[1]])) for b in own}
    groups, where = [], {}
    for b in sorted(own, key=lambda b: (home[b[1]], ids[b[1]])):
        a = anchor(b[1])
        if a in where:
            where[b[1]] = where[a]
        elif b[3] in ("formula", "code") and groups:
            where[b[1]] = len(groups) - 1
        else:
            groups.append([])
            where[b[1]] = len(groups) - 1
        groups[where[b[1]]].append(b)
    size = lambda b: len(" ".join((b[4] or b[5] or "").split()))
    out, now, n = [], [], 0
    for g in groups:
        add = sum(size(b) + 1 for b in g)
        if now and n + add > 1400:
            out, now, n = [*out, now], [], 0
        now, n = now + g, n + add
        if n >= 700:
            out, now, n = [*out, now], [], 0
    out += [now] if now else []
    if len(out) > 1 and sum(map(size, out[-1])) < 120:
        out[-2:] = [out[-2] + out[-1]]
    return [[b[1] for b in w] for w in out]


def corpus():
    rng = random.Random(11)
    rows = []
    for o in range(40):
        n = rng.randint(0, 25)
        for i in range(n):
            kind = rng.choice(["paragraph", "paragraph", "caption", "formula", "code", "table", "figure", "page_footer"])
            text = rng.choice([" ", "", "word " * rng.randint(1, 60), "x" * rng.randint(1, 1600)])
            link = f"o{o}:{min(n - 1, max(0, i + rng.choice([-1, 1])))}" if kind == "caption" else None
            rows.append((f"o{o}", f"o{o}:{i}", i, kind, text, "y = 1" if kind == "formula" else None, link))
    return rows


def test_windows_match_a_plain_fold(spark):
    rows = corpus()
    got = {}
    for r in W.greedy_windows(W.block_groups(spark.createDataFrame(rows, BLOCKS).repartition(4))).collect():
        got.setdefault((r.object_id, r.number), []).append((r.place, r.block_id))
    for o in {r[0] for r in rows}:
        mine = [[b for _, b in sorted(got[k])] for k in sorted(got) if k[0] == o]
        assert mine == plain(sorted((r for r in rows if r[0] == o), key=lambda r: r[2]))


def test_chains_of_any_length_and_cycles(spark):
    rng, rows = random.Random(5), []
    for o in range(60):
        n = rng.randint(2, 18)
        for i in range(n):
            far = rng.choice([None, i - 1, i + 1, rng.randrange(n), rng.randrange(n)])
            link = None if far is None or rng.random() < 0.3 else f"o{o}:{far}"
            rows.append((f"o{o}", f"o{o}:{i}", i, rng.choice(["paragraph", "caption", "formula", "table"]), "word " * rng.randint(1, 80), None, link))
    rows += [("five", f"five:{i}", i, "paragraph", f"text {i}", None, f"five:{t}" if t is not None else None) for i, t in enumerate([None, None, 0, 2, 3, None, 4])]
    groups = W.block_groups(spark.createDataFrame(rows, BLOCKS).repartition(4))
    five = {r.block_id: r.grp for r in groups.filter("object_id = 'five'").collect()}
    assert five == {"five:0": 1, "five:1": 2, "five:2": 1, "five:3": 1, "five:4": 1, "five:5": 3, "five:6": 1}
    got = {}
    for r in W.greedy_windows(groups).collect():
        got.setdefault((r.object_id, r.number), []).append((r.place, r.block_id))
    for o in {r[0] for r in rows}:
        assert [[b for _, b in sorted(got[k])] for k in sorted(got) if k[0] == o] == plain([r for r in rows if r[0] == o])


def test_windows_deal_blocks_once(spark):
    rows = spark.createDataFrame(corpus(), BLOCKS)
    objects = spark.createDataFrame([("o1", "Heading")], "object_id string, heading_path string")
    for made in (W.represent(rows, objects, ["word"]), W.block_groups(rows)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_objects_of_more_than_a_batch_and_repeated_ids(spark):
    rows = [("big", f"big:{i}", i, "caption" if i % 3 == 2 else "paragraph", f"text {i}", None, f"big:{i - 2}" if i % 3 == 2 else None) for i in range(500)]
    rows += [(f"s{i}", f"s{i}:0", 0, "paragraph", "alone", None, None) for i in range(40)]
    objects = spark.createDataFrame([("big", "Heading"), ("s1", "One"), ("s1", "Two"), ("none", "No blocks")], "object_id string, heading_path string")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        got = W.represent(spark.createDataFrame(rows, BLOCKS).coalesce(1), objects, ["example"]).collect()
    finally:
        spark.conf.set(key, before)
    big = sorted((r.number, r.block_ids) for r in got if r.object_id == "big")
    assert [ids for _, ids in big] == plain([r for r in rows if r[0] == "big"])
    assert sorted((r.object_id, r.heading_path) for r in got if r.object_id != "big") == [("s1", "One"), ("s1", "Two")]


def test_representations_carry_statements_and_headings(spark):
    rows = [("o", f"o:{i}", i, "paragraph", t, None, None) for i, t in enumerate(["long " * 150, "Example 1 find it", "then " * 150, "more " * 30])]
    objects = spark.createDataFrame([("o", "Heading")], "object_id string, heading_path string")
    got = {r.number: r for r in W.represent(spark.createDataFrame(rows, BLOCKS), objects, ["example"]).collect()}
    assert got[1].block_ids == ["o:0"] and got[1].search_text.startswith("Heading\nlong")
    assert all("o:1" not in r.block_ids or r.context_id is None for r in got.values())
    assert [r.context_id for r in got.values() if r.number == 2] == [None]


def test_context_is_not_cited(spark):
    rows = [("o", f"o:{i}", i, k, t, None, None) for i, (k, t) in enumerate([("paragraph", "Problem one: " + "a " * 350), ("paragraph", "b " * 400)])]
    objects = spark.createDataFrame([("o", "")], "object_id string, heading_path string")
    two = W.represent(spark.createDataFrame(rows, BLOCKS), objects, ["problem"]).filter("number = 2").first()
    assert two.context_id == "o:0" and two.block_ids == ["o:1"] and two.search_text.startswith("Problem one:")
