"""Alignment, folds, graphs, intervals, rules, deltas and keyed streams against plain programs."""

import math
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from docloom.operators import deltas, diff, graph, intervals, lattice, lcs, matching, scan
from docloom.streaming import keyed


def plain_lcs(a: list, b: list) -> tuple[int, list]:
    n, m = len(a), len(b)
    same = lambda x, y: x is not None and x == y
    table = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(m):
            table[i + 1][j + 1] = table[i][j] + 1 if same(a[i], b[j]) else max(table[i][j + 1], table[i + 1][j])
    i, j, out = n, m, []
    while i and j:
        if same(a[i - 1], b[j - 1]):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif table[i - 1][j] > table[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return table[n][m], out[::-1]


@pytest.fixture(scope="module")
def pairs():
    rnd = random.Random(2)
    out = {k: tuple([rnd.choice(list("abcdefgh"[: rnd.randint(1, 8)]) + [None] * (k % 3 == 0)) for _ in range(rnd.randint(0, 60))] for _ in range(2)) for k in range(30)}
    out[None] = (list("xaxbxcab"), list("abcxbab"))
    out[99] = (["one side"], [])
    return out


def side(spark, pairs, s):
    return spark.createDataFrame([(k, i, t, "x") for k, p in pairs.items() for i, t in enumerate(p[s])], "k int, pos int, t string, pair string").repartition(5)


@pytest.mark.parametrize("tile", [1 << 15, 16])
def test_lcs(spark, pairs, tile):
    a, b = side(spark, pairs, 0), side(spark, pairs, 1)
    want = {k: plain_lcs(*p) for k, p in pairs.items()}
    got = {r.k: (r.n_left, r.n_right, r.lcs) for r in lcs.lcs_lengths(a, b, ["k"], ["pos"], "t", tile).collect()}
    assert got == {k: (len(p[0]), len(p[1]), want[k][0]) for k, p in pairs.items() if p[0] or p[1]}
    found: dict = {}
    for r in lcs.lcs_matches(a, b, ["k"], ["pos"], "t", tile).collect():
        found.setdefault(r.k, []).append((r.left_place, r.right_place))
    assert {k: sorted(v) for k, v in found.items()} == {k: v[1] for k, v in want.items() if v[1]}


def test_lcs_of_arrays(spark, pairs, monkeypatch):
    """Short pairs move as arrays, without a row a token; long ones and repeated keys give the same as tiles do."""
    rows = lambda s: spark.createDataFrame([(k, p[s]) for k, p in pairs.items()], "k int, t array<string>").repartition(3)
    want = {k: (len(p[0]), len(p[1]), plain_lcs(*p)[0]) for k, p in pairs.items() if p[0] or p[1]}
    answer = lambda df: {r.k: (r.n_left, r.n_right, r.lcs) for r in df.collect()}
    assert answer(lcs.lcs_lengths_of(rows(0), rows(1), ["k"], "t", 20)) == want
    twice = [spark.createDataFrame([(1, ["a"]), (1, ["b"]), (2, None), (None, ["c"]), (None, [])], "k int, t array<string>"), spark.createDataFrame([(1, ["a"]), (2, ["c"]), (None, ["c"]), (3, [])], "k int, t array<string>")]
    got = answer(lcs.lcs_lengths_of(*twice, ["k"], "t"))
    assert got == {1: (2, 1, 1), 2: (0, 1, 0), None: (1, 1, 1)}
    monkeypatch.setattr(lcs, "Sequences", None)  # by tokens: not for these
    assert answer(lcs.lcs_lengths_of(rows(0), rows(1), ["k"], "t")) == want


def test_lcs_edges(spark, pairs):
    a = side(spark, pairs, 0)
    assert lcs.lcs_lengths(a.limit(0), a.limit(0), ["k"], ["pos"], "t").count() == 0
    assert lcs.lcs_matches(a.limit(0), a.limit(0), ["k"], ["pos"], "t").count() == 0
    alone = lcs.lcs_lengths(a, a.limit(0), ["k"], ["pos"], "t").collect()
    assert alone and all(r.lcs == 0 and r.n_right == 0 for r in alone)


def test_one_long_pair_takes_tiles(spark):
    """A pair that is many tiles long: the tasks hold a tile each, and the length is exact."""
    n = 30_000
    words = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("pos"), F.when(F.col("id") % 10 < 3, "the").otherwise(F.concat(F.lit("w"), (F.col("id") % 4999).cast("string"))).alias("t"))
    other = words.filter("pos % 7 <> 0").withColumn("pos", F.col("pos") * 2).unionByName(words.filter("pos % 11 = 0").select("k", (F.col("pos") * 2 + 1).alias("pos"), F.lit("new").alias("t")))
    got = lcs.lcs_lengths(words, other, ["k"], ["pos"], "t", 8192).first()
    assert got.lcs == n - len(range(0, n, 7)) and got.n_left == n


def plain_greedy(edges: list) -> list:
    x, y, out = set(), set(), []
    for a, b in edges:
        if a not in x and b not in y:
            x.add(a)
            y.add(b)
            out.append((a, b))
    return sorted(out)


@pytest.mark.parametrize("at_once", [1 << 17, 90])
def test_greedy_pairs(spark, monkeypatch, at_once):
    monkeypatch.setattr(matching, "COMPONENT_EDGES", at_once)
    rnd = random.Random(3)
    # Also a chain, in which each edge waits for the one before it.
    edges = sorted({(rnd.randint(0, 80), rnd.randint(0, 80)) for _ in range(300)} | {(i + 200, i + 200 + k) for i in range(100) for k in (0, 1)})
    weight = {e: rnd.randint(0, 5) for e in edges}
    df = spark.createDataFrame([(a, b, weight[a, b]) for a, b in edges] + [(None, 1, 0), (0, None, 0), (*edges[0], weight[edges[0]])], "a int, b int, w int").repartition(5)
    got = lambda order: sorted((r.a, r.b) for r in matching.greedy_pairs(df, "a", "b", order).collect())
    assert got(["a", "b"]) == plain_greedy(edges)
    if at_once > 1000:
        assert got(["w"]) == plain_greedy(sorted(edges, key=lambda e: (weight[e], e)))
        assert matching.greedy_pairs(df.limit(0), "a", "b", ["w"]).count() == 0


@pytest.mark.parametrize("points", [40, 1 << 15])
def test_nearest_pairs(spark, monkeypatch, points):
    """Ties, chains that cross every cut, copies at one place and rests of one side, in ranges of some points."""
    monkeypatch.setattr(matching, "RANGE_POINTS", points)
    rnd = random.Random(5)
    at = lambda g, s: rnd.choice([rnd.randint(0, 60) * 1.0, rnd.randint(0, 2000) / 8, 300.0 + (s if g else 0)])
    sides = [[(g, i, at(g, s)) for i, g in enumerate(rnd.choices([0, 1], k=400))] + [(2, 1000 + i, i * (i + 1.0) / 2 + s * i / 2) for i in range(100)] for s in (0, 1)]
    a, b = (spark.createDataFrame([*side, (None, 7000, 1.0), (0, None, 1.0), (0, 7001, None), (0, 7002, float("nan")), (0, 7003, float("inf"))], f"{x}g int, {x} long, {x}at double").repartition(3) for x, side in zip("ab", sides, strict=True))
    edges = sorted((abs(p - q), i, j) for g, i, p in sides[0] for h, j, q in sides[1] if g == h and abs(p - q) < 9.5)
    want = plain_greedy([(i, j) for _, i, j in edges])
    got = lambda x: sorted((r.a, r.b) for r in matching.nearest_pairs(x, b, [("ag", "bg")], "a", "b", "aat", "bat", 9.5).collect())
    assert got(a) == want
    assert got(a.limit(0)) == []


def test_greedy_pairs_makes_no_pairs(spark, tmp_path):
    """The copies of one part are as many rows as they are, not their square."""
    from pyspark.sql import functions as F

    from docloom.plans import sequence_queries

    n = 20_000
    spark.range(n).select(F.col("id").alias("p_partkey"), F.lit(1).alias("p_size"), F.lit(900.0).alias("p_retailprice")).write.parquet(f"{tmp_path}/part.parquet")
    got = sequence_queries.greedy_pairs(spark, str(tmp_path)).filter("b_key = a_key + 1")
    assert got.count() == n // 2


def test_band_match_deals_pairs(spark, monkeypatch):
    """Small tables with many pairs are dealt by cells, and a cell of copies into parts; nothing is broadcast for the pairs."""
    from docloom.operators import diff

    monkeypatch.setattr(diff, "CELL_PAIRS", 500)
    rows = [(i, i % 2, 5.0 if i < 120 else i / 4) for i in range(300)] + [(900, None, 5.0), (901, 0, None)]
    side = lambda s: spark.createDataFrame(rows, "k int, g int, x double").toDF(*[f"{s}{c}" for c in "kgx"])
    got = diff.band_match(side("l"), side("r"), [("lg", "rg")], "lx", "rx", 1.5)
    assert got.columns == ["lk", "lg", "lx", "rk", "rg", "rx"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [_k0" in plan and "_part" in plan
    want = sorted((p[0], q[0]) for p in rows[:300] for q in rows[:300] if p[1] == q[1] and abs(p[2] - q[2]) < 1.5)
    assert sorted((r.lk, r.rk) for r in got.collect()) == want


def test_pages_are_aligned_in_batches(spark, monkeypatch):
    """Many small pairs of pages are rows of a batch, not a Python group each; null keys meet, one-sided pages too."""
    from docloom.operators import diff

    monkeypatch.setattr(diff, "PAGES_AT_ONCE", 3)
    schema = "k int, idx long, text string, x double, y double, font_name string, font_size double"
    page = lambda k, *texts: [(k, i, t, 1.0, 20.0 * i, "F", 9.0) for i, t in enumerate(texts, 5)]
    a = spark.createDataFrame([r for k in range(20) for r in page(k, "p", "q")] + page(None, "n") + page(77, "only"), schema).repartition(3)
    b = spark.createDataFrame([r for k in range(20) for r in page(k, "p", f"r{k}")] + page(None, "m") + page(78, "other"), schema).repartition(3)
    got = diff.align_elements(a, b, ["k"])
    assert "CoGroups" not in got._jdf.queryExecution().toString()
    rows = sorted(((-1 if r.k is None else r.k, r.kind, r.left_idx, r.right_idx) for r in got.collect()), key=repr)
    assert rows == sorted([(k, "modified", 6, 6) for k in range(20)] + [(-1, "modified", 5, 5), (77, "removed", 5, None), (78, "added", None, 5)], key=repr)


def test_alignment_as_a_plan(spark):
    """Rows of pages full of ties, as the alignment of single pages gives them."""
    schema = "p int, idx int, text string, x double, y double, font_name string, font_size double"

    def rows(k: int, seed: int) -> list:
        r = random.Random(seed)
        return [(k, i, r.choice("abcdefg"), float(r.randint(0, 3) * 4), float(r.randint(0, 3) * 4), r.choice("FG"), 12.0) for i in range(r.randint(0, 25))]

    left = spark.createDataFrame([x for k in range(25) for x in rows(k, k)], schema)
    right = spark.createDataFrame([x for k in range(25) for x in rows(k, k + 1000)], schema)
    got = matching.align_sequences(left, right, ["p"], tile=8)
    want = diff.align_elements(left, right, ["p"]).select("p", "kind", "left_idx", "right_idx")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    with pytest.raises(ValueError):
        matching.align_sequences(left, right, ["p"], diff.CompareOptions(granularity="word"))


def test_running_transform(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["a"] * 5 + ["b", "c", None]), i, rnd.choice([None, *range(-5, 9)]), rnd.choice([None, *range(-5, 9)]), rnd.random() < 0.1) for i in range(2000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "k string, i int, m int, c int, z boolean, state int").repartition(5).drop("state")
    for modulus in (2147483629, None):
        states: dict = {}
        want = {}
        for k, i, m, c, z in rows:
            m = (1 if m is None else m) / (1 if modulus else 16)
            x = (3 if z else states.get(k, 3)) * m + (c or 0)
            states[k] = want[i] = x % modulus if modulus else x
        factor = F.coalesce("m", F.lit(1)) if modulus else F.coalesce("m", F.lit(1)) / 16
        got = {r.i: r.state for r in scan.running_transform(df, ["k"], ["i"], factor, F.col("c"), F.col("z"), 3, modulus).collect()}
        assert got == want if modulus else all(abs(got[i] - want[i]) < 1e-9 * max(1, abs(want[i])) for i in want)
    total = scan.running_transform(df, [], ["i"], F.lit(1), F.col("c"), None, 0, 2147483629).orderBy(F.desc("i")).first().state
    assert total == sum(r[3] or 0 for r in rows) % 2147483629
    assert scan.running_transform(df.limit(0), ["k"], ["i"], F.lit(1), F.col("c")).count() == 0


def test_asof_join(spark):
    rnd = random.Random(5)
    left = [(rnd.choice("aaab") if rnd.random() < 0.95 else None, rnd.randint(0, 500) if rnd.random() < 0.95 else None, i) for i in range(600)]
    right = [(rnd.choice("aaabc"), rnd.randint(0, 500), i, rnd.random()) for i in range(200)] + [("a", None, 999, 0.0), (None, 1, 998, 0.0)]
    a, b = spark.createDataFrame(left, "k string, t int, i int"), spark.createDataFrame(right, "q string, u int, j int, v double")
    got = {r.i: (r.j, r.v) for r in scan.asof_join(a, b, ["k"], ["q"], "t", "u", ["j", "v"], ["j"]).collect()}
    want = {}
    for k, t, i in left:
        seen = [(u, j, v) for q, u, j, v in right if q is not None and q == k and t is not None and u is not None and u <= t]
        want[i] = max(seen)[1:] if seen else (None, None)
    assert got == want
    assert scan.asof_join(a, b.limit(0), ["k"], ["q"], "t", "u", ["j"]).filter("j is not null").count() == 0


def test_cells_cover_a_range_once(spark):
    rnd = random.Random(6)
    rows = [(i, a := rnd.randint(-40, 40), a + rnd.randint(-2, 60)) for i in range(200)]
    got = spark.createDataFrame(rows, "i int, lo long, hi long").select("i", intervals.range_cells(F.col("lo"), F.col("hi")).alias("c")).collect()
    for r in got:
        held = [x for c in r.c for x in range(c.cell << c.level, (c.cell + 1) << c.level)]
        assert sorted(held) == list(range(rows[r.i][1], rows[r.i][2])) and len(r.c) <= 14


def test_overlaps(spark):
    rnd = random.Random(7)
    make = lambda: [(rnd.choice("aab"), i, x := rnd.randint(-300, 300), x + rnd.choice([0, 1, 2, 7, 50, 400])) for i in range(300)]
    a, b = make(), make()
    want = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3])
    for grain in (1, 7):
        got = intervals.overlaps(spark.createDataFrame(a, "k string, ai int, al long, ah long"), spark.createDataFrame(b, "k string, bi int, bl long, bh long"), ["k"], "ai", "al", "ah", "bi", "bl", "bh", grain)
        assert sorted((r.ai, r.bi) for r in got.collect()) == want


def test_rules(spark):
    rnd = random.Random(8)
    data = [(i, rnd.choice(["O", "F", "P", None]), rnd.random() * 100 if rnd.random() < 0.9 else None, rnd.choice(["1-URG", "2-HI", "3-MED"])) for i in range(300)]
    rules = []
    for r in range(100):
        some: list = [("s", "equals", rnd.choice("OFP"), None, None)] if rnd.random() < 0.4 else []
        if rnd.random() < 0.7:
            lo = rnd.random() * 100
            some.append(("p", "between", None, lo, lo + rnd.random() * 20))
        if rnd.random() < 0.4 or not some:
            some.append(("q", "startsWith", rnd.choice(["1", "2-", "3-M"]), None, None))
        if rnd.random() < 0.3:
            some.append(("q", "notEquals", "2-HI", None, None))
        rnd.shuffle(some)
        rules.append((r // 2, r % 2, some))

    def holds(row, c) -> bool:
        v = {"s": row[1], "p": row[2], "q": row[3]}[c[0]]
        return v is not None and {"equals": lambda: v == c[2], "notEquals": lambda: v != c[2], "startsWith": lambda: v.startswith(c[2]), "between": lambda: c[3] <= v < c[4]}[c[1]]()

    table = spark.createDataFrame(data, "id int, s string, p double, q string")
    as_rows = lambda r: spark.createDataFrame(r, f"rule_id int, clause int, conditions array<{intervals.CONDITION}>")
    want = sorted({(r[0], row[0]) for r in rules for row in data if all(holds(row, c) for c in r[2])})
    for scale in (1, 100):
        assert sorted((r.rule_id, r.id) for r in intervals.match_rules(table, "id", as_rows(rules), scale).collect()) == want
    with pytest.raises(ValueError):
        intervals.match_rules(table, "id", as_rows([(1, 0, [("q", "notEquals", "x", None, None)])]))


def test_rules_are_tested_on_columns(spark):
    """Candidates carry columns, not maps and arrays of conditions; pairs that two clauses or two rows give come once."""
    kind = "rule int, clause int, conditions array<struct<field:string,op:string,value:string,lo:double,hi:double>>"
    both = [("n", "between", None, 2.0, 6.0), ("n", "between", None, 4.0, 9.0), ("q", "notEquals", "b", None, None)]
    rules = spark.createDataFrame([(1, 0, both), (2, 0, [("q", "equals", "a", None, None)]), (2, 1, [("n", "between", None, 0.0, 3.0)]), (3, 0, [("n", "between", None, None, 5.0)]), (4, 0, [("q", "equals", "a", None, None), ("n", "odd", None, None, None)])], kind).withColumnRenamed("rule", "rule_id")
    rows = [(1, 1.0, "a"), (2, 4.5, "a"), (3, 5.0, "b"), (4, 5.5, None), (2, 4.5, "a")]
    for data, want in ((rows, [(1, 2), (2, 1), (2, 2)]), (rows[:4], [(1, 2), (2, 1), (2, 2)])):
        got = intervals.match_rules(spark.createDataFrame(data, "id int, n double, q string"), "id", rules)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "forall" not in plan and "map" not in plan
        assert sorted((r.rule_id, r.id) for r in got.collect()) == want


def test_pairs_of_rules_are_written_nowhere(spark, monkeypatch):
    """Clauses of one rule are told apart by a test; only rows that repeat an id, and rules of many clauses, pass a distinct."""
    monkeypatch.setattr(intervals, "RANGE_RULES", 16)
    rnd = random.Random(12)
    place = lambda: rnd.choice([-math.inf, -1.0, -0.0, 0.0, 7.0, 7.5, 40.0, 99.0, math.inf, math.nan, None])
    data = [(i, place() if rnd.random() < 0.3 else 7.0 if rnd.random() < 0.5 else rnd.random() * 100, rnd.choice("abc"), f"{rnd.choice(['ü', 'x', 'xy', ''])}{i % 50}") for i in range(2500)]
    ops = [lambda: ("n", "between", None, place(), place()), lambda: ("s", "equals", rnd.choice("abcd"), None, None), lambda: ("w", "startsWith", rnd.choice(["ü", "x", "xy1", "", "z"]), None, None), lambda: ("w", "equals", f"x{rnd.randrange(50)}", None, None)]
    rules = [(r // 3, r % 3, [rnd.choice(ops)() for _ in range(rnd.randint(1, 3))]) for r in range(90)] + [(None, 0, [("s", "equals", "a", None, None)]), (None, 1, [("n", "between", None, 0.0, 8.0)])]
    many = [(100, i, [("n", "between", None, float(i), i + 2.0)]) for i in range(12)]
    order = lambda x: (math.isnan(x), 0.0 if math.isnan(x) else x)  # noqa: E731 - NaN stands after all others

    def holds(row, c) -> bool:
        v = {"n": row[1], "s": row[2], "w": row[3]}[c[0]]
        if c[1] == "between":
            return None not in (v, c[3], c[4]) and order(c[3]) <= order(v) < order(c[4])
        return v == c[2] if c[1] == "equals" else v.startswith(c[2])

    def check(rows, asked) -> str:
        got = intervals.match_rules(spark.createDataFrame(rows, "id int, n double, s string, w string"), "id", spark.createDataFrame(asked, f"rule_id int, clause int, conditions array<{intervals.CONDITION}>"))
        want = {(r[0], row[0]) for r in asked for row in rows if all(holds(row, c) for c in r[2])}
        pairs = [(r.rule_id, r.id) for r in got.collect()]
        assert len(pairs) == len(want) and set(pairs) == want
        return got._jdf.queryExecution().optimizedPlan().toString()

    assert "Aggregate [rule_id" not in check(data, rules)
    assert "Aggregate [rule_id" in check(data, rules + many)
    assert "Aggregate [rule_id" in check([*data, *[(i, 8.0, "a", "x1") for i in range(0, 2500, 100)]], rules)


def test_tree_order(spark):
    rnd = random.Random(9)
    parent: dict = {i: None if i == 0 or rnd.random() < 0.03 else rnd.randrange(i) for i in range(250)}
    kids: dict = {}
    for n, p in parent.items():
        kids.setdefault(p, []).append(n)
    want, count = {}, [0]

    def walk(n: int, depth: int) -> None:
        count[0] += 1
        me = count[0]
        for c in sorted(kids.get(n, [])):
            walk(c, depth + 1)
        want[n] = (me, depth, count[0] - me + 1, count[0])

    for r in sorted(kids[None]):
        walk(r, 0)
    lost = {1000: 1001, 1001: 1000, 1002: 1001, 1003: 999}  # a cycle, below one, below no node
    df = spark.createDataFrame(list((parent | lost).items()), "n int, p int").repartition(4)
    assert {r.node: (r.place, r.depth, r["size"], r["last"]) for r in graph.tree_order(df, "n", "p", ["n"]).collect()} == want
    assert graph.tree_order(df.limit(0), "n", "p", ["n"]).count() == 0


def test_tree_order_reads_in_proportion(spark, monkeypatch):
    """All rounds of a long chain with stray nodes write some times its steps, not a multiple that grows with its length."""
    n = 1500
    rows = [(i, i - 1 if i else None) for i in range(n)] + [(n + i, 10 * n + i // 2) for i in range(40)] + [(2 * n, 2 * n), (2 * n + 1, 2 * n + 2), (2 * n + 2, 2 * n + 1)]
    written, real = [], graph.stage
    monkeypatch.setattr(graph, "stage", lambda df, label, *a: written.append(real(df, label, *a)) or written[-1])
    monkeypatch.setattr(graph, "discard", lambda *tables: None)
    got = graph.tree_order(spark.createDataFrame(rows, "n int, p int"), "n", "p", ["n"], **({"at_once": 64} if hasattr(graph, "AT_ONCE") else {}))
    assert {(r.node, r.place, r.depth, r["size"], r["last"]) for r in got.collect()} == {(i, i + 1, i, n - i, n) for i in range(n)}
    assert sum(t.count() for t in written) < 7 * 2 * len(rows)


def test_reach(spark):
    rnd = random.Random(10)
    edges = [(rnd.randrange(100), rnd.randrange(100)) for _ in range(130)] + [(5, 5), (None, 3), (4, None)]
    near: dict = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
    want, queue = {0: 0, 7: 0, 555: 0}, deque([0, 7, 555])
    while queue:
        for y in near.get(x := queue.popleft(), []):
            if y is not None and y not in want:
                want[y] = want[x] + 1
                queue.append(y)
    e, seeds = spark.createDataFrame(edges, "a int, b int"), spark.createDataFrame([(0,), (7,), (555,), (0,), (None,)], "node int")
    found = graph.reach(e, seeds)
    assert {r.node: r.hops for r in found.collect()} == want
    nodes, kept = graph.renumbered(found, e, ["hops", "node"])
    number = {r.node: r.new_number for r in nodes.collect()}
    assert sorted(number.values()) == list(range(1, len(want) + 1))
    assert {(r.new_a, r.new_b) for r in kept.collect()} == {(number[a], number[b]) for a, b in edges if a in want and b in want}


def test_schema_lattice(spark):
    rows = ['{"a": 1, "b": "x", "c": null}', '{"a": 2.5, "b": true, "d": ""}', '{"a": 0, "e": true, "f": 1}', '{"e": "0", "f": "12"}', None, "broken", "[1]"]
    want = {"a": ("float", 3, 0), "b": ("string", 2, 0), "c": ("empty", 0, 1), "d": ("empty", 1, 0), "e": ("bool", 2, 0), "f": ("int", 2, 0)}
    for order in (rows, rows[::-1]):
        got = lattice.infer_schema(spark.createDataFrame([(r,) for r in order], "j string").repartition(3), "j").collect()
        assert {r.key: (r.type, r.n, r.n_null) for r in got} == want


def test_deltas_equal_recomputation(spark, tmp_path):
    rnd = random.Random(11)
    schema = "k int, t int, g string, v int"
    state = deltas.LastWriter(spark, f"file://{tmp_path}/state", schema, ["k"], ["t"], ["g", "v"], F.col("g"), F.col("v"), buckets=8)
    live: dict = {}
    for batch in range(4):
        changes = []
        for _ in range(60):
            if live and rnd.random() < 0.3:
                row = rnd.choice(sorted(live))
                changes.append((*row, -1))
                del live[row]
            else:
                row = (rnd.choice([0] * 20 + list(range(30))), rnd.randint(0, 10**6), rnd.choice("xyz"), rnd.randint(0, 9))
                if row not in live:
                    live[row] = 1
                    changes.append((*row, 1))
        df = spark.createDataFrame(changes, schema + ", _n int")
        for _ in range(2 if batch == 2 else 1):  # a batch that is given again replaces itself
            moved = state.apply(batch, df)
        newest = {k: max(r[1:] for r in live if r[0] == k) for k in {r[0] for r in live}}
        assert {r.k: (r.t, r.g, r.v) for r in state.newest().collect()} == newest
        want: dict = {}
        for _, g, v in newest.values():
            n, a = want.get(g, (0, 0))
            want[g] = n + 1, a + v
        assert {r.group: (r.n, r.amount) for r in state.summary().collect()} == want
        assert {r.k for r in moved.collect()} <= {c[0] for c in changes}
    few = spark.createDataFrame([(3, 1, "x", 1, 1)], schema + ", _n int").withColumn("bucket", state._bucket())
    plan = state.touched(9, few)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    assert {r.k for r in state.touched(9, few).collect()} <= {3}


def test_keyed_state_asks_little_of_the_jvm():
    """A key and batch take one read and one write, timers only where the newest row moves; no frame is built for a key."""
    calls: list = []

    class Fake:
        value = None

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name == "update":
                    Fake.value = args[0]
                return {"getValueState": self, "get": Fake.value, "exists": Fake.value is not None, "listTimers": []}.get(name)

            return call

    v = keyed.Versions(10, 100)
    v.init(Fake())
    row = lambda *x: dict(zip(("ts_us", "event_id", "value"), x, strict=True))
    for rows, want, asked in (
        ([row(50, 2, 2.0), row(50, 1, 1.0), row(60, 3, 3.0)], [("first", 50, 1, 3), ("last", 60, 3, 3)], ["get", "update", "registerTimer"]),
        ([row(49, 4, 4.0), row(55, 5, 5.0)], [("late", 49, 4, None), ("first", 50, 1, 4), ("last", 60, 3, 4)], ["get", "update"]),
        ([row(70, 6, 6.0)], [("first", 50, 1, 5), ("last", 70, 6, 5)], ["get", "update", "deleteTimer", "registerTimer"]),
        ([row(1, 7, 7.0)], [("late", 1, 7, None)], ["get"]),
    ):
        calls.clear()
        assert [(r.kind, r.ts_us, r.event_id, r.n) for r in v.handleInputRows((1,), iter(rows), None)] == want
        assert calls == asked


def test_keyed_stream_with_restart_late_rows_and_timers(spark, tmp_path):
    day = 86_400
    schema = "k long, at long, e long, v double"

    def write(rows: list, name: str) -> None:
        spark.createDataFrame(rows, schema).select("k", F.timestamp_seconds("at").alias("at"), "e", "v").coalesce(1).write.parquet(f"{tmp_path}/{name}")
        for f in (tmp_path / name).glob("part-*.parquet"):
            f.rename(tmp_path / "source" / f"{name}.parquet")

    (tmp_path / "source").mkdir()
    source, out, at = (f"file://{tmp_path}/{x}" for x in ("source", "out", "checkpoint"))

    def run() -> list:
        keyed.run_to_end(keyed.versions(keyed.replay(spark, source, ["k", "at", "e", "v"]), 2 * day * 1_000_000, 30 * day * 1_000_000, "60 days"), out, at)
        return [tuple(r) for r in keyed.read_output(spark, out).collect()]

    write([(1, 10 * day, 1, 1.0), (1, 9 * day, 2, 2.0), (2, 10 * day, 3, 3.0), (None, 1, 4, 4.0)], "first")
    rows = run()
    assert {r[:2] for r in rows} == {(1, "first"), (1, "last"), (2, "first"), (2, "last")}
    # After a restart states go on: one row too late for its key, one that is only earlier than the first.
    write([(1, 7 * day, 5, 5.0), (1, 8 * day, 6, 6.0), (2, 11 * day, 7, 7.0)], "second")
    rows = run()
    assert [r[:2] + r[3:4] for r in rows if r[1] == "late"] == [(1, "late", 5)]
    newest = {k: {r.key: r.event_id for r in keyed.newest_of(keyed.read_output(spark, out), k).collect()} for k in ("first", "last")}
    assert newest == {"first": {1: 6, 2: 3}, "last": {1: 1, 2: 7}}
    assert len(run()) == len(rows)  # nothing new, nothing twice
    # Long after, the watermark passes the timers of the keys that fell silent.
    write([(3, 200 * day, 8, 8.0)], "third")
    run()
    write([(3, 201 * day, 9, 9.0)], "zz-fourth")
    assert {(r[0], r[1], r[3]) for r in run() if r[1] == "closed"} == {(1, "closed", 1), (2, "closed", 7)}
