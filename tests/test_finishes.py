import random

import pytest

from huemill.operators import finishes, spatial

BLOCKS, RULES = "page int, block_id int, text string, cx double, cy double", "page int, orient string, pos double, a double, b double"


def loop_table(blocks, rules):
    """Groups and rows of one page with the texts of their cells, by loops over all blocks."""
    hs, tall = [r for r in rules if r[1] == "h"], [r for r in rules if r[1] == "v" and r[4] - r[3] > 200]
    xs = sorted({float(round(r[2])) for r in tall})
    left, right, bottom = min(r[3] for r in hs), max(r[4] for r in hs), max(r[4] for r in tall)
    var = xs[-2] if len(xs) > 1 else xs[0]
    rows, groups = {bottom}, {bottom}
    for _, _, y, a, b in hs:
        if b >= right - 20 and a <= left + 20:
            groups.add(y)
        if b >= right - 20 and (a <= left + 20 or a <= var + 20):
            rows.add(y)
    rows, groups, cols = sorted(rows), sorted(groups), [left, *xs, right]

    def read(k, y0, y1):
        inside = [b for b in blocks if cols[k] <= b[3] <= cols[k + 1] and y0 <= b[4] <= y1]
        return [b[2] for b in sorted(inside, key=lambda b: (round(b[4], 1), b[3], b[1]))]

    out = []
    for g, (g0, g1) in enumerate(zip(groups, groups[1:], strict=False)):
        mine = [y for y in rows if g0 - 0.5 <= y <= g1 + 0.5]
        out.append((g, read(0, g0, g1), read(1, g0, g1), [(read(2, a, z), read(3, a, z)) for a, z in zip(mine, mine[1:], strict=False)]))
    return out


def page(r, number):
    rules = [(number, "v", p + r.choice([0.0, 0.3]), 0.0, 900.0) for p in (60, 160, 300)] + [(number, "v", 200.0, 0.0, 100.0), (number, "h", 1.0, 0.0, 500.0)]
    y = 20.0
    while y < 880:
        rules.append((number, "h", y, r.choice([0.0, 0.0, 12.0, 150.0, 165.0, 250.0]), r.choice([500.0, 500.0, 500.0, 430.0])))
        y += r.choice([0.3, 0.5, 15.0, 40.0, 90.0])
    edges = [x[2] for x in rules if x[1] == "h"]
    blocks = []
    for k in range(150):
        cy = r.choice(edges) if r.random() < 0.2 else round(r.uniform(-10, 950), 2)
        blocks.append((number, k, r.choice(["1201", "12F", "a", "・", "1,2", "?", "3402※n 1", "PF12", "12031204"]), r.choice([0.0, 30.0, 60.0, 110.0, 160.0, 230.0, 300.0, 400.0, 500.0, 520.0]), cy))
    return blocks, rules


@pytest.mark.parametrize("seed", [1, 2])
def test_cells_equal_loops(spark, seed):
    r = random.Random(seed)
    made = [page(r, n) for n in range(4)]
    blocks = spark.createDataFrame([b for bs, _ in made for b in bs], BLOCKS).repartition(3)
    rules = spark.createDataFrame([x for _, rs in made for x in rs], RULES).distinct()
    of_groups, of_rows = finishes.cells(blocks, rules)
    heads = {(x.page, x.group): (x.kind or [], x.description or []) for x in of_groups.collect()}
    rows = {(x.page, x.group, x.row): (x.variation or [], x.codes or []) for x in of_rows.collect()}
    want_heads, want_rows = {}, {}
    for n, (bs, rs) in enumerate(made):
        for g, kind, text, each in loop_table(bs, sorted(set(rs))):
            if kind or text:
                want_heads[n, g] = (kind, text)
            want_rows |= {(n, g, k): x for k, x in enumerate(each) if x[0] or x[1]}
    assert heads == want_heads
    assert rows == want_rows


def test_variations(spark):
    rules = [(1, "v", x, 0.0, 400.0) for x in (60.0, 160.0, 300.0)] + [(1, "h", 10.0, 0.0, 500.0), (1, "h", 50.0, 165.0, 500.0), (1, "h", 90.0, 0.0, 500.0), (1, "h", 130.0, 165.0, 500.0)]
    blocks = [(1, 0, "銀", 20.0, 40.0), (1, 1, "引", 30.0, 40.0), (1, 2, "12", 100.0, 30.0), (1, 3, "3 x", 100.0, 60.0), (1, 4, "着色の①", 200.0, 20.0), (1, 5, "21、22", 400.0, 20.0), (1, 6, "23F※a", 400.0, 30.0),
              (1, 7, "31", 400.0, 60.0), (1, 8, "コゲ", 20.0, 100.0), (1, 9, "??", 400.0, 100.0), (1, 10, "41,?,42", 400.0, 140.0)]
    df, rs = spark.createDataFrame(blocks, BLOCKS), spark.createDataFrame(rules, RULES)
    found = finishes.variations(df, rs, {"コゲ": "コゲ金"}, {("銀引", 1): "銀引オーロラ"})
    got = sorted((x.group, x.place, x.kind, x.description, x.name, list(x.methods), list(x.numbers), x.note, list(x.rejected)) for x in found.collect())
    assert got == [
        (0, 0, "銀引", "12・3 x", "着色", ["着色"], ["21", "22", "23F"], "a", []),
        (0, 1, "銀引", "12・3 x", "銀引オーロラ", ["オーロラ"], ["31"], None, []),
        (1, 0, "コゲ金", "", "コゲ金", [], ["41", "42"], None, ["?"]),
    ]
    docs = finishes.nested(found).orderBy("group").collect()
    assert [(d.name, [v.name for v in d.variations]) for d in docs] == [("銀引", ["着色", "銀引オーロラ"]), ("コゲ金", ["コゲ金"])]
    assert [(x.finish, list(x.tokens), x.raw) for x in finishes.rejected(found).collect()] == [("コゲ金", ["?"], "41,?,42")]


def test_pages_without_table_and_empty_input(spark):
    blocks = spark.createDataFrame([(1, 0, "x", 1.0, 1.0), (2, 0, None, None, None)], BLOCKS)
    rules = spark.createDataFrame([(1, "h", 10.0, 0.0, 500.0), (2, "v", 10.0, 0.0, 500.0), (2, "h", 5.0, 0.0, 9.0)], RULES)
    assert finishes.variations(blocks, rules).count() == 0
    assert finishes.variations(blocks.limit(0), rules).count() == 0
    assert finishes.variations(blocks, rules.limit(0)).count() == 0


def test_elementary_numbers_and_clashing_names(spark):
    points = spark.createDataFrame([("g", v, i) for i, v in enumerate([None, -1.0, 0.0, 0.5, 1.0, 1.0, 7.0])] + [("h", 3.0, 9)], "k string, v double, last int")
    bounds = spark.createDataFrame([("g", 0.0), ("g", 1.0), ("z", 2.0)], "k string, b double")
    got = {x.last: x.number for x in finishes.elementary(points, bounds, ["k"], "v", "b", "number").collect()}
    assert got == {0: -1, 1: -1, 2: 0, 3: 1, 4: 2, 5: 2, 6: 3, 9: -1}


def test_cell_text_by_bands(spark):
    r = random.Random(5)
    blocks = [(1, k, f"t{k}", float(r.randint(0, 50)), float(r.randint(0, 90))) for k in range(200)]
    cells = [(1, k, *sorted(float(r.randint(0, 50)) for _ in range(2)), *sorted(float(r.randint(0, 90)) for _ in range(2))) for k in range(40)]
    out = spatial.cell_text(spark.createDataFrame(blocks, BLOCKS), spark.createDataFrame(cells, "page int, cell_id int, x0 double, x1 double, y0 double, y1 double"), ",")
    want = {}
    for _, c, x0, x1, y0, y1 in cells:
        inside = sorted((b for b in blocks if x0 <= b[3] <= x1 and y0 <= b[4] <= y1), key=lambda b: (b[4], b[3], b[1]))
        if inside:
            want[c] = ",".join(b[2] for b in inside)
    assert {x.cell_id: x.text for x in out.collect()} == want
