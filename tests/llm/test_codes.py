import hashlib
import math
import random

from boardstat.llm import codes


def brute(rows):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0], r[1]))
    if not kept:
        return []
    size = len(kept[0][1]) // 4

    def part(v, p):
        return v[p * size:(p + 1) * size]

    books = [[part(v, p) for _, v, _ in kept[:256]] for p in range(4)]

    def best(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(part(v, p), e)), k) for k, e in enumerate(books[p]))

    for _ in range(4):
        new = []
        for p in range(4):
            members = [[] for _ in books[p]]
            for _, v, _ in kept:
                members[best(v, p)[1]].append(part(v, p))
            new.append([[sum(c) // len(m) for c in zip(*m)] if m else e for m, e in zip(members, books[p])])
        books = new
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [(i, [best(v, p) for p in range(4)], label) for i, v, label in kept]
    total = {}
    for _, f, label in found:
        total[label] = total.get(label, 0) + sum(d for d, _ in f)
    return sorted((i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), total[label], digest) for i, f, label in found)


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def table(spark, rows, more=""):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int" + more)


def vectors(n, width=8):
    draw = random.Random(n)
    near = [[draw.uniform(-1, 1) for _ in range(width)] for _ in range(12)]
    return [(draw.randint(0, 10 ** 6) * 1000 + i, [round((x + draw.gauss(0, .1)) * 64) / 64 for x in draw.choice(near)],
             draw.choice((1, 1, 1, 2, None))) for i in range(n)]


def test_codes_are_those_of_brute_force(spark):
    rows = vectors(400)
    rows += [(-1, None, 1), (-2, [None] + [0.0] * 7, 1), (-3, [float("nan")] + [0.0] * 7, 1), (-4, [float("inf")] * 8, None), rows[7]]
    assert rows_of(codes.compress(table(spark, rows))) == brute(rows)


def test_few_vectors_give_few_entries(spark):
    rows = vectors(9, 4)
    assert rows_of(codes.compress(table(spark, rows))) == brute(rows)


def test_columns_of_other_names_and_shapes(spark):
    rows = [(*r, "x", 1, [1]) for r in vectors(40)]
    got = codes.compress(table(spark, rows, ", code string, error int, ints array<int>"))
    assert rows_of(got) == brute([r[:3] for r in rows])


def test_vectors_that_cannot_be_compared(spark):
    rows = vectors(30) + [(10 ** 12, [1.0, 2.0], 1), (10 ** 12 + 1, [3e38] * 8, 1)]
    got = rows_of(codes.compress(table(spark, rows)))
    assert [r[:4] for r in got[-2:]] == [(10 ** 12, None, None, None), (10 ** 12 + 1, None, None, None)]
    assert got[:-2] == brute(vectors(30))


def test_empty_tables(spark):
    assert codes.compress(table(spark, [])).collect() == []
    assert codes.compress(table(spark, [(1, None, 1)])).collect() == []
    assert [r["code"] for r in codes.compress(table(spark, [(1, [1.0, 2.0, 3.0], 1)])).collect()] == [None]


def test_joined_label_sums(spark, monkeypatch):
    monkeypatch.setattr(codes, "BROADCAST_LABELS", 0)
    rows = vectors(50)
    assert rows_of(codes.compress(table(spark, rows))) == brute(rows)
