import itertools
import random
import re

from boardstat.llm import decontaminate as d

from .fixtures import documents, prose


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute(docs, items):
    found = {}
    for i, text in docs:
        w = words(text)
        for j, item in items:
            t = words(item)
            if i is None or j is None or not t:
                continue
            size = min(13, len(t))
            need = size if len(t) < 10 else size - 1 if len(t) < 13 else 11
            for a in range(len(w) - size + 1):
                for b in range(len(t) - size + 1):
                    m = sum(x == y for x, y in zip(w[a:a + size], t[b:b + size]))
                    if m >= need:
                        old = found.get((i, j), (a, a + size, 0))
                        found[i, j] = (min(a, old[0]), max(a + size, old[1]), max(m, old[2]))
    return found


def test_the_mask_fits_every_window_with_two_substitutions():
    for spoiled in itertools.combinations(range(d.WINDOW), d.SUBSTITUTIONS):
        assert any(not {at + p for p in d.MASK} & set(spoiled) for at in range(d.WINDOW - d.SPAN + 1))


def test_the_mask_fits_ten_words_with_one_substitution():
    assert all(any(spoiled - at not in d.MASK for at in range(d.ONE_OFF - d.SPAN + 1)) for spoiled in range(d.ONE_OFF))
    assert not all(any(spoiled - at not in d.MASK for at in range(d.ONE_OFF - d.SPAN)) for spoiled in range(d.ONE_OFF - 1))


def planted():
    draw = random.Random(5)
    items = [(j, prose(100 + j, n)) for j, n in enumerate([40, 13, 20, 8, 10, 7, 60, 30])]
    more = [(20, "zebra"), (21, prose(120, 2) + " zebra"), (22, prose(122, 11)), (23, prose(123, 12)), (24, prose(124, 9)), (25, prose(125, 4))]
    items += [(8, items[0][1]), (None, prose(1, 30)), (9, None), (10, "")]
    docs = []
    for i in range(40):
        t = words(items[i % 8][1])
        for _ in range(draw.choice([0, 1, 2, 5])):
            t[draw.randrange(len(t))] = "swapped"
        part = t[draw.randrange(3):] if i % 3 == 0 else t
        docs.append((i, f"..{prose(i, draw.randrange(20))} {' '.join(part).upper()}, {prose(500 + i, draw.randrange(20))}!"))
    docs += [(40, None), (41, ""), (42, "--"), (43, prose(77, 30_000)), (44, prose(78, 500) + " " + items[6][1]),
             (50, f"{prose(90, 5)} {more[1][1]} {prose(91, 5)} Zebra"), (51, prose(92, 3) + " " + more[5][1] + " " + more[5][1]),
             *[(60 + k, f"{prose(93, 3)} {' '.join(['x' if n == 4 else w for n, w in enumerate(words(m[1]))])} {prose(94, 4)}") for k, m in enumerate(more[2:5])],
             (None, items[0][1]), (3, docs[3][1]), (4, prose(4, 9) + items[0][1])]
    return docs, items + more


def test_overlaps_against_brute_force(spark):
    docs, items = planted()
    frames = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, seed string, item_id long"), \
        spark.createDataFrame(items, "item_id long, text string")
    expected = brute([x for x in docs if x[0] != 43], items)
    assert len(expected) > 20
    for bounds in ((d.BROADCAST_SEEDS, d.BROADCAST_HITS), (0, 0)):
        got = {(r["doc_id"], r["item_id"]): (r["doc_start"], r["doc_end"], r["best_match"])
               for r in d.overlaps(*frames, *bounds).collect()}
        assert {k: v for k, v in got.items() if k[0] != 43} == expected
    kept = d.decontaminate(*frames)
    assert kept.columns == ["doc_id", "text", "seed", "item_id"]
    hit = {i for i, _ in expected} | {k[0] for k in got}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in docs if i not in hit)


def test_main_path_is_native(spark):
    docs, items = planted()
    plan = d.overlaps(spark.createDataFrame(docs, "doc_id long, text string"),
                      spark.createDataFrame(items, "item_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_empty_tables(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert d.overlaps(documents(spark), items).collect() == []
    assert d.decontaminate(documents(spark), items).count() == documents(spark).count()
    some = spark.createDataFrame([(1, prose(1, 20))], "item_id long, text string")
    assert d.overlaps(documents(spark, []), some).collect() == []
