import random
import re
from itertools import permutations

from boardstat.llm import filters

from .fixtures import documents, prose


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    firsts = {}
    for i, text, _ in rows:
        if i is not None:
            firsts[text or ""] = min(firsts.get(text or "", i), i)
    failing = []
    for i, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = {"A"} if len(words) < 50 else set()
        failed |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
        failed |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text) else set()
        failed |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        failed |= {"E"} if i is not None and firsts[text] < i else set()
        failing.append((part or "", failed, i in good, i in toxic))
    out, orders = [], ["".join(p) for p in permutations("ABCDE")]
    for part in {f[0] for f in failing}:
        mine, share = [f for f in failing if f[0] == part], dict.fromkeys("ABCDE", 0)
        found = []
        for order in orders:
            left = mine
            for step, name in enumerate(order, 1):
                gone = [f for f in left if name in f[1]]
                redundant = sum(name in f[1] for f in mine) - len(gone)
                left = [f for f in left if name not in f[1]]
                share[name] += len(gone)
                found.append((part, order, step, len(left), len(gone), redundant, sum(f[1] == {name} for f in mine),
                              sum(f[2] for f in gone), sum(f[3] for f in gone), name))
        out += [(*f[:-1], share[f[-1]]) for f in found]
    return sorted(out)


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_audit_is_that_of_brute_force(spark):
    draw, rows = random.Random(3), []
    for i in range(120):
        text = prose(i % 70, draw.choice((3, 49, 50, 80)))
        text = draw.choice((text, text.upper(), text + " #", (text + " ") * 3, "", None))
        rows.append((draw.choice((i, i, i, 5, None)), text, draw.choice(("a", "b", "", None))))
    rows += [rows[0], (5, prose(1, 60), "a"), (4, prose(1, 60), "c"), (5, prose(1, 60), "a")]
    labels = [(i, draw.choice((0, 1, None)), draw.choice((0, 1, None))) for i in range(0, 120, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert rows_of(filters.audit(docs, marks)) == brute(rows, labels)


def test_odd_texts_and_clashing_columns(spark):
    docs = documents(spark).withColumnRenamed("signature", "part").withColumnRenamed("fp", "mask").withColumnRenamed("n_tokens", "n")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [(r["doc_id"], r["text"], r["part"]) for r in docs.collect()]
    assert rows_of(filters.audit(docs, marks, part_column="part")) == brute(rows, [])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    marks = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert filters.audit(docs, marks).collect() == []


def test_product_of_masks_and_orders():
    orders, places, steps = filters.removal_steps()
    assert len(orders) == 120 and steps.shape == (32, 120)
    for mask in (0, 1, 0b10100, 31):
        for k in (0, 37, 119):
            failing = [orders[k].index(f) + 1 for i, f in enumerate("ABCDE") if mask >> i & 1]
            assert steps[mask, k] == min(failing, default=6)
