import random

from boardstat.llm import passages

from .fixtures import ODD_TEXTS, documents, prose


def brute(rows, size=13):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, words in split:
        for k in range(len(words) - size + 1) if i is not None else ():
            key = tuple(words[k:k + size])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, words in split:
        gone = set()
        for k in range(len(words) - size + 1) if i is not None else ():
            if first[tuple(words[k:k + size])] < i:
                gone |= set(range(k, k + size))
        kept = [w for k, w in enumerate(words) if k not in gone]
        out.append((i, len(words), len(gone), b" ".join(kept).decode()))
    return sorted(out, key=str)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_words", "n_removed", "kept").collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def planted(n=60):
    draw, shared = random.Random(7), [prose(500 + k, draw_size) for k, draw_size in enumerate((12, 13, 14, 40, 200))]
    rows = []
    for i in range(n):
        parts = [prose(i, draw.randint(0, 60)), draw.choice(shared), prose(1000 + i % 7, draw.randint(5, 80))]
        draw.shuffle(parts)
        rows.append((draw.randint(0, 10 ** 6), " ".join(parts)))
    near = prose(77, 150).split()
    for i in range(10):
        copy = list(near)
        copy[draw.randrange(150)] = f"new{i}"
        rows.append((2 * 10 ** 6 + i, "\n\t ".join(copy)))
    rows += [(3 * 10 ** 6 + i, prose(5, 90)) for i in range(20)] + [(-5, "a " * 100), (5 * 10 ** 6, "a " * 30), (9, "b c " * 40)]
    return rows


def test_removed_words_are_those_of_brute_force(spark):
    rows = planted()
    rows += [rows[3], (rows[5][0], prose(5, 90) + " tail"), (None, rows[4][1]), (None, None)]
    assert rows_of(passages.without_repeats(frame(spark, rows))) == brute(rows)


def test_heavy_seeds_are_cut_into_slots(spark):
    rows = planted(30)
    line = prose(3, 5)
    rows += [(100 + i, f"{prose(200 + i // 2, 8)} {line} {prose(300 + i // 2, 8)}") for i in range(80)]
    assert rows_of(passages.without_repeats(frame(spark, rows), shard=4)) == brute(rows)


def test_odd_texts_and_clashing_columns(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    clash = docs.withColumnRenamed("fp", "seed").withColumnRenamed("signature", "row")
    assert rows_of(passages.without_repeats(clash)) == brute(rows)
    assert len(rows) > len(ODD_TEXTS)


def test_empty_table(spark):
    assert passages.without_repeats(frame(spark, [])).collect() == []
    assert rows_of(passages.without_repeats(frame(spark, [(1, None), (2, " ")]))) == [(1, 0, 0, ""), (2, 0, 0, "")]
