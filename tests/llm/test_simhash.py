import random
import re

import xxhash

from boardstat.llm import simhash

from .fixtures import ODD_TEXTS, components, documents, prose


def fingerprint(text):
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", low)
    features = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(f, 42) for f in features]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(points):
    points = sorted(points)
    return [(a, b) for i, a in enumerate(points) for b in points[i + 1:] if (a ^ b).bit_count() <= 4]


def family(base, n, bits, seed):
    draw = random.Random(seed)
    return {base ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, bits))) for _ in range(n)}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_of_odd_texts(spark):
    got = {r["doc_id"]: r["fp"] for r in simhash.fingerprints(documents(spark)).collect()}
    assert all(got[i] == signed(fingerprint(t)) for i, t in enumerate(ODD_TEXTS))


def test_long_text_in_parts(monkeypatch):
    monkeypatch.setattr(simhash, "PART", 100)
    text = prose(3, 900)
    assert simhash._fingerprint(text.encode()) == fingerprint(text)


def linked(spark, points, chunk):
    frame = spark.createDataFrame([(signed(p),) for p in points], "fp long")
    rows = simhash.links(frame, chunk).collect()
    pairs = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in rows]
    assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
    return components(points, pairs)


def test_links_connect_what_brute_force_connects(spark):
    draw = random.Random(4)
    points = {draw.getrandbits(64) for _ in range(300)} | family(draw.getrandbits(64), 200, 3, 1) | family(0, 60, 5, 2)
    points |= family(draw.getrandbits(64), 40, 4, 3)
    expected = components(points, near(points))
    assert linked(spark, points, simhash.CHUNK) == expected
    assert linked(spark, points, 8) == expected  # dense signatures in chunks


def test_classes_of_documents(spark):
    base = prose(7, 300)
    texts = [base, base, base + " end", prose(8, 300), base.upper(), "", None, " ", "one two", "one  two", *ODD_TEXTS]
    rows = simhash.near_duplicates(documents(spark, texts)).collect()
    prints = {i: fingerprint(t) for i, t in enumerate(texts)}
    known = components(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows if r["doc_id"] is not None}
    assert got == {i: (f"{prints[i]:016x}", known[i]) for i in prints}
    assert len(rows) == len(texts) + 2
    kept = simhash.keep_one(documents(spark, texts)).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(set(known.values()))
    assert sum(r["doc_id"] is None for r in kept) == 1


def test_empty_table(spark):
    assert simhash.near_duplicates(documents(spark, [])).collect() == []
    assert simhash.keep_one(documents(spark, [])).collect() == []


def test_components_of_a_long_chain_and_a_star(spark):
    from boardstat.llm.shared import components as distributed

    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(300, 340)] + [(5, 339), (9, 9)]
    frame = spark.createDataFrame(links, "a long, b long")
    nodes = {x for a, b in links for x in (a, b) if a != b}
    got = {r["node"]: r["root"] for r in distributed(frame).collect()}
    assert got == {k: v for k, v in components(nodes, links[:-1]).items()}
