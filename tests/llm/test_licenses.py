import random

from boardstat.llm import licenses

from .fixtures import ODD_TEXTS, VOCABULARY, documents, prose


def common(a, b):
    """Length of the longest common subsequence."""
    best = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(best[j] + 1 if x == y else max(best[j + 1], row[j]))
        best = row
    return best[-1]


def test_alignment_is_a_common_subsequence():
    draw = random.Random(1)
    for _ in range(300):
        template = [draw.choice(VOCABULARY[:draw.choice([4, 20, 48])]) for _ in range(draw.randrange(25))]
        text = [w for w in template if draw.random() > 0.2]
        for _ in range(draw.randrange(10)):
            text.insert(draw.randrange(len(text) + 1), draw.choice(VOCABULARY))
        pairs = licenses.align(text, template)
        assert all(text[a] == template[b] for a, b in pairs)
        assert all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:]))
        assert len(pairs) <= common(text, template)
        if len(set(template)) == len(template) and len(set(text)) == len(text):
            assert len(pairs) == common(text, template)


def test_gaps_are_aligned_again():
    template = "a x b x c x d".split()
    assert len(licenses.align("a x b q x c x d".split(), template)) == 7


def spoiled(name, share, seed):
    draw = random.Random(seed)
    return " ".join(w if draw.random() > share else "other" for w in licenses.words(licenses.TEMPLATES[name]))


def test_scan_of_documents(spark):
    texts = [*ODD_TEXTS]
    wanted = {}
    for k, name in enumerate(licenses.TEMPLATES):
        for share, ok in ((0, True), (0.1, True), (0.6, False)):
            if share and "notice" in name:
                continue
            if ok:
                wanted[len(texts)] = name
            texts.append(f"{prose(k, 70)}. {spoiled(name, share, k)}! {prose(k + 50, 90)}")
    twice = len(texts)
    texts.append(f"{licenses.TEMPLATES['MIT notice']} {prose(9, 5)} {licenses.TEMPLATES['MIT notice']} {prose(8, 9)}")
    wanted[twice] = "MIT notice"
    rows = licenses.scan_licenses(documents(spark, texts)).collect()
    found = {(r["doc_id"], r["license"]) for r in rows}
    assert set(wanted.items()) <= found
    assert {i for i, _ in found} == set(wanted)
    for r in rows:
        n = len(licenses.words(licenses.TEMPLATES[r["license"]]))
        span = licenses.words(texts[r["doc_id"]])[r["first_word"]:r["end_word"]]
        assert 0.8 <= r["coverage"] == r["matched"] / n <= 1
        assert r["matched"] <= common(span, licenses.words(licenses.TEMPLATES[r["license"]]))
    assert next(r for r in rows if r["doc_id"] == twice)["first_word"] == 0


def test_marks_lose_no_document():
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8)
    everywhere = licenses.Scanner(licenses.TEMPLATES, 0.8)
    everywhere.marks = {name: set(words) for name, words in everywhere.templates.items()}
    everywhere.all_marks = sorted(set().union(*everywhere.marks.values()))
    for seed in range(60):
        name = list(licenses.TEMPLATES)[seed % len(licenses.TEMPLATES)]
        text = f"{prose(seed, seed * 3)} {spoiled(name, 0.15, seed)} {prose(seed, 40)}"
        assert sorted(x[:3] for x in scanner.scan(text)) == sorted(x[:3] for x in everywhere.scan(text))


def test_empty_table(spark):
    assert licenses.scan_licenses(documents(spark, [])).collect() == []


def test_relatives_are_told_apart():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE)

    def names(text):
        return {x[0] for x in scanner.scan(f"{prose(1, 30)}. {text} {prose(2, 30)}")}

    assert names("Licensed under CC BY 4.0.") == {"CC-BY-4.0 short notice"}
    assert names("Licensed under CC BY-NC 4.0.") == {"CC-BY-NC-4.0 notice"}
    assert names("Licensed under CC BY-NC 4.0. And CC BY-NC 4.0. Licensed under CC BY 4.0.") >= {
        "CC-BY-NC-4.0 notice", "CC-BY-4.0 short notice"}
    assert names("Released under the Apache License.") == {"Apache notice"}
    assert names("Released under the Zlib License.") == set()
    assert names("This work is licensed under the GNU General Public License, version 2.") == {"GPL-2.0 notice"}
    assert names("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.") == {
        "CC-BY-SA-4.0 long notice"}
    for name, text in licenses.TEMPLATES.items():
        assert name in names(text)
        if name.startswith(("GPL", "LGPL", "AGPL", "BSD", "CC")):
            assert names(text) == {name}


def test_torn_texts_are_found_over_any_distance():
    """Each text cut at random places, with foreign words between, is found; all its words are aligned unless a window
    holds enough of it already."""
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE)
    for k, (name, text) in enumerate(licenses.TEMPLATES.items()):
        template = licenses.words(text)
        if len(template) < 30:
            continue
        for distance in (300, 489, 4000):
            draw = random.Random(k + distance)
            cuts = sorted(draw.sample(range(6, len(template) - 6, 6), 2))
            parts = [template[a:b] for a, b in zip([0, *cuts], [*cuts, len(template)])]
            torn = f" {prose(k, distance)} ".join(" ".join(part) for part in parts)
            found = {x[0]: x for x in scanner.scan(f"{prose(k + 1, 40)} {torn} {prose(k + 2, 40)}")}
            assert set(found) == {name}
            assert found[name][2] >= 0.8 * len(template)
            if distance > 3 * len(template) and max(map(len, parts)) < 0.8 * len(template):
                assert found[name][2] == len(template)


def test_scattered_words_are_no_license():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE)
    scattered = " ".join(f"{word} {prose(k, 12)}" for k, word in enumerate(licenses.words(licenses.TEMPLATES["MIT"])))
    assert list(scanner.scan(scattered)) == []
    assert list(scanner.scan(f"Released under {prose(1, 30)} the MIT {prose(2, 30)} License.")) == []


def test_torn_copies_beside_whole_ones():
    """A place that stands together wins; a torn text is found beside another license; repeats of a part do no harm."""
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE)
    mit, isc = licenses.words(licenses.TEMPLATES["MIT"]), " ".join(licenses.words(licenses.TEMPLATES["ISC"]))
    torn = f"{' '.join(mit[:80])} {prose(1, 900)} {' '.join(mit[80:])}"
    found = {x[0]: x for x in scanner.scan(f"{torn} {isc}")}
    assert set(found) == {"MIT", "ISC"} and found["MIT"][3:] == (0, len(mit) + 900)
    whole = {x[0]: x for x in scanner.scan(f"{torn} {prose(2, 600)} {' '.join(mit)}")}
    assert whole["MIT"][3] == len(mit) + 1500
    parts = " ".join(f"{' '.join(mit[60:90])} {prose(k, 300)}" for k in range(20))
    repeated = {x[0]: x for x in scanner.scan(f"{' '.join(mit[:60])} {prose(3, 700)} {parts} {' '.join(mit[90:])}")}
    assert repeated["MIT"][2] == len(mit)


def test_short_names_and_identifiers():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE)
    for text, name in (("// SPDX-License-Identifier: Apache-2.0", "Apache-2.0 SPDX notice"),
                       ("# SPDX-License-Identifier: MIT", "MIT SPDX notice"),
                       ("SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause SPDX notice"),
                       ("under the BSD 2-Clause License.", "BSD-2-Clause short notice"), ("BSD 3-Clause License", "BSD-3-Clause short notice"),
                       (licenses.TEMPLATES["MPL-2.0"], "MPL-2.0"), (licenses.TEMPLATES["Unlicense"], "Unlicense")):
        assert [x[0] for x in scanner.scan(f"{prose(3, 20)} {text} {prose(4, 20)}")] == [name]
    assert list(scanner.scan("SPDX-License-Identifier: Zlib")) == []
