"""Small tables with the awkward cases every operator must take."""

import random

VOCABULARY = [a + b for a in "ba ko ri tu len mos dra fin".split() for b in "da ne sil por um vek".split()]


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(VOCABULARY) for _ in range(n))


ODD_TEXTS = [
    None, "", " \n\t ", "word", "Don't, it's. 'Twas they're, A.B. x'. 3.14, a1!", "Éa É é́ naïve… “x” ﬁ ǅ İ Σ ΑΣ. ß 中文字 ́a",
    "<|endoftext|> <|ENDOFTEXT|>, abc<|startoftext|>def. (foo) %%% a%% -- a--, b|| !!! ...", "a b c​d e\x1cf \x85",
    prose(1, 60_000), prose(2, 40), prose(2, 40), "x" * 200_000,
]


def documents(spark, texts=None):
    """Documents with a null id, a repeated row, and columns whose names the operators use themselves."""
    texts = ODD_TEXTS if texts is None else texts
    rows = [(i, t, "fp", i * 2, "x") for i, t in enumerate(texts)] + [(1, text, "fp", 2, "x") for text in texts[1:2]]
    rows += [(None, prose(99, 30), None, None, None)] * bool(texts)
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, n_tokens int, signature string")


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}
