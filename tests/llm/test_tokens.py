import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from boardstat.llm import tokens

from .fixtures import ODD_TEXTS, documents, prose

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")


def library_count(path, text):
    if path.endswith(".model"):
        import sentencepiece

        return len(sentencepiece.SentencePieceProcessor(model_file=path).encode(text or ""))
    return len(Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("path", [WORD, BYTE, PIECE])
def test_counts_are_the_librarys(spark, path):
    docs = documents(spark)
    got = tokens.token_counts(docs, path).collect()
    assert len(got) == docs.count()
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for i, text in enumerate(ODD_TEXTS):
        n = library_count(path, text)
        assert (by_id[i]["n_tokens"], by_id[i]["n_bytes"]) == (n, len((text or "").encode()))
        assert by_id[i]["over_limit"] == (n > 2048)


def test_only_the_word_tokenizer_is_cut_at_white_space():
    assert tokens.drops_white_space(WORD) and not tokens.drops_white_space(BYTE)


@pytest.mark.parametrize("path", [BYTE, PIECE])
def test_safe_parts_keep_the_ids(path):
    text = prose(5, 3000) + "  two spaces, 12 34\n\nlines\t" + prose(6, 3000)
    parts = tokens.safe_parts(path, text, 500)
    assert len(parts) > 20
    assert [i for p in parts for i in tokens.encode_whole(path, [p])[0]] == tokens.encode_whole(path, [text])[0]


def test_full_tables_start_anew(monkeypatch):
    monkeypatch.setattr(tokens, "STEMS", 10)
    words = tokens.Words(WORD)
    for seed in range(5):
        text = prose(seed, 50) + ", end."
        assert words.encode(pa.array([text]), False)[0].tolist() == [library_count(WORD, text)]


def test_empty_table(spark):
    docs = documents(spark, [])
    assert tokens.token_counts(docs, WORD).collect() == []


def test_a_file_that_keeps_case_is_no_word_file(tmp_path):
    import json

    with open(WORD, encoding="utf-8") as file:
        known = json.load(file)
    assert tokens.drops_white_space(WORD)
    steps = known["normalizer"].get("normalizers", [known["normalizer"]])
    known["normalizer"] = {"type": "Sequence", "normalizers": [s for s in steps if s["type"] != "Lowercase"]}
    (tmp_path / "cased.json").write_text(json.dumps(known))
    assert not tokens.drops_white_space(str(tmp_path / "cased.json"))
