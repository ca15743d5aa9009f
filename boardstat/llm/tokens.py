"""Token counts and token ids of whole texts with public tokenizer files.

Texts are encoded in Arrow batches that are dealt into groups of about `GROUP` bytes. A tokenizer that drops white
space and never joins two words gives each word the same ids wherever it stands; its texts are cut into words, and the
distinct words of a group that are not known yet are encoded by the library in batches. Other tokenizers get whole
texts, long ones cut between two words of ASCII letters, where their pre-tokenizers always cut. A null text is empty.
"""

from __future__ import annotations

import json
import os
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import as_bytes, lean, slices, worker_cache

cloudpickle.register_pickle_by_value(sys.modules[__name__])

GROUP = 1 << 21
STEMS = 300_000
JOINED_WORDS = 4096
LONG_TEXT = 1 << 16
_CUT = r"^(?P<stem>.*[0-9a-z])(?P<tail>[.,;:!?#$%&*|)]+)$"
_BETWEEN_WORDS = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")


def drops_white_space(path: str) -> bool:
    """Whether the file's pre-tokens are runs without white space, so that words can be encoded apart."""
    import regex

    with open(path, encoding="utf-8") as file:
        known = json.load(file)
    step, before = known.get("pre_tokenizer") or {}, known.get("normalizer") or {}
    # words are looked up in lower case, so the file must lower them itself
    if "Lowercase" not in {n.get("type") for n in before.get("normalizers") or [before]}:
        return False
    step = (step.get("pretokenizers") or [step])[0]
    if step.get("type") != "Split" or step.get("behavior") != "Removed" or not step.get("invert"):
        return False
    found = regex.findall(step["pattern"].get("Regex", " "), "a b, c\td\n1 2 . !")
    return bool(found) and not any(c.isspace() for token in found for c in token)


def _library(path: str):
    """The tokenizer of a file and whether it drops white space, kept by the Python worker."""
    cache = worker_cache()
    if ("library", path) not in cache:
        cache["library", path] = _load(path)
    return cache["library", path]


def _load(path: str):
    """A `.model` file belongs to sentencepiece, others to tokenizers."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path), False
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path), drops_white_space(path)


def encode_whole(path: str, texts: list[str]) -> list[list[int]]:
    """Ids of texts as the library gives them, without added special tokens."""
    library, _ = _library(path)
    if path.endswith(".model"):
        return library.encode(texts, num_threads=1)
    return [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]


def safe_parts(path: str, text: str, size: int = LONG_TEXT) -> list[str]:
    """A text cut between words of ASCII letters after about `size` characters each. The parts' ids, one after another,
    are the text's ids: byte-level patterns start a token at such a space, and sentencepiece puts a space before each
    part itself."""
    parts, start = [], 0
    while len(text) - start > size:
        cut = _BETWEEN_WORDS.search(text, start + size)
        if not cut:
            break
        parts.append(text[start:cut.start()])
        start = cut.start() + path.endswith(".model")
    return [*parts, text[start:]]


class Words:
    """Ids of texts of a tokenizer that drops white space: each text's ids are its words' ids, one after another.

    The words of a group of texts are made distinct by Arrow's dictionary encoding, in lower case, and cut before their
    final ASCII punctuation, which pre-tokenizers of this kind keep apart from a letter or digit before it. Only the
    distinct parts are looked up among `stems`, which the Python worker keeps and starts anew at `STEMS` words; what is
    not there yet goes to the library.
    """

    def __init__(self, path: str):
        self.path = path
        self.stems = worker_cache().setdefault(("stems", path), {b"": b""})

    def encode(self, texts: pa.Array, with_ids: bool):
        """(number of ids of each text, ids of all texts or None)."""
        import numpy as np
        import pyarrow.compute as pc

        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        words = lists.flatten().dictionary_encode()
        at, distinct = words.indices.to_numpy(), words.dictionary
        cut = pc.extract_regex(distinct, _CUT)
        stem, tail = pc.coalesce(pc.struct_field(cut, "stem"), distinct), pc.fill_null(pc.struct_field(cut, "tail"), "")
        parts = pa.concat_arrays([stem, tail]).dictionary_encode()
        values = self._values(as_bytes(parts.dictionary))
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        of = parts.indices.to_numpy().reshape(2, -1)
        lengths = sizes[of].sum(axis=0)
        ends = np.r_[0, np.cumsum(lengths[at])][lists.offsets.to_numpy()]
        ids = None
        if with_ids:
            ids = _gather(np.frombuffer(b"".join(values), "<u4"), sizes, of.T.ravel())
            ids = _gather(ids, lengths, at)
        return np.diff(ends), ids

    def _values(self, parts: list[bytes]) -> list[bytes]:
        stems = self.stems
        values = list(map(stems.get, parts))
        missing = [p for p, v in zip(parts, values) if v is None]
        if not missing:
            return values
        if len(stems) + len(missing) > STEMS:
            stems.clear()
            stems[b""] = b""
        self._learn(missing)
        return [stems[p] if v is None else v for p, v in zip(parts, values)]

    def _learn(self, missing: list[bytes]) -> None:
        ends = _word_ends(self.path)
        plain, rest = [], []
        for data, word in zip(missing, b" ".join(missing).decode().split(" ")):
            latin = ends is not None and word.isalpha() and (word.isascii() or max(word) < "\u0250" and word == word.lower())
            (plain if latin else rest).append((data, word))
        for start in range(0, len(plain), JOINED_WORDS):
            part = plain[start:start + JOINED_WORDS]
            if not self._learn_joined(part, ends):
                rest += part
        for (data, _), ids in zip(rest, encode_whole(self.path, [word for _, word in rest])):
            self.stems[data] = as_words(ids)

    def _learn_joined(self, part: list[tuple[bytes, str]], ends) -> bool:
        """Lower-case words of Latin letters in one text: normalizing leaves them alone, each is one pre-token, and its last
        id alone carries the end mark."""
        import numpy as np

        text = " ".join([word for _, word in part])
        ids = np.array(_plain(self.path).encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        last = np.flatnonzero(ends[ids]) + 1
        if len(last) != len(part):
            return False
        bounds, data = [0, *(4 * last).tolist()], ids.tobytes()
        self.stems.update((key, data[a:b]) for (key, _), a, b in zip(part, bounds, bounds[1:]))
        return True


def as_words(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    return b"".join(i.to_bytes(4, "little") for i in ids)


def _gather(values, sizes, at):
    """The runs of `values`, whose lengths are `sizes`, in the order `at`, one after another."""
    import numpy as np

    starts, wanted = np.cumsum(sizes) - sizes, sizes[at]
    shift = starts[at] - (np.cumsum(wanted) - wanted)
    return values[np.repeat(shift, wanted) + np.arange(wanted.sum())]


def _plain(path: str):
    """The same tokenizer without normalizing, its words split at white space: for words that need no more."""
    from tokenizers import Tokenizer

    cache = worker_cache()
    if ("plain", path) not in cache:
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        after = parts["pre_tokenizer"].get("pretokenizers", [])[1:]
        parts |= {"normalizer": None,
                  "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *after]}}
        cache["plain", path] = Tokenizer.from_str(json.dumps(parts))
    return cache["plain", path]


def _word_ends(path: str):
    """Per id whether it ends a pre-token, for vocabularies that mark it; otherwise None."""
    import numpy as np

    cache = worker_cache()
    if ("ends", path) not in cache:
        with open(path, encoding="utf-8") as file:
            mark = json.load(file)["model"].get("end_of_word_suffix")
        vocabulary = _library(path)[0].get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[i for token, i in vocabulary.items() if mark and token.endswith(mark)]] = True
        cache["ends", path] = ends if mark else None
    return cache["ends", path]


def _row_groups(texts: pa.Array, size: int = GROUP) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `size` bytes; a longer row, or one that may hold a special token, comes alone."""
    import numpy as np
    import pyarrow.compute as pc

    lengths = pc.binary_length(texts).to_numpy()
    alone = (lengths > size) | pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for row in range(len(texts)):
        if alone[row] or total >= size:
            if start < row:
                yield start, row
            start, total = row, 0
            if alone[row]:
                yield row, row + 1
                start = row + 1
                continue
        total += int(lengths[row])
    if start < len(texts):
        yield start, len(texts)


def encoded(path: str, texts: pa.Array, with_ids: bool) -> Iterator[tuple[int, int, object, object]]:
    """(first row, end row, number of ids of each row, their ids or None) of a text column, in groups of rows."""
    import numpy as np

    texts = texts.cast(pa.string()).fill_null("")
    if not _library(path)[1]:
        for row, text in enumerate(texts.to_pylist()):
            ids = [i for part in _part_groups(safe_parts(path, text)) for found in encode_whole(path, part) for i in found]
            yield row, row + 1, np.array([len(ids)]), np.array(ids, "<u4") if with_ids else None
        return
    words = Words(path)
    for start, end in _row_groups(texts):
        group = texts.slice(start, end - start)
        if end - start > 1 or len(data := group[0].as_buffer().to_pybytes()) <= GROUP and b"<|" not in data:
            yield start, end, *words.encode(group, with_ids)
            continue
        counts, found = 0, []
        for part in slices(data, GROUP):
            if b"<|" in part:
                ids = np.array(encode_whole(path, [part.decode()])[0], "<u4")
            else:
                n, ids = words.encode(pa.array([part.decode()]), with_ids)
                counts += int(n[0])
            counts += len(ids) if b"<|" in part else 0
            found.append(ids)
        yield start, end, np.array([counts]), np.concatenate(found) if with_ids else None


def _part_groups(parts: list[str], size: int = GROUP) -> Iterator[list[str]]:
    found, total = [], 0
    for part in parts:
        found.append(part)
        total += len(part)
        if total >= size:
            yield found
            found, total = [], 0
    if found:
        yield found


def token_counts(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text",
                 limit: int = 2048) -> DataFrame:
    """One row per row of `docs`: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null or empty text has no bytes and no tokens; repeated rows are counted each; other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_column]

    def count(batches):
        for batch in lean(batches):
            for start, end, counts, _ in encoded(path, batch.column(1), False):
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t) for t in as_bytes(part.column(1))], pa.int64()),
                     pa.array(counts, pa.int64())], [id_column, "n_bytes", "n_tokens"])

    rows = docs.select(id_column, text_column).mapInArrow(count, f"`{id_column}` {kind}, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
