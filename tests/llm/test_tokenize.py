import base64
import os
import random

import pytest

from docloom.llm import tokenize as K
from docloom.llm.queries import TOKENIZERS

JSON, RANKS = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(JSON), reason="no vocabulary files")


@pytest.fixture(scope="module")
def encoder():
    return K.Encoder(K.Vocabulary(JSON))


@pytest.fixture(scope="module")
def other():
    tiktoken = pytest.importorskip("tiktoken")
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=K.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_agrees_with_another_encoder(encoder, other):
    rng = random.Random(3)
    parts = ["a", "the", "ing", " ", "  ", "\n", "19", "é", "ж", "漢", "😀", "'s", "=", "\t", "<|endoftext|>", "​", "\x85", "\x1c", "е́"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert encoder.encode(text) == other.encode_ordinary(text)
        assert encoder.decode(encoder.encode(text)) == text


def test_long_pieces(encoder, other):
    rng = random.Random(4)
    for text in ("a" * 50_000, "".join(rng.choice("etaoin") for _ in range(50_000)), "=" * 9999):
        assert encoder.encode(text) == other.encode_ordinary(text)


def test_tables(spark, encoder):
    df = spark.createDataFrame([(1, "Hello world", "x"), (2, "", "x"), (3, None, "x"), (1, "Hello world", "x"), (None, "a", "x")], "doc_id bigint, text string, ids string")
    got = K.encoded(df, JSON)
    rows = [(r.doc_id, list(r.ids)) for r in got.collect()]
    assert sorted(rows, key=str) == sorted([(1, encoder.encode("Hello world"))] * 2 + [(2, []), (3, []), (None, encoder.encode("a"))], key=str)
    assert {r.text for r in K.decoded(got, JSON).collect()} == {"Hello world", "", "a"}
    assert K.encoded(df.limit(0), JSON).count() == 0
    assert dict(got.dtypes) == {"doc_id": "bigint", "ids": "array<int>"}


def test_other_kinds_of_vocabularies_are_refused(tmp_path):
    import json

    with pytest.raises(ValueError, match="normalizer"):
        K.Vocabulary(f"{TOKENIZERS}/word_bpe_49k.json")
    whole = {"model": {"type": "BPE", "vocab": {"a": 0}, "merges": []}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}
    (tmp_path / "v.json").write_text(json.dumps(whole))
    with pytest.raises(ValueError, match="pre_tokenizer"):
        K.Vocabulary(str(tmp_path / "v.json"))
