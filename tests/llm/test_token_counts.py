import random

import pytest
from conftest_llm import EDGE

from sparrowdex.llm import bpe
from sparrowdex.llm import common as C
from sparrowdex.llm.token_counts import token_counts

SIGNS = ["a", "'s", "'ll", "'", "  ", " ", "\n", "\t", "1", "23", ".", ",", "!", "é", "ß", "Ⱥ", "İ", "'re", "'ve", "x", "The", " the", "\x1c", "日本", "<|endoftext|>", "<|startoftext|>", "<|", "'T", "€", "…", "´", "👍", "é", "²", " ", "́", "ﬁ"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_the_library(name, monkeypatch):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    want = [e.ids for e in Tokenizer.from_file(C.tokenizer(name)).encode_batch(texts, add_special_tokens=False)]
    model = bpe.RankBPE(C.tokenizer(name))
    ids, n = model.encode(texts)
    assert [x.tolist() for x in ids] == want
    assert n.tolist() == [len(x) for x in want]
    assert model.encode(texts, with_ids=False)[1].tolist() == n.tolist()
    monkeypatch.setattr(bpe, "_WINDOW", 40)  # long texts are cut into windows
    monkeypatch.setattr(bpe.RankBPE, "LIMIT", 500)  # the store of words runs over
    small = bpe.RankBPE(C.tokenizer(name))
    long = [" ".join(texts[i : i + 50]) for i in range(0, 500, 50)]
    want = [e.ids for e in Tokenizer.from_file(C.tokenizer(name)).encode_batch(long, add_special_tokens=False)]
    assert [x.tolist() for x in small.encode(long)[0]] == want


def test_counts_of_edges(spark, edge, nothing):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(C.tokenizer("byte_bpe_50k.json"))
    want = sorted(((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, *_ in EDGE), key=str)
    out = token_counts(edge, C.tokenizer("byte_bpe_50k.json")).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in out), key=str) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in out)
    assert token_counts(nothing, C.tokenizer("byte_bpe_50k.json")).count() == 0
