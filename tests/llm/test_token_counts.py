"""Token counts: array merging against the tokenizers library."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from talentgrid.llm.queries import QUERIES
from talentgrid.llm.token_counts import Counter, Merges, merged_counts, token_counts

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
TEXTS = [None, "", " ", "a  b", "a   b c", " lead", "trail ", "x \n y", "tab\t z", "\n", "a b", "é́ a", "b\n c", "a b\n",
         "don't  stop 's", "ΑΣ ΣΑΣ İ", "a\x1c b \x1c c", "<|endoftext|> x", "日本 語 123 4,5", " \n a", "A!! B.\nC  D",
         "ŵ x1y2", "​ ​", "aaaa" * 999, "ab" * 501 + "a" * 1001, "日本語" * 700, "  <|endoftext|>  a<|endoftext|>",
         "<|startoftext|>A<|ENDOFTEXT|>", "Ã© é", "\x00a \x00"]


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("known,symbols", [(400_000, 1 << 18), (3, 5)])
def test_counts_equal_the_library(name, known, symbols):
    counter, plain, draw = Counter(public_tokenizers.path(name), known, symbols), library(name), random.Random(1)
    texts = TEXTS + ["".join(draw.choice("ab  \n\t'sé1.日<|") for _ in range(draw.randint(1, 30))) for _ in range(600)]
    assert counter.count(texts) == [plain(t) for t in texts]
    assert [counter.count([t])[0] for t in texts[:40]] == [plain(t) for t in texts[:40]]  # from what is known by now
    assert counter.encoder.rule is not None and counter.merges.ordered


def _merge_one_by_one(symbols, rank):
    symbols = list(symbols)
    while True:
        best = min(((rank[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in rank), default=None)
        if best is None:
            return len(symbols)
        i = best[1]
        symbols[i:i + 2] = [rank[symbols[i], symbols[i + 1]][1]]


@pytest.mark.parametrize("seed", range(6))
def test_merging_by_its_definition(seed):
    """Also where a symbol is made in two ways or used before it is made."""
    draw = random.Random(seed)
    vocab, merges, tokens = {c: i for i, c in enumerate("abc")}, [], list("abc")
    for _ in range(25):
        pair = draw.choice(tokens), draw.choice(tokens)
        if pair not in merges:
            merges.append(pair)
            if "".join(pair) not in vocab:
                vocab["".join(pair)] = len(vocab)
                tokens.append("".join(pair))
    draw.shuffle(merges) if seed % 2 else None
    rank = {(vocab[a], vocab[b]): (i, vocab[a + b]) for i, (a, b) in enumerate(merges)}
    words = ["".join(draw.choice("abc") for _ in range(draw.randint(1, 40))) for _ in range(200)] + ["a" * 33, "b"]
    flat = np.array([vocab[c] for w in words for c in w], np.int32)
    got = merged_counts(flat, np.array([len(w) for w in words]), Merges(vocab, merges))
    assert got.tolist() == [_merge_one_by_one([vocab[c] for c in w], rank) for w in words]


def test_odd_rows_and_no_rows(spark, odd, none):
    path, plain = public_tokenizers.path(FILES[0]), library(FILES[0])
    want = sorted((str(r.id), len((r.text or "").encode()), plain(r.text), plain(r.text) > 20) for r in odd.collect())
    got = token_counts(odd, path, limit=20, id_col="id").collect()
    assert sorted((str(r.id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert token_counts(none, path, id_col="id").collect() == []


def test_query_equals_the_library(spark, small):
    plain = library(FILES[0])
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = QUERIES["op12_token_counts"](spark, small).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {
        i: (len((t or "").encode()), plain(t), plain(t) > 512) for i, t in texts.items()}
    assert len(got) == len(texts)
