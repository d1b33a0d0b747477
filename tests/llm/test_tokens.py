"""Token files and packing: exact round trips with the tokenizers library."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from talentgrid.llm.encoding import Encoder
from talentgrid.llm.packing import pack
from talentgrid.llm.shared import portions
from talentgrid.llm.token_files import read_metadata, read_tokens, write_tokens
from talentgrid.session import new_path

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
TEXTS = ["", " ", "a  b", "a   b c", " lead", "trail ", "x \n y", "tab\t z", "\n", "a b", "é́ a", "don't  stop 's",
         "ΑΣ ΣΑΣ İ", "a\x1c b \x1c c", "<|endoftext|> x", "日本 語 123 4,5", " \n a", "A!! B.\nC  D", "ŵ x1y2", "​ ​"]


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


@pytest.mark.parametrize("name", FILES)
def test_encoder_equals_the_library(spark, small, name):
    encoder, plain = Encoder(public_tokenizers.path(name), capacity=500), library(name)
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()]
    for t in texts:
        assert encoder.encode(t) == plain(t)[:-1].tobytes(), t[:60]
    assert encoder.rule is not None


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, odd, none, encoding):
    path, plain = new_path(spark, "tokens"), library(FILES[0])
    write_tokens(odd, path, public_tokenizers.path(FILES[0]), id_col="id", encoding=encoding, page_rows=2)
    rows = sorted(read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert [r.id for r in rows] == sorted((r.id for r in odd.collect()), key=lambda i: (i is not None, i))
    assert sorted(map(tuple, (r.tokens for r in rows))) == sorted(tuple(plain(r.text).tolist()) for r in odd.collect())
    at = 0
    for r in rows:
        assert (r.start, r.n_tokens) == (at, len(r.tokens))
        at += r.n_tokens
    some = read_tokens(spark, path, F.col("id") == 7).collect()
    assert [r.id for r in some] == [7] and "EqualTo(id,7)" in (
        read_tokens(spark, path, F.col("id") == 7)._jdf.queryExecution().toString().split("PushedFilters", 1)[1])
    scan = read_metadata(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "n_tokens:bigint" in scan and "tokens:array" not in scan
    empty = new_path(spark, "tokens")
    write_tokens(none, empty, public_tokenizers.path(FILES[0]), id_col="id", encoding=encoding)
    assert read_tokens(spark, empty).collect() == []


def test_encodings_and_page_indexes_of_the_files(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for encoding, name in (("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")):
        path = new_path(spark, "tokens")
        write_tokens(docs, path, public_tokenizers.path(FILES[0]), encoding=encoding)
        files = [r[0] for r in spark.read.parquet(path).select(F.input_file_name()).distinct().collect()]
        for f in files:
            meta = pq.ParquetFile(f.removeprefix("file://")).metadata.row_group(0)
            column = next(c for i in range(meta.num_columns) if (c := meta.column(i)).path_in_schema.startswith("tokens"))
            assert name in column.encodings and column.has_column_index and column.has_offset_index


@pytest.mark.parametrize("sequence,windows", [(4096, 64), (32, 2)])
def test_packing(spark, small, odd, none, sequence, windows):
    plain, path = library(FILES[1]), public_tokenizers.path(FILES[1])
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pack(docs, path, sequence=sequence, open_windows=windows).collect():
        by_doc[r.id].append(r)
        by_sequence[r.sequence_id].append(r)
    for r in docs.collect():
        ids, at = plain(r.text), 0
        for p in sorted(by_doc[r.doc_id], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(ids[at:at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= sequence
        padding += sequence - at if at & at - 1 else 0
    assert padding < 0.1 * sum(p.length for x in by_doc.values() for p in x)
    got = pack(odd, path, id_col="id", sequence=sequence).collect()
    assert sum(p.length for p in got) == sum(len(plain(r.text)) for r in odd.collect())
    assert pack(none, path, id_col="id").collect() == []


@pytest.mark.parametrize("name", FILES)
def test_added_tokens_in_texts_are_those_of_the_library(spark, name):
    path, unmodified = public_tokenizers.path(name), Tokenizer.from_file(public_tokenizers.path(name))
    texts = ["hello <|endoftext|> world", "a<|startoftext|>b <|endoftext|>", "<|ENDOFTEXT|> é", "<|endoftext|>", "plain text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = {i: unmodified.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    out = new_path(spark, "tokens")
    write_tokens(docs, out, path, id_col="id")
    assert {r.id: r.tokens[:-1] for r in read_tokens(spark, out).collect()} == want
    for r in pack(docs, path, id_col="id").collect():
        ids = np.array(want[r.id] + [2], "<u4")
        assert (r.doc_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids[r.start:r.start + r.length].tobytes()))


def test_portions_are_bounded_and_whole():
    texts = ["é" * 30, "", "x" * 200, "a", "b" * 99, "c", "", "d" * 101]
    batch = pa.RecordBatch.from_pydict({"id": list(range(8)), "text": texts})
    parts = list(portions([batch, batch.slice(0, 0), batch.slice(2, 3)], 100))
    assert [(i, t) for p in parts for i, t in zip(p["id"].to_pylist(), p["text"].to_pylist())] == [
        *enumerate(texts), *list(enumerate(texts))[2:5]]
    assert all(p.num_rows == 1 or sum(len(t.encode()) for t in p["text"].to_pylist()) <= 100 for p in parts)
