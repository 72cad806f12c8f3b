import hashlib
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from cragline.llm import pieces, token_files

MODEL, FILE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "   ", "\n", "\n\n a\n", " lead", "trail ", "a  b   c", "▁", "a▁b ▁c", "<s></s><unk>", "<0x0A>", "中文字", "😀😀 x", "é　\xa0z", "\x00\x1f", "<|endoftext|> x", "don't 'll", "\r\n\t", "x" * 3000, " " * 300, "-" * 500, "=_" * 200, "a\x85b c"]


def texts():
    draw = random.Random(4)
    letters = "ab  cdeéü\n\t▁xyz 中文😀  <s>0123.,!?ThE' \x1c"
    return ODD + ["".join(draw.choice(letters) for _ in range(draw.randint(0, 60))) for _ in range(800)]


def test_pieces_equal_the_library():
    model, library = pieces.piece_model(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = texts() + ["".join(library.id_to_piece(random.Random(k).randint(259, 31999)) for _ in range(8)) for k in range(500)]
    ids, offsets = model.encode(pa.array(rows, pa.string()))
    out = model.decode(ids, offsets)
    for k, t in enumerate(rows):
        want = library.encode(t or "")
        assert ids[offsets[k] : offsets[k + 1]].tolist() == want, t
        assert out[k].decode() == library.decode(want), t
    assert len(model.encode(pa.array([], pa.string()))[0]) == 0


def test_long_words_equal_the_library_in_bounded_time(monkeypatch):
    import time

    model, library = pieces.piece_model(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    draw = random.Random(8)
    long = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=60_000)), "".join(draw.choices("ABCabc0189+/=", k=20_000)), "x" * 9000, "ab" * 5000, "中文é😀" * 1000, "=-" * 3000 + " short " + "the" * 3000, "▁" * 2000]
    began = time.perf_counter()
    model.encode(pa.array(long[:1], pa.string()))
    assert time.perf_counter() - began < 5
    for few in (512, 2):  # all words from the queue, too
        monkeypatch.setattr(pieces, "LONG", few)
        rows = long + texts()[:400]
        ids, offsets = model.encode(pa.array(rows, pa.string()))
        for k, t in enumerate(rows):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == library.encode(t or ""), t and t[:80]


def test_byte_tokens_equal_the_library():
    mine, library = token_files.byte_tokenizer(FILE), Tokenizer.from_file(FILE)
    library.encode_special_tokens = True
    rows = texts()
    for _ in range(2):  # the second time from memory
        ids, offsets = mine.encode(pa.array(rows, pa.string()))
        for k, t in enumerate(rows):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids, t


def test_encoded_columns(spark):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(ODD)] + [(None, "a", "y"), (3, "a", "y")], "doc_id long, text string, ids string")
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = pieces.encoded(docs, MODEL, carry=["doc_id", "text", "ids"]).toPandas()
    assert list(got) == ["doc_id", "text", "ids", "n_tokens", "ids", "decoded"] and len(got) == len(ODD) + 2
    got = pieces.encoded(docs, MODEL, with_ids=False).where("doc_id = 7").first()
    want = library.encode(ODD[7])
    assert (got.n_tokens, got.ids_sha256, got.decoded_sha256) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(library.decode(want).encode()).hexdigest())
    assert pieces.encoded(docs.limit(0), MODEL).count() == 0


def test_token_files_round_trip(spark, tmp_path):
    import pyarrow.parquet as pq

    rows = [(k * 3 % 101, t, "x") for k, t in enumerate(texts()[:300])] + [(None, "last", "x"), (5, "again", "x"), (5, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens string").repartition(3)
    folder = f"file://{tmp_path}/tokens"
    token_files.write_tokens(docs, folder, FILE)
    got = token_files.read_digests(spark, folder).collect()
    library = Tokenizer.from_file(FILE)
    library.encode_special_tokens = True
    at, want = 0, []
    for k, t, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((k, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    files = sorted((tmp_path / "tokens").glob("*.parquet"))
    group = pq.read_metadata(files[0]).row_group(0)
    kinds = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert any("DICTIONARY" in e for e in kinds["tokens.list.element"].encodings) and "DELTA_BINARY_PACKED" in kinds["start"].encodings
    assert kinds["start"].has_offset_index and kinds["start"].has_column_index


def test_empty_table_of_tokens(spark, tmp_path):
    token_files.write_tokens(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/none", FILE)
    assert token_files.read_digests(spark, f"file://{tmp_path}/none").count() == 0


def test_added_tokens_equal_the_unaltered_library():
    mine, library = token_files.byte_tokenizer(FILE, True), Tokenizer.from_file(FILE)
    rows = texts() + [a + "<|endoftext|>" + b for a in ("", "x", "x ", "x  ", "é\n") for b in ("", "y", " y z", "  ", "<|endoftext|> don't")]
    for _ in range(2):
        ids, offsets = mine.encode(pa.array(rows, pa.string()))
        for k, t in enumerate(rows):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids, t
    assert 50256 in ids


def test_the_query_encodes_added_tokens(spark, tmp_path):
    from cragline.llm import queries

    spark.createDataFrame([(1, "a <|endoftext|> b"), (2, "c")], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    ids = [*Tokenizer.from_file(FILE).encode("a <|endoftext|> b", add_special_tokens=False).ids, 2]
    got = {r.doc_id: r for r in queries.op6_token_files(spark, f"file://{tmp_path}").collect()}
    assert (got[1].n_tokens, got[1].ids_crc32, got[2].start) == (len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), len(ids))


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from cragline.llm._spark import shared_folder

    def session(master, named):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: named, set=lambda key, value: None), sparkContext=SimpleNamespace(master=master))

    assert shared_folder(session("spark://host:7077", "hdfs://host/shared")) == "hdfs://host/shared"
    with pytest.raises(ValueError):
        shared_folder(session("spark://host:7077", None))


def test_plain_units_skip_the_pre_tokenizer_with_the_same_ids(monkeypatch):
    units = [" word", " Wörter,", " ÀÉÿ", " it's", " a×b", " x÷", " a1", " !", " end.", " two..", " straße?", " Ǆx", " naïve;", " ", "lone", " ét", " 日本", " tab\tx", " <|endoftext|>"]
    mine, library = token_files.ByteTokenizer(FILE), Tokenizer.from_file(FILE)
    library.encode_special_tokens = True
    data, offsets = np.frombuffer("".join(units).encode(), np.uint8), np.r_[0, np.cumsum([len(u.encode()) for u in units])]
    plain = token_files.plain_units(data, offsets, np.arange(len(units)))
    assert [u for u, p in zip(units, plain) if p] == [" word", " Wörter,", " ÀÉÿ", " end.", " straße?", " naïve;"]
    seen = []
    monkeypatch.setattr(mine, "tokenizer", type("Told", (), {"encode_batch_fast": lambda self, texts, **k: seen.extend(texts) or library.encode_batch_fast(texts, **k)})())
    ids, ends = mine.encode_units(data, offsets)
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [library.encode(u, add_special_tokens=False).ids for u in units]
    assert not any("word" in t or "Wörter" in t or "naïve" in t for t in seen)


def test_a_word_is_one_unit_whatever_mark_or_line_follows():
    library, mine = Tokenizer.from_file(FILE), token_files.ByteTokenizer(FILE)
    library.encode_special_tokens = True
    rows = ["The oak, the oak. the oak\nThe oak; the oak!", "été,été.\n\nété \n été\n", "a.b,c\n.d\n", "x's. 'll,it's\n's", "1.5,a1.b2", "中,文.ñ×,÷.ÿ", "\n", "\n.", ".\n", " \n."]
    ids, offsets = mine.encode(pa.array(rows))
    for k, t in enumerate(rows):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, t
    mine._forget()
    mine.encode(pa.array(rows[:1]))
    assert len(mine.places) == 8  # The, oak, the, four marks and the line feed


def test_bare_words_skip_the_pre_tokenizer_with_the_same_ids():
    library = Tokenizer.from_file(FILE)
    draw = random.Random(6)
    units = sorted({"".join(draw.choices("abcdeTHéÿ", k=draw.randint(1, 9))) for _ in range(9000)} | {",", "\n", "don't", "a1", " the"})
    data, offsets = np.frombuffer("".join(units).encode(), np.uint8), np.r_[0, np.cumsum([len(u.encode()) for u in units])]
    mine = token_files.ByteTokenizer(FILE)
    batches, merger = [], mine.merger

    class Counted:
        def encode_batch_fast(self, texts, **named):
            batches.append(texts[0].count(" "))
            return merger.encode_batch_fast(texts, **named)

    mine.merger = Counted()
    ids, ends = mine.encode_units(data, offsets)
    for k, u in enumerate(units):
        assert ids[ends[k] : ends[k + 1]].tolist() == library.encode(u, add_special_tokens=False).ids, u
    assert sum(batches) >= len(units) - 4


def test_units_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(token_files, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    library, mine = Tokenizer.from_file(FILE), token_files.ByteTokenizer(FILE)
    for rows in (["one two six", "two ten"], ["ten six one", "three"], ["one"]):
        ids, offsets = mine.encode(pa.array(rows))
        for k, t in enumerate(rows):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, t
