"""Cross-tokenizer alignment against brute force with the libraries."""

import hashlib
import random
from collections import Counter

import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cragline.llm import alignment, queries

SF = "/root/testdata/sf0.001"
LEFT, RIGHT = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "   ", "\n", "\n\n a\n", " lead", "trail ", "a  b   c", "▁", "a▁b ▁c", "<s></s><unk>", "<0x0A> <0x0A>", "中文字 中文", "😀😀 x", "é　\xa0z", "\x00\x1f", "<|endoftext|> x <|endoftext|>", "don't 'll",
       "\r\n\t", "x" * 2000, " " * 300, "-" * 500, "=_" * 200, "a\x85b c", "the same the same the same", "word " * 20_000]


def brute(rows):
    left, right = Tokenizer.from_file(LEFT), sentencepiece.SentencePieceProcessor(model_file=RIGHT)
    left.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}

    def piece_bytes(i):
        return bytes([int(right.id_to_piece(i)[3:5], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("▁", " ").encode()

    found, holders = [], Counter()
    for k, t in rows:
        a = left.encode(" " + t, add_special_tokens=False).ids if t else []
        b = right.encode(t) if t else []
        sides = [[bytes(byte_of[c] for c in left.id_to_token(i)) for i in a], [piece_bytes(i) for i in b]]
        if not t or any(b"".join(s) != (" " + t).encode() for s in sides):
            found.append((k, 0, 0, 0, Counter(), ""))
            continue
        spans = []
        for ids, side in zip((a, b), sides):
            at, rows_of = 0, []
            for i, x in zip(ids, side):
                rows_of.append((i, at, at + len(x)))
                at += len(x)
            spans.append(rows_of)
        shared = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups, start = [], 0
        at = [0, 0]
        for end in shared:
            part = []
            for s in (0, 1):
                ids = []
                while at[s] < len(spans[s]) and spans[s][at[s]][2] <= end:
                    ids.append(str(spans[s][at[s]][0]))
                    at[s] += 1
                part.append(",".join(ids))
            groups.append("|".join(part))
        links, j = Counter(), 0
        for i, s, e in spans[0]:
            while spans[1][j][2] <= s:
                j += 1
            x = j
            while x < len(spans[1]) and spans[1][x][1] < e:
                links[i, spans[1][x][0]] += 1
                x += 1
        holders.update(links.keys())
        found.append((k, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = Counter()
    for (a, _), n in holders.items():
        best[a] = max(best[a], n)
    return sorted(((k, na, nb, g, sum(x.values()), sum(m for p, m in x.items() if holders[p] == best[p[0]]), sum(m * holders[p] for p, m in x.items()), sha) for k, na, nb, g, x, sha in found), key=str)


def odd_rows(n):
    draw = random.Random(5)
    letters = "ab  cdeéü\n\t▁xyz 中文😀  <s>0123.,!?ThE' \x1c"
    words = "the tokenizer aligns Überraschung words, naïve 12345 don't <unk> http://x.y/z?q=1 日本語 \n\n end.".split(" ")
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 60))) for _ in range(n)] + [" ".join(draw.choices(words, k=draw.randint(1, 30))) for _ in range(n)]
    return list(enumerate(ODD + texts)) + [(None, "a null key"), (3, "again"), (3, "again")]


@pytest.mark.parametrize("known", [1_000_000, 50, 0])
def test_alignment_by_brute_force(spark, monkeypatch, known):
    monkeypatch.setattr(alignment, "KNOWN", known)
    rows = odd_rows(150)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, pairs string, n_a int").repartition(3)
    got = alignment.aligned_counts(docs, LEFT, RIGHT)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.aligned_counts(docs, LEFT, RIGHT).count() == 0


def test_query_by_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op11_token_alignment(spark, SF).collect()), key=str) == brute(rows)


def test_a_word_is_aligned_once_whatever_mark_or_line_follows():
    both = alignment.Aligner(LEFT, RIGHT)
    both.aligned(pa.array(["The oak, the oak. the oak\nThe oak; the oak!"]))
    # " The" opens the text, "The" a line; " oak", " the", four marks and the line feed
    assert both.right.marks_apart and len(both.known) == 9
