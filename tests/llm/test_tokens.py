"""Encoding, decoding and token files against the tokenizers library, and their invariants."""

import hashlib
import os
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from poolgrade.llm import bpe, queries, token_planes
from poolgrade.llm.words import stretches

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
FOLDER = "/root/testdata/sf0.001"
PARTS = list("abz AB'srtvml  \n\t129#$%é中ß　՘😀\x85\x1cć٣\x00") + ["<|endoftext|>", "'ll", "   ", "\n\n", " the", "<|endof"]
ODD = [None, "", " ", "  ", "a", " a", "a " * 3000, "\n" * 50, "<|endoftext|>", "x<|endoftext|> \n y"]


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def noise(n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choices(PARTS, k=draw.choice([0, 1, 3, 10, 60]))) for _ in range(n)]


def test_encode_is_the_librarys():
    for text in noise(1500, 1) + ODD:
        ids = bpe.encode(text, PATH)
        assert ids == bpe.packed(library(text))
        assert bpe.decode(ids, PATH) == LIBRARY.decode(library(text), skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text_goes_there_and_back(text):
    ids = bpe.encode(text, PATH)
    assert ids == bpe.packed(library(text))
    assert bpe.decode(ids, PATH) == text


@pytest.mark.parametrize("open_", [20, 4096])
def test_feeding_in_pieces_changes_nothing(monkeypatch, open_):
    monkeypatch.setattr(bpe, "OPEN", open_)
    draw = random.Random(2)
    for text in noise(600, 3):
        encoder, out, at = bpe.Encoder(bpe.codes(PATH)), b"", 0
        while at < len(text):
            size = draw.choice([1, 2, 7, 40])
            out += encoder.feed(text[at : at + size])
            at += size
        assert out + encoder.finish() == bpe.packed(library(text))


@pytest.mark.parametrize(
    "text",
    ["a" * 60000, " " * 30000 + "x", "abcab" * 12000, "#" * 30000 + "'s", "".join(random.Random(4).choices("abcdefgh", k=30000)),
     " " * 9000 + "\n" + "é" * 9000, "1234567" * 3000 + "<|endoftext|>" + "x" * 9000],
)
def test_long_pieces_keep_bounded_state(text):
    encoder, out, most = bpe.Encoder(bpe.codes(PATH)), b"", 0
    for at in range(0, len(text), 777):
        out += encoder.feed(text[at : at + 777])
        most = max(most, len(encoder.tail) + (len(encoder.run.known) if encoder.run else 0))
    assert out + encoder.finish() == bpe.packed(library(text))
    assert most <= 4 * (bpe.OPEN + bpe.BLOCK + bpe.codes(PATH).words.lookahead)


def test_lookahead_is_sufficient_for_random_merges():
    """Tokens that end that long before the end of the known bytes are the same whatever follows."""
    draw = random.Random(5)
    for _ in range(60):
        tokens, rules = [b"a", b"b", b"c"], []
        for _ in range(12):
            left, right = draw.choice(tokens), draw.choice(tokens)
            if left + right not in tokens and len(left + right) <= 6:
                rules.append((left, right))
                tokens.append(left + right)
        ahead = bpe.sufficient_lookahead(rules)

        def merged(text):
            parts = [bytes([b]) for b in text]
            for left, right in rules:
                out, at = [], 0
                while at < len(parts):
                    pair = parts[at : at + 2] == [left, right]
                    out.append(left + right if pair else parts[at])
                    at += 1 + pair
                parts = out
            return parts

        for _ in range(40):
            start = bytes(draw.choices(b"abc", k=ahead + 10))
            ends = [merged(start + bytes(draw.choices(b"abc", k=draw.randrange(9)))) for _ in range(4)]
            sure = []
            for parts in ends:
                size, kept = 0, []
                for p in parts:
                    size += len(p)
                    if size <= len(start) - ahead:
                        kept.append(p)
                sure.append(kept)
            assert all(s == sure[0] for s in sure)


def test_many_pieces_merge_like_one():
    words = bpe.codes(PATH).words
    pieces = [p.encode() for t in noise(200, 6) for p in t.split(" ") if len(p) < 40] + [b"", b"a" * 30, b"abab" * 8]
    assert words.merge_many(pieces) == [bpe.packed(words.merge(p)) for p in pieces]


def test_decoder_takes_ids_one_by_one():
    words, draw = bpe.codes(PATH).words, random.Random(7)
    for _ in range(500):
        ids = [draw.choice(words.single) if draw.random() < 0.7 else draw.randrange(50257) for _ in range(9)]
        decoder = bpe.Decoder(words)
        got = "".join(decoder.feed([i]) for i in ids) + decoder.finish()
        assert got == LIBRARY.decode(ids, skip_special_tokens=False) == bpe.decode(bpe.packed(ids), PATH)


def test_operator_keeps_other_columns(spark):
    rows = [(n, t, "x") for n, t in enumerate(ODD)] + [(0, "again", "x"), (None, "no id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, BPE string")
    got = bpe.encoded(docs, PATH, back=True).collect()
    assert [(r["doc_id"], r["bpe"]["ids"]) for r in got] == [(n, bpe.packed(library(t))) for n, t, _ in rows]
    assert [r["bpe"]["decoded"] for r in got] == [t or "" for _, t, _ in rows]
    ids = bpe.encoded(docs, PATH).select("doc_id", F.col("bpe.ids").alias("ids"))
    assert [r["text"] for r in bpe.decoded(ids, PATH).collect()] == [t or "" for _, t, _ in rows]


def documents(spark):
    return [(r["doc_id"], r["text"]) for r in queries.texts(spark, FOLDER).orderBy("doc_id").collect()]


def test_query_op2(spark):
    want = {}
    for doc, text in documents(spark):
        ids = library(text)
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        want[doc] = (len(ids), hashlib.sha256(bpe.packed(ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert {r[0]: tuple(r)[1:] for r in queries.op2_bpe_transducer(spark, FOLDER).collect()} == want


def test_query_op5(spark):
    want, at = {}, 0
    for doc, text in documents(spark):
        ids = [*library(text), 2]
        want[doc] = (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    assert {r[0]: tuple(r)[1:] for r in queries.op5_token_planes(spark, FOLDER).collect()} == want


def test_stretches_hold_the_whole_text():
    texts = noise(500, 8) + ODD
    cut = stretches(pa.array(texts))
    strings = [" " + w for w in cut.after.to_pylist()] + cut.others
    for a, b, text in zip(cut.edges, cut.edges[1:], texts):
        assert "".join(strings[c] for c in cut.codes[a:b]) == (text or "")


@pytest.mark.parametrize("bits,count", [(8, 2), (8, 4), (1, 16), (1, 17)])
@pytest.mark.parametrize("n", [0, 1, 7, 4099])
def test_planes_go_back(bits, count, n):
    ids = np.random.default_rng(n).integers(0, 50257, n).astype("<u4")
    assert (token_planes.from_planes(token_planes.to_planes(ids, bits, count), bits, n) == ids).all()


@pytest.mark.parametrize("bits", [1, 8])
def test_token_files(spark, monkeypatch, tmp_path, bits):
    monkeypatch.setattr(token_planes, "CHUNK_IDS", 50)
    monkeypatch.setattr(token_planes, "BLOCK_IDS", 16)
    rows = [(n, t) for n, t in enumerate(ODD + noise(60, 9))] + [(3, "tie"), (3, "tie"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    token_planes.write(docs, f"file://{tmp_path}/ids", PATH, bits=bits)
    got = token_planes.read(spark, f"file://{tmp_path}/ids").orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    assert [(r["doc_id"], r["ids"]) for r in got] == [(n, bpe.packed([*library(t), 2])) for n, t in order]
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    assert "planes" not in token_planes.index(spark, f"file://{tmp_path}/ids").columns


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encoded(none, PATH, back=True).count() == 0
    token_planes.write(none, f"file://{tmp_path}/none", PATH)
    assert token_planes.read(spark, f"file://{tmp_path}/none").count() == 0
