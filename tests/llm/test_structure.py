"""Conversation repair, fill-in-middle and SentencePiece against brute-force versions and the library."""

import hashlib
import os
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from poolgrade.llm import fim, pieces, queries, repair

FOLDER = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TURNS = "conv_id long, turn int, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Conversation repair


def all_audits(kinds):
    """(cost, audit) of every way with at most four insertions, by trying them all."""
    out = []

    def go(at, state, cost, audit, added):
        if at == len(kinds) and state in repair.ENDS:
            out.append((cost, audit))
        for (before, letter), to in repair.FOLLOWS.items():
            if before == state and letter in "ua" and added < 4:
                go(at, to, cost + 5, audit + "I", added + 1)
        if at == len(kinds):
            return
        first, fault = "sua?"[kinds[at] // 4], kinds[at] % 4
        go(at + 1, state, cost + 2, audit + "D", added)
        for (before, letter), to in repair.FOLLOWS.items():
            if before == state and fault in (0, 3):
                extra = 5 * (fault == 3)
                if letter == first:
                    go(at + 1, to, cost + extra, audit + "K", added)
                elif letter in "ua":
                    go(at + 1, to, cost + extra + 1, audit + "R", added)

    go(0, repair.NONE, 0, "", 0)
    return out


def test_cheapest_edits_are_the_brute_forces():
    draw = random.Random(4)
    for _ in range(400):
        kinds = bytes(draw.choice([0, 3, 4, 7, 8, 11, 12, 15, 5, 6]) for _ in range(draw.randrange(0, 5)))
        assert repair._solve(kinds, repair.NONE, repair.ENDS) == min(all_audits(kinds))


def plain_repair(rows):
    """What the contract asks of one conversation's rows (turn, role, text), in one pass over whole lists."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))
    seen, kinds = set(), []
    counts = {1: 0, 2: 0, 3: 0, 0: 0}
    for _, role, text in rows:
        letters = text.strip(" \t\n\v\f\r")
        fault = 1 if not letters else 2 if (role, text) in seen else 3 if letters[-1] not in ".!?" else 0
        seen.add((role, text))
        counts[fault] += 1
        kinds.append(4 * ("sua".find(role[0]) if role[:1] in list("sua") else 3) + fault)
    # labels turn by turn, insertions tried until nothing gets better
    labels = {0: (0, "")}

    def with_insertions(labels):
        for _ in range(3):
            for (before, letter), to in repair.FOLLOWS.items():
                if before in labels and letter in "ua":
                    cost, audit = labels[before]
                    labels[to] = min(labels.get(to, (10**9, "")), (cost + 5, audit + "I"))
        return labels

    with_insertions(labels)
    for k in kinds:
        now = {}
        for state, (cost, audit) in labels.items():
            ways = [("D", 2, state)]
            for (before, letter), to in repair.FOLLOWS.items():
                if before == state and k % 4 in (0, 3):
                    extra = 5 * (k % 4 == 3)
                    if letter == "sua?"[k // 4]:
                        ways.append(("K", extra, to))
                    elif letter in "ua":
                        ways.append(("R", 1 + extra, to))
            for edit, more, to in ways:
                now[to] = min(now.get(to, (10**9, "")), (cost + more, audit + edit))
        labels = with_insertions(now)
    cost, audit = min(labels[s] for s in (0, 3) if s in labels)
    made = repair.edited([r for _, r, _ in rows], [x for _, _, x in rows], audit, 0)
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in made))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    firsts = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:]))
    return gaps, counts[1], counts[2], counts[3], illegal, cost, audit, sha("\n".join(f"{r}:{x}" for r, x in made))


def odd_conversations(n, seed):
    draw = random.Random(seed)
    rows = []
    for conv in range(n):
        size = draw.choice([1, 1, 2, 3, 6, 40])
        for turn in range(size):
            rows.append(
                (
                    draw.choice([conv] * 9 + [None]),
                    draw.choice([turn] * 8 + [None, turn + 3]),
                    draw.choice(["user", "assistant"] * 5 + ["system", "tool", "", None, "User", "🙂"]),
                    draw.choice(["Yes.", "No", "  ", "", None, "Ah!", "é?\n", "one. two", "Yes. ", "x" * 5000 + "."]),
                )
            )
    return rows + rows[:3]


@pytest.mark.parametrize("block", [3, 512])
def test_repaired_tables_are_the_plain_versions(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)  # executors are threads' workers: the closure carries it by module
    rows = odd_conversations(60, 5)
    turns = spark.createDataFrame(rows, TURNS).withColumn("ways", F.lit(1))
    told = repair.audited(repair.repaired(turns)).collect()
    want = {}
    for conv, *row in rows:
        want.setdefault(conv, []).append(row)
    assert len(told) == len(want)
    for r in told:
        s = r["sums"]
        gaps = s["most"] - s["least"] + 1 - s["numbers"] if s["most"] is not None else 0
        got = (gaps, s["blank"], s["duplicate"], s["truncated"], s["illegal"], s["cost"], r["audit"], r["digest"])
        assert got == plain_repair(want[r["conv_id"]]), r["conv_id"]


def test_one_long_conversation_is_cut_into_pieces(spark):
    draw = random.Random(6)
    rows = [(1, k, draw.choice(["user", "assistant", "system"]), draw.choice(["a.", "b", "c!", ""]) + str(k) + ".") for k in range(3000)]
    turns = spark.createDataFrame(rows, TURNS)
    fixed = repair.repaired(turns)
    assert fixed.count() > 3000 // repair.BLOCK
    (told,) = repair.audited(fixed).collect()
    s = told["sums"]
    want = plain_repair([r[1:] for r in rows])
    assert (s["most"] - s["least"] + 1 - s["numbers"], s["blank"], s["duplicate"], s["truncated"], s["illegal"], s["cost"]) == want[:6]
    assert (told["audit"], told["digest"]) == want[6:]


def test_no_turns_no_conversations(spark):
    assert repair.audited(repair.repaired(spark.createDataFrame([], TURNS))).collect() == []


def test_repair_query_keeps_conversations_without_turns_left(spark, tmp_path):
    gone = next(c for c in range(10**6) if __import__("zlib").crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hi."), (None, None, None, None), (7, 1, "user", "Hi.")]
    spark.createDataFrame(rows, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    out = {r["conv_id"]: r for r in queries.QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect()}
    assert set(out) == {gone, None, 7}
    assert tuple(out[gone])[1:] == (0, 0, 0, 0, 0, 0, "", sha(""))


# Fill-in-middle


def plain_fim(text, doc_id):
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts(n, seed):
    draw = random.Random(seed)
    parts = list("ab é中😀 \t\n\x0b\x0c\r\x1c\x85 <>PSM") + [" word"] * 4 + ["<P", "S>", "  "]
    out = ["".join(draw.choices(parts, k=draw.choice([0, 1, 2, 3, 10, 40]))) for _ in range(n)]
    return out + ["a<M>b", "<P>", None, "", " ", "x" * 100_000 + " y", "w " * 50_000]


@pytest.mark.parametrize("block", [7, 1 << 20])
def test_displaced_bytes_are_the_plain_versions(monkeypatch, block):
    monkeypatch.setattr(fim, "BLOCK", block)
    texts = odd_texts(300, 7) if block > 7 else odd_texts(300, 8)[:-2]
    texts = [t or "" for t in texts]
    digests = [hashlib.sha256(f"42:{i}".encode()).hexdigest() for i in range(len(texts))]
    drawn = np.array([[int(d[8 * k : 8 * k + 8], 16) for k in range(4)] for d in digests])
    n, form, prefix, middle, out, edges = fim.assembled(pa.array(texts, pa.string()), drawn, 50, 80)
    outputs = fim._strings(out, edges).to_pylist()
    for k, text in enumerate(texts):
        moved = form[k] > 0
        got = n[k], fim.FORMS[form[k]], prefix[k] if moved else None, middle[k] if moved else None, outputs[k]
        assert got == plain_fim(text, k)
    text, edges, sound = fim.gathered(pa.array(outputs, pa.string()), form)
    assert sound.all() and fim._strings(text, edges).to_pylist() == texts


def test_fim_columns_nulls_and_repeats(spark):
    rows = [(k if k % 7 else None, t, "mine") for k, t in enumerate(odd_texts(60, 9))] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, FIM string")
    made = fim.transformed(docs)
    assert made.columns == ["doc_id", "text", "fim"]
    back = fim.restored(made.select("doc_id", F.col("text").alias("was"), "fim.*"))
    for r in back.collect():
        text = r["was"] or ""
        n, form, prefix, middle, output = plain_fim(text, "" if r["doc_id"] is None else r["doc_id"])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["text"]) == (n, form, prefix, middle, output, text)
    assert fim.restored(fim.transformed(docs.where("false")).select("fim.*")).collect() == []


def test_outputs_that_no_form_makes_give_null(spark):
    rows = [("<P>a<S>b", "psm"), ("<S>b<P>a<M>c", "spm"), ("<S>b<P>a<M>c", "psm"), (None, "plain"), ("a", None), ("a", "odd"), ("<P>", "plain")]
    back = fim.restored(spark.createDataFrame(rows, "output string, form string")).collect()
    assert [r["text"] for r in back] == [None, "acb", None, None, None, None, "<P>"]


# SentencePiece


PARTS = list("abz AB'srtvml  \n\t129#$%é中ß　՘😀\x85\x1cć٣\x00.,") + ["<s>", "</s>", "<0x0A>", "   ", "\n\n", " the", "ing", "▁", "▁▁"]


def noise(n, seed):
    draw = random.Random(seed)
    own = pieces.pieces(MODEL).text[259:]
    return ["".join(draw.choices(PARTS if k % 2 else own, k=draw.choice([1, 3, 10, 60]))) for k in range(n)]


def test_piece_ids_are_the_librarys():
    runs = [c * n for c in (" ", "▁", "a", "\n", "=", "ab") for n in range(1, 60)]
    for text in noise(3000, 11) + runs + ["", "a " * 3000, "x" * 20_000, "<s>a</s>"]:
        ids = pieces.encode(text, MODEL)
        assert ids == LIBRARY.encode(text, add_eos=True)
        assert pieces.decode(ids, MODEL) == LIBRARY.decode(ids)


def test_any_ids_decode_as_the_librarys():
    draw = random.Random(12)
    for _ in range(3000):
        ids = [draw.choice([draw.randrange(300), draw.randrange(32000), 28705, 231, 192]) for _ in range(draw.randrange(12))]
        assert pieces.decode(ids, MODEL) == LIBRARY.decode(ids)


def test_prefix_table_holds_each_prefixs_last_token():
    model = pieces.pieces(MODEL)
    for text in noise(100, 13):
        text = text.replace(" ", pieces.BLANK)
        last = model.prefix_table(text)
        for n in range(1, len(text) + 1):
            token = model.merge(text[:n])[-1]
            assert last[n] == model.id.get(token, -ord(token[-1]) - 1)


def test_a_memory_of_a_few_stretches_changes_nothing(monkeypatch):
    model = pieces.Pieces(MODEL)
    monkeypatch.setattr(pieces, "PAIRS", 10)
    model.known.most = 5
    for text in noise(200, 14):
        assert np.frombuffer(model.encode(text), "<i4").tolist() == LIBRARY.encode(text)


def test_piece_columns(spark):
    rows = [(None if k == 3 else k, t, 1) for k, t in enumerate([*noise(40, 15), None, ""] * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Pieces int")
    coded = pieces.encoded(docs, MODEL, back=True)
    assert coded.columns == ["doc_id", "text", "pieces"]
    for r in coded.collect():
        ids = LIBRARY.encode(r["text"] or "", add_eos=True)
        assert r["pieces"]["ids"] == ids and r["pieces"]["decoded"] == LIBRARY.decode(ids)
    back = pieces.decoded(coded.select("pieces.ids"), MODEL)
    assert [r["text"] for r in back.collect()] == [LIBRARY.decode(LIBRARY.encode(t or "")) for _, t, _ in rows]
    assert pieces.encoded(docs.where("false"), MODEL).collect() == []


def test_piece_query_is_the_librarys(spark):
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_sentencepiece"](spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = LIBRARY.encode(d["text"] or "", add_eos=True)
        want = (d["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(LIBRARY.decode(ids)))
        assert tuple(got[d["doc_id"]]) == want
