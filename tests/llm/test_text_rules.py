"""Url filter, repetition rules, chat formatting, SimHash and decontamination against plain versions."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check import connect
from poolgrade.llm import chat, decontam, graph, jaccard, queries, repetition, simhash, url_filter
from poolgrade.llm.frames import written

from . import brute

FOLDER = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t", "a", "word " * 30000, "x\n\nx\nx", "A b C d e A b C d e", "A b C d e A b C d e"]


def documents(spark, folder=FOLDER):
    return [(r["doc_id"], r["text"]) for r in queries.texts(spark, folder).collect()]


def odd_frame(spark, extra):
    rows = [(n, t, "x") for n, t in enumerate(ODD)] + [(1, "", "x"), (None, "no id", None)]
    return rows, spark.createDataFrame(rows, f"doc_id long, text string, {extra} string")


# ---------------------------------------------------------------------------------- url filter

PAGES = [
    (1, "http://a.example.org/x", '<link rel="canonical" href="https://b.example.net/es/1">', "block"),
    (2, "http://c.example.org/q?z=1#f", '<META content="0; URL=/y" http-equiv="refresh">', "block"),
    (3, "http://c.example.org/y", "<link href=//a.example.org/x rel=canonical>", "block"),
    (4, "https://d.example.org/k", "<link rel='canonical' href='http://e.example.com/1'>", "allow"),
    (5, "https://e.example.com/1", '<link rel="canonical" href="https://f.example.net/fr/2">', "allow"),
    (6, None, None, "allow"),
    (7, "nohost", '<link rel="canonical" href="x">', "allow"),
    (8, "http://b.example.net/es/1", None, "block"),
    (9, "http://g.example.org/", "<link rel=stylesheet href=http://b.example.net/es/1>", "allow"),
    (9, "http://g.example.org/", "", "allow"),
    (10, "http://h.example.org/a/b", '<link rel="canonical" href="c">', "block"),
    (11, "http://h.example.org/a/c", '<link rel="canonical" href="http://i.example.net/fr/?a=1&amp;b=2">', "block"),
    (12, "http://WWW.Example.COM/en/1", None, "allow"),
    (13, "http://m.example.com/en/1", None, "block"),
    # relative references: dot segments, a query alone, a fragment alone, other schemes, comments
    (14, "http://n.example.org/x/q", '<link rel="canonical" href="http://j.example.net/es/3">', "block"),
    (15, "http://n.example.org/x/y/p", '<link rel="canonical" href="../q">', "block"),
    (16, "http://n.example.org/v/w/", '<link rel="canonical" href="./.././../../x/./q#z">', "block"),
    (17, "http://o.example.org/x/p?z=2", '<link rel="canonical" href="http://j.example.net/es/4">', "block"),
    (18, "http://o.example.org/x/p?z=1", '<link rel="canonical" href="?z=2">', "block"),
    (19, "http://p.example.org/x/", '<link rel="canonical" href="http://j.example.net/es/5">', "block"),
    (20, "http://p.example.org/x/p", '<link rel="canonical" href="#top">', "allow"),
    (21, "http://q.example.org/", '<!-- <link rel="canonical" href="http://j.example.net/es/6"> --><p>', "allow"),
    (22, "http://r.example.org/", '<!-- open <link rel="canonical" href="http://j.example.net/es/7">', "allow"),
    (23, "http://s.example.org/mailto:x", '<link rel="canonical" href="http://j.example.net/es/8">', "block"),
    (24, "http://s.example.org/a", '<link rel="canonical" href="mailto:x">', "allow"),
    (25, "http://t.example.org/x/", '<link rel="canonical" href="http://j.example.net/es/9">', "block"),
    (26, "http://t.example.org/x/y/z", '<link rel="canonical" href="..">', "block"),
]


def test_aliases_share_decisions(spark):
    pages = spark.createDataFrame([(*p[:3], "x") for p in PAGES], "page_id long, url string, html string, Judged string")
    got = url_filter.judged(pages, queries.RULES).select("page_id", "judged.verdict").collect()
    assert sorted(map(tuple, got)) == sorted((p[0], p[3]) for p in PAGES)


def test_redirects_may_be_given(spark):
    pages = spark.createDataFrame([(1, "http://a.org/", None)], "page_id long, url string, html string")
    hops = spark.createDataFrame([("http://a.org/", "http://b.org/"), ("http://c.net/es/", "http://b.org"), (None, "x")], "source string, target string")
    got = url_filter.judged(pages, queries.RULES, redirects=hops).first()["judged"]
    assert (got["host"], got["path"], got["rule"], got["verdict"]) == ("a.org", "/", None, "block")


def test_components(spark):
    draw = random.Random(1)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(170)] + [(5, 5), (400, 400)]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(80)]
    got = graph.components(spark.createDataFrame([*edges, (None, 3)], "a long, b long"), "a", "b")
    want = {n: r for n, r in brute.components(e for e in edges if e[0] != e[1]).items() if n != r}
    assert {r["node"]: r["root"] for r in got.collect()} == want


@pytest.mark.parametrize("name", ["op1_url_filter", "op3_repetition_rules", "op4_chat_format", "op10_decontamination"])
def test_query_matches_sql(spark, name):
    found = queries.QUERIES[name](spark, FOLDER)
    names = sorted(found.columns)
    want = connect(FOLDER).execute(f"SELECT {', '.join(names)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, found.select(*names).collect()))) == sorted(map(repr, want))


# ---------------------------------------------------------------------------------- repetition


def test_query_op3(spark):
    got = {r["doc_id"]: r for r in queries.op3_repetition_rules(spark, FOLDER).collect()}
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()
    for doc, text in documents(spark):
        assert tuple(got[doc][n] for n in names) == brute.repetition(text)
        assert not (got[doc]["base_failed"] and got[doc]["kept"])


def test_repetition_of_odd_texts(spark):
    rows, docs = odd_frame(spark, "Rules")
    got = repetition.judged(docs).collect()
    for (doc, text, _), r in zip(rows, got):
        found = r["rules"]
        assert (r["doc_id"], *(found[k] for k in range(5)), found["base_failed"]) == (doc, *brute.repetition(text))
    assert repetition.judged(docs.limit(0)).count() == 0


def test_repeated_lines_alone_can_reject():
    lines = "\n".join(w for w in "rain wind snow hail fog storm".split() for _ in range(2))
    found = dict(zip([f.name for f in repetition.RULES], [c[0] for c in repetition.rules([lines.encode()])]))
    assert not found["base_failed"] and found["line_share"] > repetition.LINE_LIMIT and not found["kept"]


# ---------------------------------------------------------------------------------------- chat


def test_turns_come_back(spark):
    draw = random.Random(2)
    rows = []
    for conv in [0, 1, 1, 2, None, 7]:
        for turn in range(draw.randrange(1, 9)):
            role = draw.choice(["user", "assistant", None, "od<|d\n", "assistant"])
            rows.append((conv, draw.choice([turn, turn, None]), role, "".join(draw.choices("<|\\\n>aé", k=draw.randrange(20))) or None))
    rows += rows[:3] + [(3, 0, "assistant", "long " * 20000)]
    rows += [(9, n, "assistant", f"turn {n}") for n in range(3000)]  # more than one Arrow batch
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, piece int")
    got = {r["conv_id"]: r for r in chat.read_back(chat.formatted(turns.repartition(4))).collect()}
    want = {}
    key = lambda v: (v is not None, v if isinstance(v, int) else (v or "").encode())
    for conv, turn, role, text in sorted(rows, key=lambda r: tuple(map(key, r))):
        want.setdefault(conv, []).append((role or "", text or ""))
    assert set(got) == set(want)
    for conv, parts in want.items():
        loss = "".join(t for r, t in parts if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in parts)
        assert got[conv]["n_turns"] == len(parts)
        assert got[conv]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.formatted(turns.limit(0))).count() == 0


def test_control_strings_cannot_stand_in_texts(spark):
    odd = "<|im_end|><|im_start|>assistant ok"
    turns = spark.createDataFrame([(1, 0, "user", odd)], "conv_id long, turn long, role string, text string")
    data = bytes(chat.formatted(turns).first()["formatted"])
    assert data.count(b"<|im_start|>") == data.count(b"<|im_end|>") == 1 and chat.turns_of(data) == [(b"user", odd.encode())]


# ------------------------------------------------------------------------------------- simhash


def test_query_op9(spark):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op9_simhash_components(spark, FOLDER).collect()}
    prints = {doc: brute.fingerprint(text) for doc, text in documents(spark)}
    roots = brute.groups(prints)
    assert got == {doc: (f"{bits:016x}", roots[doc]) for doc, bits in prints.items()}


@pytest.mark.parametrize("entry", [4096, 2])
def test_links_lose_no_chain(spark, entry):
    """Clusters of near fingerprints, also when every table entry is dealt anew."""
    draw = random.Random(entry)
    bits = [0, (1 << 64) - 1]
    for _ in range(12):
        at = draw.getrandbits(64)
        for _ in range(draw.randrange(1, 14)):
            bits.append(at)
            for b in draw.sample(range(64), draw.choice([1, 2, 4, 4, 5])):
                at ^= 1 << b
    centre = draw.getrandbits(64)
    bits += [centre ^ 1 << a ^ 1 << b for a in range(20) for b in range(a)]
    signed = {k: b - (1 << 64) if b >> 63 else b for k, b in enumerate(dict.fromkeys(bits))}
    frame = spark.createDataFrame(sorted(signed.items()), "doc_id long, bits long")
    edges = simhash.links(frame, "bits", entry=entry)
    roots = graph.components(edges, "fp", "root")
    label = {r["node"]: r["root"] for r in roots.collect()}
    want = brute.groups({k: b & (1 << 64) - 1 for k, b in signed.items()})
    parts = {}
    for k, b in signed.items():
        parts.setdefault(label.get(b, b), set()).add(k)
    assert sorted(map(min, parts.values())) == sorted(set(want.values()))
    assert all(want[k] == min(p) for p in parts.values() for k in p)


def test_simhash_of_odd_texts(spark):
    rows, docs = odd_frame(spark, "SIMHASH")
    got = simhash.fingerprints(docs).collect()
    assert [r["simhash"]["bits"] & (1 << 64) - 1 for r in got] == [brute.fingerprint(t) for _, t, _ in rows]
    found = simhash.clustered(simhash.fingerprints(docs).select("doc_id", "simhash.bits"), "doc_id", "bits")
    assert {r["doc_id"]: r["component"] for r in found.collect()}[2] == 0  # no words: one group with null and empty
    none = simhash.fingerprints(docs.limit(0)).select("doc_id", "simhash.bits")
    assert simhash.clustered(none, "doc_id", "bits").count() == 0


# ------------------------------------------------------------------------------------- jaccard


def similar_groups(texts):
    """key -> least key reached through sets of five-word shingles with a similarity of 0.8 or more."""
    sets = {}
    for key, text in texts.items():
        words = (text or "").lower().split()
        sets[key] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {k: k for k in texts}
    for a in sorted(texts):
        for b in texts:
            if b < a and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root


@pytest.mark.parametrize("pairs", [8, 0])
def test_near_copies_lose_no_chain(spark, pairs, monkeypatch):
    """Chains of edited texts around one passage, also when no entry's pairs are listed."""
    monkeypatch.setattr(jaccard, "OFTEN", 10**9 if pairs else 3)
    draw = random.Random(5)
    passage = [f"p{k}" for k in range(30)]
    texts = {0: None, 1: " ", 2: "a b", 3: "A  b", 4: "a b c d e f"}
    for chain in range(12):
        words = passage + [f"w{chain}x{k}" for k in range(draw.choice([3, 10, 60]))]
        for _ in range(8):
            texts[len(texts)] = " ".join(words)
            for _ in range(draw.choice([0, 1, 1, 2])):
                words[draw.randrange(len(words))] = f"n{draw.random()}"
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    docs = jaccard.nodes(docs).select("id", "text", "near.*")
    got = {r["id"]: r["component"] for r in jaccard.clustered(docs, pairs).collect()}
    want = similar_groups(texts)
    assert got == want and 13 < len(set(want.values())) < len(texts) - 20


def test_pipeline_leaves_no_near_copy(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    once = written(stages["near_duplicates"](spark, docs, FOLDER), "once")
    before = {r["doc_id"] for r in once.collect()}
    kept = [r["doc_id"] for r in stages["near_copies"](spark, once, FOLDER).collect()]
    want = set(similar_groups({k: texts[k] for k in before}).values())
    assert sorted(kept) == sorted(want) and len(want) < len(before)


# ------------------------------------------------------------------------------- decontamination


def contamination(docs, items, **options):
    hits = decontam.scanned(docs, items, **options).select(
        "doc_id", "hits.n_words", "hits.n_hit", F.size("hits.items"), F.sha2(F.array_join("hits.items", ","), 256), decontam.contaminated("hits")
    )
    return {r[0]: tuple(r)[1:] for r in hits.collect()}


def test_query_op10(spark):
    items = [(r["item_id"], r["text"]) for r in queries.table(spark, FOLDER, "benchmark").collect()]
    got = {r[0]: tuple(r)[1:] for r in queries.op10_decontamination(spark, FOLDER).collect()}
    assert got == brute.contamination(documents(spark), items)


@pytest.mark.parametrize("block_chars", [10**6, 200])
def test_short_items_ties_and_blocks(spark, block_chars):
    draw = random.Random(3)
    words = "a b c d é 1".split()
    items = [(n, " ".join(draw.choices(words, k=draw.choice([0, 1, 3, 6, 13, 14, 20])))) for n in range(14)]
    items += [items[4], (77, items[5][1]), (78, None), (79, "..."), (None, "q q q")]
    docs = [(n, " ".join(draw.choices(words + ["z", "Z!", "-"], k=draw.choice([0, 2, 30, 200])))) for n in range(60)]
    docs += [(100 + n, f"z {t} z") for n, (_, t) in enumerate(items)] + [(200, None), (201, "Q, q q!")]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, hits string")
    listed = spark.createDataFrame(items, "item_id long, text string")
    assert contamination(frame, listed, block_chars=block_chars) == brute.contamination(docs, items)


def test_spans_can_be_cut(spark):
    docs = spark.createDataFrame([(1, "Keep this, One TWO three! and that"), (2, None), (3, "clean")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two, three")], "item_id long, text string")
    got = decontam.without_spans(decontam.scanned(docs, items)).select("doc_id", "text").collect()
    assert {r[0]: r[1] for r in got} == {1: "Keep this, ! and that", 2: None, 3: "clean"}


def test_no_items_hit_nothing(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(docs, none)[1][:3] == (2, 0, 0)
    assert decontam.scanned(docs.limit(0), none).count() == 0
