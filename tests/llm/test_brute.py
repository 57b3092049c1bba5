"""Operators against brute force on small tables."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rallyframe.llm import minhash, queries, suffixes
from rallyframe.llm.bpe import PairIndexBPE
from rallyframe.llm.extract import Page, trained
from rallyframe.llm.oracles import corpus_sql
from rallyframe.llm.shared import written
from rallyframe.llm.tokens import PieceEncoder

from .cases import odd_documents

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def texts(sf_dir):
    return duckdb.sql(f"select doc_id, coalesce(text, '') from '{sf_dir}/documents.parquet' order by doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(corpus_sql()))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got, want = queries.corpus_queries()[name](spark, sf_dir).toPandas(), con.sql(corpus_sql()[name]).df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    value = lambda v: "" if pd.isna(v) else round(float(v), 6) if isinstance(v, int | float) else v
    clean = lambda f: sorted(str([value(v) for v in r]) for r in f[columns].astype(object).values)
    assert clean(got) == clean(want)


def without_repeats(rows):
    """doc_id: (bytes, removed bytes, removed runs, kept bytes)."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        b = text.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(b[i : i + 100])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(bool(gone[i]) and (i == 0 or not gone[i - 1]) for i in range(len(b)))
        out[doc] = (len(b), sum(gone), spans, kept)
    return out


def removed(rows):
    return {d: (*x[:3], hashlib.sha256(x[3]).hexdigest()) for d, x in without_repeats(rows).items()}


@pytest.mark.parametrize(("hot", "single"), [(3, 10**9), (20_000, 10**9), (3, 9), (1, 1)])
def test_suffixes(spark, texts, monkeypatch, hot, single):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "SINGLE", single)
    random.seed(hot)
    base = "".join(random.choice("abc d") for _ in range(2000))
    rows = []
    for i in range(60):
        parts = [base[a : a + random.randrange(50, 400)] for a in (random.randrange(1600), random.randrange(1600))]
        rows.append((3 * i, parts[0] + "".join(random.choice("xyz\0é") for _ in range(random.randrange(130))) + parts[1] + "ab" * random.choice([0, 0, 90])))
    rows += [(1000 + i, rows[i][1]) for i in range(0, 30, 3)] + [(2000, ""), (2001, "q" * 99), (2002, "q" * 100), (2003, "q" * 101)] + [(5000 + d, t) for d, t in texts[:60]]
    got = suffixes.suffix_rows(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()} == removed(rows)


def test_blind_trie_orders_and_measures():
    random.seed(1)
    strings = [bytes(random.choices(b"ab", k=random.randrange(1, 90))) for _ in range(400)]
    order, lcp = suffixes.deep_shallow(strings, np.zeros(400, dtype=np.int64))
    got = [strings[i] for i in order]
    assert got == sorted(strings)
    for i in range(1, 400):
        a, b = got[i - 1], got[i]
        assert lcp[i] == next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def near_labels(rows):
    """doc_id: the smallest doc_id of its class, from all pairs."""
    grams = {d: Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := t.split()) else Counter() for d, t in rows}
    label = {d: d for d, _ in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(grams)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = sum((grams[a] & grams[b]).values())
            if both and both >= 0.8 * sum((grams[a] | grams[b]).values()):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {d: find(d) for d in ids}


def test_near_classes(spark, texts):
    random.seed(2)
    base = [f"w{random.randrange(500)}" for _ in range(200)]
    rows = [t for t in texts[:120]]
    for i in range(60):  # a family of different near copies, and passages that many share
        words = list(base)
        for _ in range(random.randrange(1, 9)):
            words[random.randrange(200)] = f"z{random.randrange(10_000)}"
        rows.append((10_000 + i, " ".join(words)))
        rows.append((20_000 + i, " ".join(base[:60] + [f"q{random.randrange(10**6)}" for _ in range(120)])))
    want = near_labels(rows)
    got = {r.doc_id: r.class_id for r in minhash.near_rows(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(3000)]
    text = " ".join(words)
    other = " ".join(w if rng.random() > 0.02 else "x" + w for w in words)
    doc, unit = minhash.weighted(*minhash.shingles([text.encode(), other.encode(), b"a a a a a a a a"]))
    signature = minhash.signatures(doc, unit, 3)
    a, b, c = minhash.units_of([text.encode(), other.encode(), b"a a a a a a a a"])
    assert abs((signature[0] == signature[1]).mean() - minhash.similarity(a, b)) < 0.15 and len(c) == 4


ODD = ["", "  ", "İstanbul ΑΣ ΌΣΟΣ", "it's we'LL aaaaaaa aaaa!!!! ---'s 12½3", "日本語 テキスト🙂🙂 naïve é", "a\x1cb\x85c d​e﻿", "x" * 3000, "  zz　k ﬁ ǅ ß ẞ", "ab\x00c \r\n\t\v\f q", "a b  c"]


def test_encodings_equal_the_library(texts):
    rows = [t for _, t in texts] + ODD
    words, whole = PairIndexBPE(WORDS), Tokenizer.from_file(WORDS)
    want = [x.ids for x in whole.encode_batch([*rows, "<|endoftext|> x <|startoftext|>"], add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in words.encode([*rows, "<|endoftext|> x <|startoftext|>"])] == want
    assert [words.decode(x) for x in want] == [whole.decode(x, skip_special_tokens=False) for x in want]
    library = Tokenizer.from_file(BYTES)
    assert [np.frombuffer(x, "<u4").tolist() for x in PieceEncoder(BYTES).encode(rows)] == [x.ids for x in library.encode_batch(rows, add_special_tokens=False)]


def test_digests_and_packing(spark, sf_dir, texts):
    library = Tokenizer.from_file(BYTES)
    ids = {d: np.array([*library.encode(t, add_special_tokens=False).ids, 0], dtype="<u4") for d, t in texts}
    start, want = 0, {}
    for d in sorted(ids):
        want[d] = (start, len(ids[d]), zlib.crc32(ids[d].tobytes()))
        start += len(ids[d])
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op5_token_planes(spark, sf_dir).collect()} == want
    sequences, whole = {}, Counter()
    for r in queries.op10_best_fit_packing(spark, sf_dir).collect():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        whole[r.doc_id] += r.length
    assert whole == {d: len(x) for d, x in ids.items()}
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(sequences) <= 1.05 * start / 2048 + 2


def test_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op9_language_id(spark, sf).collect()}
    rows = duckdb.sql(f"select doc_id, lang from '{sf}/documents.parquet'").fetchall()
    held = [(got[d].lang_pred, lang) for d, lang in rows if got[d].held_out]
    assert {d for d, _ in rows if got[d].held_out} == {d for d, _ in rows if zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum(a == b for a, b in held) >= 0.97 * len(held)


def test_extraction_leaves_boilerplate_out(sf_dir):
    trees = trained([r[0] for r in duckdb.sql(f"select html from '{sf_dir}/pages.parquet'").fetchall()])
    page = Page(
        "<body><header><h2>Site</h2></header><main><h1>Title</h1><div class='cookie-notice'>We use cookies</div><p>Para one is <b>lo</b>ng and has many words in it so it counts &amp; stays.</p>"
        "<form><label>mail</label><input></form><section class=comments><p>Reader says things here at length.</p></section></main><aside>Side text</aside></body>"
    )
    assert page.text(page.decoded(trees.log_odds(page.features()))) == "Title Para one is long and has many words in it so it counts & stays."


def test_pipeline(spark, sf_dir):
    """All five stages by brute force: rules by SQL, the others from the texts that the stage before leaves."""
    import corpus_pipeline

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    good = {d for d, kept in con.sql(f"select doc_id, kept from ({corpus_sql()['op1_quality_rules']})").fetchall() if kept}
    texts = {d: t for d, t in con.sql("select doc_id, coalesce(text, '') from documents").fetchall() if d in good}
    groups: dict[str, list] = {}
    for d, t in texts.items():
        groups.setdefault("".join(c for c in t if c not in " \t\n\v\f\r"), []).append(d)
    exact = {min(g, key=lambda d: (-len(texts[d]), d)) for g in groups.values()}
    labels = near_labels([(d, texts[d]) for d in exact])
    near = [(d, texts[d]) for d in exact if labels[d] == d]
    left = {d: x[3].decode("utf-8", "ignore") for d, x in without_repeats(near).items()}
    assert len(good) > len(exact) > len(near) and any(left[d] != t for d, t in near)
    library, want = Tokenizer.from_file(BYTES), set()
    for d, t in left.items():
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for piece, n in enumerate([len(ids) % 2048 or 2048] + [2048] * ((len(ids) - 1) // 2048)):
            want.add((d, piece, at, n, zlib.crc32(ids[at : at + n].tobytes())))
            at += n
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    filled: dict[int, list] = {}
    for r in rows:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in x) <= 2048 and all(o == sum(n for p, n in x if p < o) for o, _ in x) for x in filled.values())


def test_stages_of_odd_rows(spark):
    """Nulls, repeats, long texts, clashing names and no rows at all, through all stages in turn."""
    import corpus_pipeline

    for docs in (odd_documents(spark), odd_documents(spark).limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = written(stage(spark, docs, ""), name)
            assert out.columns == docs.columns and out.count() <= docs.count()
            docs = out
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
        assert sorted({str(r.doc_id) for r in packed.collect()}) == sorted({str(r.doc_id) for r in docs.collect()})
