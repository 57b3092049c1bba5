"""Periodic runs, personal data and token alignment against brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rallyframe.llm import alignment, disclosure, periods, queries
from rallyframe.llm.queries import planted

from .cases import odd_documents

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SPACES = " \t\n\x0b\x0c\r"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts(sf_dir):
    return duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet' order by doc_id").fetchall()


def all_runs(words):
    """(start, length, period) of every run, period by period."""
    out = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > s and i + q - s >= max(24, 3 * q):
                out.setdefault((s, i + q - s), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in out.items())


def run_row(doc_id, text, change):
    words = re.findall(f"[^{SPACES}]+", text or "")
    if change:
        a, p = change(doc_id, len(words)) or (0, len(words) or 1)
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    runs = all_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None, None, None))
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda x: (x[0], x[2])))
    return (doc_id, len(words), len(runs), *best, math.floor(Fraction(1000 * best[1], best[2])) if runs else None, sha(listed), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_of_the_tables(spark, sf_dir, texts):
    got = queries.op11_periodic_runs(spark, sf_dir).collect()
    small = {i: run_row(i, t, planted) for i, t in texts if len(t or "") < 5_000}
    assert len(got) == len(texts) and any(r.n_runs for r in got)
    assert {r.doc_id: tuple(r) for r in got if r.doc_id in small} == small


def test_runs_of_made_texts(spark, monkeypatch):
    random.seed(3)
    rows = []
    for i in range(80):
        words = []
        while len(words) < random.randrange(1, 700):
            k, r, alphabet = random.choice([1, 2, 3, 7, 8, 9, 40, 90]), random.choice([1, 3, 4, 11, 40]), random.choice([1, 2, 900])
            words += ([f"w{random.randrange(alphabet)}" for _ in range(k)] * r)[: random.randrange(1, k * r + 1)]
        rows.append((i, random.choice(SPACES).join(words)))
    rows += [(1000, "a " * 3000), (1001, "a b\x1ca b " * 40), (1002, "a b " * 30), (1003, " "), (1004, "x " * 23), (1005, "x " * 24)]
    monkeypatch.setattr(periods, "BLOCK", 900)
    got = periods.periodic_rows(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()
    want = {i: run_row(i, t, None) for i, t in rows}
    assert {r.doc_id: tuple(r) for r in got} == want


def test_pieces_join_over_tiles():
    ids = np.arange(20_000)
    ids[3_000:15_000] = np.arange(12_000) % 37
    ids[15_500:19_000] = np.arange(3_500) % 1_100
    text, q, start, end = periods.fragments(ids, np.array([0, 20_000]))
    assert {37, 1100} == set(q.tolist()) and (q == 37).sum() > 5
    assert start[q == 37].min() == 3_000 and end[q == 37].max() == 15_000
    assert [(s, e) for s, e, p in zip(start, end, q, strict=True) if p == 1100] == [(15_500, 19_000)]


def test_runs_of_odd_rows(spark):
    docs = odd_documents(spark)
    rows = periods.periodic_rows(docs).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in docs.collect())
    assert {(r.n_words, r.n_runs, r.collapsed_sha256) for r in rows if r.doc_id in (3, 4, 5)} == {(0, 0, sha(""))}
    assert [(r.start, r.length, r.period) for r in rows if r.doc_id == 11] == [(0, 61, 1)] or all(r.n_runs == 0 or r.length >= 24 for r in rows)
    assert periods.periodic_rows(docs.limit(0)).collect() == []
    cut = periods.periodic_texts(spark.createDataFrame([(1, "go " + "a b " * 20 + "end"), (2, "plain")], "doc_id bigint, text string")).collect()
    assert [(r.doc_id, r.text) for r in cut] == [(1, "go a b end")]


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(digits))]
            good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0, "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                out.append((kind, *m.span()))
    return out


def test_base_spans_are_those_of_the_patterns(texts):
    random.seed(8)
    made = ["".join(random.choices(["1", "22", "256", ".", "..", "@", "a", "b-c", " ", "-", "+", "(", ")", "4111 1111 1111 1111", "x@y.z", "+1 (234) 555-0000", "é", "%"], k=random.randrange(40))) for _ in range(6000)]
    made += ["a@b.c@d.e.f", "@@a@b..c", "1.2.3.4.5.6.7.8.9", "001.000255.0.1", "4" * 200, "a" * 3000 + "@b.c", "1.2.3." * 500]
    for text in [*made, *[t for _, t in texts if t]]:
        assert [x[:3] for x in disclosure.base_spans(text)] == plain_spans(text), text


def forbidden(rows):
    """doc number: {term: (kind of span, kinds of values)}: the method by counting in plain dictionaries."""
    words = [{w.lower() for w in re.findall(r"[^\W\d_]{3,}", t or "")} for _, t in rows]
    of_value, places, both, own = Counter(), defaultdict(set), Counter(), defaultdict(set)
    for k, (_, t) in enumerate(rows):
        t = t or ""
        spans = disclosure.base_spans(t)
        around = defaultdict(list)
        for kind, s, e, value in spans:
            low, high = max(0, s - disclosure.REACH), min(len(t), e + disclosure.REACH)
            free = [m for m in re.finditer(r"[^\W\d_]{3,}", t[low:high]) if (m.start() or not low) and (m.end() < high - low or high == len(t)) and all(y <= low + m.start() or low + m.end() <= x for _, x, y, _ in spans)]
            left, right = [m[0].lower() for m in free if low + m.end() <= s], [m[0].lower() for m in free if low + m.start() >= e]
            around[f"{kind}:{value}"].append((tuple(left[-disclosure.AROUND :]), tuple(right[: disclosure.AROUND])))
        for value, sides in around.items():
            of_value[value] += 1
            for w in {w for side in sides for part in side for w in part}:
                both[value, w] += 1
                places[value, w].add(tuple(sides))
                own[k].add((value, w))
    n, df = len(rows), Counter(w for x in words for w in x)
    kinds = Counter(k for _, t in rows for k in {x[0] for x in disclosure.base_spans(t or "")})
    rule = {}
    for (v, w), x in both.items():
        pmi, whole = math.log2(n * x / (of_value[v] * df[w])), math.log2(n / of_value[v])
        if len(places[v, w]) >= disclosure.SUPPORT and whole > 0 and pmi > math.log2(n / kinds[v.split(":")[0]]) and pmi / whole > disclosure.LIMIT:
            rule[v, w] = "revealing" if pmi / whole >= disclosure.REMOVE else "related"
    return {k: {w: "revealing" if any(rule.get((v, u)) == "revealing" for v, u in own[k] if u == w) else "related" for v, w in own[k] if (v, w) in rule} for k in range(n)}


def disclosure_rows(rows):
    out = []
    for k, terms in forbidden(rows).items():
        doc_id, t = rows[k][0], rows[k][1] or ""
        base = plain_spans(t)
        more = [(terms[m[0].lower()], *m.span()) for m in re.finditer(r"[^\W\d_]{3,}", t) if m[0].lower() in terms and all(e <= m.start() or m.end() <= s for _, s, e in base)]
        listed = lambda x: ",".join(f"{a}:{b}:{c}" for a, b, c in x)
        counts = Counter(x[0] for x in base)
        out.append((doc_id, *(counts[x] for x in disclosure.KINDS), sha(listed(base)), listed([*base, *sorted(x for x in more if x[0] == "related"), *sorted(x for x in more if x[0] == "revealing")]), len(more)))
    return sorted(out, key=repr)


def made_people():
    random.seed(5)
    filler = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("nto", "rel", "sti")]
    rows = []
    for i in range(400):
        words = random.choices(filler, k=60)
        if i % 20 == 0:
            words[20:20] = ["Maria", "Quell", "writes", "from", "maria@quell.example", "daily"]
            words += ["Quell", "again"]
        if i % 9 == 4:
            words[10:10] = [f"p{i}@mail.example", f"10.9.8.{i % 250}"]
        if i % 40 == 5:
            words[30:30] = ["server", "Northgate", "at", "10.20.30.40"]
        if i % 90 == 7:
            words += ["Northgate", "writes"]
        rows.append((i, " ".join(words)))
    return [*rows, *rows[:3], (None, rows[5][1]), (900, None), (901, ""), (902, "call +1 (234) 555-0000 now")]


def test_disclosure(spark, texts):
    rows = made_people()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = disclosure.personal_rows(docs).collect()
    assert sorted((tuple(r) for r in got), key=repr) == disclosure_rows(rows)
    clean = {r.doc_id: r.text for r in disclosure.sanitised(docs).collect()}
    assert "quell" not in clean[20].lower() and "<EMAIL>" in clean[20] and "10.20" not in clean[5] and clean[1] == rows[1][1] and clean[900] is None
    assert any("EMAIL-RELATED" in (t or "") or "IP-RELATED" in (t or "") for t in clean.values()) and "Northgate" in clean[7]


def test_disclosure_of_the_tables(spark, sf_dir, texts):
    assert sorted((tuple(r) for r in queries.op12_disclosure(spark, sf_dir).collect()), key=repr) == disclosure_rows(texts)


def test_disclosure_of_odd_rows(spark):
    docs = odd_documents(spark)
    assert len(disclosure.personal_rows(docs).collect()) == docs.count() and disclosure.personal_rows(docs.limit(0)).collect() == []
    out = disclosure.sanitised(docs)
    assert out.columns == docs.columns and out.count() == docs.count() and sum(r.text is None for r in out.collect()) == 2


def plain_alignment(rows):
    """The contract, document by document, with the libraries on whole texts."""
    a_tool, b_tool = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_tool.encode_special_tokens = True
    a_tool.no_truncation()
    alphabet = alignment.byte_alphabet()
    found, links = [], Counter()
    for doc_id, text in rows:
        text = text or ""
        a, b = a_tool.encode(" " + text, add_special_tokens=False).ids, b_tool.encode(text)
        ab = [bytes(alphabet[c] for c in a_tool.id_to_token(x)) for x in a]
        bb = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(b_tool.id_to_piece, b)]
        if not text or not b"".join(ab) == (" " + text).encode() == b"".join(bb):
            found.append((doc_id, 0, 0, 0, [], ""))
            continue
        ae, be = np.cumsum([len(x) for x in ab]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        both, parts, mine = sorted(set(ae) & set(be)), [], []
        x = y = 0
        for end in both:
            i, j = list(range(x, ae.index(end) + 1)), list(range(y, be.index(end) + 1))
            x, y = i[-1] + 1, j[-1] + 1
            parts.append(",".join(str(a[k]) for k in i) + "|" + ",".join(str(b[k]) for k in j))
            mine += [(a[k], b[m]) for k in i for m in j if ae[k] - len(ab[k]) < be[m] and be[m] - len(bb[m]) < ae[k]]
        links.update(mine)
        found.append((doc_id, len(a), len(b), len(both), mine, sha(";".join(parts))))
    most = defaultdict(int)
    for (_, y), n in links.items():
        most[y] = max(n, most[y])
    return sorted(((d, n, m, g, len(mine), sum(links[x] == most[x[1]] for x in mine), sum(links[x] for x in mine), s) for d, n, m, g, mine, s in found), key=repr)


ODD_TEXTS = [
    "", None, "a", " a", "  two  spaces ", "line\nbreak\n\n end", "\n\nfoo\n", "cr\r\nlf\r\n x\r", "\r\rx; \r y;\r\n", "tab\t\tbed \t", "▁ is a space", "a▁b", "<s> </s> <unk> <0x0A> <|endoftext|> x", "日本語のテキスト 🙂🙂 é́ ﬁ", "nul\x00 \x1c \x85   　x y",
    "don't we'll I'm 123456 7.5%", "x" * 300, "!!! ... ??? -- __", "ééé " * 30,
]


def test_alignment(spark, texts, monkeypatch):
    monkeypatch.setattr(alignment, "UNITS", 150)
    rows = [*enumerate(ODD_TEXTS), *[(100 + i, t) for i, t in texts[:60]], (None, "a b"), (3, "again the same"), (3, "again the same")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = alignment.aligned_rows(docs, A, B).collect()
    cols = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted((tuple(r[c] for c in cols) for r in got), key=repr) == plain_alignment(rows)


def test_alignment_jumps():
    random.seed(2)
    for _ in range(300):
        same = [random.random() < 0.9 for _ in range(random.randrange(1, 90))]
        a, b = [], []
        for k, s in enumerate(same):
            a.append(10 * k + 10)
            b += [10 * k + 10] if s else [10 * k + 3, 10 * k + 10]
            if random.random() < 0.2 and k < len(same) - 1:
                a[-1] += 1
        got = list(zip(*alignment.group_ends(a, b), strict=True))
        assert [a[i - 1] for i, _ in got] == [b[j - 1] for _, j in got] == sorted(set(a) & set(b))


def test_alignment_of_odd_rows(spark):
    docs = odd_documents(spark)
    assert len(alignment.aligned_rows(docs, A, B).collect()) == docs.count()
    assert alignment.aligned_rows(docs.limit(0), A, B).collect() == []
