"""Personal data, and the terms near it that give it away.

Base rules find emails, ip addresses, card and phone numbers. The method is information-theoretic: every value found is a protected
entity v, and the corpus says how much a term t of its surroundings tells about it. With p by documents, PMI(v; t) = log2 p(v, t) / (p(v) p(t)) is what t
discloses and IC(v) = -log2 p(v) is all there is to disclose; the kind of v (that it is some email) is the generalisation that stays in the text, and
IC(kind) is what it gives away anyhow. A term is over the limit if it was seen with v in SUPPORT or more different surroundings, discloses more than the kind does, and
more than LIMIT of IC(v). It is generalised (named after the kind), or removed if it discloses REMOVE of IC(v) or more. Surroundings that repeat word for word count once, so copies are no evidence.

All counts cover all documents; a count per value, term and surroundings is made before any is made per value and term. Texts of documents without
personal data are read once and not carried on. Only documents that hold a protected value lose terms, wherever in the text these stand.

Nulls count as empty. Equal or missing doc_ids do no harm (``keyed``). Positions are code points.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Keyed, columns, keyed, map_batches, to_arrow, written

KINDS = ("email", "ip", "card", "phone")
#: The method's own kinds of spans: terms that are generalised, terms that are removed.
TERM_KINDS = ("related", "revealing")
#: Words on each side of a value, within so many characters; see above for the rest.
AROUND, REACH, SUPPORT, LIMIT, REMOVE = 8, 200, 3, 0.5, 0.9
#: Terms that a task counts before it hands the counts on.
COUNTED = 400_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
PART = re.compile(r"[0-9]+")
NO_DIGIT = re.compile(r"[^0-9]")
WORD = re.compile(r"[^\W\d_]{3,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every @ has its own run of characters before it, back to the last match: linear where a pattern would begin anew at each character."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            floor = domain.end()
        at = text.find("@", max(at + 1, floor))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Numbers joined by single dots go in fours from the left; what is left over is none."""
    for chain in NUMBERS.finditer(text):
        if chain[0].count(".") < 3:
            continue
        parts = list(PART.finditer(text, *chain.span()))
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            if all(len(x) <= 3 and int(x or 0) <= 255 for x in (p[0].lstrip("0") for p in four)):
                yield four[0].start(), four[3].end()


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) by kind as in KINDS, then start."""
    found = [("email", s, e, text[s:e].lower()) for s, e in _emails(text)]
    found += [("ip", s, e, text[s:e]) for s, e in _ips(text)]
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := NO_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            found.append(("card", *m.span(), digits))
    if "+" in text:
        found += [("phone", *m.span(), digits) for m in PHONE.finditer(text) if 9 <= len(digits := NO_DIGIT.sub("", m[0])) <= 15]
    return found


class Taken:
    """Places that spans cover, as disjoint intervals in order."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [], []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(e, self.ends[-1])
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end) - 1
        return k >= 0 and self.ends[k] > start


def surroundings(text: str, spans: list[tuple[str, int, int, str]]) -> dict[str, tuple[set[str], int]]:
    """kind:value to the terms around it in this text, and a hash of these places' words in order."""
    taken = Taken([(s, e) for _, s, e, _ in spans])
    found: dict[str, list[str]] = {}
    for kind, start, end, value in spans:
        low, high = max(0, start - REACH), min(len(text), end + REACH)
        words = [m for m in WORD.finditer(text, low, high) if (m.start() > low or low == 0) and (m.end() < high or high == len(text)) and not taken.meets(*m.span())]
        before, after = [m[0].lower() for m in words if m.end() <= start], [m[0].lower() for m in words if m.start() >= end]
        found.setdefault(f"{kind}:{value}", []).extend([*before[-AROUND:], "", *after[:AROUND], "\n"])
    return {v: ({w for w in words if w not in ("", "\n")}, xxhash.xxh64_intdigest(" ".join(words)) - (1 << 63)) for v, words in found.items()}


FOUND = columns(part="str", key="long", doc_id="long", **{f"n_{k}": "long" for k in KINDS}, base="str", text="str", value="str", term="str", place="long", n="long")


def scanned(docs: Keyed) -> DataFrame:
    """One table of three kinds of rows, by ``part``: doc (spans of each document, and its text if it has any), near (value, term, hash of the surroundings, once a document; an empty term for the value alone) and term (documents of a block that hold a term)."""
    arrow = to_arrow(FOUND)

    def batch_of(part: str, **values: list) -> pa.RecordBatch:
        n = len(next(iter(values.values())))
        whole = values | {"part": [part] * n}
        return pa.RecordBatch.from_arrays([pa.array(whole[f.name], f.type) if f.name in whole else pa.nulls(n, f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms: Counter[str] = Counter()
        for batch in batches:
            keys, ids, texts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "doc_id", "text"))
            doc: dict[str, list] = {n: [] for n in ("key", "doc_id", *(f"n_{k}" for k in KINDS), "base", "text")}
            close: dict[str, list] = {n: [] for n in ("key", "value", "term", "place")}
            for key, doc_id, text in zip(keys, ids, texts, strict=True):
                spans = base_spans(text or "")
                terms.update(set(map(str.lower, set(WORD.findall(text or "")))))
                counts = Counter(x[0] for x in spans)
                listed = ",".join(f"{k}:{s}:{e}" for k, s, e, _ in spans)
                for name, value in zip(doc, (key, doc_id, *(counts[k] for k in KINDS), listed, text if spans else None), strict=True):
                    doc[name].append(value)
                for value, (words, place) in surroundings(text, spans).items() if spans else ():
                    for term in ("", *sorted(words)):
                        for name, x in zip(close, (key, value, term, place), strict=True):
                            close[name].append(x)
                if len(terms) > COUNTED:
                    yield batch_of("term", term=list(terms), n=list(terms.values()))
                    terms.clear()
            yield batch_of("doc", **doc)
            if close["key"]:
                yield batch_of("near", **close)
        if terms:
            yield batch_of("term", term=list(terms), n=list(terms.values()))

    return docs.rows.select("key", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FOUND)


def disclosing(found: DataFrame) -> DataFrame:
    """value, term, kind of span and what the term discloses, for pairs over the limit."""
    docs, close = found.filter("part = 'doc'"), found.filter("part = 'near'")
    places = close.groupBy("value", "term", "place").agg(F.count("*").alias("docs"))
    pairs = places.groupBy("value", "term").agg(F.count("*").alias("support"), F.sum("docs").alias("both"))
    values = pairs.filter("term = ''").select("value", F.col("both").alias("of_value"))
    often = pairs.filter((F.col("term") != "") & (F.col("support") >= SUPPORT))
    terms = found.filter("part = 'term'").groupBy("term").agg(F.sum("n").alias("of_term"))
    totals = docs.agg(F.count("*").alias("all"), *[F.count_if(F.col(f"n_{k}") > 0).alias(k) for k in KINDS])  # one row
    rows = often.join(values, "value").join(terms, "term").crossJoin(F.broadcast(totals))
    kind = F.substring_index("value", ":", 1)
    of_kind = F.coalesce(*[F.when(kind == k, F.col(k)) for k in KINDS])
    told = F.log2(F.col("all") * F.col("both") / (F.col("of_value") * F.col("of_term")))
    whole, anyhow = F.log2(F.col("all") / F.col("of_value")), F.log2(F.col("all") / of_kind)
    over = rows.withColumns({"pmi": told, "share": told / F.when(whole > 0, whole), "anyhow": anyhow}).filter((F.col("pmi") > F.col("anyhow")) & (F.col("share") > LIMIT))
    return over.select("value", "term", F.when(F.col("share") >= REMOVE, TERM_KINDS[1]).otherwise(TERM_KINDS[0]).alias("span"), "pmi", "share")


CLEANED = columns(key="long", doc_id="long", **{f"n_{k}": "long" for k in KINDS}, base_sha256="str", spans="str", n_terms="long", sanitised="str")


def cleaned(docs: Keyed) -> DataFrame:
    """A row a document: its counts, base digest, all spans, and the sanitised text where that differs (else null)."""
    found = written(scanned(docs), "found")
    over = written(disclosing(found).select("value", "term", "span"), "disclosing")
    close = found.filter("part = 'near' and term <> ''").select("key", "value", "term")
    own = close.join(over, ["value", "term"]).groupBy("key").agg(F.collect_set(F.struct("term", "span", F.substring_index("value", ":", 1).alias("kind"))).alias("own"))
    rows = found.filter("part = 'doc'").select("key", "doc_id", *[f"n_{k}" for k in KINDS], "base", "text").join(own, "key", "left")

    def each(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {f.name: [] for f in CLEANED}
        for r in batch.to_pylist():
            base = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r["base"].split(",") if x)]
            more = term_spans(r["text"] or "", base, r["own"] or [])
            spans = [r["base"], *(f"{span}:{s}:{e}" for span, s, e, _ in more)]
            values = (
                r["key"], r["doc_id"], *(r[f"n_{k}"] for k in KINDS), hashlib.sha256(r["base"].encode()).hexdigest(), ",".join(x for x in spans if x), len(more),
                replaced(r["text"], base, more) if base else None,
            )
            for name, value in zip(out, values, strict=True):
                out[name].append(value)
        return out

    return map_batches(rows, CLEANED, each)


def term_spans(text: str, base: list[tuple[str, int, int]], own: list[dict]) -> list[tuple[str, int, int, str]]:
    """(kind of span, start, end, kind of the value) of all places of terms that this document's values forbid, outside of base spans; by kind of span, then start. A term that several values forbid goes by the strictest, then by the first kind."""
    if not own:
        return []
    rule: dict[str, tuple[int, int]] = {}
    for x in own:
        mine = (-TERM_KINDS.index(x["span"]), KINDS.index(x["kind"]))
        rule[x["term"]] = min(mine, rule.get(x["term"], mine))
    taken, found = Taken([(s, e) for _, s, e in base]), []
    for m in WORD.finditer(text):
        if (term := m[0].lower()) in rule and not taken.meets(*m.span()):
            strict, kind = rule[term]
            found.append((TERM_KINDS[-strict], *m.span(), KINDS[kind]))
    return sorted(found, key=lambda x: (TERM_KINDS.index(x[0]), x[1]))


def replaced(text: str, base: list[tuple[str, int, int]], more: list[tuple[str, int, int, str]]) -> str:
    """The text with values as <KIND>, generalised terms as <KIND-RELATED> and removed ones gone. Of values that overlap the first stands for all."""
    marks = sorted([(s, e, f"<{k.upper()}>") for k, s, e in base] + [(s, e, f"<{k.upper()}-RELATED>" if span == TERM_KINDS[0] else "") for span, s, e, k in more])
    out, at = [], 0
    for start, end, mark in marks:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def personal_rows(docs: DataFrame) -> DataFrame:
    """A row a document: doc_id, counts of the base kinds, base_sha256, spans (all), n_terms (those that the method adds)."""
    return cleaned(keyed(docs)).drop("key", "sanitised")


def sanitised(docs: DataFrame) -> DataFrame:
    """docs with sanitised texts; all columns, documents and null texts stay."""
    rows = keyed(docs)
    new = cleaned(rows).filter("sanitised is not null").select("key", "sanitised")
    both = rows.rows.join(new, "key", "left")
    return both.select(*[F.coalesce("sanitised", F.col("_row")[c]).alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])
