"""Every operator on odd rows and on empty tables."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest

from rallyframe.llm import bpe, exact, extract, langid, minhash, packing, planes, quality, suffixes, warc

from .cases import odd_documents, odd_pages

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PER_DOCUMENT = {
    "quality": quality.quality_rows, "suffix": suffixes.suffix_rows, "bpe": lambda d: bpe.bpe_rows(d, WORDS), "exact": exact.exact_rows, "planes": lambda d: planes.plane_rows(d, BYTES),
    "near": minhash.near_rows, "language": langid.language_rows,
}
FILTERS = {"quality": quality.quality_filter, "exact": exact.exact_filter, "near": minhash.near_filter, "suffix": suffixes.suffix_filter}


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_one_row_a_document(spark, name):
    docs = odd_documents(spark)
    assert sorted(str(r.doc_id) for r in PER_DOCUMENT[name](docs).collect()) == sorted(str(r.doc_id) for r in docs.select("doc_id").collect())


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_empty_table(spark, name):
    assert PER_DOCUMENT[name](odd_documents(spark).limit(0)).collect() == []


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_columns(spark, name):
    docs = odd_documents(spark)
    out = FILTERS[name](docs)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    rows = out.collect()
    assert 0 < len(rows) <= docs.count() and all(r["kept"] == "x" and r["_row"] == 7 + 1 for r in rows)
    assert FILTERS[name](docs.limit(0)).collect() == []


def test_exact_groups_of_odd_rows(spark):
    rows = exact.exact_rows(odd_documents(spark)).collect()
    one = [r for r in rows if r.text_sha256 == hashlib.sha256(b"one").hexdigest()]
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in one} == {(7, 7, 2, True), (8, 7, 2, False)}
    empty = [r for r in rows if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert {r.keep_id for r in empty} == {5} and sum(r.kept for r in empty) == 1 and len(empty) == 4
    assert sum(r.kept for r in rows if r.doc_id == 2) == 0 and sum(r.kept for r in rows if r.doc_id == 1) == 1


def test_packing_of_odd_rows(spark):
    rows = packing.packed_rows(odd_documents(spark), BYTES).collect()
    assert sorted({str(r.doc_id) for r in rows}) == sorted({str(r.doc_id) for r in odd_documents(spark).collect()})
    assert [r.length for r in rows if r.doc_id == 3] == [1]
    assert packing.packed_rows(odd_documents(spark).limit(0), BYTES).collect() == []


def test_planes_round_trip(spark, tmp_path):
    docs = odd_documents(spark).filter("doc_id is not null and doc_id <> 2")
    planes.write_planes(docs, BYTES, f"file://{tmp_path}/p", block=100)
    parts = {}
    for r in planes.read_planes(spark, f"file://{tmp_path}/p").collect():
        parts.setdefault(r.doc_id, {})[r.at] = bytes(r.ids)
    from rallyframe.llm.tokens import encoder

    for r in docs.collect():
        want = encoder(BYTES).encode([r.text or ""])[0] + bytes(4)
        assert b"".join(parts[r.doc_id][k] for k in sorted(parts[r.doc_id])) == want
    ids = np.arange(5000, dtype="<u4") * 70001
    assert planes.from_planes(planes.to_planes(ids)) == ids.tobytes()


def test_warc_of_odd_rows(spark, tmp_path):
    pages = odd_pages(spark)
    manifest = warc.write_warc(pages, f"file://{tmp_path}/w", roll_bytes=300)
    assert manifest.count() > 2
    rows = warc.read_warc(spark, f"file://{tmp_path}/w").collect()
    assert len(rows) == pages.count()
    big = [r for r in rows if r.payload_bytes >= 1000]
    assert {(r.page_id, r.record_type, r.refers_to) for r in big} == {(1, "revisit", 3), (2, "revisit", 3), (3, "response", None), (None, "revisit", 3)}
    assert all(r.record_type == "response" for r in rows if r.payload_bytes < 1000)
    texts = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    assert all(bytes(r.payload) == texts[r.page_id] for r in rows if r.record_type == "response")
    first = sorted((p.name, zlib.crc32(p.read_bytes())) for p in (tmp_path / "w/records").glob("*.gz"))
    warc.write_warc(pages, f"file://{tmp_path}/again", roll_bytes=300)
    assert first == sorted((p.name, zlib.crc32(p.read_bytes())) for p in (tmp_path / "again/records").glob("*.gz"))
    assert warc.warc_rows(pages.limit(0)).collect() == []


def test_equal_pages_give_equal_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SHARD_BYTES", 60_000)
    rows = spark.range(4000).selectExpr("id * id % 7919 * 1000003 as page_id", "concat('http://h/', id) as url", "repeat(concat('text ', id % 700), 1 + cast(id % 211 as int)) as html")
    seen = []
    for parts, adaptive in ((1, "true"), (7, "true"), (23, "false"), (4, "false")):
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        warc.write_warc(rows.repartition(parts, "html"), f"file://{tmp_path}/{parts}", roll_bytes=4_000)
        seen.append(sorted((p.name, zlib.crc32(p.read_bytes())) for p in (tmp_path / str(parts) / "records").glob("*.gz")))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len({name.split("-")[1] for name, _ in seen[0]}) > 10 and len(seen[0]) > 30 and all(x == seen[0] for x in seen)
    ids = [r.page_id for r in warc.read_warc(spark, f"file://{tmp_path}/23").collect()]
    assert sorted(ids) == sorted(r.page_id for r in rows.collect())


def test_extraction_of_odd_rows(spark):
    rows = {r.page_id: r for r in extract.extracted(odd_pages(spark)).collect()}
    assert rows[1].text.startswith("T words in a row") and rows[1].n_chars == len(rows[1].text)
    assert rows[4].text == rows[5].text == ""
    assert extract.extracted(odd_pages(spark).limit(0)).collect() == []


def test_language_of_odd_rows(spark):
    rows = langid.language_rows(odd_documents(spark)).collect()
    by = {r.doc_id: r for r in rows}
    assert by[3].lang_pred == by[4].lang_pred == by[5].lang_pred == by[12].lang_pred == "und" and by[9].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in rows)
