"""Operators over the whole table: mixing, sharding, fingerprints, licenses."""

import hashlib
import random
import re
import zlib

import cases
import duckdb
import pytest

from originline.llm import fingerprint, jobs, licenses, mixing, shards

SMALL = "/root/testdata/sf0.01"


def test_mixing_equals_its_sql(spark):
    want = duckdb.connect()
    want.sql(f"create view documents as select * from '{SMALL}/documents.parquet'")
    rows = sorted(want.sql(mixing.ORACLE_SQL).fetchall())
    got = sorted(tuple(r) for r in jobs.QUERIES["op5_mixing"](spark, SMALL).collect())
    assert got == rows


def water(sizes, weights, cap):
    """Targets by the plain loop."""
    full, total = set(), sum(sizes)
    while True:
        free = [i for i in range(len(sizes)) if i not in full]
        if not free:
            return [cap * s for s in sizes]
        level = (total - sum(cap * sizes[i] for i in full)) / sum(weights[i] for i in free)
        above = {i for i in free if weights[i] * level > cap * sizes[i]}
        if not above:
            return [cap * s if i in full else weights[i] * level for i, s in enumerate(sizes)]
        full |= above


@pytest.mark.parametrize("sizes", [[1, 100, 1000], [0, 5, 5], [10, 1, 1, 1, 500], [7]])
def test_water_filling(spark, sizes):
    weights = [(5.0, 2.0, 1.0)[i % 3] for i in range(len(sizes))]
    df = spark.createDataFrame(list(zip(range(len(sizes)), sizes, weights, strict=True)), "source int, source_size long, weight double")
    got = [r["target"] for r in mixing.water_fill(df, 3.0).orderBy("source").collect()]
    assert got == pytest.approx(water(sizes, weights, 3.0))


def test_mixing_edges(spark):
    docs = cases.table(spark)
    out = mixing.mix(docs).toPandas()
    assert len(out) == len(cases.ROWS)
    words = {1: 18, 2: 0, 3: 0, 4: 0, 5: 4, 9: 2}
    for doc_id, n in words.items():
        assert out[out.doc_id == doc_id]["size"].iloc[0] == n
    assert (out.taken <= 3 * out["size"]).all()
    assert mixing.mixed_rows(docs).columns == docs.columns
    assert mixing.mixed_rows(docs).count() == out.copies.sum()
    assert mixing.mix(cases.empty(spark)).count() == 0
    assert mixing.mixed_rows(cases.empty(spark)).count() == 0


def check_shards(out, rows, n=40):
    assert len(out) == rows
    for _, part in out.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert out.shard.between(0, n - 1).all() and (out.law == "bytes").all() and out.grown_shard.isna().all()


def test_shards_are_even_and_whole(spark):
    out = jobs.QUERIES["op3_shards"](spark, "/root/testdata/sf0.1").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").toPandas()
    check_shards(out, len(docs))
    sizes = out.groupby("shard")["size"].sum()
    assert len(sizes) == 40 and sizes.max() / sizes.mean() < 1.06 and sizes.min() / sizes.mean() > 0.94
    both = out.merge(docs[["doc_id", "text"]], on="doc_id")
    assert (both["size"] == both.text.map(lambda t: len(t.encode()) + 16)).all()
    assert (both.text_crc32 == both.text.map(lambda t: zlib.crc32(t.encode()))).all()
    assert both.groupby("text").shard.nunique().max() == 1


def test_a_group_of_copies_beyond_a_shard_is_cut(spark):
    rows = [(i, "the same text for all of these rows", None, None, None) for i in range(3000)]
    rows += [(i, f"another text number {i}", None, None, None) for i in range(3000, 6000)]
    out = shards.assign_shards(cases.table(spark, rows), shards=8).toPandas()
    check_shards(out, 6000, 8)
    sizes = out.groupby("shard")["size"].sum()
    assert sizes.max() / sizes.mean() < 1.1


def test_repeated_rows_beyond_a_shard_are_cut(spark):
    rows = [(7, "the same text for all of these rows", None, None, None)] * 3000
    rows += [(i, f"another text number {i}", None, None, None) for i in range(3000, 6000)]
    out = shards.assign_shards(cases.table(spark, rows), shards=8)
    assert out.columns == shards.assign_shards(cases.table(spark), shards=8).columns
    out = out.toPandas()
    check_shards(out, 6000, 8)
    sizes = out.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() / sizes.mean() < 1.1


def test_overfull_ranges_are_cut_until_none_is(spark, monkeypatch):
    """Even a sample that never gives a new bound leads to even shards."""
    whole = shards._sample
    monkeypatch.setattr(shards, "_sample", lambda rows, n, total, mean, again: whole(rows, n, total, mean, again)[:0])
    rows = [(i, f"text number {i}", None, None, None) for i in range(2000)]
    out = shards.assign_shards(cases.table(spark, rows), shards=4, per_shard=16).toPandas()
    check_shards(out, 2000, 4)
    sizes = out.groupby("shard")["size"].sum()
    assert len(sizes) == 4 and sizes.max() / sizes.mean() < 1.3


def test_shard_edges(spark):
    docs = cases.table(spark)
    out = shards.assign_shards(docs, shards=4)
    check_shards(out.toPandas(), len(cases.ROWS), 4)
    assert out.toPandas().set_index("doc_id")["size"].loc[2] == 16
    assert shards.assign_shards(cases.empty(spark)).count() == 0


def test_fingerprints_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").toPandas()
    out = jobs.QUERIES["op6_fingerprints"](spark, SMALL).toPandas().sort_values("doc_id").reset_index(drop=True)
    texts = docs.text.fillna("").tolist()
    for i in range(0, len(texts), 9):
        k = len(texts[i]) // 4
        new = texts[i][: len(texts[i]) - k] + texts[(i + 1) % len(texts)][:k]
        value = fingerprint.vector(fingerprint.paragraphs(new))
        assert out.n_chars[i] == len(texts[i])
        assert out.edited_sha256[i] == hashlib.sha256(new.encode()).hexdigest()
        assert out.edited_fingerprint[i] == fingerprint.text_of(value)
    assert out.near_edited.mean() > 0.5 and out.near_next.mean() < 0.1
    same = out.assign(text=texts).groupby("text").fingerprint.nunique()
    assert same.max() == 1


def test_fingerprint_is_a_sum():
    pieces = [f"paragraph {i}" for i in range(50)]
    whole = fingerprint.vector(pieces)
    mixed = pieces[:]
    random.Random(1).shuffle(mixed)
    assert fingerprint.text_of(fingerprint.vector(mixed)) == fingerprint.text_of(whole)
    less = fingerprint.add(whole, fingerprint.vector(pieces[:10]), -1)
    assert fingerprint.text_of(less) == fingerprint.text_of(fingerprint.vector(pieces[10:]))
    assert fingerprint.likeness(whole, whole) == 1.0
    assert fingerprint.likeness(whole, less) > fingerprint.likeness(whole, fingerprint.vector([f"x{i}" for i in range(50)]))


@pytest.mark.parametrize("text,following", [("a.b!?", "c"), ("one. two! three? four", "x.y"), ("....!", "...."), ("abc", ""), ("", "z")])
def test_edited_vector_needs_only_the_tail(text, following):
    new, cut = fingerprint.edited(text, following)
    own = fingerprint.vector(fingerprint.paragraphs(text))
    got = fingerprint.edited_vector(own, text, new, cut)
    assert fingerprint.text_of(got) == fingerprint.text_of(fingerprint.vector(fingerprint.paragraphs(new)))


def test_fingerprint_edges(spark):
    out = fingerprint.fingerprints(cases.table(spark)).toPandas()
    assert len(out) == len(cases.ROWS)
    by = out.set_index("doc_id")
    assert by.loc[1].fingerprint == by.loc[6].fingerprint.iloc[0]
    assert by.loc[2].n_chars == 0 and by.loc[7].n_chars == len(cases.LONG)
    # The null id is last; its next is the first row.
    last = "A text without any id stands here alone"
    k = len(last) // 4
    want = hashlib.sha256((last[: len(last) - k] + cases.PLAIN[:k]).encode()).hexdigest()
    assert out[out.doc_id.isna()].edited_sha256.iloc[0] == want
    assert fingerprint.fingerprints(cases.empty(spark)).count() == 0
    alone = fingerprint.fingerprints(cases.table(spark, [cases.ROWS[0]])).toPandas()
    assert alone.near_next[0] == 1.0


def contained(text, least=0.8):
    """(license, containment) of a text by trying every window of every template."""
    words, found = licenses.words_of(text or ""), {}
    for name, template in licenses.TEMPLATES:
        w = licenses.words_of(template)
        want = set(licenses.shingles_of(w))
        if f" {' '.join(w)} " in f" {' '.join(words)} ":
            found[name] = 1.0
        for start in range(max(1, len(words) - len(w) + 1)):
            own = set(licenses.shingles_of(words[start : start + len(w)])) if len(words) >= len(w) else set()
            share = len(own & want) / len(want)
            if share >= least:
                found[name] = max(found.get(name, 0), share)
    return found


def test_licenses_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {(r["doc_id"], r["license"]): r["containment"] for r in jobs.QUERIES["op4_licenses"](spark, SMALL).collect()}
    want = {(r["doc_id"], name): share for r in docs.collect() for name, share in contained(r["text"]).items()}
    assert set(got) == set(want) and all(got[k] >= want[k] for k in want)


def test_licenses_of_edited_templates(spark):
    rows, filler = [], "lorem ipsum dolor sit amet " * 40
    for i, (name, text) in enumerate(licenses.TEMPLATES):
        rows.append((i, f"{filler}\n{text.upper()}\n{filler}", None, None, None))
        words = re.split(r"\s+", text)
        if len(words) > 25:  # one word put in between costs few of many shingles
            rows.append((100 + i, filler + " ".join([*words[:3], "indeed", *words[3:]]) + filler, None, None, None))
    rows += [(500, "the license of software is reserved for modification", None, None, None), (501, filler, None, None, None)]
    out = licenses.scan(cases.table(spark, rows)).collect()
    found = {(r["doc_id"], r["license"]) for r in out}
    for doc_id, *_ in rows[:-2]:
        assert (doc_id, licenses.TEMPLATES[doc_id % 100][0]) in found
    assert not {d for d, _ in found} & {500, 501}


def test_license_edges(spark):
    rows = [*cases.ROWS, (20, "All rights reserved.", None, None, None), (20, "All rights reserved.", None, None, None)]
    out = [tuple(r) for r in licenses.scan(cases.table(spark, rows)).select("doc_id", "license", "containment").collect()]
    assert out == [(20, "all-rights-reserved", 1.0)]
    assert licenses.scan(cases.empty(spark)).count() == 0


def test_license_scan_has_no_python(spark):
    import contextlib
    import io

    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        licenses.scan(spark.read.parquet(f"{SMALL}/documents.parquet")).explain("formatted")
    assert not re.search("Python|Pandas|Arrow", text.getvalue())
