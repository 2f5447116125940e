"""Collocations, the filter audit and near-duplicate vectors against brute force."""

import itertools
import math
import random
import re
from collections import Counter

import cases
import duckdb
import numpy as np
import pyarrow as pa
import pytest

from originline.llm import collocations, embedding_dedup, filter_audit, jobs

SMALL = "/root/testdata/sf0.01"
_LOWER = {i: i + 32 for i in range(65, 91)}


def views(connection, folder):
    for name in ("documents", "labels", "embeddings"):
        connection.sql(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name, sql", [
    ("op11_collocations", collocations.ORACLE_SQL), ("op12_filter_audit", filter_audit.ORACLE_SQL),
    ("op13_embedding_dedup", embedding_dedup.ORACLE_SQL)])
def test_query_equals_its_sql(spark, name, sql):
    want = views(duckdb.connect(), SMALL).sql(sql)
    got = jobs.QUERIES[name](spark, SMALL).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


# ------------------------------------------------------------- collocations


def phrase_counts(rows, longest=5):
    counts = {}
    for lang, text in rows:
        own = counts.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(_LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            for m in range(1, longest + 1):
                own.update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    return counts


def brute_collocations(rows, least, top):
    out = []
    for lang, counts in phrase_counts(rows).items():
        n = sum(c for p, c in counts.items() if len(p) == 1)
        often = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        gone = {q[i : i + s] for q, f in often.items() for s in range(2, len(q)) for i in range(len(q) - s + 1) if f >= counts[q[i : i + s]]}
        found = []
        for p, a in often.items():
            if p not in gone:
                score, _, left, right = min(
                    (1000 * a * n // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def made_up_texts(n, seed):
    rng = random.Random(seed)
    words = ["a", "B", "ab", "é", "ß!", "x.y", "über", "naïve", "c", "D,", "e\n", "f\x0bg", "h\x85i", "--", "I\tj", "the", "the", "the"]
    return [(rng.choice(["en", "de", None]), rng.choice([" ", "  ", "\t"]).join(rng.choices(words, k=rng.randint(0, 60)))) for _ in range(n)]


def test_collocations_by_brute_force(spark, monkeypatch):
    rows = [*made_up_texts(300, 3), (None, None), ("en", ""), ("en", "to be or not to be " * 4000), ("fr", "q" * 3_000_000), ("en", "to be or not to be")]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string").repartition(4)
    for least, top in ((2, 50), (20, 2000)):
        got = collocations.collocations(docs, least=least, top=top)
        assert sorted(map(tuple, got.select(*COLUMNS).collect())) == brute_collocations(rows, least, top)


@pytest.mark.parametrize("chunk", [7, 64, 1 << 20])
def test_stretches_see_every_phrase_once(chunk):
    texts = [t for _, t in made_up_texts(40, 9)]
    data = np.frombuffer("".join(t.translate(_LOWER) for t in texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.translate(_LOWER).encode()) for t in texts])])
    for m in range(1, 6):
        seen = Counter()
        for words in collocations.word_stretches(data, offsets, m - 1, chunk):
            for i in range(max(words.carried - m + 1, 0), len(words) - m + 1):
                if words.pieces[i] == words.pieces[i + m - 1]:
                    seen[tuple(data[words.starts[k] : words.ends[k]].tobytes().decode() for k in range(i, i + m))] += 1
        want = phrase_counts([("x", t) for t in texts])["x"]
        assert seen == Counter({p: c for p, c in want.items() if len(p) == m})


def test_trie_bursts_and_spills_whole_subtrees():
    rng = np.random.default_rng(5)
    trie, want = collocations.HatTrie(3, burst=20), Counter()
    for _ in range(30):
        paths = np.unique(rng.integers(0, [2, 40, 9, 9], (200, 4)), axis=0).astype(np.int32)
        keys = (paths.astype(np.uint64) * np.array([1, 64, 4096, 65536], np.uint64)).sum(axis=1) << np.uint64(20)
        counts = rng.integers(1, 5, len(paths))
        want.update({tuple(p): c for p, c in zip(paths.tolist(), counts.tolist(), strict=True)})
        trie.add(keys, counts, paths)
    assert any(isinstance(c, collocations.Branch) for b in trie.root.children.values() for c in b.children.values())
    had, got = trie.size, Counter()
    left = []
    for part in (trie.spill(had // 2), trie.spill(0)):
        for paths, counts in part:
            assert len({(p[0], p[1] % 16) for p in paths.tolist()}) == 1  # one subtree
            got.update({tuple(p): c for p, c in zip(paths.tolist(), counts.tolist(), strict=True)})
        left.append(trie.size)
    assert got == want and 0 < left[0] <= had // 2 and left[1] == 0 and had == len(want)


def test_collocations_with_a_small_room(spark):
    rows = made_up_texts(200, 4)
    docs = spark.createDataFrame(rows, "lang string, text string")
    small, large = (sorted(map(tuple, collocations.counted(docs, 1, None, room).collect())) for room in (10, 10**6))
    assert small == large == sorted(
        (lang, p[0], c) for lang, counts in phrase_counts(rows).items() for p, c in counts.items() if len(p) == 1)


def test_collocation_edges(spark):
    docs = cases.table(spark)
    rows = [(r[2], r[1]) for r in cases.ROWS]
    got = collocations.collocations(docs, least=2)
    assert sorted(map(tuple, got.select(*COLUMNS).collect())) == brute_collocations(rows, 2, 2000)
    assert collocations.collocations(cases.empty(spark)).count() == 0
    assert collocations.collocations(docs.drop("lang"), least=2).select("lang").distinct().collect() == [("und",)]


def test_scores_beyond_64_bits(spark):
    # 1000 * a * n passes 2^63 for counts as these; the column expression must stay exact.
    a, n, l, r = 10**11, 10**14 + 7, 10**11 + 3, 10**11 + 9
    row = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long").selectExpr(
        "(cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(n as decimal(15,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))").first()
    assert row[0] == 1000 * a * n // (l * r)


# ------------------------------------------------------------- filter audit


def mask_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    caps = sum("A" <= c <= "Z" for c in text)
    return ((len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * caps > 2 * len(text)) << 2
            | bool(re.search(r"[#$%&*|]", text)) << 3)


def brute_audit(rows, labels):
    """rows: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    docs = []
    for doc_id, text, source in rows:
        text = text or ""
        repeat = doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in rows)
        docs.append((source or "", mask_of(text) | repeat << 4, doc_id in good, doc_id in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        own, shapley = [d for d in docs if d[0] == part], Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                here, left = [d for d in left if d[1] & bit], [d for d in left if not d[1] & bit]
                failing = [d for d in own if d[1] & bit]
                shapley[letter] += len(here)
                out[part, "".join(order), step] = [
                    len(left), len(here), len(failing) - len(here), sum(d[1] == bit for d in own),
                    sum(d[2] for d in here), sum(d[3] for d in here), letter]
        for key in out:
            if key[0] == part:
                out[key][-1] = shapley[out[key][-1]]
    return sorted((*k, *v) for k, v in out.items())


REPORT = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@pytest.mark.parametrize("files, batches", [(1, 1), (6, 6), (6, 2)])
def test_audit_by_brute_force(spark, tmp_path, files, batches):
    """Ids fall from file to file, so nearly every batch retracts."""
    rng = random.Random(files)
    texts = ["", None, "Short TEXT", "a | b", " ".join(f"w{i}" for i in range(250)), "the " * 300, "W" + " x#y" * 220, "É" * 50]
    rows = [(rng.choice([None, *range(1000)]), rng.choice(texts), rng.choice(["p", "q", None, ""])) for _ in range(90)]
    rows += [(7, "the " * 300, "p"), (7, "the " * 300, "p"), (7, "the " * 300, "q"), (-5, "Short TEXT", "r")]
    labels = [(i, i % 2, i % 3) for i in range(0, 900, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1), (8, None, 1)]
    folder = tmp_path / "documents.parquet"
    folder.mkdir()
    ordered = sorted(rows, key=lambda r: -(r[0] if r[0] is not None else 500))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("source", pa.string()), ("n", pa.int64())])
    import pyarrow.parquet as pq
    step = math.ceil(len(rows) / files)
    for k in range(files):
        part = ordered[k * step : (k + 1) * step]
        pq.write_table(pa.table([list(c) for c in zip(*[(*r, 1) for r in part], strict=True)], schema=schema), folder / f"part-{k:03d}.parquet")
        import os
        os.utime(folder / f"part-{k:03d}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(spark, str(folder), marks, batches)
    assert sorted(map(tuple, got.select(*REPORT).collect())) == brute_audit(rows, labels)


def test_a_batch_that_runs_again_changes_nothing(spark):
    first, second = ([(d, t, "p") for d, t in b] for b in ([(5, "x"), (6, "x"), (9, "y")], [(2, "x"), (9, "z"), (3, "y")]))
    run = filter_audit.Audit(spark, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    for number, rows in ((0, first), (1, second), (1, second)):
        run.absorb(spark.createDataFrame(rows, "doc_id long, text string, source string"), number)
    got = filter_audit.interactions(run.counters(spark, 2)).select(*REPORT).collect()
    assert sorted(map(tuple, got)) == brute_audit(first + second, [])


def test_audit_edges(spark, tmp_path):
    docs, empty = cases.table(spark), cases.empty(spark)
    for frame, name in ((docs, "a.parquet"), (empty, "b.parquet")):
        frame.write.parquet(str(tmp_path / name))
    none = spark.createDataFrame([], "doc_id long, other string")
    got = filter_audit.audit(spark, str(tmp_path / "a.parquet"), none).select(*REPORT).collect()
    assert sorted(map(tuple, got)) == brute_audit([(r[0], r[1], r[3]) for r in cases.ROWS], [])
    assert filter_audit.audit(spark, str(tmp_path / "b.parquet"), none).count() == 0


# ------------------------------------------------------- near-duplicate vectors


def brute_links(rows, least=0.95):
    """(id, n_links, component, kept) by all pairs; rows are (id, vector)."""
    unit = []
    for _, v in rows:
        fine = v and all(c is not None and math.isfinite(c) for c in v) and any(v)
        x = np.array(v, float) if fine else None
        unit.append(None if x is None else (x / np.abs(x).max()) / np.linalg.norm(x / np.abs(x).max()))
    head, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
            links[i] += 1
            links[j] += 1
            head[find(i)] = find(j)
    least_id = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least_id[find(i)] = min(least_id.get(find(i), name), name)
    return sorted(((r[0], n, least_id.get(find(i)), r[0] is not None and least_id.get(find(i)) == r[0])
                   for i, (r, n) in enumerate(zip(rows, links, strict=True))), key=repr)


def near_copies(n, groups, size, spread, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, size))
    for k in range(groups):
        at = rng.integers(0, n, n // (4 * groups))
        x[at] = x[at[0]] + rng.normal(size=(len(at), size)) * spread[k % len(spread)]
    return x.astype(np.float32)


VECTORS = ("vec_id", "n_links", "component_id", "kept")


def links_of(frame):
    return sorted(map(tuple, frame.select(*VECTORS).collect()), key=repr)


def test_links_by_brute_force(spark):
    x = near_copies(1500, 6, 24, (0.0, 0.05, 0.15), 1)
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = {r[0]: r for r in links_of(embedding_dedup.near_duplicates(frame))}
    want = {r[0]: r for r in brute_links(rows)}
    assert all(got[i][1] <= want[i][1] for i in want)  # none below the threshold
    found, total = sum(r[1] for r in got.values()), sum(r[1] for r in want.values())
    assert total > 5000 and found >= 0.98 * total


def test_hot_cells_in_blocks_find_the_same(spark, monkeypatch):
    x = near_copies(400, 1, 16, (0.05,), 2)
    rows = [(i % 350, v) for i, v in enumerate(x.tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    assert links_of(embedding_dedup.near_duplicates(frame, target=1.0)) == brute_links(rows)


def test_multi_sequence_order():
    rng = np.random.default_rng(3)
    a, b = rng.random(7), rng.random(9)
    cells = list(embedding_dedup.nearest_cells(a, b, 0.8))
    sums = sorted((a[i] + b[j], i, j) for i in range(7) for j in range(9) if a[i] + b[j] <= a.min() + b.min() + 0.8)
    assert cells == [(i, j) for _, i, j in sums]
    assert len(list(embedding_dedup.nearest_cells(a, b, 9.0))) == 63


def test_reach_holds_the_target():
    x = near_copies(4000, 1, 32, (0.0,), 4).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    low, high = (embedding_dedup.fit(x, 8, 0.95, t).reach for t in (0.5, 0.99))
    assert 0 < low < high


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (3, [0.0, -0.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0, None]), (7, [nan, 1.0]),
            (8, [inf, 1.0]), (None, [1.0, 1e-9]), (9, [1e200, 0.0]), (10, [1e-200, 0.0]), (11, []), (12, [1.0]), (13, [-3.0]), (14, [2.0]),
            (15, [1.0, 0.0, 0.0]), (16, [-1.0, 0.0])]
    frame = spark.createDataFrame([(*r, 1, "x", True) for r in rows], "vec_id long, embedding array<double>, node int, n_links string, kept boolean")
    got = embedding_dedup.near_duplicates(frame, keep=("node", "n_links"), target=1.0)
    assert got.columns == ["vec_id", "node", "n_links", "component_id", "kept"]
    assert links_of(got) == brute_links(rows)
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0


# -------------------------------------------------------------------- pages

FIRST, SECOND = ("The first paragraph of the article is long enough to be read as text, with commas and words.",
                 "The second one goes on about the same matter and is as long, if not a little longer than that.")
BODY = f"<article><p>{FIRST}</p><p>{SECOND}</p></article>"
BOTH = f"{FIRST}\n\n{SECOND}"


@pytest.mark.parametrize("html, want", [
    (f"<head><title>x</title><body>{BODY}</body>", BOTH),  # no </head>
    (f"<body><article><p>{FIRST}<p class=\"ad\">Buy now<p>{SECOND}</article></body>", BOTH),
    (f"<body><ul><li class=\"menu\">Home<li class=\"menu\">About</ul>{BODY}</body>", BOTH),
    (f"<body><div><nav><ul><li>Home<li>About</div>{BODY}</body>", BOTH),  # </nav> is missing
    (f"<body><form action=\"/x\"><input name=a>{BODY}<button>Go</button></form></body>", BOTH),
    (f"<body><div class=\"page sidebar-right\">{BODY}<div class=\"sidebar\"><p>Other things to read on this site today</p></div></div></body>", BOTH),
    (f"<body><article><p>{FIRST}</p><![foo bar><p>{SECOND}</p></article></body>", BOTH),
    (f"<body><form><p>{FIRST}</p><p>{SECOND}</p><label>Name</label></form></body>", BOTH),  # no article element
    (f"<body>{BODY}<section class=\"comments\"><article class=\"comment\"><p>I read this twice and must say that I agree.</p></article></section></body>", BOTH),
    (f"<body><div class=\"content\"><p>{FIRST}</p><p>{SECOND}</p></div><div class=\"comments\">" + "<p>A reader says a good many things at length here.</p>" * 20 + "</div></body>", BOTH),
    (f"<body><div id=\"main-search\">{BODY}</div><aside>Ad</aside><footer>Imprint</footer></body>", BOTH),
    ("<body><nav><a href=x>Only a menu</a></nav></body>", ""),
])
def test_pages_with_omitted_tags_and_wrappers(html, want):
    from originline.llm import pages

    assert pages.main_text(html) == want


# ----------------------------------------------------------------- licenses


def test_alike_licenses_are_told_apart(spark):
    from originline.llm import licenses

    text = {}
    for name, words in licenses.TEMPLATES:
        text[name] = max(text.get(name, ""), words, key=len)
    rows, filler = [], "lorem ipsum dolor sit amet " * 60
    asked = ["BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MIT", "BSL-1.0", "ISC", "Zlib", "Unlicense"]
    for i, name in enumerate(asked):
        rows.append((i, filler + text[name] + " " + filler, None, None, None))
    rows.append((50, text["GPL-3.0"] + " " + filler * 5 + text["LGPL-3.0"], None, None, None))  # both, far apart
    rows.append((51, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                     "conditions are met: anything goes", None, None, None))
    found = {}
    for r in licenses.scan(cases.table(spark, rows)).collect():
        found.setdefault(r["doc_id"], set()).add(r["license"])
    assert {asked[i]: found[i] for i in range(len(asked))} == {name: {name} for name in asked}
    assert found[50] == {"GPL-3.0", "LGPL-3.0"} and found[51] == {"BSD"}
