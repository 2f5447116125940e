"""Decontamination, the n-gram Jaccard join, and the pipeline."""

import math
import random
import re
from collections import Counter

import cases
import numpy as np
import pytest

import corpus_pipeline
from originline.llm import components, decontaminate, jobs, ngram_join

SF = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    words = _WORD.findall((text or "").translate(_LOWER))
    width = min(5, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if words else frozenset()


def brute_components(rows):
    """Least id of each row's component, by index; rows are (id, text)."""
    sets, head = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    index = {}
    for i, own in enumerate(sets):
        shared = Counter(j for s in own for j in index.get(s, ()))
        for j, k in shared.items():
            if 100 * k >= 80 * (len(own) + len(sets[j]) - k):
                head[find(i)] = find(j)
        for s in own:
            index.setdefault(s, []).append(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [least.get(find(i)) for i in range(len(rows))], [len(s) for s in sets]


def compare(spark, rows):
    df = cases.table(spark, [(i, t, None, None, None) for i, t in rows])
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.link_components(df).collect())
    least, size = brute_components(rows)
    assert got == Counter(zip((i for i, _ in rows), size, least, strict=True))


def test_join_equals_brute_force_on_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r["doc_id"]: r["component_id"] for r in jobs.QUERIES["op7_ngram_join"](spark, SMALL).collect()}
    least, _ = brute_components(rows)
    assert got == {i: c for (i, _), c in zip(rows, least, strict=True)}


def test_join_of_near_copies_and_shared_passages(spark):
    """Edits around the threshold, chains, and a passage common to many."""
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(40)]
    rows, base = [], [[word() for _ in range(rng.randrange(6, 120))] for _ in range(25)]
    for words in base:
        for _ in range(8):
            own = words[:]
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows), " ".join(own)))
    for _ in range(60):
        rows.append((len(rows), " ".join([word() for _ in range(rng.randrange(1, 90))] + passage)))
    chain = [word() for _ in range(100)]
    for _ in range(12):
        chain = [*chain[4:], *[word() for _ in range(4)]]
        rows.append((len(rows), " ".join(chain)))
    rng.shuffle(rows)
    compare(spark, rows)


def test_join_edges(spark):
    rows = [(r[0], r[1]) for r in cases.ROWS]
    rows += [(20, "two  Words"), (21, "Two"), (22, "a b c d e"), (23, "A B C D E"), (23, "another text under one id for two rows"), (24, "two words two")]
    compare(spark, rows)
    assert ngram_join.link_components(cases.empty(spark)).count() == 0
    docs = cases.table(spark)
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.select("doc_id").collect())
    assert ids == Counter([1, 2, 3, 4, 5, None, 7, 8, 9])


def test_bounds():
    for a in range(1, 60):
        for b in range(1, 60):
            least = ngram_join.needed(a, b)
            assert least == min(k for k in range(a + b + 1) if 100 * k >= 80 * (a + b - k))
            if 5 * b >= 4 * a and 5 * a >= 4 * b:
                assert a - ngram_join.prefix_length(a) + 1 <= least


def test_trie_walk_equals_set_overlap():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 60, 300, dtype=np.uint64)
    sets = []
    for _ in range(80):
        n = int(rng.integers(1, 300))
        sets.append(np.unique(np.concatenate([rng.choice(base, n), rng.integers(0, 1 << 60, int(rng.integers(0, 20)), dtype=np.uint64)])))
    sets += sets[:3]
    for probe in sets[:20]:
        got = set(ngram_join.descend(probe, sets, ngram_join.lexicographic(sets)))
        want = {i for i, s in enumerate(sets) if len(np.intersect1d(probe, s)) >= ngram_join.needed(len(probe), len(s))}
        assert got == want


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    rng.shuffle(edges)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    head = {}

    def find(i):
        while head.setdefault(i, i) != i:
            i = head[i]
        return i

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            head[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in head}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def brute_contaminated(docs, items, least=0.8):
    def words(text):
        return (text or "").lower().split()

    def of(w):
        k = min(5, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    sets = {i: of(words(t)) for i, t in items}
    df = Counter(s for own in sets.values() for s in own)
    weight = lambda s: 1 / (1 + math.log(df[s])) if s in df else 1.0
    found = set()
    for doc_id, text in docs:
        w = words(text)
        for item, t in items:
            n = len(words(t))
            if not n:
                continue
            for start in range(len(w) - n + 1):
                own = of(w[start : start + n])
                if own & sets[item] and sum(map(weight, own & sets[item])) / sum(map(weight, own | sets[item])) >= least - 1e-12:
                    found.add((doc_id, item))
                    break
    return found


def test_decontamination_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in jobs.QUERIES["op2_decontamination"](spark, SF).collect()}
    assert got == brute_contaminated(docs, items) and got


def test_decontamination_of_edited_items(spark):
    rng = random.Random(11)
    items = [(i, " ".join(f"q{rng.randrange(900)}" for _ in range(rng.randrange(1, 90)))) for i in range(30)]
    docs = []
    for i, text in items:
        words = text.split()
        for edits in range(3):
            own = words[:]
            for _ in range(edits):
                own[rng.randrange(len(own))] = "changed"
            docs.append((len(docs), " ".join(["before"] * 7 + own + ["after"] * 5).upper()))
    docs.append((len(docs), "nothing of the kind"))
    rows = cases.table(spark, [(i, t, None, None, None) for i, t in docs])
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_contaminated(docs, items)
    for words in (1_000_000, 400):  # one block of items, and several
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(rows, bench, block_words=words).collect()}
        assert got == want
        kept = {r["doc_id"] for r in decontaminate.clean_rows(rows, bench, block_words=words).collect()}
        assert kept == {i for i, _ in docs} - {d for d, _ in want}


def test_decontamination_edges(spark):
    docs = cases.table(spark)
    bench = spark.createDataFrame([(1, None), (2, ""), (3, cases.PLAIN), (3, cases.PLAIN), (None, "x y"), (4, "two words")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect())
    assert got == [(1, 3), (6, 3), (6, 3), (9, 4)]
    assert decontaminate.contaminated(cases.empty(spark), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.clean_rows(docs, bench.limit(0)).count() == len(cases.ROWS)
    assert decontaminate.clean_rows(docs, bench).columns == docs.columns


@pytest.mark.parametrize("radius", [0, 9, 40])
def test_index_finds_all_within_the_radius(radius):
    rng = np.random.default_rng(radius)
    texts = [" ".join(f"t{rng.integers(60)}" for _ in range(12)) for _ in range(80)]
    index = decontaminate.build_index(list(range(80)), texts, radius)
    flips = rng.integers(0, 50, 200)
    prints = []
    for k in range(200):
        bits = np.unpackbits(index.prints[k % 80]).copy()
        bits[rng.choice(128, flips[k], replace=False)] ^= 1
        prints.append(np.packbits(bits))
    prints = np.array(prints)
    window, item = index.near(prints, 12)
    want = {(w, i) for w in range(200) for i in range(80) if np.unpackbits(prints[w] ^ index.prints[i]).sum() <= radius}
    assert set(zip(window.tolist(), item.tolist(), strict=True)) == want


def test_pipeline_stages(spark):
    docs, steps = spark.read.parquet(f"{SF}/documents.parquet"), {}
    frame = docs
    for name, function in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]
        frame = corpus_pipeline.stage(function(spark, frame, SF), name)
        steps[name] = (before, frame.toPandas())
        if name != "sharding":
            assert frame.columns == docs.columns
    before, after = steps["near_duplicates"]
    least, _ = brute_components(before)
    assert set(after.doc_id) == {i for (i, t), c in zip(before, least, strict=True) if i == c}
    before, after = steps["decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(after.doc_id) == {i for i, _ in before} - {d for d, _ in brute_contaminated(before, items)}
    before, after = steps["sharding"]
    assert len(after) == len(before) and after.shard.max() < 40
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().drop_duplicates("doc_id").set_index("doc_id").quality
    kept = steps["quality"][1].doc_id
    assert labels.reindex(kept).dropna().mean() > 0.97


def test_pipeline_edges(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (cases.table(spark), cases.empty(spark)):
        docs = rows.select("doc_id", "text", "lang", "source", "n_chars")
        for name, function in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stage(function(spark, docs, str(tmp_path)), name)
        assert set(docs.columns) >= {"doc_id", "text", "shard", "slot"}


def test_the_row_that_stays_does_not_depend_on_the_order(spark):
    """Rows equal in doc_id and text but not in source: reruns keep the same one."""
    rows = [(1, cases.PLAIN, "en", f"s{i}", 80) for i in range(40)] + [(2, cases.PLAIN + " today", "en", "t", 86)]
    kept = {tuple(r["source"] for r in ngram_join.one_of_each(cases.table(spark, part).repartition(n)).collect())
            for part, n in ((rows, 3), (rows[::-1], 7))}
    assert len(kept) == 1 and len(kept.pop()) == 1


def test_documents_shorter_than_an_item(spark):
    """An item less its first or last words is compared as a whole."""
    items = [(1, " ".join(f"a{i}" for i in range(59))), (2, " ".join(f"b{i}" for i in range(15))), (3, "c0 c1 c2 c3 c4")]
    cut = lambda k, low, high: " ".join(items[k][1].split()[low:high])
    docs = [(0, cut(0, 0, 58)), (1, cut(0, 1, 59)), (2, cut(1, 0, 14)), (3, cut(1, 3, 14)), (4, cut(0, 0, 40)), (5, cut(2, 0, 4))]
    rows = cases.table(spark, [(i, t, None, None, None) for i, t in docs])
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(rows, bench).collect()}
    want = {(i, k) for i, t in docs for k, own in items if len(t.split()) < len(own.split())
            for a, b in [({tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (t.split(), own.split()))]
            if len(a & b) >= 0.8 * len(a | b)}
    assert set(out) == want == {(0, 1), (1, 1), (2, 2)}
    assert out[0, 1]["similarity"] == pytest.approx(54 / 55) and out[0, 1]["n_words"] == 58 and out[0, 1]["start_word"] == 0
    assert {r["doc_id"] for r in decontaminate.clean_rows(rows, bench).collect()} == {3, 4, 5}


def test_repeated_items_keep_the_threshold(spark):
    """A passage under several ids, in near copies, and in one block or many is found alike."""
    words = [f"d{i}" for i in range(59)]
    near = [*words[:50], "other", *words[51:]]
    items = [(1, " ".join(words)), (2, " ".join(words).upper()), (3, " ".join(near)), *((k, f"filler{k} " * 30) for k in range(4, 12))]
    edited = " ".join(["before"] * 9 + words[:20] + ["changed"] + words[21:] + ["after"] * 9)
    rows = cases.table(spark, [(0, edited, None, None, None), (1, "before after", None, None, None)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = []
    for block in (1_000_000, 250):
        out = decontaminate.contaminated(rows, bench, block_words=block).collect()
        found.append(sorted((r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in out))
        assert {r["doc_id"] for r in decontaminate.clean_rows(rows, bench, block_words=block).collect()} == {1}
    assert found[0] == found[1] and {(0, 1), (0, 2)} <= {f[:2] for f in found[0]}


def test_left_over_nodes_meet_one_leading_component(spark):
    """Every node in a component of its own, all in the same MinHash groups: each meets the largest, not each other."""
    from originline.llm.ngram_join import leader_meetings

    keys = list(range(8))
    rows = [(i, None, None, keys) for i in range(40)] + [(100 + i, 100, 5, keys) for i in range(5)]
    rows += [(200, None, None, [1000 + k for k in keys])]
    placed = spark.createDataFrame(rows, "node long, component long, members long, keys array<long>")
    met = sorted(map(tuple, leader_meetings(placed).select("group", "node").collect()))
    assert met == [(100, i) for i in range(40)]


def test_components_of_known_ones_and_few_links(spark):
    """New links tie known components; few links take few tasks, and no table or shuffle of a round stays."""
    from pathlib import Path

    from originline import session

    rng = random.Random(8)
    old = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)]
    new = [(40, 150), (7, 9), (300, 3), (301, 302), (302, 303), (5, 5)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(40)]
    table = lambda rows: spark.createDataFrame(rows, "a long, b long")
    keys = {"spark.sql.shuffle.partitions": "100", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    written = {path for _, path in session._WRITTEN}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        context.setJobGroup("few links", "")
        whole = components.components(table(old + new), "a", "b")
        stages = {s for j in tracker.getJobIdsForGroup("few links") for s in tracker.getJobInfo(j).stageIds}
        assert sum(tracker.getStageInfo(s).numCompletedTasks for s in stages) < 1000
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    known = components.components(table(old), "a", "b")
    grown = components.components(table(new), "a", "b", known=known)
    assert sorted(map(tuple, grown.collect())) == sorted(map(tuple, whole.collect()))
    assert sorted(map(tuple, components.components(table([]), "a", "b", known=grown).collect())) == sorted(map(tuple, grown.collect()))
    assert {Path(path).name.split("-")[0] for _, path in session._WRITTEN if path not in written} == {"components"}
