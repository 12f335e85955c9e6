import collections
import hashlib
import pathlib
import random
import time
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import cases
from crestline.llm import components, exact_dedup, jaccard, kernel, lines, passages, store


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("block", [3, 64, 4096])
def test_exact_against_groups(spark, block):
    docs = cases.table(spark, extra=True)
    source = rows_of(docs)
    groups = collections.defaultdict(list)
    for d, t in source:
        groups[t or ""].append(-1 if d is None else d)
    got = exact_dedup.exact_duplicates(docs, block_chars=block).collect()
    assert len(got) == len(source)
    expect = collections.Counter()
    for d, t in source:
        g = groups[t or ""]
        expect[(d, None if max(g) < 0 else max(g), len(g), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == expect
    kept = collections.Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_stage_and_empty(spark):
    docs = cases.table(spark, extra=True)
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(t or "" for _, t in rows_of(left)) == sorted({t or "" for _, t in rows_of(docs)})
    assert exact_dedup.exact_duplicates(cases.empty(spark)).count() == 0


def test_shared_hash_goes_by_block(spark, monkeypatch):
    """With a hash that maps all blocks to one value, names still tell texts apart."""
    real = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.length(c[0]).cast("long") if len(c) == 1 else real(*c))
    docs = cases.table(spark, n=15)
    got = exact_dedup.exact_duplicates(docs, block_chars=50).collect()
    assert len({r["text_sha256"] for r in got if r["kept"]}) == sum(r["kept"] for r in got) == len({t or "" for _, t in rows_of(docs)})


def brute_components(source, k, num, den):
    sets = []
    for _, t in source:
        w = cases.lower_words(t)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = collections.defaultdict(lambda: None)
    for i, (d, _) in enumerate(source):
        r = find(i)
        if d is not None and (least[r] is None or d < least[r]):
            least[r] = d
    return collections.Counter((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(source)), len({find(i) for i in range(len(sets))})


@pytest.mark.parametrize("k,num", [(4, 85), (5, 80), (2, 50)])
def test_jaccard_against_all_pairs(spark, k, num):
    docs = cases.table(spark, extra=True)
    expect, _ = brute_components(rows_of(docs), k, num, 100)
    got = jaccard.jaccard_components(docs, k=k, num=num, den=100).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == expect


def test_split_units_lose_nothing(spark, monkeypatch):
    docs = cases.table(spark, n=30, seed=4)
    expect, _ = brute_components(rows_of(docs), 4, 85, 100)
    monkeypatch.setattr(jaccard, "UNIT_SHINGLES", 300)
    got = jaccard.jaccard_components(docs, k=4, num=85, den=100).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == expect


def test_split_units_go_in_passes(spark, monkeypatch):
    """Copies of sets for many blocks are not on disk all at once."""
    docs = cases.table(spark, n=30, seed=4)
    expect, _ = brute_components(rows_of(docs), 4, 85, 100)
    names, real = [], jaccard.cut
    monkeypatch.setattr(jaccard, "cut", lambda df, name: names.append(name) or real(df, name))
    monkeypatch.setattr(jaccard, "UNIT_SHINGLES", 100)
    got = jaccard.jaccard_components(docs, k=4, num=85, den=100).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == expect
    assert names.count("verified-links") > 1


def near_band(n: int):
    """Texts of 100 words in two bands about one base: a third are near it, the others 0.7 to 0.85 alike, few of them linked."""
    rng = random.Random(7)
    base = [f"v{i}" for i in range(100)]
    rows = []
    for i in range(n):
        words = list(base)
        for x in range(1 if i % 3 == 0 else 3):
            words[rng.randrange(100)] = f"u{rng.randrange(12)}" if i % 2 else f"o{i}x{x}"
        rows.append((i, " ".join(words)))
    return rows


def test_large_units_are_narrowed_before_they_are_split(spark, monkeypatch):
    """Near copies that do not all link share their prefixes: copies for blocks do not grow with the square of the group."""
    rows, copies, real = near_band(300), [], jaccard.cut

    def cut(df, name):
        out = real(df, name)
        if name == "unit-classes":
            copies.append(out.agg(F.sum("blocks")).first()[0] or 0)
        return out

    monkeypatch.setattr(jaccard, "cut", cut)
    monkeypatch.setattr(jaccard, "UNIT_SHINGLES", 1500)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expect, _ = brute_components(rows, 4, 85, 100)
    got = jaccard.jaccard_components(docs, k=4, num=85, den=100).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == expect
    assert copies[0] > 5 * copies[-1], copies


def test_blocks_go_in_passes_where_rounds_do_not_narrow(spark, monkeypatch):
    rows, passes = near_band(60), []
    monkeypatch.setattr(jaccard, "UNIT_SHINGLES", 600)
    monkeypatch.setattr(jaccard, "_narrowed", lambda large, sets, num, den: (jaccard.cut(large.select(F.col("cid").alias("a"), F.col("cid").alias("b")).limit(0), "no-links"), jaccard.cut(large.drop("blocks"), "as-before")))
    real = jaccard.cut
    monkeypatch.setattr(jaccard, "cut", lambda df, name: passes.append(name) or real(df, name))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expect, _ = brute_components(rows, 4, 85, 100)
    got = jaccard.jaccard_components(docs, k=4, num=85, den=100).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == expect
    assert passes.count("verified-links") > 1


def test_partners_against_pairs():
    rng = np.random.default_rng(1)
    for m in rng.integers(0, 25, 500).tolist():
        unit, token, comp, n, reach = (rng.integers(lo, hi, m) for lo, hi in ((0, 2), (0, 3), (0, 5), (1, 12), (1, 14)))
        fits = lambda i, j: unit[i] == unit[j] and token[i] == token[j] and comp[i] != comp[j] and n[j] <= reach[i] and n[i] <= reach[j]  # noqa: B023, E731
        stay, before = set(range(m)), None
        while stay != before:
            before, stay = stay, {i for i in stay if any(fits(i, j) for j in stay)}
        rows, others = jaccard._partners(unit, token, comp, n, reach)
        assert sorted(rows.tolist()) == sorted(stay) and all(fits(i, j) for i, j in zip(rows, others, strict=True))


@pytest.mark.parametrize("before", [None, "false"])
def test_shuffle_files_go_with_the_write(spark, before):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    dirs = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    found = lambda: {str(f) for d in dirs for f in pathlib.Path(d).rglob("shuffle_*.data")}
    (spark.conf.set(key, before) if before else spark.conf.unset(key))
    try:
        old = found()
        out = store.cut(spark.range(50_000).groupBy(F.xxhash64("id").alias("h")).count(), "shuffled")
        for _ in range(50):
            if not found() - old:
                break
            time.sleep(0.1)
        assert not found() - old and out.count() == 50_000 and spark.conf.get(key, None) == before
    finally:
        spark.conf.unset(key)


def test_near_stage_and_empty(spark):
    docs = cases.table(spark, extra=True)
    left = jaccard.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert left.count() == brute_components(rows_of(docs), 5, 80, 100)[1]
    assert jaccard.jaccard_components(cases.empty(spark)).count() == 0


def test_links_in_one_unit_against_pairs():
    rng = random.Random(5)
    for num, den in ((85, 100), (60, 100)):
        base = rng.sample(range(10_000), 60)
        sets = []
        for _ in range(80):
            s = set(base if rng.random() < 0.6 else rng.sample(range(10_000), 50))
            for x in rng.sample(sorted(s), rng.randint(0, 14)):
                s.discard(x)
                s.add(rng.randrange(10_000))
            sets.append(np.array(sorted(s), np.uint64))
        counts = collections.Counter(x for s in sets for x in s.tolist())
        prefixes = []
        for s in sets:
            ordered = sorted(s.tolist(), key=lambda x: (counts[x], x))
            prefixes.append(np.array(ordered[: jaccard._prefix_length(len(s), num, den)], np.int64))
        found = jaccard.Links(sets, prefixes, [0] * len(sets), num, den).component
        t, parent = Fraction(num, den), list(range(len(sets)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i in range(len(sets)):
            for j in range(i):
                a, b = set(sets[i].tolist()), set(sets[j].tolist())
                if len(a & b) >= t * len(a | b):
                    parent[find(i)] = find(j)
        for i in range(len(sets)):
            for j in range(i):
                assert (found[i] == found[j]) == (find(i) == find(j))
        # what is connected already stays so, and nothing is lost
        known = np.array([find(i) if rng.random() < 0.5 else 1000 + i for i in range(len(sets))])
        again = jaccard.Links(sets, prefixes, [0] * len(sets), num, den, known).component
        assert (again == found).all() or len(set(zip(again.tolist(), found.tolist()))) == len(set(found.tolist()))


def test_lone_group_is_joined_inside(spark):
    """Four texts with one prefix are two pairs: whichever is first, the pair without it is found."""
    region, rows = jaccard._region(85, 100), []
    for seed in range(400):
        rng = random.Random(seed)
        word = lambda: f"g{rng.randrange(10**9)}"
        base = [word() for _ in range(20)]
        texts = [" ".join(base + tail + [word()]) for tail in [[word(), word()] for _ in range(2)] for _ in range(2)]
        sets = [set(s.tolist()) for s in kernel.shingle_sets(pa.array(texts), 4)]
        every = set.intersection(*sets)
        own = set.union(*sets) - every
        if min(own) >= region and sum(x < region for x in every) >= jaccard._prefix_length(20, 85, 100):
            rows += [(len(rows) + i, t) for i, t in enumerate(texts)]
    assert len(rows) >= 40
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expect, n = brute_components(rows, 4, 85, 100)
    assert n == len(rows) // 2
    got = jaccard.jaccard_components(docs, k=4, num=85, den=100).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == expect


def test_prefixes_at_other_places_are_other_groups():
    """Sets of one size and prefix, of which one skips ten unshared shingles: its place is not the other's."""
    shared = list(range(1, 7))
    skips = shared + list(range(100, 194))
    whole = shared + list(range(1000, 1094))
    near = whole[:92] + list(range(2000, 2008))
    sets = [np.array(s, np.uint64) for s in (skips, whole, near)]
    found = jaccard.Links(sets, [np.array(shared, np.int64)] * 2 + [np.array([*shared, 2000], np.int64)], [10, 0, 0], 85, 100).component
    assert found[1] == found[2] != found[0]


def test_chains_of_near_copies_are_one_component(spark):
    """Each text is linked with the next alone, so that stars find few of the links."""
    rng = random.Random(11)
    words = [f"v{rng.randrange(10**6)}" for _ in range(100)]
    rows = []
    for i in range(120):
        rows.append((i, " ".join(words)))
        for _ in range(1):
            words[rng.randrange(100)] = f"u{rng.randrange(10**6)}"
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expect, _ = brute_components(rows, 4, 85, 100)
    got = jaccard.jaccard_components(docs, k=4, num=85, den=100).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == expect


def test_scans_that_are_split_otherwise(spark, monkeypatch):
    """The number of cores, and so the borders of file splits, changes between any two scans."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").repartition(6, "doc_id")
    path = f"{spark.conf.get('spark.checkpoint.dir')}/split-otherwise"
    docs.write.mode("overwrite").parquet(path)
    docs = spark.read.parquet(path)

    def results():
        exact = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.exact_duplicates(docs).collect()}
        near = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs).collect()}
        left = [sorted(r["doc_id"] for r in f(docs).collect()) for f in (exact_dedup.drop_exact_duplicates, jaccard.drop_near_duplicates)]
        cleaned = {r["doc_id"]: r["text"] for r in lines.clean_lines(docs).collect()}
        repeats = sorted(tuple(r)[1:] for r in passages.repeated_passages(docs).select("row", "id", "start", "words", "source_start", "matches").collect())
        return exact, near, left, cleaned, [r[0] for r in repeats]

    expect = results()
    counter = iter(range(10**6))
    real = store.cut

    def moving(df, name):
        out = real(df, name)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(4 + 44 * (next(counter) % 2)))
        return out

    for module in (exact_dedup, jaccard, lines, passages, components, store):
        if hasattr(module, "cut"):
            monkeypatch.setattr(module, "cut", moving)
    spark.conf.set("spark.sql.files.openCostInBytes", "65536")
    try:
        got = results()
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got[:4] == expect[:4] and set(got[4]) == set(expect[4])


def test_columns_of_internal_names_are_carried(spark):
    docs = cases.table(spark, extra=True).withColumn("__row", F.lit("a")).withColumn("__ROW_", F.lit("b"))
    for f in (exact_dedup.drop_exact_duplicates, jaccard.drop_near_duplicates):
        left = f(docs)
        assert left.columns == docs.columns and {(r["__row"], r["__ROW_"]) for r in left.collect()} == {("a", "b")}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    alone = {x for x in parent if all(x not in e or e[0] == e[1] for e in edges)}
    assert got == {x: find(x) for x in parent if x not in alone}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
