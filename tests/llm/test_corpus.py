import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import cases
import corpus_pipeline
from crestline.llm import jaccard, lines, mixing, packing, passages, queries, toxicity

DATA = "/root/testdata/sf0.001"
PATH = queries.tokenizer_path()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{DATA}/documents.parquet'")
    ours, theirs = queries.queries()[name](spark, DATA).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    cols = sorted(ours.columns)
    assert cols == sorted(theirs.columns)
    rows = lambda d: sorted(tuple(str(v) for v in r) for r in d[cols].astype(object).itertuples(index=False, name=None))
    assert rows(ours) == rows(theirs)


def test_words_are_encoded_like_whole_texts():
    whole, mine = Tokenizer.from_file(PATH), packing.WordTokenizer(PATH)
    rng = random.Random(1)
    odd = ["İstanbul it's I'm", "a\x1cb  x", "<|endoftext|> a<|startoftext|>b", "ÀÉÎ, ŉ! 12,3 x2. ﬁ. é. Σας ΣΑΣ.", "日本語。 ªº. ²³ ẞ. straße", "İ! İ>", "", " "]
    odd += ["".join(rng.choice("aBé ßİΣ,.'!<|>12́‍　\x85\n_😀日") for _ in range(60)) for _ in range(400)]
    for t in odd:
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_patterns_use_all_pieces():
    rng = random.Random(2)
    for _ in range(60):
        cap = rng.choice([10, 33, 100])
        hist = {k: rng.randint(1, 30) for k in rng.sample(range(1, cap + 1), rng.randint(1, cap // 2))}
        patterns = packing.plan_patterns(dict(hist), cap)
        used = collections.Counter()
        for p, n in patterns:
            assert sum(p) <= cap and n > 0
            for x in p:
                used[x] += n
        assert dict(used) == hist
        n_bins, least = sum(n for _, n in patterns), math.ceil(sum(k * v for k, v in hist.items()) / cap)
        decreasing = []
        for x in sorted((k for k, v in hist.items() for _ in range(v)), reverse=True):
            fit = [i for i, g in enumerate(decreasing) if g >= x]
            if fit:
                decreasing[min(fit, key=lambda i: decreasing[i])] -= x
            else:
                decreasing.append(cap - x)
        assert least <= n_bins <= len(decreasing) * 1.05 + 1
    assert packing.plan_patterns({}, 10) == []
    assert packing.plan_patterns({6: 2, 4: 2}, 10) == [((6, 4), 2)]


def check_packing(rows, texts, cap):
    whole = Tokenizer.from_file(PATH)
    expect = collections.Counter()
    for d, t in texts:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for i, at in enumerate(range(0, len(ids), cap)):
            x = ids[at : at + cap]
            expect[(d, i, at, len(x), zlib.crc32(x.tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expect
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= cap
    return len(by), math.ceil(sum(k[3] * n for k, n in expect.items()) / cap)


def test_packing_round_trip(spark):
    docs = cases.table(spark, extra=True)
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    out = packing.pack(docs, PATH, capacity=128, with_ids=True).collect()
    n, least = check_packing(out, texts, 128)
    assert n <= least * 1.02 + 2
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in out)
    assert packing.pack(cases.empty(spark), PATH).count() == 0


def test_poisson_inverse(spark):
    rates = [0.0, 0.01, 0.5, 1.0, 3.7, 40.0, 480.0]
    rows = [(r, (i + 0.5) / 500) for r in rates for i in range(500)]
    got = spark.createDataFrame(rows, "rate double, u double").select("rate", "u", mixing.poisson_inverse(F.col("u"), F.col("rate")).alias("k")).collect()
    for r in got:
        p = c = math.exp(-r["rate"])
        k = 0
        while r["u"] > c:
            k += 1
            p *= r["rate"] / k
            c += p
        assert r["k"] == k


def test_large_rates_are_poisson(spark):
    """Above the largest rate of one draw, several hashed draws add up: to the loop's value, and to a Poisson spread."""
    got = spark.range(4000).select("id", F.lit(1730.0).alias("rate")).select("id", mixing.poisson_copies(7, F.col("rate"), F.col("id")).alias("n")).collect()

    def uniform(*key):
        return (int(hashlib.md5("\x1f".join(map(str, key)).encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)

    for r in got[:40]:
        k = 0
        for j in range(1, 5):
            p = c = math.exp(-1730.0 / 4)
            i = 0
            while uniform(7, r["id"], j) > c:
                i += 1
                p *= 1730.0 / 4 / i
                c += p
            k += i
        assert r["n"] == k
    n = np.array([r["n"] for r in got])
    assert abs(n.mean() - 1730) < 3 and 0.9 < n.var() / 1730 < 1.1


def test_equal_rows_are_dealt_out(spark):
    docs = spark.createDataFrame([(None, "same text of all", "a")] * 400, "doc_id long, text string, source string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = mixing.mix_sources(docs, floor=4.0).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in parts) < 0.5 * sum(r["count"] for r in parts)


def test_mixing(spark):
    docs = cases.table(spark, extra=True)
    out = mixing.mix_sources(docs, seed=3)
    n = {r["source"]: r["copy"] for r in out.select("source", "copy").collect()}
    assert set(n) <= {None, "s0", "s1", "s2"}
    assert set(out.columns) == set(docs.columns) and out.count() == mixing.mix_sources(docs, seed=3).count()
    per = collections.Counter((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    copies = collections.defaultdict(list)
    for r in out.select("doc_id", "text", "copy").collect():
        copies[(r["doc_id"], r["text"])].append(r["copy"])
    for key, found in copies.items():
        top = max(found)
        assert sorted(found) == sorted(list(range(1, top + 1)) * (len(found) // top)) and per[key] >= len(found) // top
    only = mixing.mix_sources(docs, {"s1": 2.0, "absent": 1.0}).select("source").distinct().collect()
    assert [r["source"] for r in only] == ["s1"]
    assert mixing.mix_sources(docs, {}).count() == 0
    assert mixing.mix_sources(cases.empty(spark)).count() == 0
    floor = mixing.mix_sources(docs, {"s1": 1.0}, floor=30.0)
    assert floor.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_mixing_reaches_its_weights(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x" * 50).alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    got = {r["source"]: r["count"] for r in mixing.mix_sources(docs, {"a": 0.7, "b": 0.3}).groupBy("source").count().collect()}
    assert abs(got["a"] / sum(got.values()) - 0.7) < 0.02


def test_mixing_ways_are_equal(spark, monkeypatch):
    docs = cases.table(spark)
    a = collections.Counter((r["doc_id"], r["copy"]) for r in mixing.mix_sources(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert collections.Counter((r["doc_id"], r["copy"]) for r in mixing.mix_sources(docs).collect()) == a


def test_lines(spark):
    rng = random.Random(6)
    boiler = [f"Licensed under the public licence number {i} of all\nnext {cases.prose(rng, 30)}" for i in range(12)]
    prose = [f"Licensed under the {w} licence" for w in ("a", "b")]
    texts = [*boiler, *prose, None, "", "\n\n", boiler[0], "\n".join(["same line of five words"] * 20), "long " * 5000]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(None, None, 1)], "doc_id long, text string, n_lines int")
    out = {r["doc_id"]: r for r in lines.clean_lines(docs).collect()}
    assert len(out) == len(texts) + 1
    for i in range(12):
        assert out[i]["n_dropped"] == 1 and out[i]["text"] == boiler[i].split("\n", 1)[1]
    for i in range(12, len(texts)):
        if i != 17:
            assert out[i]["n_dropped"] == 0 and out[i]["text"] == (texts[i] or "")
    assert out[17]["n_dropped"] == 1 and out[None]["text"] == ""
    # copies of one text are one document, so its lines do not recur
    copies = spark.createDataFrame([(i, "one two three four five\nsix seven eight nine ten") for i in range(30)], "doc_id long, text string")
    assert lines.clean_lines(copies).where("n_dropped > 0").count() == 0
    assert lines.clean_lines(cases.empty(spark)).count() == 0


def test_lines_with_clashing_names(spark):
    docs = cases.table(spark, extra=True)
    for name in ("__row", "__text", "__drop", "line", "leaf", "doc"):
        docs = docs.withColumn(name, docs["lang"])
    out = lines.clean_lines(docs, min_docs=2)
    assert set(out.columns) == set(docs.columns) | {"n_lines", "n_dropped"} and out.count() == docs.count()
    plain = lines.clean_lines(docs.select("doc_id", "text"), min_docs=2)
    key = lambda df: collections.Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in df.collect())
    assert key(out) == key(plain) and out.where("n_dropped > 0").count()


def test_masked_lines_in_linear_time(spark):
    odd = ["a1 b  c\t2", " x ", "\x0b\x0c\r", "", "no digits", "x" * 200_000 + " 7", "9" * 100_000, "é٣ ٣x 3x"]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    got = [r[0] for r in df.select(lines._masked(df.t)).collect()]
    words = [[w for w in re.split("[ \t\x0b\x0c\r]", t) if w] for t in odd]
    assert got == [" ".join("<*>" if re.search("[0-9]", w) else w for w in ws) for ws in words]


def best_chain(x, y):
    n = len(x)
    score = [1.0] * n
    for i in sorted(range(n), key=lambda k: (x[k], y[k])):
        for j in range(n):
            if x[j] < x[i] and y[j] < y[i]:
                score[i] = max(score[i], score[j] + 1 - passages.GAP_COST * (x[i] - x[j] + y[i] - y[j]))
    return max(score)


def test_chains_are_best():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(1, 14)
        x, y = (np.array([rng.randrange(40) for _ in range(n)]) for _ in range(2))
        found = passages.chain(x, y)
        assert sorted(i for p in found for i in p.tolist()) == list(range(n))
        for p in found:
            assert (np.diff(x[p]) > 0).all() and (np.diff(y[p]) > 0).all()
        value = lambda p: len(p) - passages.GAP_COST * (x[p[-1]] - x[p[0]] + y[p[-1]] - y[p[0]])
        assert max(value(p) for p in found) >= best_chain(x.tolist(), y.tolist()) - 1e-9


def test_planted_passages(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    text = lambda n: [word() for _ in range(n)]
    common = text(70)
    docs, planted = [], {}
    for i in range(40):
        w = text(rng.randint(80, 200))
        if i % 2:
            p = list(common)
            if i % 4 == 3:
                for _ in range(4):
                    p[rng.randrange(70)] = word()
                del p[rng.randrange(70)]
            at = rng.randrange(len(w))
            w[at:at] = p
            planted[i] = (at, at + len(p))
        docs.append((i, rng.choice([" ", "\n"]).join(w)))
    docs += [(100, None), (101, ""), (102, docs[0][1]), (102, docs[0][1]), (None, "short text"), (104, " ".join(text(8000)))]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, row string").coalesce(1)
    out = passages.repeated_passages(df).collect()
    found = collections.defaultdict(set)
    for r in out:
        found[r["id"]].update(range(r["start"], r["start"] + r["words"]))
    for i, (lo, hi) in planted.items():
        if i > 1:
            assert len(found[i] & set(range(lo, hi))) >= 0.85 * (hi - lo), i
            assert len(found[i] - set(range(lo, hi))) <= 4
    assert set(found) == {i for i in planted if i > 1} | {102}
    assert passages.repeated_passages(cases.empty(spark)).count() == 0


def test_pipeline(spark):
    """Each stage against brute force on its own input."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "ngram_jaccard", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.cut(stage(spark, docs, DATA), f"test-{name}")
        if name != "packing":
            assert docs.columns == before.columns
        old, new = ([(r["doc_id"], r["text"]) for r in x.collect()] for x in (before, docs if name != "packing" else before))
        if name == "toxicity":
            labels = spark.read.parquet(f"{DATA}/labels.parquet")
            model = toxicity.train(before, labels.where(toxicity.fold("doc_id", 5) != 0))
            kept = toxicity.score(before, model).where("score < 0.5").select("doc_id").collect()
            assert {r[0] for r in kept} == {d for d, _ in new}
        if name == "exact_dedup":
            last = {}
            for d, t in old:
                last[t] = max(d, last.get(t, d))
            assert {d for d, _ in new} == set(last.values())
        if name == "ngram_jaccard":
            found = jaccard.jaccard_components(before, k=5, num=80, den=100).collect()
            assert {d for d, _ in new} == {r["component_id"] for r in found}
        if name == "mixing":
            assert {d for d, _ in new} <= {d for d, _ in old}
        if name == "packing":
            n, least = check_packing(docs.collect(), old, 2048)
            assert n <= least + 2


def test_stages_that_are_not_written(spark):
    """A stage's tables stay as long as the next one's docs read them, and go after."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    lazily = docs
    for _, f in corpus_pipeline.STAGES[1:3]:
        lazily = f(spark, lazily, DATA)
    lazily = sorted(r["doc_id"] for r in lazily.select("doc_id").collect())
    written = docs
    for _, f in corpus_pipeline.STAGES[1:3]:
        written = corpus_pipeline.cut(f(spark, written, DATA), "test-written")
    assert lazily == sorted(r["doc_id"] for r in written.select("doc_id").collect())
    before = list(corpus_pipeline._made)
    corpus_pipeline.STAGES[3][1](spark, written, DATA)
    assert before and not set(before) & set(corpus_pipeline._made)


def test_stages_take_odd_tables(spark):
    for docs in (cases.table(spark, extra=True), cases.empty(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, DATA).columns == docs.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()


def test_hash_kernel_types():
    big = pa.array(["a b", None, "c"], pa.large_string()).slice(1)
    assert [len(s) for s in jaccard.shingle_sets(big, 2)] == [0, 1]
