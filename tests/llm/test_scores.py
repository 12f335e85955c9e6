import collections
import math
import string
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import cases
from crestline.llm import kernel, lm_score, queries, quality, toxicity, urls

DATA = "/root/testdata/sf0.01"


def test_kernel_words_and_shingles():
    texts = ["One  two\tthree", None, "", "é É x", " \n", "one TWO three one two three", "a" * 2_000_000 + " b"]
    col = pa.array(texts, pa.string())
    got, by_word = [], {}
    for _, h, first in kernel.rows_of_words(col):
        got += [h[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
    assert [len(g) for g in got] == [len(cases.words(t)) for t in texts]
    for g, t in zip(got, texts):
        for x, w in zip(g, cases.lower_words(t)):
            assert by_word.setdefault(w, x) == x
    assert len(set(by_word.values())) == len(by_word)
    sizes = [len(s) for s in kernel.shingle_sets(col, 3)]
    assert sizes == [1, 0, 0, 1, 0, 3, 1]
    assert list(kernel.rows_of_words(pa.array([], pa.string()))) == []


def auc(score, label):
    order = np.argsort(np.argsort(score))
    pos = label == 1
    return (order[pos].mean() - (pos.sum() - 1) / 2) / (~pos).sum()


def test_toxicity_held_out(spark):
    out = queries.op1_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").toPandas()
    held = out[out.held_out]
    assert set(out.predicted) <= {0, 1} and out.score.between(0, 1).all()
    assert (held.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5) == 0).all()
    assert auc(held.score.to_numpy(), held.toxic.to_numpy()) > 0.95
    clean = held[held.toxic == 0]
    assert (clean.predicted == 0).mean() > 0.98 and held[held.toxic == 1].predicted.mean() > 0.7


def test_toxicity_cases(spark):
    docs = cases.table(spark, extra=True)
    p = toxicity.FtrlParams(bits=12, max_rows=30, l1=0.1)
    labels = docs.where("doc_id IS NOT NULL").select("doc_id", (F.col("text").contains("w1")).cast("int").alias("toxic")).distinct()
    model = toxicity.train(docs, labels, p)
    assert 0 < model.n_rows <= 30 and len(model.weight) <= 1 << 12
    scored = toxicity.score(docs, model, score_col="score")
    assert scored.count() == docs.count() and sorted(scored.columns) == sorted(docs.columns)
    w = model.dense()
    for r in scored.select("text", "score").collect():
        expect = model.bias
        for _, _, idx in toxicity.features(pa.array([r["text"]], pa.string()), 12):
            expect += w[np.unique(idx)].sum()
        assert float(r["score"]) == pytest.approx(1 / (1 + math.exp(-max(-35, min(35, expect)))))
    none = toxicity.toxicity(docs, labels.where("false"), p)
    assert {(r["predicted"], r["score"] < 1e-9) for r in none.collect()} == {(0, True)}
    assert toxicity.toxicity(cases.empty(spark), labels, p).count() == 0


def loop_features(text, bits):
    """Distinct coordinates of words, pairs and pairs one word apart, one by one."""
    found = "".join(c.lower() if "A" <= c <= "Z" else c if ord(c) > 127 or c.isalnum() else " " if c in string.whitespace + string.punctuation else c for c in text or "").split(" ")
    hashes = [int(kernel.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0][0]) for w in found if w]
    mask = (1 << 64) - 1

    def mix(h):
        h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & mask
        h = (h ^ (h >> 27)) * 0x94D049BB133111EB & mask
        return h ^ (h >> 31)

    every = hashes + [mix((a * int(salt) + b) & mask) for gap, salt in ((1, toxicity._PAIR), (2, toxicity._SKIP)) for a, b in zip(hashes, hashes[gap:])]
    return {h >> (64 - bits) for h in every}


def loop_ftrl(rows, p):
    """FTRL-proximal by coordinate, with a bias that has no L1 term."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        l1 = 0.0 if i == "bias" else p.l1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((p.beta + math.sqrt(n[i])) / p.alpha + p.l2)

    for _ in range(p.epochs):
        for coordinates, y in rows:
            w = {i: weight(i) for i in [*coordinates, "bias"]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            g *= p.positive_weight if y else 1.0
            for i in w:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / p.alpha * w[i]
                n[i] += g * g
    return {i: weight(i) for i in list(z)}


def test_toxicity_against_loops(spark):
    """Features, the order of the sample, FTRL and scores against loops over words and coordinates."""
    p = toxicity.FtrlParams(bits=14, max_rows=40, l1=0.05)
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["good", "Day", "to", "you,", "vile", "fool!", "x1"], int(rng.integers(1, 12)))) for _ in range(50)] + ["", None, "one"]
    rows = [(i, t, int("vile" in (t or "") and rng.random() < 0.9)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + [rows[5], rows[5]], "doc_id long, text string, toxic int")
    model = toxicity.train(docs, docs.select("doc_id", "toxic"), p)
    hashed = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    sample = sorted(hashed, key=lambda i: (hashed[i], i))[: p.max_rows]
    order = sorted(sample, key=lambda i: int(kernel.mix(np.array([i], np.int64).astype(np.uint64))[0]))
    expect = loop_ftrl([(loop_features(texts[i], p.bits), rows[i][2]) for i in order], p)
    assert model.n_rows == len(order) and model.bias == pytest.approx(expect.pop("bias"))
    got = dict(zip(model.index.tolist(), model.weight.tolist()))
    assert got == pytest.approx({i: w for i, w in expect.items() if w})
    for r in toxicity.score(docs, model).collect():
        total = model.bias + sum(got.get(i, 0.0) for i in loop_features(r["text"], p.bits))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total)))


def test_training_sample_is_bounded_by_ids(spark):
    """Rows of one id, however many, are one training row; without labels nothing is toxic."""
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(300)] + [(2, "other words")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels, toxicity.FtrlParams(bits=10, max_rows=5)).n_rows == 2


def counts(text):
    w = cases.words(text)
    windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    twice = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if cases.words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(twice)


def test_quality_counts(spark):
    docs = cases.table(spark, extra=True)
    got = quality.quality(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    expect = collections.Counter((r["doc_id"], *counts(r["text"])) for r in docs.select("doc_id", "text").collect())
    assert collections.Counter((r["doc_id"], *(r[n] for n in names)) for r in got) == expect
    for r in got:
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["posterior"] >= 0.5)
    assert quality.quality(cases.empty(spark)).count() == 0


def test_quality_separates(spark):
    out = quality.quality(spark.read.parquet(f"{DATA}/documents.parquet")).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").toPandas()
    good, bad = out[(out.quality == 1) & ~out.base_failed], out[out.quality == 0]
    assert good.kept.mean() > 0.95 and bad.kept.mean() < 0.15


def test_expectation_maximisation_recovers_rates():
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.8
    cols = []
    for hit in (0.9, 0.8, 0.7, 0.6):
        cols.append(np.where(rng.random(20_000) < np.where(good, 0.02, hit), -1, np.where(rng.random(20_000) < 0.5, 1, 0)))
    patterns = sorted(collections.Counter(zip(*(c.tolist() for c in cols))).items())
    share, rates = quality.fit_accuracies(patterns)
    assert abs(share - 0.8) < 0.05
    for hit, r in zip((0.9, 0.8, 0.7, 0.6), rates):
        assert abs(r[False][0] - hit) < 0.1 and r[True][0] < 0.05
    verdict = {p: quality.posterior(p, share, rates) >= 0.5 for p, _ in patterns}
    assert np.mean([verdict[p] == g for p, g in zip(zip(*(c.tolist() for c in cols)), good)]) > 0.97


def test_url_ways_are_equal(spark):
    """Windows are broadcast or shuffled with the same result."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    key = lambda df: sorted((r["page_id"], r["verdict"], round(r["score"], 9)) for r in df.collect())
    assert key(urls.filter_urls(pages, queries.URL_RULES, broadcast_windows=0)) == key(urls.filter_urls(pages, queries.URL_RULES))


def test_urls_parse_and_rules(spark):
    cases_ = [
        (1, "http://WWW.Example.com/en/1?x#y"), (2, "https://a.example.com/en/"), (3, "https://example.com/EN/"), (4, "http://x.net/es/a"), (5, "http://net/fr/"),
        (6, "http://planet/es/"), (7, None), (8, ""), (9, "no scheme"), (10, "http://com"), (11, "a://b://c/d?e"), (12, "http://x.org/en#q?r"), (12, "http://x.org/en#q?r"),
        (None, "http://x.com/?a"), (14, "http://" + "y" * 5000 + ".org/" + "z" * 5000),
    ]
    pages = spark.createDataFrame([(i, u, u, u) for i, u in cases_], "page_id long, url string, host string, verdict string")
    got = urls.filter_urls(pages, queries.URL_RULES).collect()
    assert len(got) == len(cases_)

    def parts(u):
        if not u or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        path = rest[cut:]
        return rest[:cut].translate(cases.LOWER), path[: min([path.index(c) for c in "?#" if c in path] or [len(path)])]

    expect = collections.Counter()
    for i, u in cases_:
        h, p = parts(u)
        fits = [r for r in queries.URL_RULES if (h == r.host or h.endswith("." + r.host)) and p.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.host + r.path), default=None)
        expect[(i, h, p, best and best.host + best.path)] += 1
        for r in got:
            if best and (r["page_id"], r["host"], r["path"]) == (i, h, p):
                assert r["verdict"] == best.verdict
    assert collections.Counter((r["page_id"], r["host"], r["path"], r["rule"]) for r in got) == expect
    assert {r["verdict"] for r in urls.filter_urls(pages, []).collect()} == {"allow"}
    assert urls.filter_urls(pages.where("false"), queries.URL_RULES).count() == 0


def test_url_models_against_loops(spark):
    """Window scores equal a direct Witten-Bell computation."""
    train = [("abcabd", True, 2), ("abd", True, 1), ("xyzabx", False, 3)]
    pad = lambda s: "\x02" * urls.ORDER + s + "\x03"
    grams = [(pad(s)[i : i + urls.ORDER + 1], ok, n) for s, ok, n in train for i in range(len(s) + 1)]
    c, x = urls.fit_windows(spark.createDataFrame(grams, "window string, accepted boolean, n long"))
    asked = sorted({g[0] for g in grams} | {pad("abz")[i : i + urls.ORDER + 1] for i in range(4)})
    got = {r["window"]: r["ratio"] for r in urls.score_windows(spark.createDataFrame([(w,) for w in asked], "window string"), c, x).collect()}

    def chance(window, ok):
        p = urls.UNSEEN
        for k in range(urls.ORDER + 1):
            ctx, ch = window[urls.ORDER - k : urls.ORDER], window[-1]
            seen = collections.Counter()
            for w, a, n in grams:
                if a == ok and w[urls.ORDER - k : urls.ORDER] == ctx:
                    seen[w[-1]] += n
            total, kinds = sum(seen.values()), len(seen)
            if total:
                p = (seen[ch] + kinds * p) / (total + kinds)
        return p

    for w in asked:
        assert got[w] == pytest.approx(math.log(chance(w, True)) - math.log(chance(w, False)))
    slope, offset = urls.calibrate([(-100, 0, 50), (-20, 5, 20), (30, 40, 4), (90, 60, 0)])
    assert slope > 0 and -1 < -offset / slope < 1
    assert urls.calibrate([]) == (1.0, 0.0)


def test_lm_base_counts(spark):
    docs = cases.table(spark, extra=True)
    got = lm_score.lm_scores(docs).collect()
    rows = docs.select("doc_id", "text").collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c = collections.Counter()
    for r in rows:
        if not held(r["doc_id"]):
            c.update([*cases.lower_words(r["text"]), None])
    n, v = sum(c.values()), len(c)
    expect = []
    for r in rows:
        t = [*cases.lower_words(r["text"]), None]
        expect.append((r["doc_id"] is None, r["doc_id"], held(r["doc_id"]), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 5)))
    mine = [(r["doc_id"] is None, r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got]
    key = lambda t: (t[0], t[1] or 0, t[3:])
    assert sorted(mine, key=key) == sorted(expect, key=key)
    assert all(r["score"] < 0 for r in got)
    assert lm_score.lm_scores(cases.empty(spark)).count() == 0


def test_lm_rare_words_are_exact(spark, monkeypatch):
    """With few frequent words, the join finds the rest."""
    docs = cases.table(spark, n=20, seed=3)

    def base():
        return sorted((r["doc_id"] or -1, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in lm_score.lm_scores(docs).collect())

    monkeypatch.setattr(lm_score, "TOP_WORDS", 20)
    few = base()
    monkeypatch.undo()
    assert few == base()


def small_vocabulary(words, counts, placed=None):
    """A vocabulary whose ``placed`` most frequent words have leaves of their own."""
    order = np.lexsort((words, -counts))[lm_score.PLACED :]
    leaf, inverse = np.unique(lm_score.deep_code(words[order], 5), return_inverse=True)
    mass = np.bincount(inverse, weights=counts[order] + 1.0, minlength=len(leaf))
    return lm_score.Vocabulary.build(words, counts, leaf, mass, int(counts.sum()), len(words), 5)


def noisy(v, seed=0):
    rng = np.random.default_rng(seed)
    w = lm_score.Weights.zero(v.bits)
    w.root += rng.normal(0, 0.3, w.root.shape).astype(np.float32)
    w.inner += rng.normal(0, 0.3, w.inner.shape).astype(np.float32)
    return w


@pytest.mark.parametrize("few", [False, True])
def test_lm_probabilities_sum_to_one(monkeypatch, few):
    """Over all words and the unseen one, whatever the weights; with few leaves of their own, most words share leaves."""
    if few:
        monkeypatch.setattr(lm_score, "PLACED", 7)
    words = kernel.mix(np.arange(1, 401, dtype=np.uint64))
    counts = np.arange(400, 0, -1) ** 2
    v = small_vocabulary(words, counts)
    w = noisy(v)
    code = np.append(v.code(words), lm_score.deep_code(np.array([lm_score._UNSEEN], np.uint64), 5))
    assert len(np.unique(v.code(words[: lm_score.PLACED]))) == min(400, lm_score.PLACED)
    for one, two in ((words[:1], words[1:2]), (words[9:10], words[3:4])):
        p = 10 ** lm_score.path_score(v, w, code, np.repeat(one, 401), np.repeat(two, 401))
        share = np.where(v.is_deep(code), (np.append(counts, 0) + 1.0) / np.maximum(v.leaf_mass[np.maximum(code - (lm_score.DEEP_FIRST << 16), 0)], 1.0), 1.0)
        assert (p * share).sum() == pytest.approx(1.0, abs=1e-4)


def test_lm_training_against_loops(monkeypatch):
    """Gradient steps and scores, token by token."""
    monkeypatch.setattr(lm_score, "BATCH", 7)
    rng = np.random.default_rng(5)
    text = " ".join(f"w{int(x)}" for x in rng.random(60) ** 2 * 30)
    col = pa.array([text, "w1 w2"])
    stream = list(lm_score.token_stream(col))
    token, one, two = (np.concatenate([s[i] for s in stream]) for i in range(3))
    names, n = np.unique(token, return_counts=True)
    monkeypatch.setattr(lm_score, "PLACED", 12)
    v = small_vocabulary(names, n)
    start = noisy(v, 1)
    w, used = start.copy(), (np.zeros(len(start.root)), np.zeros(len(start.inner)))
    lm_score.train_on(col, v, w, used)

    def path(h):
        code = int(v.code(np.array([h], np.uint64))[0])
        digits = [(code >> (4 * (4 - k))) & 15 for k in range(5)]
        return digits[: int(lm_score.depth_of(np.array([code]), 5)[0])]

    def logits(tables, i, digits, level):
        if level == 1:
            rows = [("root", int(r[0])) for r in lm_score.root_rows(one[i : i + 1], two[i : i + 1], v.bits)]
            bias = v.bias[0][0]
        else:
            node = 0
            for d in digits[: level - 1]:
                node = node * 16 + d
            rows = [("inner", int(lm_score.inner_rows(one[i : i + 1], np.array([node]), level, v.bits)[0]))]
            bias = v.bias[level - 1][node - lm_score._first_node(level)]
        z = [float(bias[j]) + sum(float(tables[t][r][j]) for t, r in rows) for j in range(16)]
        total = sum(math.exp(x) for x in z)
        return rows, [math.exp(x) / total for x in z]

    tables = {"root": start.root.astype(float).copy(), "inner": start.inner.astype(float).copy()}
    uses = collections.Counter()
    for lo in range(0, len(token), 7):
        batch = range(lo, min(lo + 7, len(token)))
        for level in range(1, 6):
            moves = []
            for i in batch:
                digits = path(token[i])
                if len(digits) >= level:
                    rows, p = logits(tables, i, digits, level)
                    moves += [(r, [p[j] - (j == digits[level - 1]) for j in range(16)]) for r in rows]
            uses.update(r for r, _ in moves)
            for (t, r), g in moves:
                for j in range(16):
                    tables[t][r][j] -= lm_score.RATE / math.sqrt(1 + uses[(t, r)]) * g[j]
    assert np.abs(tables["root"] - w.root).max() < 1e-4 and np.abs(tables["inner"] - w.inner).max() < 1e-4
    assert used[0].sum() == 3 * len(token) and {r for t, r in uses if t == "inner"} == set(np.flatnonzero(used[1]).tolist())
    expect = 0.0
    for i in range(len(token)):
        digits = path(token[i])
        for level in range(1, len(digits) + 1):
            expect += math.log10(logits({"root": w.root, "inner": w.inner}, i, digits, level)[1][digits[level - 1]])
        if len(digits) == 5:
            code = v.code(token[i : i + 1])
            expect += math.log10((n[names == token[i]][0] + 1) / v.mass(code)[0])
    assert sum(s[3].sum() for s in lm_score.score_column(col, v, w)) == pytest.approx(expect, rel=1e-4)


def test_lm_average_against_loops():
    """Rows become the mean over tasks by use; rows that no task used stay."""
    v = small_vocabulary(kernel.mix(np.arange(1, 50, dtype=np.uint64)), np.arange(49, 0, -1))
    start, rng, tasks = noisy(v), np.random.default_rng(2), []
    for seed in range(3):
        used = tuple(np.where(rng.random(1 << v.bits) < 0.5, rng.integers(1, 9, 1 << v.bits), 0).astype(float) for _ in range(2))
        tasks.append((noisy(v, seed + 7), used))
    parts = collections.defaultdict(list)
    for w, used in tasks:
        for block, *sums in lm_score.used_rows(start, w, used):
            parts[block].append(tuple(sums))
    # added up in two steps, as a tree of tasks does
    got = lm_score.averaged(start, {k: lm_score.add_rows([lm_score.add_rows(p[:2]), *p[2:]]) for k, p in parts.items()})
    for name, t in (("root", 0), ("inner", 1)):
        n = sum(used[t] for _, used in tasks)
        mean = sum(getattr(w, name) * used[t][:, None] for w, used in tasks) / np.maximum(n, 1)[:, None]
        assert np.abs(getattr(got, name) - np.where(n[:, None] > 0, mean, getattr(start, name))).max() < 1e-4


def test_lm_untrained_model_is_the_base(spark):
    docs = cases.table(spark, n=30, seed=5)
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    counts, v, w = lm_score.fit(docs.where(~out), rounds=0)
    for r in lm_score.score(docs, counts, v, w, out).collect():
        assert r["score"] == pytest.approx(r["base_score"], rel=1e-4, abs=1e-4)
    held = docs.where("crc32(cast(doc_id as string)) % 7 = 2")
    assert held.count() and all(-1e-3 < r["score"] <= 0 == r["base_score"] for r in lm_score.lm_scores(held).collect())


def test_lm_beats_the_base_on_held_out_text(spark):
    out = queries.op9_lm_score(spark, "/root/testdata/sf0.1").where("held_out").toPandas()
    assert out.score.sum() > out.base_score.sum()
