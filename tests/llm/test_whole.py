"""Places where an operator once did less than its whole job."""

import random

import numpy as np
import pyarrow as pa

from crestline.llm import passages, queries, urls


def text(rng, n):
    return [f"v{rng.randrange(10**9)}" for _ in range(n)]


def found_in(spark, texts, name):
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    path = f"{spark.conf.get('spark.checkpoint.dir')}/whole-{name}"
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("overwrite").parquet(path)
    return [(r["id"], r["source_id"], r["start"], r["words"], r["matches"]) for r in passages.repeated_passages(spark.read.parquet(path)).collect()]


def test_runs_whose_parts_were_first_elsewhere(spark):
    """Runs of 60 words in two documents, whose halves have their first occurrences in two others."""
    rng = random.Random(3)
    texts, expect = [], []
    for _ in range(30):
        a, b = text(rng, 30), text(rng, 30)
        at = len(texts)
        texts += [text(rng, 40) + a + text(rng, 40), text(rng, 40) + b + text(rng, 40)]
        texts += [text(rng, 40) + a + b + text(rng, 40), text(rng, 20) + a + b + text(rng, 30)]
        expect.append((at + 3, at + 2, 20, 60, 60))
    assert sorted(found_in(spark, texts, "parts")) == expect


def test_wide_shingles_are_of_their_words_alone():
    h = np.random.default_rng(0).integers(0, 1 << 63, 300).astype(np.uint64)
    for k in (1, 2, 3, 21, 50, 64):
        whole = passages.wide_shingles(np.concatenate((h, h[:100])), k)
        assert (whole[300 : 300 + 101 - k] == whole[: 101 - k]).all() and len(set(whole[:300].tolist())) == 300
        assert len(passages.wide_shingles(h[: k - 1], k)) == 0


def edited(rng, t, n):
    out = list(t)
    for i in range(1, n + 1):
        out[i * len(t) // (n + 1)] = text(rng, 1)[0]
    return out


def test_good_parts_of_a_poor_chain():
    """Two passages of 60 words with 5 edits each, and 30 other words between them."""
    rng = random.Random(5)
    a, b = text(rng, 60), text(rng, 60)
    one, two = a + text(rng, 30) + b, edited(rng, a, 5) + text(rng, 30) + edited(rng, b, 5)
    names = {w: k for k, w in enumerate({*one, *two})}
    p, q = (np.array([names[w] for w in t], np.uint32) for t in (one, two))
    x = np.flatnonzero(np.convolve(p == q, np.ones(passages.K, int), "valid") == passages.K)
    found = passages.passages_along(p, q, x, x, 50, 0.8)
    assert sorted(found) == [(0, 60, 0, 60, 55), (90, 150, 90, 150, 55)]
    # and with words put in between, so that the passages are on two diagonals
    q = np.concatenate((q[:70], np.arange(10**6, 10**6 + 7, dtype=np.uint32), q[70:]))
    found = passages.passages_along(p, q, x, np.where(x < 70, x, x + 7), 50, 0.8)
    assert sorted(found) == [(0, 60, 0, 60, 55), (90, 150, 97, 157, 55)]


def test_good_stretches_against_loops():
    rng = np.random.default_rng(2)
    for _ in range(300):
        same = rng.random(int(rng.integers(0, 60))) < rng.choice([0.5, 0.8, 0.95])
        got = passages.good_stretches(same, 12, 0.8)
        assert all(q - p >= 12 and same[p:q].sum() >= 0.8 * (q - p) - 1e-6 for p, q in got)
        assert all(b <= c for (_, b), (c, _) in zip(got, got[1:]))
        assert bool(got) == any(same[p:q].sum() >= 0.8 * (q - p) for p in range(len(same)) for q in range(p + 12, len(same) + 1))


def test_lone_repeated_anchors_are_kept():
    """A seed that a document has twice gives a chain at both places, whichever is the passage."""
    anchors = [[{"src": 7, "x": x, "y": 500, "before": 0, "after": 0} for x in (10, 900)]]
    kind = pa.list_(pa.struct([("src", pa.int64()), ("x", pa.int32()), ("y", pa.int32()), ("before", pa.int64()), ("after", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array([9], pa.int64()), pa.array(anchors, kind)], ["row", "anchors"])
    out = [r for b in passages._chains(50, 0.8)([batch]) for r in b.to_pylist()]
    assert sorted((r["x"][0], r["y"][0]) for r in out) == [(10, 500), (900, 500)]


def test_repeat_on_a_lone_repeated_anchor(spark):
    """An edited passage whose only seed in its source also occurs earlier in the document, by chance."""
    rng = random.Random(8)
    texts, expect = [], []
    for _ in range(40):
        phrase = text(rng, 6)
        whole = text(rng, 25) + phrase + text(rng, 25)
        other = list(whole)
        for i in (3, 8, 13, 18, 24, 31, 36, 41, 46, 51):  # no other run of six words is left
            other[i] = text(rng, 1)[0]
        at = len(texts)
        texts += [text(rng, 60) + whole + text(rng, 60), text(rng, 40) + phrase + text(rng, 70) + other + text(rng, 20)]
        expect.append((at + 1, at))
    # the phrase is a seed where its hash is the smallest of its windows in both texts
    assert len({r[:2] for r in found_in(spark, texts, "lone")} & set(expect)) >= 3


def sides(t, x):
    """The bits of the words beside one place, as seeds carry them."""
    bits = [0, 0]
    for k in range(passages.MARGIN):
        for side, at in ((0, x - passages.MARGIN + k), (1, x + passages.K + k)):
            if 0 <= at < len(t):
                bits[side] |= (int(t[at]) >> 40 & 1) << k
    return [np.array([b], np.uint64) for b in bits]


def test_sides_never_rule_out_a_passage():
    """An anchor whose sides hold a passage can match by its bits; nearly no other can."""
    rng = np.random.default_rng(4)
    x, k, m = 80, passages.K, passages.MARGIN
    passed, passed_exactly = [], 0
    for i in range(600):
        a = rng.integers(0, 1 << 63, int(rng.integers(x + k, 230))).astype(np.uint64)
        b = rng.integers(0, 1 << 63, int(rng.integers(x + k, 230))).astype(np.uint64)
        lo, n = int(rng.integers(x - 50, x)), min(len(a), len(b))
        hi = min(n, lo + 60)
        if i % 2:
            b[lo:hi] = np.where(rng.random(hi - lo) < 0.85, a[lo:hi], b[lo:hi])
        b[x : x + k] = a[x : x + k]
        (l1, r1), (l2, r2) = sides(a, x), sides(b, x)
        able = bool(passages.can_match(l1 ^ l2, r1 ^ r2, 50, 0.8)[0])
        same = a[x - m : min(n, x + k + m)] == b[x - m : min(n, x + k + m)]
        assert able or not passages.good_stretches(same, 50, 0.8)
        passed.append(able and not i % 2)
        words = (b >> np.uint64(32)).astype(np.uint32)
        tiles = passages.Tiles([{"src": 5, "tile": t, "words": words[t * passages.TILE : (t + 1) * passages.TILE].tobytes()} for t in range(-(-len(b) // passages.TILE))])
        exact = bool(tiles.can_match((a >> np.uint64(32)).astype(np.uint32), [(5, x, x)], 50, 0.8)[0])
        assert exact or not passages.good_stretches(same, 50, 0.8)
        passed_exactly += exact and not i % 2
    assert sum(passed) <= 30 and not passed_exactly


def test_seeds_are_the_smallest_of_their_windows():
    """Of a column of texts, as of each text alone; with the bits of the words beside them."""
    rng = np.random.default_rng(0)
    lengths = [0, 1, 4, 5, 6, 16, 17, 40, 300, 0, 63, 500, 0]
    first = np.concatenate(([0], np.cumsum(lengths)))
    h = rng.integers(0, 1 << 63, first[-1]).astype(np.uint64)
    h[100:140] = h[100]
    seeds, at, before, after, starts = passages.seeds_of(h, first)
    for i, n in enumerate(lengths):
        t = h[first[i] : first[i + 1]]
        own = passages.shingles(t, passages.K)
        windows = [own[lo : lo + passages.WINDOW] for lo in range(max(1, len(own) - passages.WINDOW + 1))] if len(own) else []
        expect = sorted({lo + int(k) for lo, w in enumerate(windows) for k in np.flatnonzero(w == w.min())})
        mine = slice(starts[i], starts[i + 1])
        assert at[mine].tolist() == expect and (seeds[mine] == own[expect]).all()
        for x, b, a in zip(expect, before[mine], after[mine]):
            assert [int(v[0]) for v in sides(t, x)] == [int(b), int(a)]


def test_edited_passages_are_found(spark):
    """Recall of passages whose words were replaced at random, of those that are still 0.8 alike."""
    rng = random.Random(21)
    texts, planted = [], {}
    for n in (50, 60, 120):
        for share in (0.10, 0.15):
            done = 0
            while done < 100:
                p = text(rng, n)
                q = [w if rng.random() >= share else text(rng, 1)[0] for w in p]
                if sum(v == w for v, w in zip(p, q)) < 0.8 * n or p[0] != q[0] or p[-1] != q[-1]:
                    continue  # of its own words fewer than min_words, or too few, are alike
                texts += [text(rng, 60) + p + text(rng, 60), text(rng, 60) + q + text(rng, 60)]
                planted[len(texts) - 1] = (n, share)
                done += 1
    found = {(d, s) for d, s, *_ in found_in(spark, texts, "edited")}
    recall = {key: sum((i, i - 1) in found for i, k in planted.items() if k == key) / 100 for key in set(planted.values())}
    assert all(r >= (0.95 if share == 0.10 else 0.9) for (_, share), r in recall.items()), recall


def test_merged_passages_against_sets():
    rng = random.Random(3)
    for _ in range(300):
        found = [(rng.randrange(60), rng.randint(5, 30), rng.randrange(99), 5, rng.randrange(30), rng.random() < 0.5) for _ in range(rng.randint(0, 9))]
        out = passages.merged(found)
        for exact in (False, True):
            cover = lambda ps: {i for s, n, *_, e in ps if e == exact for i in range(s, s + n)}
            assert cover(out) == cover(found)
        whole = sorted(p[:2] for p in out if not p[5])
        assert all(a + n <= b for (a, n), (b, _) in zip(whole, whole[1:]))
        runs = [(p[0], p[0] + p[1]) for p in out if p[5]]
        for s, n, *_, exact in found:
            assert not exact or sum(a <= s and s + n <= b for a, b in runs) == 1 or (s, s + n) in runs or any(a <= s and s + n <= b for a, b in runs)


def test_row_passages_cover_what_all_chains_cover():
    """Leaving out lone anchors inside found passages loses no word of a repetitive text."""
    rng = np.random.default_rng(9)
    for _ in range(60):
        period = rng.integers(0, 1 << 31, int(rng.integers(4, 30)))
        theirs = np.concatenate([rng.integers(0, 1 << 31, 40), np.tile(period, 20), rng.integers(0, 1 << 31, 40)]).astype(np.uint32)
        own = np.concatenate([rng.integers(0, 1 << 31, 30), np.tile(period, 30), rng.integers(0, 1 << 31, 30), np.tile(period, 12)]).astype(np.uint32)
        y = 40 + len(period) * int(rng.integers(0, 10))
        words = theirs[y : y + passages.K].tobytes()
        chains = [([x], [y]) for x in range(len(own)) if own[x : x + passages.K].tobytes() == words]
        words_of = lambda lo, hi: theirs[lo:hi]
        every = [p for c in chains for p in passages.row_passages(own, [c], words_of, 50, 0.8)]
        got = passages.row_passages(own, chains, words_of, 50, 0.8)
        cover = lambda ps: {i for s, n, *_ in ps for i in range(s, s + n)}
        assert cover(got) == cover(every) and len(got) <= len(every)


def test_models_read_whole_urls(spark):
    """Urls without a rule are told apart by their queries, fragments, schemes, or text without a scheme."""
    rows = [(i, f"http://{'bad' if i % 2 else 'good'}{i}.org/p?to={'casino-win' if i % 2 else 'library'}") for i in range(200)]
    asked = ["http://x.com/a?to=casino-win", "http://x.com/a?to=library", "http://x.com/a", "x.com/casino-win", "x.com/library", None]
    pages = spark.createDataFrame(rows + [(1000 + i, u) for i, u in enumerate(asked)], "page_id long, url string").coalesce(1)
    rules = [urls.Rule("block" if i % 2 else "allow", f"{'bad' if i % 2 else 'good'}{i}.org", "/") for i in range(200)]
    got = {r["page_id"]: r for r in urls.filter_urls(pages, rules).where("page_id >= 1000").collect()}
    assert [got[1000 + i]["verdict"] for i in (0, 1)] == ["block", "allow"]
    assert got[1000]["score"] < got[1002]["score"] < got[1001]["score"] and got[1003]["score"] < got[1004]["score"]
    texts = spark.createDataFrame([("HTTP://WWW.X.com:80/A?B#C",), ("a://B",), ("No Scheme",), (None,)], "u string")
    assert [r[0] for r in texts.select(urls.whole_url(texts.u)).collect()] == ["HTTP://www.x.com:80/A?B#C", "a://b", "No Scheme", ""]


def test_short_lines_that_recur_are_dropped(spark):
    path = f"{spark.conf.get('spark.checkpoint.dir')}/whole-lines"
    rows = [(i, f"All rights reserved.\nown line {'abcdefghijkl'[i]}\n\n7") for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    got = queries.queries()["op6_line_dedup"](spark, path).collect()
    assert len(got) == 12 and {(r["n_lines"], r["n_dropped"]) for r in got} == {(4, 1)}
