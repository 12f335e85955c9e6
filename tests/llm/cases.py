"""Small tables with nulls, empty and long texts, copies, repeated rows and clashing names."""

import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORDS.findall(text or "")


def lower_words(text):
    return words((text or "").translate(LOWER))


def prose(rng, n, vocabulary=400):
    out = []
    for i in range(n):
        w = "".join(rng.choice("abcdeéghilmnoprstu") for _ in range(rng.randint(1, 8))) if rng.random() < 0.3 else f"w{int(rng.random() ** 2 * vocabulary)}"
        out.append(w.capitalize() if rng.random() < 0.1 else w)
        out.append(rng.choice([" ", " ", " ", "  ", "\n", "\t", ". "]))
    return "".join(out)


def table(spark, extra=False, n=60, seed=1):
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(n)]
    base = prose(rng, 150)
    near = []
    for _ in range(12):
        w = base.split(" ")
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
        near.append(" ".join(w))
    texts += [base, *near, base, texts[0], texts[1], texts[0], None, "", "", None, " \n\t ", "one", "One", "one two three", prose(rng, 20_000)]
    texts += ["a " * 40, "line one\nline one\nline one\n", "ß É ünïcode 日本 \U0001f600 " * 9, "\x0b\x0c\r", "x" * 30_000]
    rows = [(i * 3, t, None if i % 9 == 4 else "en", None if i % 11 == 5 else f"s{i % 3 if i % 2 else 0}", None) for i, t in enumerate(texts)]
    rows += [(None, texts[2], "en", "s0", 5), (None, None, None, None, None), rows[3], rows[3]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id")
    path = f"{spark.conf.get('spark.checkpoint.dir')}/cases-{seed}-{n}"
    df.write.mode("overwrite").parquet(path)
    df = spark.read.parquet(path)
    if extra:
        for name in ("row", "id", "score", "copy", "rate", "shuffle_key", "n", "name", "level", "held_out", "h", "pos", "n_lines", "label"):
            df = df.withColumn(name, df["lang"])
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
