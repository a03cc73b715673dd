"""Small tables with nulls, empty and very long texts, ties, repeated rows and clashing extra columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, alphabet="abcdefgh"):
    return [" "] and ["".join(rng.choices(alphabet, k=rng.randint(2, 6))) for _ in range(n)]


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = " ".join(words(rng, rng.randint(30, 90)))
        rows.append([i, text, "en", f"s{i % 3}", len(text)])
    for k, i in enumerate((3, 3, 7, 20)):  # exact copies
        rows.append([n + k, rows[i][1], "en", "s0", rows[i][4]])
    rows.append([n + 10, rows[5][1].replace(" ", " \t\n"), None, None, None])  # equal after normalising
    near = rows[9][1].split()
    near[len(near) // 2] = "zzzz"
    rows.append([n + 11, " ".join(near), "en", "s1", 1])
    rows += [[n + 12, None, None, None, None], [n + 13, "", "en", "s2", 0], [n + 14, "  \n", "en", "s2", 3]]
    rows.append([n + 15, " ".join(words(rng, 20_000)), "en", "s1", 1])  # very long
    rows.append([n + 16, "The MIT License, apache\nLICENSE and General Public license. mit license", "en", "Ünï", 1])
    rows.append([n + 17, "Ünïcödé ☃ mit-license 𝔘𝔫𝔦 mit  license", "en", "𝔰", 1])
    rows += [rows[11][:], rows[11][:]]  # repeated rows
    rows.append([None, rows[12][1], "en", "s0", 1])
    rows.append([None, "only a null id has this text", "en", "s0", 1])
    return [tuple(r) for r in rows]


def documents(spark, rows=None, extra=True):
    df = spark.createDataFrame(corpus() if rows is None else rows, DOCS)
    if extra:  # names that the operators themselves use
        from pyspark.sql import functions as F

        for c in ("fp", "key", "digest", "kept", "size", "part", "one", "row", "score", "length", "component_id", "__n", "hash"):
            df = df.withColumn(c, F.lit(f"x{c}"))
    return df
