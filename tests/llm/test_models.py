"""License scan, language mixtures and the quality classifier."""

import math
import re
import textwrap
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from test_text_operators import HARD, frame, given

from panelspark.llm import language_id, license_scan, quality_classifier, queries

SF = "/root/testdata/sf0.01"


def brute_licences(files, notices, texts, header, whole):
    def tokens(x):
        return re.findall(r"[0-9]+(?:\.[0-9]+)*|[^\W_]+", (x or "").lower())

    n, df = len(files), Counter(w for _, t in files for w in set(tokens(t)))

    def vector(words):
        v = {w: c * (math.log((1 + n) / (1 + df[w])) + 1) for w, c in Counter(words).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    templates = [(name, len(tokens(t)) if k else 0, vector(tokens(t))) for k, group in enumerate((notices, texts)) for name, many in group.items() for t in many]
    vocabulary = {w for _, k, m in templates if not k for w in m}

    def scores(words):
        v = vector(words)
        return [(round(sum(x * m.get(w, 0) for w, x in v.items()), 9), name, k) for name, k, m in templates]

    own = {}
    for f in set(files):
        lines = [tokens(x) for x in (f[1] or "").split("\n") if re.search(r"[^\W_]", x)]
        dense = [sum(w in vocabulary for w in x) >= license_scan.SHARE * len(x) for x in lines]
        found = [(name not in license_scan.WEAK, True, s, name) for s, name, n in scores(tokens(f[1])) if s >= whole and (not n or len(tokens(f[1])) <= license_scan.LONGEST * n)]
        for i in range(len(lines)):
            for k in range(1, min(license_scan.RUN, len(lines) - i) + 1):
                if k == 1 or all(dense[i : i + k]):
                    run = [w for x in lines[i : i + k] for w in x]
                    found += [(name not in license_scan.WEAK, False, s, name) for s, name, group in scores(run) if not group and s >= header]
        if found:
            strong, is_file, score, name = max(found)
            own[f] = ((name, score), is_file and strong)
    sources = {}
    for (path, _), ((name, score), is_file) in own.items():
        if is_file and path is not None:
            sources.setdefault(path.rpartition("/")[0], []).append((-score, path, name))
    out = []
    for path, text in files:
        if (path, text) in own:
            (name, score), _ = own[path, text]
            out.append((path, name, "header", score, path))
            continue
        d, found = path, None
        while path is not None and found is None and d:
            d = d.rpartition("/")[0]
            found = min(sources[d]) if d in sources else None
        out.append((path, found[2], "inherited", -found[0], found[1]) if found else (path, None, "none", None, None))
    return out


def test_license_scan_equals_plain_python(spark):
    docs = given(spark)
    files = [(f"r{i % 3}/d{i % 7}/{i}", t) for i, t in docs if i is not None] + [
        ("r0/LICENSE", "Licensed under the Apache License, Version 2.0."), ("r1/d1/COPYING", "Released under the MIT License.\n"), ("top.txt", None), ("", "x"), (None, "Released under the MIT License."), (None, "y"),
        ("r0/d0/sub/deep/a.txt", "words"), ("r9/a", ""), ("r0/d0/long.txt", "the of under " * 5000 + "\nThis work is licensed under the GNU General Public License, version 3.\n" + "x " * 9), ("r0/d0/sub/deep/a.txt", "words"),
    ]
    df = spark.createDataFrame([(p, t, 1, "x") for p, t in files], "path string, text string, score int, `how` string")
    got = license_scan.licences(df)
    assert got.columns == ["path", "text", "licence", "how", "score", "licence_path"]
    rows = sorted(((r.path, r.licence, r.how, None if r.score is None else round(r.score, 6), r.licence_path) for r in got.collect()), key=str)
    want = brute_licences(files, license_scan.NOTICES, license_scan.TEXTS, license_scan.HEADER, license_scan.FILE)
    assert rows == sorted(((p, n, h, None if s is None else round(s, 6), q) for p, n, h, s, q in want), key=str)
    assert {r[2] for r in rows} == {"header", "inherited", "none"}
    assert license_scan.licences(df.limit(0)).count() == 0


def installed(name):
    """The licence file of an installed package, if there is one."""
    found = [p for p in Path(np.__file__).parents[1].glob(f"{name}-*.dist-info/**/LICEN*") if p.is_file()]
    return found[0].read_text() if found else None


def wrapped(text, width, mark):
    return "\n".join(mark + x for x in textwrap.wrap(text, width))


def test_real_licence_files_and_wrapped_notices(spark):
    """Whole licences as projects hold them, notices wrapped in comments, and lines with words beside the notice, among
    other files in two numbers: the same licences are found in both."""
    notices = license_scan.NOTICES
    cases = {
        "py/a.py": (wrapped(notices["GPL-3.0"][2], 72, "# ") + "\n\nimport os\n", "GPL-3.0"),
        "c/a.c": ("/*\n" + wrapped(notices["Apache-2.0"][1], 60, " * ") + "\n */\nint main() {}\n", "Apache-2.0"),
        "c/b.c": (wrapped(notices["MIT"][2], 50, "// "), "MIT"),
        "c/c.c": ("Copyright (c) 2021 Jane Doe. All rights reserved.\n" + wrapped(notices["BSD-3-Clause"][1], 70, "") + ":\nAll rights reserved.", "BSD-3-Clause"),
        "md/a.md": ("# A tool\nThis project is released under the MIT License.\nIt runs.", "MIT"),
        "md/b.md": ("Some notes\nAll rights reserved.\nmore notes", "All-Rights-Reserved"),
        "no/a": ("The licence of the software is in the conditions of the contract of any person.", None),
        "gone/LICENSE": ("MIT License\n\nCopyright (c) 2020 A. Person\n\n" + wrapped(license_scan.TEXTS["MIT"][0], 78, ""), "MIT"),
        "gone/src/deep/x.c": ("int x;", "MIT"),
        **{f"whole/{n}/LICENSE": (t[0], n) for n, t in license_scan.TEXTS.items()},
        **{f"whole/{n}/src/x.c": ("int x;", n) for n in license_scan.TEXTS},
        "bsd2/LICENSE": ("Copyright (c) 2018-2020, Ewald de Wit\nAll rights reserved.\n\n" + wrapped(license_scan.TEXTS["BSD-2-Clause"][0], 70, ""), "BSD-2-Clause"),
        "isc/LICENSE": ("A tool is under the ISC license.\n\nCopyright (c) 2013, A team\n\n" + wrapped(license_scan.TEXTS["ISC"][0].upper(), 80, "    "), "ISC"),
        "weak/LICENSE": ("All rights reserved.", "All-Rights-Reserved"),
        "weak/x.c": ("int x;", None),
    }
    for name, licence in (("pytest", "MIT"), ("tiktoken", "MIT"), ("pandas", "BSD-3-Clause"), ("psutil", "BSD-3-Clause")):
        text = installed(name)
        if text:
            cases[f"pkg-{name}/LICENSE"] = (text, licence)
    prose = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("text is not null and not lower(text) rlike 'licen[sc]e|rights reserved|public domain'").collect()]
    for many in (60, 900):
        rows = [(p, t) for p, (t, _) in cases.items()] + [(f"docs{i}/x", t) for i, t in enumerate(prose[:many])]
        got = {r.path: (r.licence, r.how) for r in license_scan.licences(spark.createDataFrame(rows, "path string, text string")).collect()}
        assert {p: got[p][0] for p in cases} == {p: x for p, (_, x) in cases.items()}, many
        assert got["gone/src/deep/x.c"][1] == "inherited"


def test_licence_lines_of_a_long_file_are_rows(spark):
    """10 MB of licence lines in one file: the whole text is no licence, its lines state one."""
    line = "Licensed under the Apache License, Version 2.0."
    text = "\n".join([line, "int x = 1;", "/* released under the terms of the License */"] * 96_000)
    assert len(text) > 10_000_000
    got = license_scan.licences(spark.createDataFrame([("a/x", text), ("a/y", "words")] + [(f"d/{i}", f"other words {i}") for i in range(20)], "path string, text string")).collect()
    assert {r.path: (r.licence, r.how) for r in got if r.path < "b"} == {"a/x": ("Apache-2.0", "header"), "a/y": (None, "none")}


def test_language_of_held_out_documents(spark):
    got = queries.QUERIES["op2_language_id"](spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").where("held_out and lang is not null").collect()
    assert len(rows) > 150 and sum(r.lang_pred == r.lang for r in rows) > 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_mixtures_and_hard_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    langs, model = language_id.learn(docs)
    texts = {lang: " ".join(r.text for r in docs.where(F.col("lang") == lang).orderBy(F.length("text").desc()).limit(3).collect())[:6000] for lang in langs}
    mixed = texts["de"][:4000] + "\n" + texts["fr"][:2000]
    df = frame(spark, [*HARD, (100, mixed), (101, "12 34 !!"), (102, "é")])
    got = {r.doc_id: r for r in language_id.identify(df, langs, model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 101)] == ["und"] * 4 and got[101].score == 0
    assert got[102].lang_pred in langs
    shares = {x.lang: x.share for x in got[100].languages}
    assert shares.keys() == {"de", "fr"} and abs(shares["de"] - 2 / 3) < 0.1
    none, empty = language_id.learn(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(df, none, empty).collect()} == {"und"}


def test_em_raises_the_likelihood():
    p = np.array([[0.7, 0.1], [0.2, 0.3], [0.1, 0.6]])
    count = np.array([5.0, 3.0, 4.0])
    share, value, bound = language_id.em(p.T, count, np.zeros(1, dtype=int), np.zeros(3, dtype=int), np.array([12.0]))
    even = (np.log(p.mean(axis=1)) * count).sum()
    assert value[0] >= even and abs(share.sum() - 1) < 1e-9
    grid = max((np.log(p @ [a, 1 - a]) * count).sum() for a in np.linspace(0, 1, 1001))
    assert abs(value[0] - grid) < 1e-2 and bound[0] >= grid


def plain_grams(text):
    """Distinct hashed 4-byte n-grams of a text with their counts, byte by byte."""
    seen = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in (text or "").encode())
    codes = [int.from_bytes(seen[i : i + 4], "big") for i in range(len(seen) - 3)]
    return Counter((c * 0x9E3779B97F4A7C15) % (1 << 64) >> 48 for c in codes if c != 0x20202020)


def plain_mixture(p, counts):
    """Greedy choice of languages by penalised likelihood, with no bound to cut it short."""
    n = sum(counts)

    def fitted(langs):
        share = [1 / len(langs)] * len(langs)
        for _ in range(language_id.ROUNDS):
            mix = [sum(s * p[k][g] for s, k in zip(share, langs, strict=True)) for g in range(len(counts))]
            share = [s * sum(c * p[k][g] / mix[g] for g, c in enumerate(counts)) / n for s, k in zip(share, langs, strict=True)]
        return sum(c * math.log(sum(s * p[k][g] for s, k in zip(share, langs, strict=True))) for g, c in enumerate(counts)), share

    alone = [sum(c * math.log(p[k][g]) for g, c in enumerate(counts)) for k in range(len(p))]
    chosen = [max(range(len(p)), key=lambda k: alone[k])]
    best, share = alone[chosen[0]], [1.0]
    while len(chosen) < len(p):
        value, new, mine = max((fitted([*chosen, k])[0], k, fitted([*chosen, k])[1]) for k in range(len(p)) if k not in chosen)
        if value - best <= language_id.PENALTY * math.log(n + 1):
            break
        best, share, chosen = value, mine, [*chosen, new]
    return dict(zip(chosen, share, strict=True))


def test_language_mixtures_equal_plain_python(spark):
    """Six related languages, texts of one to three of them: the same model, sets and shares as without any shortcut."""
    rng = np.random.default_rng(4)
    stock = ["".join(rng.choice(list("abcdeé"), 4)) for _ in range(60)]
    weights = [rng.dirichlet(np.full(60, 0.5)) for _ in range(6)]
    write = lambda k, n: " ".join(rng.choice(stock, n, p=weights[k]))
    train = [(f"l{k}", write(k, 400)) for k in range(6)] + [(None, "x"), ("l0", None)]
    langs, model = language_id.learn(spark.createDataFrame(train, "lang string, text string"))
    counts = {k: plain_grams(t) for k, t in train if k and t}
    assert langs == sorted(counts)
    for k, lang in enumerate(langs):
        total = sum(counts[lang].values()) + 0.5 * language_id.BUCKETS
        assert all(abs(model[b, k] - (n + 0.5) / total) < 1e-15 for b, n in counts[lang].items())
    texts = [" ".join(write(k, int(rng.integers(5, 200))) for k in rng.choice(6, int(rng.integers(1, 4)), replace=False)) for _ in range(40)]
    got = language_id.shares_of(pa.array(texts), model)
    several = 0
    for text, share in zip(texts, got, strict=True):
        grams = plain_grams(text)
        want = plain_mixture([[model[b, k] for b in grams] for k in range(6)], list(grams.values()))
        assert set(np.flatnonzero(share).tolist()) == set(want) and all(abs(share[k] - s) < 1e-9 for k, s in want.items())
        several += len(want) > 1
    assert several > 5


def test_texts_without_a_letter_are_und(spark):
    docs = frame(spark, [(1, "½ ²³ 12"), (2, "٣ _"), (3, "ª"), (4, "日本")])
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, ["xx"], np.full((language_id.BUCKETS, 1), 1 / language_id.BUCKETS)).collect()}
    assert got == {1: "und", 2: "und", 3: "xx", 4: "xx"}


def test_quality_of_held_out_documents(spark):
    got = queries.QUERIES["op5_quality_classifier"](spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    clean = [r.kept for r in rows if r.quality == 1 and r.toxic == 0]
    bad = [r.kept for r in rows if r.quality == 0 or r.toxic == 1]
    assert sum(clean) > 0.97 * len(clean) and sum(bad) < 0.3 * len(bad)
    assert all(r.p_grade_1_up >= r.p_grade_2_up and 0 <= r.expected_grade <= 2 for r in rows)


def test_ordinal_fit_recovers_order_and_hard_rows(spark):
    texts = [("bad " if k % 3 == 0 else "fair " if k % 3 == 1 else "good ") + f"filler{k % 5}" for k in range(300)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    ratings = spark.createDataFrame([(k, k % 3) for k in range(300)] + [(5, 7), (None, 1), (8, None), (4, 2)], "doc_id long, grade int")
    weights, cuts = quality_classifier.learn(docs, ratings, 3)
    assert cuts[0] < cuts[1]
    rows = quality_classifier.grade(frame(spark, [*HARD, (100, "bad x"), (101, "fair x"), (102, "good x")]), weights, cuts).collect()
    got = {r.doc_id: r.expected_grade for r in rows}
    assert got[100] < got[101] < got[102] and got[100] < 0.6 and got[102] > 1.4
    assert len(rows) == len(HARD) + 3
    none = quality_classifier.learn(docs, ratings.limit(0), 3)
    assert {round(r.expected_grade, 6) for r in quality_classifier.grade(docs, *none).collect()} == {1.0}
    assert quality_classifier.sample(docs, ratings, 10).count() == 10
    twice = spark.range(1000).selectExpr("id % 2 doc_id", "concat('w', id) text")
    one = quality_classifier.learn(twice, ratings.where("doc_id < 2"), 3, most=1)
    assert one[0].any() and np.count_nonzero(one[0]) <= 5  # one row of five buckets at most
    batch = pa.RecordBatch.from_pydict({"text": ["A a", None]})
    assert len(quality_classifier.hashed(batch, {})) == 2


def plain_buckets(text):
    """Distinct buckets of a text's words and style, from its characters."""
    text = (text or "").encode()
    words = {m.lower() for m in re.findall(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~]+", text)}
    w = text.split()
    n = max(1, len(w))
    shares = [("capitals", sum(x.isupper() for x in w) / n), ("again", sum(a == b for a, b in zip(w, w[1:])) / n), ("signs", sum(c in b"#*$%&|<>" for c in text) / n), ("distinct", len(set(w)) / n)]
    style = [b"\x00" + f"{k}{min(10, int(10 * v + 0.999))}".encode() for k, v in shares]
    return {zlib.crc32(x) % quality_classifier.BUCKETS for x in [*words, *style]}


def plain_fit(rows, grade, grades):
    """The same ascent, a row at a time, with probabilities of each grade written out."""
    used = sorted(set().union(*rows))
    n, sig = len(rows), lambda x: 1 / (1 + math.exp(-x))
    share = [(sum(g <= k for g in grade) + k + 1) / (n + grades) for k in range(grades - 1)]
    start = [math.log(s / (1 - s)) for s in share]
    x = {**{b: 0.0 for b in used}, "t0": start[0], **{f"s{k}": math.log(max(start[k] - start[k - 1], 1e-2)) for k in range(1, grades - 1)}}
    m, v = dict.fromkeys(x, 0.0), dict.fromkeys(x, 0.0)
    cuts = lambda: [x["t0"] + sum(math.exp(x[f"s{j}"]) for j in range(1, k + 1)) for k in range(grades - 1)]
    for step in range(1, quality_classifier.STEPS + 1):
        t, d = cuts(), dict.fromkeys(x, 0.0)
        for row, g in zip(rows, grade, strict=True):
            f = sum(x[b] for b in row)
            high, low = (sig(t[g] - f) if g < grades - 1 else 1.0), (sig(t[g - 1] - f) if g else 0.0)
            up, down = high * (1 - high) / (high - low) / n, low * (1 - low) / (high - low) / n
            for b in row:
                d[b] += up - down
            for k, slope in ((g, -up), (g - 1, down)):
                if 0 <= k < grades - 1:
                    d["t0"] += slope
                    for j in range(1, k + 1):
                        d[f"s{j}"] += slope * math.exp(x[f"s{j}"])
        for k in x:
            slope = d[k] + (quality_classifier.RIDGE * x[k] if k in used else 0)
            m[k], v[k] = 0.9 * m[k] + 0.1 * slope, 0.99 * v[k] + 0.01 * slope * slope
            x[k] -= quality_classifier.RATE * (m[k] / (1 - 0.9**step)) / (math.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    return {b: x[b] for b in used}, cuts()


def test_quality_classifier_equals_plain_python(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["bad", "Fair", "good!", "é", "a", "b", "C"], int(rng.integers(1, 9)))) for _ in range(60)]
    grade = [sum(w in t for w in ("good", "Fair")) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ratings = spark.createDataFrame(list(enumerate(grade)), "doc_id long, grade int")
    weights, cuts = quality_classifier.learn(docs, ratings, 3)
    rows = [plain_buckets(t) for t in texts]
    want, want_cuts = plain_fit(rows, grade, 3)
    assert all(abs(weights[b] - w) < 1e-4 for b, w in want.items()) and np.count_nonzero(weights) <= len(want)
    assert np.allclose(cuts, want_cuts, atol=1e-4)
    for r in quality_classifier.grade(frame(spark, [*enumerate(texts), *HARD]), weights, cuts).collect():
        f = sum(float(weights[b]) for b in plain_buckets(r.text))
        tails = [1 - 1 / (1 + math.exp(-(c - f))) for c in want_cuts]
        assert abs(r.expected_grade - sum(tails)) < 1e-3 and np.allclose(r.tails, tails, atol=1e-3)
