"""The pipeline against plain Python, stage by stage on its own input, and the SQL forms."""

import duckdb
import public_tokenizers
import tiktoken
from brute import contamination, fingerprint, jaccard, line_dedup, rules, sha, shingle_set, smallest_reachable, words
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from panelspark.llm import byte_bpe, oracles, quality_rules, queries

SF = "/root/testdata/sf0.001"


def kept_by_rules(text):
    n, chars, signs, dup, rep = rules(text)
    import re

    lines = sum(bool(words(x)) for x in (text or "").split("\n"))
    facts = {"n_words": n, "word_chars": chars, "n_symbols": signs, "n_dup_lines": dup, "n_repeat_words": rep, "n_lines": lines, "n_capital_runs": len(re.findall("[A-Z]{2,}", text or ""))}
    failed = sum(1 << b for b, (_, condition) in quality_rules.RULES.items() if eval(condition, {}, facts))
    return failed & quality_rules.POLICIES["v2"] == 0


def test_pipeline_equals_plain_python(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = [(i, t) for i, t in sorted(docs.items()) if kept_by_rules(t)]
    assert 100 < len(left) < 200
    lined = [(i, x) for (i, _), (_, gone, x) in zip(left, line_dedup(left, range(len(left))), strict=True) if not gone or words(x)]
    marks = [(i, (fingerprint(t, 5), shingle_set(t))) for i, t in lined]
    least = smallest_reachable(marks, lambda a, b: (a[0] ^ b[0]).bit_count() <= 2 or jaccard(a[1], b[1]) >= 0.8)
    single = [(i, t) for (i, t), c in zip(lined, least, strict=True) if c == i]
    clean = [(i, t) for i, t in single if not contamination(t, items)[-1]]
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path(queries.RANKS)), special_tokens={})
    want = sorted((i, sha(b"".join(k.to_bytes(4, "little") for k in own.encode_ordinary(t)))) for i, t in clean)
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.ids_sha256) for r in got.collect()) == want
    assert got.where("not round_trip").count() == 0


def test_stages_keep_columns_and_take_hard_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", None, 0), (None, "a b\nc", None, "s", 5), (3, "x y z " * 30, "en", "s", 180), (3, "x y z " * 30, "en", "s", 180), (4, "", "de", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        for part in (docs, docs.limit(0)):
            got = stage(spark, part, SF)
            assert name == "byte_bpe" or got.columns == docs.columns
            assert got.count() <= part.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "byte_bpe"]


def test_sql_forms_agree(spark):
    base = duckdb.connect()
    for t in ("documents", "benchmark"):
        base.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in oracles.ORACLE_SQL.items():
        rel = base.sql(sql)
        columns = sorted(rel.columns)
        want = sorted(tuple(dict(zip(rel.columns, r, strict=True))[c] for c in columns) for r in rel.fetchall())
        df = queries.QUERIES[name](spark, SF)
        assert sorted(df.columns) == columns
        assert sorted(tuple(r) for r in df.select(columns).collect()) == want, name


def test_each_operator_has_one_query(spark):
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()
    assert spark.range(1).select(F.lit(1)).count() == 1
