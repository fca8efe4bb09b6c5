"""The pipeline stage by stage against plain versions, and its registration."""

import hashlib

import __spark_entry__
import corpus_pipeline

from scenelake.llm import op5_decontaminate, op7_suffix
from tests.llm.test_near_copies import shingles


def test_registered():
    queries = __spark_entry__.queries()
    assert sorted(int(k[2:].split("_")[0]) for k in queries if k.startswith("op")) == list(range(1, 11)) and "pipeline" in queries
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "suffix_dedup", "decontaminate", "mix"]


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        if name == "language":
            assert after == before
        if name == "near_dedup":
            sets = {i: shingles(t) for i, t in before.items()}
            near = lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])  # noqa: E731, B023
            root = {i: i for i in before}
            find = lambda i: i if root[i] == i else find(root[i])  # noqa: E731, B023
            for i in sorted(before):
                for j in sorted(before):
                    if i < j and near(i, j):
                        low, high = sorted((find(i), find(j)))
                        root[high] = low
            assert set(after) == {find(i) for i in before}
        if name == "suffix_dedup":
            seen = set()
            for i in sorted(before):
                t = before[i].encode()
                gone = [False] * len(t)
                for p in range(len(t) - 99):
                    if t[p : p + 100] in seen:
                        gone[p : p + 100] = [True] * 100
                    seen.add(t[p : p + 100])
                edges = [k for k in range(len(t) + 1) if (k < len(t) and gone[k]) != (k > 0 and gone[k - 1])]
                spans = op7_suffix.whole_characters(t, list(zip(edges[::2], edges[1::2], strict=True)))
                assert after[i] == op7_suffix._kept(t, spans).decode()
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        if name == "decontaminate":
            bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            whole = {i for i, t in before.items() if any(op5_decontaminate.plain(b.encode()).split() and b in t for _, b in bench)}
            assert whole and not whole & set(after) and len(after) >= 0.8 * len(before)
        before = after
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in mixed} == set(before)
    assert all(r.size == len(before[r.doc_id].encode().split()) for r in mixed)
    assert hashlib.sha256(repr(sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()))).encode()).hexdigest() == hashlib.sha256(repr(sorted(map(tuple, mixed))).encode()).hexdigest()


ODD = [
    (None, "a text of no id that has some words in it", "en", "s", 41), (None, None, None, None, None), (1, None, "en", None, 0), (2, "", "en", "s", 0), (3, "the same row twice over and over", "en", "s", 32),
    (3, "the same row twice over and over", "en", "s", 32), (4, "x" * 1_000_000, "en", "s", 1_000_000), (5, "w " * 300_000, "en", None, 600_000), (3, "another row of that id", "de", "s", 22),
]


def test_stages_on_odd_rows(spark, sf):
    """Nulls in any column, empty and very long texts, repeated rows and ids, clashing names, and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    clashing = ["g", "row", "node", "node_", "kept_", "copy_", "leaked_", "rest", "key", "size", "own_id", "c0"]
    for rows in (ODD, []):
        docs = spark.createDataFrame(rows, schema).selectExpr("*", *[f"'mine' as {c}" for c in clashing])
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            got = out.collect()
            assert len(got) <= len(rows)
            if name != "mix":
                assert out.columns == docs.columns and all(r[c] == "mine" for r in got for c in clashing)
            if name == "language":
                assert all(r.text for r in got)
            if name in ("suffix_dedup", "mix"):
                assert len(got) == len(rows)
            if name == "near_dedup" and rows:  # both without an id, the least id of the empty ones, each other text once
                assert sorted((r.doc_id or 0, len(r.text or "")) for r in got) == [(0, 0), (0, 41), (1, 0), (3, 22), (3, 32), (4, 1_000_000), (5, 600_000)]
