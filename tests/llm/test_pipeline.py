"""The pipeline against a plain version of each stage, and its queries' contracts."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline as pipeline
from tests.llm.test_dedup_mixing import lower, water, words
from tests.llm.test_near import brute
from tests.llm.test_texts import check_packing
from tidemark.llm import quality
from tidemark.llm.common import documents, materialise
from tidemark.llm.queries import ORACLE_SQL, QUERIES


def test_stages_against_brute_force(spark, sf):
    docs = documents(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = []
    for _, stage in pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf))
        out.append(docs)
    rows = [(r.doc_id, r.text, r.source) for r in documents(spark, sf).collect()]

    good = {r.doc_id for r in quality.score(documents(spark, sf), quality.fit(documents(spark, sf), labels)).where("quality_predicted = 1").collect()}
    rows = [r for r in rows if r[0] in good]
    assert sorted(r.doc_id for r in out[0].collect()) == sorted(r[0] for r in rows)

    last = {}
    for i, t, _ in rows:
        last[lower(t)] = max(i, last.get(lower(t), i))
    rows = [r for r in rows if last[lower(r[1])] == r[0]]
    assert sorted(r.doc_id for r in out[1].collect()) == sorted(r[0] for r in rows)

    component = brute([(i, t) for i, t, _ in rows])
    rows = [r for r in rows if component[r[0]][1] == r[0]]
    assert sorted(r.doc_id for r in out[2].collect()) == sorted(r[0] for r in rows)

    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
    order = sorted(sizes)
    want = water(sizes, {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)})
    taken, times = defaultdict(int), Counter()
    for r in out[3].collect():
        taken[r.source] += words(r.text)
        times[r.doc_id] += 1
    assert max(times.values()) <= 3 and set(times) <= {r[0] for r in rows}
    largest = {s: max(words(t) for _, t, o in rows if o == s) for s in sizes}
    assert all(want[s] - largest[s] <= taken[s] <= want[s] + 1 for s in sizes)  # a source has a few documents here

    assert all(f.columns == documents(spark, sf).columns for f in out[:4])
    assert check_packing(out[4].collect(), out[3]) > 0.95


def test_run_gives_the_stages_rows(spark, sf):
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality classifier", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "packing"]
    assert pipeline.run(spark, sf).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_every_number_has_a_query():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_contract_columns(spark, sf):
    want = {
        "op1_": "doc_id held_out score predicted",
        "op3_": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
        "op4_": "doc_id n_shingles component_id",
        "op5_": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
        "op6_": "doc_id keep_id group_size kept text_sha256",
        "op7_": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
        "op8_": "doc_id held_out lang_pred score",
        "op10_": "doc_id size source_size target taken",
        "op11_": "vec_id component n deviation whitened explained identity_error",
        "op12_": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
        "op13_": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    }
    n = documents(spark, sf).count()
    for start, columns in want.items():
        (name,) = [q for q in QUERIES if q.startswith(start)]
        rows = QUERIES[name](spark, sf)
        assert set(columns.split()) <= set(rows.columns), name
        if start not in ("op3_", "op7_", "op11_"):
            assert rows.count() == n, name


@pytest.mark.parametrize("table", ["odd", "none"])
def test_stages_on_odd_and_empty_tables(spark, sf, request, table):
    """Nulls, repeated rows, clashing names and no rows at all go through every stage; what a stage keeps are rows it got."""
    docs = request.getfixturevalue(table)
    rows = Counter(docs.select("doc_id", "text").collect())
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k + 1 == len(pipeline.STAGES):
            assert sum(r.length for r in out.collect() if r.start == 0) >= 0 and (out.count() > 0) == bool(rows)
            break
        assert out.columns == docs.columns
        docs = materialise(out)
        rows = Counter(docs.select("doc_id", "text").collect()) if set(docs.select("doc_id", "text").collect()) <= set(rows) else None
        assert rows is not None
