"""The pipeline stage by stage and whole, on small corpora with planted cases."""

import random

import pytest

import corpus_pipeline as cp
from barleaf.llm import queries

from .conftest import same
from .test_joins import shingle_set

NAMES = list(cp.COLUMNS)


@pytest.fixture(scope="module")
def corpus(spark, prose, tmp_path_factory):
    """documents and labels with junk, exact and near copies, and secrets."""
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(200):
        text = prose(i, rng.randint(20, 90)).capitalize() + "."
        if i % 10 == 3:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if i % 10 == 5:
            text = rows[i - 1][1] if i % 20 == 5 else rows[i - 1][1] + " more"
        if i % 10 == 7:
            text += " password=verysecret99"
        rows.append((i, text, "a", f"s{i % 3}", len(text)))
        if i % 2:
            labels.append((i, 0 if i % 10 == 3 else 1, 0))
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_stages_one_after_the_other(spark, corpus, tmp_path):
    folder, rows = corpus
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), None
    results = []
    for i, (_, f) in enumerate(cp.STAGES):
        out = f(spark, docs, folder)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        results.append(docs.collect())
    quality, unique, clean, mixed, ids = results
    assert all(list(r.asDict()) == NAMES for stage in results[:4] for r in stage)
    assert {r.doc_id for r in quality} == {r[0] for r in rows if "!!" not in r[1]}
    # of each group of near copies, the smallest key
    sets = {r.doc_id: shingle_set(r.text) for r in quality}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    parent = {k: k for k in sets}
    for _ in range(len(links) + 1):
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert sorted(r.doc_id for r in unique) == sorted(k for k in sets if parent[k] == k)
    assert len(clean) == len(unique) and all("verysecret99" not in r.text and r.n_chars == len(r.text) for r in clean)
    times = {}
    for r in mixed:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert set(times.values()) <= {1, 2} and set(times) <= {r.doc_id for r in clean}
    assert len(ids) == len(mixed) and all(r.exact and r.n_tokens == len(r.ids) for r in ids)
    assert same([tuple(r) for r in cp.run(spark, folder).collect()], [tuple(r) for r in ids])


def test_stages_on_awkward_rows(spark, docs, clashing, empty, rows, tmp_path, corpus):
    folder, _ = corpus
    for table in (docs, clashing):
        for name, f in cp.STAGES:
            out = f(spark, table, folder)
            assert out.columns == NAMES or f is cp.token_ids
            got = out.collect()
            if f is cp.near_duplicates:
                texts = [r.text for r in got]
                assert texts.count(rows[7][1]) == 1
            if f is cp.secret_scans:
                assert len(got) == len(rows)
    for _, f in cp.STAGES:
        assert f(spark, empty, folder).count() == 0


def test_mixture_stage_repeats_documents(spark, docs, rows, corpus):
    from barleaf.llm import mixing

    got = cp.source_mixture(spark, docs, corpus[0]).collect()
    taken = mixing.mix_sources(docs.selectExpr("coalesce(doc_id, -1) as k", "xxhash64(text, lang, source, n_chars) as d", "text", "source"), ("k", "d")).where("size > 0").collect()
    assert len(got) == sum(r.taken // r["size"] for r in taken)
    # what comes are whole rows of the table, none more than twice for each time it is there
    have = {r: rows.count(r) for r in rows}
    assert all(tuple(r) in have for r in got) and all(got.count(r) <= 2 * have[tuple(r)] for r in got)


def test_repeated_and_missing_keys_are_documents_of_their_own(spark, prose, corpus):
    """Equal keys with different texts, equal texts with different keys, whole copies, and rows without a key or a text."""
    a, b, c = (prose(700 + i, 40) for i in range(3))
    rows = [(5, a), (5, b), (5, a), (2, a), (None, a), (None, b), (None, c), (None, c), (None, None), (None, None), (7, None), (9, b + " end")]
    table = spark.createDataFrame([(k, t, "x", f"s{i % 2}", 1) for i, (k, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(((r.doc_id, r.text) for r in cp.near_duplicates(spark, table.coalesce(1), corpus[0]).collect()), key=str)
    assert kept == sorted([(2, a), (5, b), (None, c), (None, None), (None, None), (7, None)], key=str)
    mixed = [(r.doc_id, r.text) for r in cp.source_mixture(spark, table, corpus[0]).collect()]
    assert set(mixed) <= {r for r in rows if r[1]} and all(mixed.count(r) <= 2 * rows.count(r) for r in set(mixed))
    again = [(r.doc_id, r.text) for r in cp.source_mixture(spark, table.repartition(3), corpus[0]).collect()]
    assert sorted(mixed, key=str) == sorted(again, key=str)


def test_every_operator_has_one_query():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
