"""The vector index against brute force; archives and their index."""

from __future__ import annotations

import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from ledgerline.llm import captures, pivots, queries
from ledgerline.llm.components import components
from ledgerline.session import materialize

SF_DIR = "/root/testdata/sf0.001"
VECTORS = "vec_id bigint, embedding array<float>, label int, name string, links int"


def brute(rows):
    links = {i: set() for i, _, _ in rows}
    usable = []
    for i, v, label in rows:
        if v and label is not None and None not in v and np.isfinite(v).all() and np.any(v):
            v = np.asarray(v, np.float32).astype(float)
            usable.append((i, v / np.linalg.norm(v), label))
    for i, v, a in usable:
        for j, w, b in usable:
            if i != j and a == b and len(v) == len(w) and v @ w >= 0.93:
                links[i].add(j)
    root = {i: i for i in links}
    changed = True
    while changed:
        changed = False
        for i, near in links.items():
            low = min([root[i], *(root[j] for j in near)])
            changed |= low != root[i]
            root[i] = low
    return {(i, len(links[i]), root[i], i == root[i]) for i in links}


@pytest.mark.parametrize("block", [1024, 7])
def test_near_vectors_equal_brute_force(spark, block):
    rng = np.random.default_rng(2)
    rows, centre = [], rng.normal(size=16)
    for i in range(240):
        v = centre + rng.normal(size=16) * 0.28 if i % 2 else rng.normal(size=16)
        rows.append((i, v.astype(np.float32).tolist(), int(i % 3 == 0)))
    rows += [(900 + k, rows[1][1], rows[1][2]) for k in range(4)]  # equal vectors
    rows += [(910, None, 1), (911, [], 1), (912, [0.0] * 16, 1), (913, [None] + [1.0] * 15, 1)]
    rows += [(914, [float("nan")] * 16, 1), (915, [1.0, 2.0], 1), (916, [2.0, 4.0], 1), (917, rows[1][1], None)]
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], VECTORS)
    found = pivots.near_vectors(df, block=block, min_shared=1, pivots=8).collect()
    assert {tuple(r) for r in found} == brute(rows)


@pytest.mark.parametrize(("n", "block"), [(2000, None), (6000, None), (6000, 300)])
def test_near_vectors_of_a_crowded_family_are_all_found(spark, n, block):
    rng = np.random.default_rng(n)
    centre = rng.normal(size=64)
    centre /= np.linalg.norm(centre)
    v = rng.normal(size=(n, 64))
    v[: n // 3] = centre + rng.normal(size=(n // 3, 64)) * 0.27 / 8
    v = v.astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist(), 1, "", 1) for i, x in enumerate(v)], VECTORS)
    found = pivots.near_vectors(df, **({"block": block} if block else {})).collect()
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    expected = (u @ u.T >= 0.93).sum(axis=1) - 1
    assert 0 < expected[: n // 3].mean() < n // 3 - 1
    assert {r.vec_id: r.n_links for r in found} == dict(enumerate(expected.tolist()))


def test_near_vectors_of_odd_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    assert pivots.near_vectors(none).collect() == []
    rows = [(1, [1.0, 0.0], 1, "", 1), (1, [1.0, 0.0], 1, "", 1), (None, [1.0, 0.0], 1, "", 1)]
    found = pivots.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in found) == Counter(
        [(1, 2, 1, True), (1, 2, 1, True), (None, 2, None, True)]
    )


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 90), (90, 100), (5, 5), (200, 200)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 1 for i in range(1, 61)}, 90: 90, 100: 90}


PAGES = "page_id bigint, url string, html string, key string"


def test_archives_come_back(spark):
    body = "<p>é</p>\r\n\r\n" * 200
    rows = [
        (1, "http://Www.Example.com/a?b=c#d", body), (2, "http://www.example.com/a?b=c", body),
        (3, "https://example.com:8080/x", body), (4, None, None), (5, "not a url\r\nX: y", ""),
        (6, "http://example.com/short", "short"), (7, "http://example.org/short", "short"),
        (8, "http://example.com/x", body), (8, "http://example.com/x", body), (None, "http://n.example/", body),
    ]
    pages = spark.createDataFrame([(*r, "k") for r in rows], PAGES)
    places = captures.write_archives(pages)
    index = captures.build_index(places, lines=2)
    assert index.directory.count() >= 5
    found = captures.read_records(captures.look_up(index, captures.keys_of(pages))).collect()
    digest = hashlib.sha1(body.encode()).hexdigest()
    told = Counter((r.page_id, r.record_type, r.refers_to) for r in found)
    assert told == Counter(
        [(i, "revisit", 8) for i in (1, 2, 3, None)] + [(8, "response", None)] * 2
        + [(i, "response", None) for i in (4, 5, 6, 7)]
    )
    assert all(r.payload_digest == digest and r.payload_bytes == len(body.encode()) for r in found if r.page_id in (1, 2, 3, 8))
    assert {bytes(r.payload) for r in found if r.page_id == 8} == {body.encode()}
    one = spark.createDataFrame([("com,example,www)/a?b=c",), ("com,nobody)/",)], "key string")
    assert sorted(r.page_id for r in captures.look_up(index, one).collect()) == [1, 2]
    none = spark.createDataFrame([], PAGES)
    empty = captures.build_index(captures.write_archives(none))
    assert captures.read_records(captures.look_up(empty, captures.keys_of(pages))).collect() == []


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    theirs = con.sql(queries.oracle_sql()[name]).to_arrow_table()
    ours = queries.queries()[name](spark, SF_DIR).toArrow().select(theirs.column_names)
    assert Counter(map(str, ours.to_pylist())) == Counter(map(str, theirs.to_pylist()))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    before, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialize(stage(spark, before, SF_DIR))
        assert after.columns == columns, name
        ids = after.select("doc_id")
        assert ids.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
        assert ids.distinct().count() == ids.count()
        before = after
    packed = corpus_pipeline.run(spark, SF_DIR)
    assert packed.select("doc_id").distinct().count() == before.count()
    assert packed.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls, empty and repeated texts, no rows, columns of the operators' own names."""
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, score int, _mentions int, label int"
    long = " ".join(f"word{i}" for i in range(4000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (4, "one"), (5, long), (6, long), (None, None), (None, "Mr Smith")]
    docs = spark.createDataFrame([(i, t, None, None, 1, "r", 2, 3, 4) for i, t in rows], columns)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for table in (docs, docs.limit(0)):
            after = materialize(stage(spark, table, SF_DIR))
            assert after.columns == docs.columns, name
            assert after.count() <= table.count()
            told = after.where("doc_id <> 6").select("row", "score", "_mentions", "label").distinct().collect()
            assert set(map(tuple, told)) <= {("r", 2, 3, 4)}
    assert corpus_pipeline.packed(spark, docs.limit(0), SF_DIR).count() == 0
    kept = corpus_pipeline.one_of_each(spark, docs, SF_DIR)
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 2, 3, 4, 5]
