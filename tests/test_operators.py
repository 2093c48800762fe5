import threading
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.functions import vectors as V
from siftline.operators import clusters, control, corpus, dedup, evaluation, graph, parsing, retrieval
from siftline.providers import FirstSentence, HashedEmbedder, RuleExtractor, complete_column, embed_column, extract_entities
from siftline.streaming import events as S


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_header_footer(spark):
    pages = [(1, p, f"ACME Report {p}\nbody {['x', 'y', 'z', 'w'][p]}\n\nPage {p}") for p in range(4)] + [(2, p, f"Head\nb{p}") for p in range(2)]
    out = {(r["doc"], r["page"]): r["text"] for r in parsing.remove_repeated_edges(spark.createDataFrame(pages, "doc int, page int, text string")).collect()}
    assert out[1, 0] == "body x" and out[2, 0] == "Head\nb0"


def test_page_offsets(spark):
    pages = spark.createDataFrame([(1, 1, "abc"), (1, 2, " "), (1, 3, "de")], "doc int, page int, text string")
    spans = parsing.page_offsets(pages)
    assert rows(spans, "page", "start", "end") == [(1, 0, 3), (3, 5, 7)]
    at = parsing.page_at(spark.createDataFrame([(1, 0), (1, 3), (1, 99), (7, 0)], "doc int, offset int"), spans)
    assert rows(at, "doc", "offset", "page") == [(1, 0, 1), (1, 3, 3), (1, 99, 3), (7, 0, 1)]


def test_page_at_of_a_long_document_is_no_product(spark):
    rng = np.random.default_rng(5)
    ends = [(d, int(p), int(e)) for d in (1, 2) for p, e in zip(rng.integers(1, 90, 300), rng.integers(0, 400, 300))] + [(3, 4, 7), (3, 2, 7), (None, 9, 500)]
    asked = [(d, o) for d in (1, 2, 3, 4) for o in range(0, 420, 7)] + [(1, 7), (None, 3)]
    spans = spark.createDataFrame([(d, p, 0, e) for d, p, e in ends], "doc int, page int, start int, end int")
    at = parsing.page_at(spark.createDataFrame(asked, "doc int, offset int"), spans)

    def page(d, o):
        own = [(e, p) for x, p, e in ends if x == d is not None]
        return min((x for x in own if o < x[0]), default=max(own, default=(0, 1)))[1]

    assert at.count() == len(set(asked)) and {(r["doc"], r["offset"], r["page"]) for r in at.collect()} == {(d, o, page(d, o)) for d, o in asked}
    assert "Join" not in at._jdf.queryExecution().executedPlan().toString()  # each page would meet each offset of its document


def test_link_batch_and_roots(spark):
    batch = spark.createDataFrame([("n2", "n0", 1.0), ("n3", "n0", 0.96)], "id string, earlier string, similarity double")
    held = spark.createDataFrame([("n3", "old-1", 0.97, "old-0"), ("n0", "old-9", 0.5, None)], "id string, chunk_id string, similarity double, dup_of string")
    assert rows(dedup.link_batch(batch, held, 0.95), "id", "source", "parent") == [("n2", "batch", "n0"), ("n3", "existing", "old-0")]
    links = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "zz"), ("f", "g"), ("g", None)], "id string, parent string")
    assert rows(dedup.roots(links), "id", "root", "depth") == [("b", "a", 1), ("c", "a", 2), ("d", "a", 3)]


def test_collapse(spark):
    hits = spark.createDataFrame([(1, 1, "dup1", 0.9), (1, 2, "canon", 0.88), (1, 3, "other", 0.5), (1, 4, "lost", 0.4)], "query_id int, rank int, chunk_id string, similarity double")
    canonical = spark.createDataFrame([("dup1", "canon"), ("canon", None), ("other", None), ("lost", "gone")], "chunk_id string, head string")
    out = {r["chunk_id"]: (r["rank"], r["similarity"], r["collapsed_from"]) for r in retrieval.collapse(hits, canonical).collect()}
    assert out == {"canon": (1, 0.9, ["dup1"]), "other": (2, 0.5, []), "lost": (3, 0.4, [])}


def test_threshold_and_rrf(spark):
    df = spark.createDataFrame([(0.6,), (0.2,), (0.35,)], "s double")
    assert [r["r"] for r in df.select(retrieval.below_threshold(F.col("s"), 0.35).alias("r")).collect()] == [None, "similarity 0.20 < threshold 0.35", None]
    v = spark.createDataFrame([(1, x, i) for i, x in enumerate("abc", 1)], "query_id int, chunk_id string, rank int")
    g = spark.createDataFrame([(1, "c", 1), (1, "d", 2)], "query_id int, chunk_id string, rank int")
    out = retrieval.weighted_rrf(v, g, 0.7).orderBy("rank").collect()
    assert [(r["chunk_id"], r["source"]) for r in out] == [("c", "both"), ("a", "vector"), ("b", "vector"), ("d", "graph")]
    assert [r["chunk_id"] for r in retrieval.weighted_rrf(v, g, 1.0).orderBy("rank").collect()] == ["a", "b", "c"]
    assert [r["chunk_id"] for r in retrieval.weighted_rrf(v, g, 0.0).orderBy("rank").collect()] == ["c", "d"]
    alone = retrieval.fuse(v, g.where("false"), spark.createDataFrame([("a",)], "chunk_id string"), 0.7, 2)
    assert rows(alone, "rank", "chunk_id") == [(1, "a"), (2, "b")]


def test_exact_top_k_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, v array<double>")
    got = {(r["query_id"], r["rank"]): r["id"] for r in V.exact_top_k(df.where("id < 9"), df, 4, query_block=4, vector_block=7).collect()}
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    assert all(got[q, r + 1] == np.argsort(-s[q])[r] for q in range(9) for r in range(4))
    assert V.exact_top_k(df.where("id < 0"), df, 4).count() == 0


def test_clusters(spark):
    base = np.array([[1.0, 0.1], [0.1, 1.0]])
    data = [(f"m{i:02d}", [float(v) for v in base[i % 2] + 0.01 * i]) for i in range(12)]
    df = spark.createDataFrame(data, "id string, v array<double>")
    a, b = rows(clusters.choose_k(df, most=3), "id", "cluster_id"), rows(clusters.choose_k(df.orderBy(F.desc("id")), most=3), "id", "cluster_id")
    assert a == b and a[0] == ("m00", 0) and {c for _, c in a} == {0, 1}
    assert rows(clusters.choose_k(df.limit(2)), "cluster_id") == [(0,), (0,)]
    terms = clusters.key_terms(spark.createDataFrame([(0, "Flour and flour dough"), (1, "Ledger entry ledger")], "cluster_id int, text string"))
    assert {r["cluster_id"]: r["term"] for r in terms.where("rank = 1").collect()} == {0: "flour", 1: "ledger"}
    assert clusters.principal_plane(df).count() == 12


def test_choose_k_moves_all_starts_together(spark):
    rng = np.random.default_rng(4)
    heart = np.linalg.qr(rng.normal(size=(8, 8)))[0][:5]
    x = np.concatenate([h + rng.normal(scale=0.05, size=(60, 8)) for h in heart])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>").repartition(10)
    spark.sparkContext.setJobGroup("choose", "")
    got = [c for _, c in rows(clusters.choose_k(df, most=8, restarts=10), "id", "cluster_id")]
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("choose"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == [i // 60 for i in range(300)]
    assert jobs < 150  # seventy fits by themselves take several jobs each

    # the silhouette is that of all pairs
    centres = [heart, heart[:3], np.concatenate([heart[:2], x[:1] * 50])]
    data = df.withColumn("h", F.lit(0)).cache()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    known = clusters._sums(data, centres, many=True, unit=True)
    assert all(np.allclose(a, b) for p, q in zip(known, clusters._sums(data, centres, many=False, unit=True)) for a, b in zip(p, q))
    for c, s in zip(centres, clusters._silhouettes(data, centres, known)):
        own, far = clusters._distances(x, c).argmin(1), 1 - u @ u.T
        mean = lambda i, k: far[i][(own == k) & (np.arange(300) != i)].mean()
        want = []
        for i in range(300):
            a, b = mean(i, own[i]) if (own == own[i]).sum() > 1 else None, min(mean(i, k) for k in set(own) - {own[i]})
            want.append(0 if a is None else (b - a) / max(a, b))
        assert s == pytest.approx(np.mean(want))
    data.unpersist()


def test_choose_k_is_registered_with_its_whole_range(spark, monkeypatch):
    from siftline.plans import retrieval

    seen = {}
    monkeypatch.setattr(retrieval, "embeddings", lambda s, d: s.createDataFrame([(1, [1.0])], "id int, v array<double>"))
    monkeypatch.setattr(retrieval.clusters, "choose_k", lambda vectors, **given: seen.update(given) or vectors)
    retrieval.clu3_choose_k(spark, "")
    assert seen == {"most": 12, "restarts": 10}


def test_graph(spark):
    m = spark.createDataFrame([(1, "Knowledge Graph", "OTHER", "", "c1"), (2, "the knowledge graph", "CONCEPT", "a store", "c2"), (3, "Fusion", None, None, "c3")], "seq int, name string, type string, description string, chunk_id string")
    got = {r["key"]: (r["name"], r["type"], r["description"], r["chunks"]) for r in graph.merge_entities(m).collect()}
    assert got == {"knowledge graph": ("Knowledge Graph", "CONCEPT", "a store", 2), "fusion": ("Fusion", "OTHER", "", 1)}
    edges = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c"), ("d", "r", "a")], "source string, relation string, target string")
    seeds = spark.createDataFrame([(1, "a"), (2, "zz")], "query_id int, key string")
    assert rows(graph.neighbourhood(edges, seeds, 2).where("query_id = 1"), "key", "hop") == [("a", 0), ("b", 1), ("c", 2), ("d", 1)]
    assert graph.neighbourhood(edges, seeds, 1, limit=2).where("query_id = 1").count() == 2
    gone = spark.createDataFrame([("c1",)], "chunk_id string")
    owners = spark.createDataFrame([("v", ["c1", "c2"]), ("w", ["c1"])], "key string, chunk_ids array<string>")
    assert rows(graph.remove_provenance(owners, gone), "key") == [("v",)]
    moved = graph.remove_provenance(owners, gone, spark.createDataFrame([("c1", "c2")], "chunk_id string, by string"))
    assert {r["key"]: r["chunk_ids"] for r in moved.collect()} == {"v": ["c2"], "w": ["c2"]}
    hops = spark.createDataFrame([(1, "s", 0), (1, "n", 1)], "query_id int, key string, hop int")
    v = spark.createDataFrame([("s", "Seed", "c1"), ("s", "Seed", "c2"), ("n", "Near", "c2")], "key string, name string, chunk_id string")
    e = spark.createDataFrame([("s", "n", "c2")], "source string, target string, chunk_id string")
    out = [(r["chunk_id"], r["score"], r["via"]) for r in graph.evidence(v, e, hops).orderBy("rank").collect()]
    assert out == [("c2", 2.0, ["Near", "Seed"]), ("c1", 1.0, ["Seed"])]


def test_store_and_cascade(spark, tmp_path):
    c = spark.createDataFrame([("a1", "a", None), ("b1", "b", "a1"), ("b2", "b", "a1"), ("c1", "c", "b1")], "id string, document_id string, is_duplicate_of string")
    out = corpus.delete_documents(c, spark.createDataFrame([("a",)], "document_id string"))
    assert {r["id"]: r["is_duplicate_of"] for r in out.collect()} == {"b1": None, "b2": "b1", "c1": "b1"}
    store = corpus.SnapshotStore(spark, str(tmp_path / "s"), {"model": "m", "dim": 3})
    store.commit({"chunks": c})
    store.commit({"chunks": corpus.upsert(store.read("chunks"), spark.createDataFrame([("a1", "a", "zz")], c.schema), ["id"])})
    assert store.snapshot == 2 and store.read("chunks").where("id = 'a1'").first()["is_duplicate_of"] == "zz"
    with pytest.raises(ValueError):
        corpus.SnapshotStore(spark, str(tmp_path / "s"), {"model": "other", "dim": 3})
    with pytest.raises(RuntimeError):
        store.commit({"chunks": c}, expected=1)


def test_evaluation(spark):
    left = spark.createDataFrame([(1, "x", 0, 100), (2, "x", 50, 150), (3, "x", 51, 151), (4, "y", 0, 100), (5, "x", 100, 200)], "id int, doc string, a_start int, a_end int")
    right = spark.createDataFrame([("x", 0, 100)], "doc string, b_start int, b_end int")
    assert rows(evaluation.span_matches(left, right), "id") == [(1,), (2,)]
    judged = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, False)], "query_id int, rank int, relevant boolean")
    assert rows(evaluation.hit_and_rank(judged, 5), "query_id", "hit", "mrr") == [(1, 1.0, 0.5), (2, 0.0, 0.0)]
    means = evaluation.metric_means(spark.createDataFrame([(0.5, None), (0.5, None), (0.5, None)], "a double, b double"), [], ["a", "b"])
    assert {r["metric"]: (r["mean"], r["n"]) for r in means.collect()} == {"a": (0.5, 3), "b": (None, 0)}
    assert evaluation.grid({}) == [{}] and evaluation.grid({"a": [1, 2], "b": [3, 4]})[1] == {"a": 1, "b": 4}
    with pytest.raises(ValueError):
        evaluation.grid({"a": list(range(7))})
    assert evaluation.parse_grid_line("1, x, 2,1") == [1.0, 2.0] and evaluation.varying_keys([{"a": 1, "b": 2}, {"a": 1, "b": 3}]) == ["b"]
    assert evaluation.index_key(["b", "a"], size=1) == evaluation.index_key(["a", "b"], size=1)


def test_providers(spark):
    v = HashedEmbedder().embed_documents(["red fox", "Fox red", ""])
    assert np.allclose(v[0], v[1]) and np.isclose(np.linalg.norm(v[0]), 1) and not v[2].any()
    df = spark.createDataFrame([("x", "Blue River Bank holds. More."), ("y", None)], "id string, text string")
    assert len(df.select(embed_column(F.col("text")).alias("v")).first()["v"]) == 64
    assert "blue" in extract_entities(df, RuleExtractor()).first()["name"].lower()
    assert df.select(complete_column(F.lit("[a-1] (f)\nFirst one. Second."), FirstSentence()).alias("r")).first()["r"]["answer"] == "First one. [a-1]"


def test_redaction_any_split():
    mask = lambda t: t.replace("a@b.co", "<EMAIL>")
    text = "Mail a@b.co. Done\nnext a@b.co"
    for step in (1, 2, 5, 100):
        assert "".join(S.redact_deltas([text[i : i + step] for i in range(0, len(text), step)], mask)) == "Mail <EMAIL>. Done\nnext <EMAIL>"

    def broken(_):
        raise RuntimeError

    assert S.redact_deltas(["One. ", "Two. "], broken) == [S.WITHHELD]


def test_streams_equal_tables(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    data = [(i % 3, i, t0 + timedelta(seconds=i), f"s{i % 2}", float(i)) for i in range(30)]
    df = spark.createDataFrame(data, "run_id bigint, event_id bigint, ts timestamp, stage string, value double")
    batch = S.sequence(df)
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = S.fold_stream(S.deduplicated(stream)).writeStream.outputMode("complete").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("folded"), "run_id", "stage", "last_seq", "value") == rows(S.fold(batch), "run_id", "stage", "last_seq", "value")


def test_redacting_stream(spark, tmp_path):
    deltas = [(1, 0, "Mail a@b.", False), (1, 1, "co. Do", False), (1, 2, "ne", True), (2, 0, "x", True)]
    df = spark.createDataFrame(deltas, "stream_id bigint, seq int, delta string, final boolean")
    df.write.parquet(str(tmp_path / "in"))
    q = S.redact_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), lambda t: t.replace("a@b.co", "<EMAIL>")).writeStream.outputMode("append").format("memory").queryName("redacted").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    out = {}
    for r in spark.table("redacted").collect():
        out[r["stream_id"]] = out.get(r["stream_id"], "") + r["out"]
    assert out == {1: "Mail <EMAIL>. Done", 2: "x"}


def test_control():
    slots = control.Slots()
    with slots.hold("ingest"), pytest.raises(control.Conflict), slots.hold("eval"):
        pass
    flag, seen = threading.Event(), []
    assert control.evaluate_until_cancelled([1, 2], lambda x: x, flag) == ([1, 2], False)
    flag.set()
    assert control.evaluate_until_cancelled([1, 2], lambda x: x, flag) == ([], True)
    with pytest.raises(KeyError), control.stage(seen.append, "r", "s1"):
        raise KeyError
    assert [e["status"] for e in seen] == ["running", "error"]
    assert control.error_envelope(control.NotFound("x"))["error"] == "not_found"
