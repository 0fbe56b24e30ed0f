"""Core operators on small fixtures with expectations worked out by hand, and against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from scholium.functions import scores as S
from scholium.functions import text as T
from scholium.operators import components, evaluation, feedback, graphs, integration, retrieval, segments, views
from scholium.operators.tables import latest, upsert


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first()["x"]


def test_text_expressions(spark):
    assert one(spark, T.clean_title(F.col("a")), a="## 第一章 绪论 12") == "第一章 绪论"
    assert one(spark, T.clean_title(F.col("a")), a="Chapter 3") == "Chapter"
    assert one(spark, T.content_lines(F.col("a")), a=" a \t b　\r\n\n c ") == "a b\nc"
    assert one(spark, T.query_key(F.col("a")), a="A　b C") == "abc"
    assert one(spark, T.terms(F.col("a")), a="白细胞 ab x") == ["白细胞", "白细", "细胞", "白细胞", "ab"]
    assert one(spark, T.terms(F.col("a")), a="") == []
    assert one(spark, T.grams(F.col("a")), a="a 🧬b") == ["a🧬", "🧬b", "a🧬b"]
    assert one(spark, T.name_key(F.col("a")), a="Ａ·b（c）") == "abc" and one(spark, T.synonym_key(T.name_key(F.col("a"))), a="Leukocyte") == "白细胞"
    assert one(spark, T.token_estimate(F.col("a")), a="") == 0 and one(spark, T.token_estimate(F.col("a")), a="细胞 cell") == 3
    assert one(spark, T.sentences(F.col("a"), 2), a="甲。乙！丙") == "甲。 乙！"
    levels = {t: one(spark, T.chapter_level(F.col("a")), a=t) for t in ("绪论", "第一章 x", "第二节 x", "一、x", "（一）x", "其他")}
    assert list(levels.values()) == ["primary", "primary", "secondary", "secondary", "secondary", "content"]


CHAPTERS = "textbook_id string, chapter_ord int, chapter_id string, title string, page_start int, page_end int, content string, char_count int"


def _chapters(spark, *texts):
    return spark.createDataFrame([("b", i + 1, f"ch_{i + 1:02d}", t, 20, 21, c, len(c)) for i, (t, c) in enumerate(texts)], CHAPTERS)


def _split(text, size, overlap):
    out, start = [], 0
    while start < len(text):
        end = len(text)
        if end - start > size:
            marks = [i for i in range(start + 500, start + size) if text[i] in T.SENTENCE_MARKS]
            end = marks[-1] + 1 if marks else start + size
        out.append((start, end))
        if end == len(text):
            break
        start = max(end - overlap, start + 1)
    return out


def test_boundary_chunks_match_a_loop(spark):
    r = random.Random(2)
    texts = ["甲" * 700, "乙" * 2000, *("".join(r.choice("甲乙丙丁。；ab") if r.random() < 0.1 else "字" for _ in range(r.randint(900, 4000))) for _ in range(6))]
    rows = segments.boundary_chunks(_chapters(spark, *[(f"章{i}", t) for i, t in enumerate(texts)])).collect()
    for i, text in enumerate(texts):
        mine = sorted((x["char_start"], x["char_end"]) for x in rows if x["chapter_id"] == f"ch_{i + 1:02d}")
        assert mine == _split(text, 800, 80)


def test_stride_chunks(spark):
    rows = segments.stride_chunks(_chapters(spark, ("a", "x" * 1200), ("b", "  "))).orderBy("char_start").collect()
    assert [(r["chunk_id"], r["char_start"], r["char_end"]) for r in rows] == [("b:ch_01:chunk_001", 0, 1200), ("b:ch_01:chunk_002", 1040, 1200)]


def test_split_chapters(spark):
    files = spark.createDataFrame([("m", "前言\n# 一 甲 #\nx\n## 乙\ny")], "textbook_id string, text string")
    got = segments.split_chapters(files, markdown=True).orderBy("chapter_ord").collect()
    assert [(r["chapter_id"], r["title"]) for r in got] == [("ch_01", "正文"), ("ch_02", "一 甲"), ("ch_03", "乙")] and got[1]["content"] == "# 一 甲 #\nx"
    plain = spark.createDataFrame([("t", "第一章 绪论\r\na\r\n第 2 节 概述\r\nb")], "textbook_id string, text string")
    assert [r["title"] for r in segments.split_chapters(plain, markdown=False).orderBy("chapter_ord").collect()] == ["第一章 绪论", "第 2 节 概述"]


def test_pages(spark):
    schema = "textbook_id string, page int, line_ord int, text string, size double, bold boolean, y0 double, y1 double, page_height double"
    rows = []
    for p in range(1, 6):
        rows += [("b", p, 0, "汇编", 9.0, False, 5.0, 12.0, 800.0), ("b", p, 9, str(p), 9.0, False, 780.0, 790.0, 800.0)]
    rows += [("b", 1, 1, "第一章 绪论", 22.0, True, 200.0, 220.0, 800.0), ("b", 1, 2, "正文一。", 10.0, False, 300.0, 310.0, 800.0), ("b", 3, 1, "第二章", 22.0, True, 200.0, 220.0, 800.0), ("b", 3, 2, "细胞", 22.0, True, 230.0, 240.0, 800.0), ("b", 3, 3, "正文二。", 10.0, False, 300.0, 310.0, 800.0)]
    got = segments.chapters_from_pages(spark.createDataFrame(rows, schema)).orderBy("chapter_ord").collect()
    assert [(r["title"], r["page_start"], r["page_end"], r["content"]) for r in got] == [("第一章 绪论", 1, 2, "正文一。"), ("第二章细胞", 3, 5, "正文二。")]


def test_graph(spark):
    text = "甲" * 100
    chapters = _chapters(spark, ("节前", text), ("第一章 A", text), ("一、块", text), ("第二章 B", text), ("二、块", text), ("第一章 A", text), ("三、块", text), ("四、短", "短"))
    nodes = graphs.graph_nodes(chapters)
    got = {r["node_id"]: r["parent_id"] for r in nodes.collect()}
    assert got == {"b_ch_02_primary": None, "b_ch_03_block": "b_ch_02_primary", "b_ch_04_primary": None, "b_ch_05_block": "b_ch_04_primary", "b_ch_07_block": "b_ch_02_primary"}
    edges = graphs.graph_edges(nodes).collect()
    assert sum(e["relation"] == "contains" for e in edges) == 3 and sum(e["relation"] == "prerequisite" for e in edges) == 2


def test_components(spark):
    r = random.Random(1)
    pairs = [(f"n{r.randint(0, 60):02d}", f"n{r.randint(0, 60):02d}") for _ in range(45)] + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(20)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    linked = {x for p in pairs if p[0] != p[1] for x in p}
    got = {(r["id"], r["component"]) for r in components.connected_components(spark.createDataFrame(pairs, "u string, v string")).collect()}
    assert got == {(x, find(x)) for x in linked}


NODES = "textbook_id string, node_ord int, node_id string, name string, definition string, aliases array<string>, source_textbook_id string, chapter_id string, node_type string, level string"


def test_integration(spark):
    long1, long2 = "这是一个足够长的定义文本用于比较两本教材之间的差异。", "完全不同而且同样很长的另一段说明文字来自第二本书籍。"
    rows = [
        ("x", 1, "n1", "白细胞", long1, ["WBC"], "x", "c", "concept", "content"), ("y", 1, "n1", "白细胞", long2, [], "y", "c", "concept", "content"), ("y", 2, "n2", "leukocyte", "short", [], "y", "c", "concept", "content"),
        ("x", 2, "n2", "独特概念", "d", [], "x", "c", "concept", "content"), ("x", 3, "n3", "未命名", None, None, "x", "c", "concept", "content"),
    ]
    nodes = spark.createDataFrame(rows, NODES)
    edges = spark.createDataFrame([("x", "n1", "n2", "related", 1.0, ["e"]), ("y", "n1", "n2", "related", 1.0, ["e"])], "textbook_id string, source string, target string, relation string, weight double, evidence array<string>")
    prepared = integration.cut(integration.prepared(nodes))
    valid = prepared.where(~integration.is_empty(F.col("norm")))
    assert valid.count() == 4
    found = integration.conflicts(valid).collect()
    assert len(found) == 1 and found[0]["definition_jaccard"] < 0.3
    groups, _ = integration.merge_groups(valid)
    sizes = sorted(r["count"] for r in groups.groupBy("component").count().collect())
    assert sizes == [1, 3]
    merged = integration.merged_nodes(valid, groups).orderBy("source_count").collect()
    assert [m["name"] for m in merged] == ["独特概念", "白细胞"] and merged[1]["aliases"] == ["WBC", "leukocyte"]
    mapped = groups.join(integration.merged_nodes(valid, groups).select("component", "node_id"), "component").select("qid", "node_id")
    assert integration.merged_edges(edges, mapped).count() == 1


def test_budget_matches_a_loop(spark):
    r = random.Random(4)
    rows = [(f"k{i:02d}", "名" * r.randint(1, 9), "d" * r.randint(0, 90), [], r.randint(1, 4)) for i in range(40)]
    nodes = spark.createDataFrame(rows, "node_id string, name string, definition string, aliases array<string>, source_count int")
    edges = spark.createDataFrame([], "source string, target string")
    budget, used, kept = 700, 0, {}
    for i, name, text, _, _ in sorted(rows, key=lambda x: (-x[4], -bool(x[2]), x[0])):
        size, rest = len(name) + len(text), budget - used
        if size <= rest:
            kept[i] = text
        elif rest > len(name) + 36:
            room = max(0, rest - len(name) - 4)
            kept[i] = text[:room] + "..." if text and room > 20 else text
        else:
            continue
        used += len(name) + len(kept[i])
    assert {r["node_id"]: r["definition"] for r in integration.within_budget(nodes, edges, budget).collect()} == kept


def test_feedback(spark):
    schema = "node_id string, name string, definition string, aliases array<string>, teacher_feedback string, split_from string"
    nodes = [("kg_node_0001", "炎症", "a", [], None, None), ("kg_node_0002", "炎症反应", "long", [], None, None), ("kg_node_0003", "坏死", "c", ["死亡"], None, None), ("kg_node_0004", "水肿", "d", [], None, None)]
    edges = [("e1", "kg_node_0001", "kg_node_0003", "r", 1.0), ("e2", "kg_node_0002", "kg_node_0003", "r", 1.0), ("e3", "kg_node_0004", "kg_node_0003", "r", 1.0)]
    graph = feedback.Graph(spark.createDataFrame(nodes, schema), spark.createDataFrame(edges, "edge_id string, source string, target string, relation string, weight double"))
    assert [feedback.action(s) for s in ("不要合并A和B", "删除A", "把A拆成B、C", "合并A和B", "你好")] == ["keep", "remove", "split", "merge", "unknown"]
    after = feedback.apply(graph, "合并“炎症”和“炎症反应”。删除“水肿”；把“坏死”拆成凝固坏死、液化坏死\n你好")
    got = {r["name"]: r for r in after.nodes.collect()}
    assert set(got) == {"炎症", "凝固坏死", "液化坏死"} and got["炎症"]["definition"] == "long" and got["炎症"]["aliases"] == ["炎症反应"]
    assert after.edges.count() == 2 and after.unapplied == ["你好"]


def test_evaluation_arithmetic():
    assert evaluation.quotas(24) == {"factual": 8, "reasoning": 6, "comparative": 5, "cross_textbook": 5}
    with pytest.raises(ValueError):
        evaluation.Config("x", size=900)


def test_scores_and_views(spark):
    row = spark.sql("select array(1.0D, 0.0D) a, array(1.0D, 1.0D) b, array('x','y') p, array('y') q")
    got = row.select(S.vector_cosine(F.col("a"), F.col("b"), S.vector_norm(F.col("a")), S.vector_norm(F.col("b"))).alias("c"), S.set_jaccard(F.col("p"), F.col("q")).alias("j")).first()
    assert abs(got["c"] - 0.5**0.5) < 1e-9 and got["j"] == 0.5
    groups = views.chapter_groups(_chapters(spark, ("第一章 A", "x"), ("一、a", "yy"), ("一、a", "zz"), ("第二章 B", "w"))).orderBy("group_id").collect()
    assert [(g["group_id"], g["children"], g["char_count"]) for g in groups] == [("group_ch_01", 1, 3), ("group_ch_04", 1, 3)]  # same page: goes with the next


def test_versions(spark):
    rows = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 3, 1)], "k string, v int, ingested_at int")
    assert {(r["k"], r["v"]) for r in latest(rows, ["k"]).collect()} == {("a", 2), ("b", 3)}
    assert {(r["k"], r["v"]) for r in upsert(rows.where("k = 'b'"), rows.where("v = 1"), ["k"]).collect()} == {("b", 3), ("a", 1)}


def test_ingest(spark, tmp_path):
    import io
    import zipfile

    from scholium.sources.files import ingest

    (tmp_path / "a.md").write_bytes("# 第一章 甲\n正文".encode("gb18030"))
    (tmp_path / "b.txt").write_bytes("﻿第一章 乙\n正文".encode())
    (tmp_path / "c.exe").write_bytes(b"x")
    (tmp_path / "d.docx").write_bytes(b"broken")
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>丙</w:t></w:r></w:p><w:p><w:r><w:t>文</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "e.docx").write_bytes(held.getvalue())
    out = ingest(spark, str(tmp_path))
    assert {(r["filename"], r["status"]) for r in out.log.collect()} == {("a.md", "completed"), ("b.txt", "completed"), ("c.exe", "failed"), ("d.docx", "failed"), ("e.docx", "completed")}
    assert {(r["textbook_id"], r["title"]) for r in out.chapters.collect()} == {("book_00", "第一章 甲"), ("book_01", "第一章 乙"), ("book_03", "丙")}


def test_stream_ingest(spark, tmp_path):
    from scholium.streaming.streams import ingest_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# 甲\nx")
    ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert [r["title"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["甲"]


def test_nearest_scores_every_node(spark):
    names = ["cell wall", "wall of bone", "bone marrow", "thin marrow", "acid", "nerve root", "root canal"]
    rows = [(f"b{i}", i, "n", n, f"part {i % 3} of the {n[:4]} tissue", [], None, None, "concept", "content") for i, n in enumerate(names)]
    valid = integration.cut(integration.prepared(spark.createDataFrame(rows, NODES)))
    merged = valid.select(F.col("qid").alias("component"), F.lit(1).alias("source_count"))
    pairs = valid.select(F.col("qid").alias("l")).crossJoin(valid.select(F.col("qid").alias("r"))).where("l <> r")
    exact = integration.scored_pairs(valid, pairs).groupBy("l").agg(F.max("similarity.final_score").alias("near")).where("near > 0")
    got = integration.nearest(valid, merged)
    assert {tuple(r) for r in got.where("near > 0").collect()} == {tuple(r) for r in exact.collect()} and exact.count() == len(rows)


def test_the_audit_log_is_made_when_asked_for(spark, monkeypatch):
    asked = []
    whole = integration._decisions
    monkeypatch.setattr(integration, "_decisions", lambda *a: asked.append(1) or whole(*a))
    nodes = spark.createDataFrame([("b0", 0, "n", "甲状腺激素", "甲状腺分泌的激素", [], None, None, "concept", "content")], NODES)
    edges = spark.createDataFrame([], "textbook_id string, source string, target string, relation string, weight double, evidence array<string>")
    done = integration.integrate(nodes, edges)
    assert done.stats.first()["source_node_count"] == 1 and not asked
    assert done.decisions.count() == done.decisions.count() >= 1 and len(asked) == 1


def test_pairs_left_out_early_never_merge(spark):
    said = ["thyroid hormone of the gland that acts on the whole body", "thyroid hormone of the gland which acts on the whole body", "no more than a word", ""]
    names = ["cell wall", "cell wall of bone", "wall", "cell wall", "bone", "bone marrow cell"]
    rows = [(f"b{i % 5}", i, f"n{i}", n, said[(i * 7) % 4], [], None, None, "concept", "primary" if i % 3 == 0 else "content") for i, n in enumerate(names * 6)]
    valid = integration.cut(integration.prepared(spark.createDataFrame(rows, NODES)))

    def merging(pairs):
        scored = integration.scored_pairs(valid, pairs)
        return {(r["l"], r["r"]) for r in scored.where(F.col("similarity.final_score") >= F.col("threshold")).collect()}

    early, every = integration.candidate_pairs(valid, merging=True), integration.candidate_pairs(valid)
    assert merging(early) == merging(every) and merging(early) and early.count() < every.count()


def test_registered_leaderboard_takes_the_whole_grid(monkeypatch):
    from scholium.operators import evaluation
    from scholium.plans import queries

    monkeypatch.setattr(queries, "table", lambda *a: None)
    monkeypatch.setattr(queries, "_titled", lambda *a: None)
    monkeypatch.setattr(evaluation, "leaderboard", lambda items, chapters, configs=evaluation.GRID: configs)
    assert queries.eval_leaderboard(None, "") == evaluation.GRID


def test_requested_rows_keep_their_order_and_missing_ids_raise(spark):
    from scholium.operators import datasets

    rows = spark.createDataFrame([("a", "A"), ("b", "B")], "textbook_id string, title string")
    ids = spark.createDataFrame([(1, "b"), (2, "zz"), (3, "a")], "ord int, textbook_id string")
    got = {r["ord"]: (r["title"], r["found"]) for r in datasets.requested(rows, ids).collect()}
    assert got == {1: ("B", True), 2: (None, False), 3: ("A", True)}
    with pytest.raises(LookupError, match="zz"):
        datasets.required(rows, ids)
    assert [r["title"] for r in datasets.required(rows, ids.where("ord <> 2")).collect()] == ["B", "A"]
    with pytest.raises(KeyError):
        datasets.resolved(None, {}, "none")


def test_dataset_falls_back_as_a_whole(spark):
    from scholium.operators import datasets

    text = "这一节说明血管的结构。" * 120
    rows = [(f"b{b}", c, f"ch_{c}", f"第{c}节 血管的结构", 30, 40, text, len(text)) for b in (1, 2) for c in (1, 2, 3)]
    chapters = spark.createDataFrame(rows, "textbook_id string, chapter_ord int, chapter_id string, title string, page_start int, page_end int, content string, char_count int")
    books = spark.createDataFrame([("b1", "甲"), ("b2", None)], "textbook_id string, title string")
    items, counts = datasets.dataset(chapters, 24, books)
    made = {r["question_id"]: r for r in items.collect()}
    assert len(made) == 24 and all(r["expected_answer"] for r in made.values()) and counts.count() > 0
    some = spark.createDataFrame([(q, "问", "答") for q in list(made)[1:]], "question_id string, question string, expected_answer string")
    assert {r["notes"] for r in datasets.dataset(chapters, 24, books, some)[0].collect()} == {"fallback-template"}
    every = spark.createDataFrame([(q, "问", "答") for q in made], "question_id string, question string, expected_answer string")
    assert {(r["notes"], r["question"]) for r in datasets.dataset(chapters, 24, books, every)[0].collect()} == {("model", "问")}


def test_numbering_by_ranges(spark):
    from pyspark.sql import functions as F

    from scholium.operators.tables import numbered

    rows = spark.range(500).select((F.col("id") * 7919 % 500).alias("k"), (F.col("id") % 5).alias("n"))
    got = numbered(rows, ["k"], "place", {"total": F.col("n")}).orderBy("place").collect()
    assert [r["k"] for r in got] == list(range(500)) and [r["place"] for r in got] == list(range(1, 501))
    total = 0
    for r in got:
        total += r["n"]
        assert r["total"] == total
    assert numbered(rows.limit(0), ["k"], "place").count() == 0


def test_budget_is_folded_in_order(spark, monkeypatch):
    from scholium.operators import integration

    rows = [(f"kg_node_{i:04d}", f"name{i}", "d" * (300 if i == 3 else 20 + i), [], 10 - i % 3) for i in range(12)]
    nodes = spark.createDataFrame(rows, "node_id string, name string, definition string, aliases array<string>, source_count int")
    edges = spark.createDataFrame([("kg_node_0001", "kg_node_0002")], "source string, target string")

    def brute(budget):
        degree = {"kg_node_0001": 1, "kg_node_0002": 1}
        used, out = 0, {}
        for node, name, said, _, count in sorted(rows, key=lambda r: (-r[4], -degree.get(r[0], 0), r[0])):
            size = len(name) + len(said)
            used, taken, at = integration._fitted({"size": size, "name": len(name), "alias": 0, "said": len(said)}, used, budget)
            if taken:
                out[node] = said if at is None else said[:at] + "..."
        return out

    monkeypatch.setattr(integration, "STEP", 2)
    for budget in (30, 150, 260, 1_000):
        got = {r["node_id"]: r["definition"] for r in integration.within_budget(nodes, edges, budget).collect()}
        assert got == brute(budget)


def test_stores_and_index(spark, tmp_path):
    from scholium.sources import store

    chapters = spark.createDataFrame([("b1", 1, "ch_01", "第一章 血管", 20, 30, "血管的结构。" * 200, 1200)], "textbook_id string, chapter_ord int, chapter_id string, title string, page_start int, page_end int, content string, char_count int")
    folder = str(tmp_path / "index")
    first = store.build_index(chapters, folder)
    assert first.count() > 1 and store.manifest(spark, folder).count() == 1
    both = chapters.unionByName(chapters.selectExpr("'b2' as textbook_id", *chapters.columns[1:]))
    assert {r[0] for r in store.build_index(both, folder).select("textbook_id").distinct().collect()} == {"b1", "b2"} and store.manifest(spark, folder).count() == 2
    assert store.clear(spark, folder) and not store.clear(spark, folder) and store.manifest(spark, folder).count() == 0
    held = spark.createDataFrame([("b1", "s1"), ("b2", "s2")], "textbook_id string, signature string")
    new = spark.createDataFrame([("b1", "s1"), ("b1", "s3")], "textbook_id string, signature string")
    after = store.put(held, new)
    assert after.count() == 3 and store.delete(after, "b2").count() == 2 and store.get(after, "b1").count() == 1
    with pytest.raises(LookupError):
        store.get(after, "none")


def test_model_connectors_and_small_forms(spark):
    from pyspark.sql import functions as F

    from scholium.functions import text as T
    from scholium.operators import quality, segments
    from scholium.sources import providers

    rows = spark.createDataFrame([("1", "ab"), ("2", "boom"), ("3", "c")], "k string, t string")

    def fails(texts):
        if "boom" in texts:
            raise OSError
        return [[1.0]] * len(texts)

    assert {r["k"]: r["embedding"] for r in providers.embed(rows, "k", "t", fails, batch=1).collect()} == {"1": [1.0], "2": None, "3": [1.0]}
    replies = providers.ask(rows.withColumn("textbook_id", F.lit("b")), "k", "t", providers.echo)
    assert replies.where("error is null").count() == 3
    got = spark.createDataFrame([("12", "a b/c"), (" ", "__"), ("x", "é" * 90)], "n string, i string").select(T.optional_int(F.col("n")), T.collection_name(F.col("i"))).collect()
    assert [tuple(r) for r in got] == [(12, "rag_a_b_c"), (None, "rag_default"), (None, "rag_default")]
    blocks = spark.createDataFrame([(1, [([("Cha", 10.0, "Serif"), ("pter 1\nnext", 14.0, "Serif-Bold")],), ([("  ", 9.0, "x")],), (None,)])], "page int, lines array<struct<spans: array<struct<text: string, size: double, font: string>>>>")
    assert [(r["text"], r["size"], r["bold"]) for r in segments.block_lines(blocks).orderBy("line_ord").collect()] == [("Chapter 1", 14.0, True), ("next", 14.0, True)]
    uploads = spark.createDataFrame([("f", "failed", "bad bytes", None)], "filename string, status string, error string, textbook_id string")
    books = spark.createDataFrame([], "textbook_id string, filename string, total_pages int, total_chars int")
    chapters = spark.createDataFrame([], "textbook_id string, title string, char_count int, page_start int, page_end int")
    report = quality.upload_quality(uploads, books, chapters).first()
    assert (report["score"], report["level"], report["warnings"]) == (0.0, "failed", ["bad bytes"])


def test_conflicts_of_one_merged_node_are_attached_once(spark):
    from scholium.operators import integration

    found = spark.createDataFrame([("n", "a", "b", 0.9, 0.1), ("n", "a", "c", 0.9, 0.1)], "normalized_name string, left_id string, right_id string, token_jaccard double, definition_jaccard double")
    node_map = spark.createDataFrame([("a", "kg1"), ("b", "kg1"), ("c", "kg2")], "qid string, node_id string")
    kept = spark.createDataFrame([("kg1",)], "node_id string")
    assert [(r["node_id"], len(r["conflicts"])) for r in integration.node_conflicts(found, node_map, kept).collect()] == [("kg1", 2)]


def test_lexical_search_against_brute_force(spark):
    from pyspark.sql import functions as F

    from scholium.operators import retrieval

    chunks = spark.createDataFrame([("c1", "血管", 30, "血管的结构与功能 blood vessel"), ("c2", None, None, None), ("c3", "", 1, ""), ("c4", "Vessel", 40, "vessel vessel blood")], "chunk_id string, chapter_title string, page_start int, text string")
    asked = spark.createDataFrame([("q1", "血管的结构"), ("q2", "blood vessel"), ("q3", None), ("q4", "")], "question_id string, question string")
    pairs = {(r["question_id"], r["chunk_id"]): r for r in retrieval.lexical_pairs(asked, chunks, "hybrid").collect()}
    assert set(pairs) == {("q1", "c1"), ("q2", "c1"), ("q2", "c4")} and pairs["q1", "c1"]["within"] == 0.15
    want = chunks.select("chunk_id", F.size(retrieval.T.terms(F.col("text")))).collect()
    assert {r[0]: r[1] for r in want}["c1"] == len(retrieval._terms("血管的结构与功能 blood vessel"))
    assert retrieval.lexical_top(asked.limit(0), chunks).count() == 0 and retrieval.lexical_top(asked, chunks.limit(0)).count() == 0


@pytest.mark.parametrize(("words", "copies", "k"), [(4, 6, 5), (40, 1, 5), (3, 12, 4)])
def test_best_cross_pairs_against_all_pairs(spark, words, copies, k):
    # few titles and many copies (scores of 1), or hardly anything in common (scores below 0.7)
    rng = random.Random(words)
    said = lambda n: " ".join(f"w{rng.randrange(words * 3)}" for _ in range(n))
    texts = [(said(3), said(8)) for _ in range(12)]
    rows = [(f"b{j % 5}:ch_{i:02d}:{j:02d}", f"b{j % 5}", t, e) for i, (t, e) in enumerate(texts) for j in range(i % 5, i % 5 + copies)]
    sets = [(s, b, set(t.split()), set(e.split())) for s, b, t, e in sorted(rows)]
    share = lambda x, y: len(x & y) / len(x | y)
    scored = [(-round(share(x[2], y[2]) * 0.7 + share(x[3], y[3]) * 0.3, 4), x[0], y[0]) for i, x in enumerate(sets) for y in sets[i + 1 :] if x[1] != y[1]]
    want = [(left, right) for score, left, right in sorted(scored) if score <= -0.16][:k]
    out = evaluation.cross_pairs(spark.createDataFrame(rows, "source_id string, textbook_id string, title string, excerpt string"), k)
    assert [(r["l"], r["r"]) for r in out.orderBy(F.desc("score"), "l", "r").collect()] == want


def test_candidates_alone_are_measured(spark, monkeypatch):
    chunks = spark.createDataFrame([(f"c{i}", "标题", 1, 2, f"白细胞 与 红细胞 {i} cell w{i % 7}") for i in range(40)], "chunk_id string, chapter_title string, page_start int, page_end int, text string")
    asked = spark.createDataFrame([("q1", "白细胞 cell w3"), ("q2", "nothing"), ("q3", None), ("q4", "红细胞 5 cell")], "question_id string, question string")
    some = spark.createDataFrame([("q1", "c3", 0.5), ("q1", "c4", 0.9), ("q2", "c1", 0.2), ("q3", "c2", 0.1), ("q4", "c5", 0.4), ("q1", "no", 0.3)], "question_id string, chunk_id string, similarity double")
    for mode in ("hybrid", "vector"):
        lexical = retrieval.lexical_pairs(asked, chunks, mode)
        every = some.join(lexical, ["question_id", "chunk_id"], "left").fillna(0.0, ["keyword", "title", "ngram", "within", "low"]).withColumn("score", retrieval.mode_score(mode, F.col("similarity")))
        want = retrieval.top(every, 5, 0.0).select("question_id", "chunk_id", F.round("score", 4), "rank").collect()
        with monkeypatch.context() as m:
            m.setattr(retrieval, "lexical_pairs", None)  # all questions with all chunks were measured
            assert sorted(retrieval.reranked(asked, some, chunks, mode).collect()) == sorted(want)


def test_conflicts_compare_classes_of_nodes(spark):
    # copies of a few definitions: what is compared is a few classes, what comes out is every pair
    said = ["alpha beta gamma delta epsilon", "zeta eta theta iota kappa lambda", "alpha beta gamma delta epsilon zeta"]
    rows = [(f"b{i % 4}", i, f"n{i:02d}", "Cell wall", said[i % 3]) for i in range(18)]
    nodes = spark.createDataFrame(rows, "textbook_id string, node_ord int, node_id string, name string, definition string")
    nodes = nodes.selectExpr("*", "cast(null as array<string>) aliases", "'content' level", "'content' node_type")
    out = integration.conflicts(integration.prepared(nodes))
    sets = [(r[0], r[1], f"{r[0]}:{r[2]}", set(r[4].split()), r[4]) for r in sorted(rows)]
    share = lambda x, y: len(x & y) / len(x | y)
    want = [(x[2], y[2], x[4], y[4]) for i, x in enumerate(sets) for y in sets[i + 1 :] if x[0] != y[0] and share(x[3], y[3]) < 0.3]
    assert sorted(tuple(r) for r in out.select("left_id", "right_id", "left_definition", "right_definition").collect()) == sorted(want)
    # what is compared was joined before anything was grouped
    assert "Aggregate" in out._jdf.queryExecution().optimizedPlan().toString()


def test_evaluation_keeps_the_best_pairs_of_all(spark):
    from pyspark.sql.window import Window

    r = random.Random(9)
    words = ["细胞", "血小板", "骨骼", "信号", "cell", "结构", "。", "疾病"]
    said = lambda n: "".join(r.choice(words) for _ in range(n))
    rows = [(f"c{i:03d}", "b", r.choice(["目录", "细胞结构", "骨骼 cell", None]), r.choice([5, 30]), r.choice([said(4), said(30), None])) for i in range(300)]
    chunks = spark.createDataFrame(rows + [(f"d{i:03d}", *rows[7][1:]) for i in range(40)], "chunk_id string, textbook_id string, chapter_title string, page_start int, text string").repartition(3)
    questions = spark.createDataFrame([(f"q{i}", r.choice(["细胞信号", "骨骼疾病 cell", "什么是血小板", said(3)])) for i in range(12)] + [("e", ""), ("n", None)], "question_id string, question string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        for mode in ("keyword", "char_ngram", "hybrid", "vector"):
            config = evaluation.Config(mode, mode=mode, top_k=4)
            got = evaluation.eval_matches(questions, chunks, config)
            scores = evaluation.eval_scores(questions, chunks, mode).where(F.col("score") >= config.min_score).withColumn("score", F.round("score", 4))
            want = scores.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id"))).where("rank <= 4")
            key = lambda df: sorted(map(tuple, df.select("question_id", "rank", "chunk_id", "score").collect()))
            assert key(got) == key(want) and got.count() > 20
            weigh = lambda rows, body, head, low: rows["within"].to_numpy() * 0
            left = evaluation.phrased_pairs(questions, chunks, "hybrid", weigh, F.lit(False), 4, 0.0)
            assert left.count() <= left.rdd.getNumPartitions() * 4 * 14
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_leaderboard_cuts_chapters_once_for_each_size(spark, monkeypatch):
    chapters = _chapters(spark, ("细胞", "细胞信号。血小板凝集。" * 60), ("骨骼", "骨骼生长。" * 90)).withColumn("textbook_title", F.lit("书"))
    cite = "array<struct<textbook_id:string,chapter_id:string,page_start:int,page_end:int,excerpt:string>>"
    items = spark.createDataFrame([("q1", "细胞信号", "细胞信号", [("b", "ch_01", 20, 21, "细胞信号")])], f"question_id string, question string, expected_answer string, expected_citations {cite}")
    made, real = [], evaluation.eval_chunks
    monkeypatch.setattr(evaluation, "eval_chunks", lambda c, config: made.append(config.size) or real(c, config))
    board = evaluation.leaderboard(items, chapters).collect()
    assert made == [650, 560, 760] and [x["rank"] for x in board] == [1, 2, 3, 4, 5, 6] and board[0]["exact_citation_hit_rate"] == 1.0


def test_candidate_pairs_are_planned_in_parts(spark):
    nodes = spark.createDataFrame([("a", "n1", 1, "细胞", "甲乙"), ("b", "n1", 1, "细胞", "丙丁"), ("b", "n2", 2, "细胞膜", "戊己")], "textbook_id string, node_id string, node_ord int, name string, definition string")
    none = F.lit(None).cast("string")
    nodes = nodes.select("*", F.array().cast("array<string>").alias("aliases"), F.lit("content").alias("level"), F.lit("concept").alias("node_type"), none.alias("category"))
    pairs = integration.candidate_pairs(integration.prepared(nodes), merging=True)
    assert sorted(map(tuple, pairs.collect())) == [("a:n1", "b:n1"), ("a:n1", "b:n2"), ("b:n1", "b:n2")]
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 2


def _joins(monkeypatch, *modules):
    """The number of joins in the plan of each cut that these modules make from now on."""
    counts = []
    for module in modules:
        whole = module.cut
        monkeypatch.setattr(module, "cut", lambda df, whole=whole: counts.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join ")) or whole(df))
    return counts


def test_stars_of_components_are_planned_one_by_one(spark, monkeypatch):
    counts = _joins(monkeypatch, components)
    chain = spark.range(40).selectExpr("format_string('%02d', id) u", "format_string('%02d', id + 1) v")
    assert components.connected_components(chain).groupBy("component").count().collect() == [("00", 41)]
    assert len(counts) > 5 and max(counts) == 1


def test_parts_of_the_integration_are_planned_and_made_when_needed(spark, monkeypatch):
    made = []
    whole = integration.conflicts
    monkeypatch.setattr(integration, "conflicts", lambda *a: made.append(1) or whole(*a))
    counts = _joins(monkeypatch, integration)
    rows = [(f"b{i % 2}", i, f"n{i}", n, f"{n} and its definition {i}", [], None, None, "concept", "content") for i, n in enumerate(["cell wall", "cell", "wall", "cell wall", "bone"])]
    edges = spark.createDataFrame([("b0", "n0", "n4", "related", 1.0, ["e"])], "textbook_id string, source string, target string, relation string, weight double, evidence array<string>")
    done = integration.integrate(spark.createDataFrame(rows, NODES), edges)
    assert done.stats.count() == 1 and not made
    assert done.conflicts.count() == done.conflicts.count() >= 0 and len(made) == 1
    # no plan holds that of another part: names inside names were four joins under those of the nodes, the map of nodes was one of the edges' sides, twice
    assert max(counts) <= 4


def test_a_name_of_many_classes_is_compared_in_blocks(spark, monkeypatch):
    rows = [(f"b{i % 3}", i, f"n{i:02d}", "Cell wall", f"w{i}a w{i}b w{i // 2}c w{i // 4}d and so on") for i in range(24)]
    nodes = spark.createDataFrame(rows, "textbook_id string, node_ord int, node_id string, name string, definition string")
    nodes = integration.cut(integration.prepared(nodes.selectExpr("*", "cast(null as array<string>) aliases", "'content' level", "'content' node_type")))
    at = ["left_id", "right_id", "definition_jaccard"]
    whole = sorted(map(tuple, integration.conflicts(nodes).select(at).collect()))
    monkeypatch.setattr(integration, "COMPARED", 5)
    assert sorted(map(tuple, integration.conflicts(nodes).select(at).collect())) == whole and len(whole) > 100


@pytest.mark.parametrize(("names", "n"), [((40,), 24), ((40, 3), 24), ((8, 2, 6), 30), ((), 24), ((6, 6, 6, 6), 18)])
def test_plans_against_a_loop(spark, names, n):
    """One book has no pairs, so that factual plans take their place; ids are in another order than sources."""
    rng = random.Random(n + len(names))
    said = lambda k: " ".join(f"w{rng.randrange(9)}" for _ in range(k))
    rows = [(f"b{b}:ch_{(i * 7) % size}:src_01", f"b{b}", f"{said(2)}", said(6), i + 1) for b, size in enumerate(names) for i in range(size)]
    share = lambda x, y: len(set(x.split()) & set(y.split())) / len(set(x.split()) | set(y.split()))
    met = [(round(share(x[2], y[2]) * 0.7 + share(x[3], y[3]) * 0.3, 4), x[0], y[0]) for i, x in enumerate(rows) for y in rows[i + 1 :] if x[1] != y[1]]
    met = [[x, y] for s, x, y in sorted((p for p in met if p[0] >= 0.16), key=lambda p: p[0], reverse=True)]
    want, turn = evaluation.quotas(n), rows[1:] + rows[:1]
    made = [("factual", [rows[i % len(rows)][0]]) for i in range(want["factual"]) if rows] + [("reasoning", [turn[i % len(rows)][0]]) for i in range(want["reasoning"]) if rows]
    c, x = want["comparative"], want["cross_textbook"]
    made += [("comparative", p) for p in met[:c]] + [("cross_textbook", p) for p in met[c : c + x]]
    while rows and len(made) < n:
        made.append(("factual", [rows[len(made) % len(rows)][0]]))
    out = evaluation.plans(spark.createDataFrame(rows, "source_id string, textbook_id string, title string, excerpt string, rank int"), n).orderBy("plan_id").collect()
    assert [(r["plan_id"], r["question_type"], r["source_ids"]) for r in out] == [(f"plan_{i:03d}", *p) for i, p in enumerate(made[:n], 1)]


@pytest.mark.parametrize("block", [5, 65_536])
def test_nearest_scores_are_found_without_pairs_as_rows(spark, monkeypatch, block):
    """Names inside and equal to others, synonyms, no tokens at all; blocks of few nodes or of all."""
    monkeypatch.setattr(integration, "NEAR", block)
    rng = random.Random(block)
    names = ["骨", "骨髓", "骨髓细胞", "cell wall", "cell wall", "wall", "白细胞", "炎症", "炎症反应", "-", "acid 骨", "LPK信号"]
    words = ["骨的", "生长", "bone", "cell", "细胞", "the", "信号"]
    rows = [(f"b{i % 3}", i, f"n{i}", rng.choice(names), " ".join(rng.choices(words, k=rng.randrange(6))), rng.choice([[], ["骨"]]), None, None, "concept", rng.choice(["content", "primary"])) for i in range(36)]
    valid = integration.cut(integration.prepared(spark.createDataFrame(rows, NODES)))
    merged = valid.select(F.col("qid").alias("component"), (1 + F.col("node_ord") % 4 / 3).cast("int").alias("source_count"))
    pairs = valid.select(F.col("qid").alias("l")).crossJoin(valid.select(F.col("qid").alias("r"))).where("l <> r")
    exact = integration.scored_pairs(valid, pairs).groupBy("l").agg(F.max("similarity.final_score").alias("near"))
    want = dict(map(tuple, exact.join(merged.where("source_count = 1").select(F.col("component").alias("l")), "l").collect()))
    monkeypatch.setattr(integration, "candidate_pairs", None)
    monkeypatch.setattr(integration, "scored_pairs", None)
    assert dict(map(tuple, integration.nearest(valid, merged).collect())) == want and len(want) > 20
