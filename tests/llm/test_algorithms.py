"""Problems 3, 4, 5, 6, 8 and 9 against brute force."""

import math
import random
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scholium.llm import components, leakage, neighbours, packing, splitting, survivors


def _union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {(x, find(x)) for x in parent}


def test_components_match_union_find(spark):
    r = random.Random(3)
    pairs = [(f"n{r.randint(0, 150):03d}", f"n{r.randint(0, 150):03d}") for _ in range(110)]
    pairs += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("hub", f"h{i}") for i in range(80)]
    rows = [(a, b, "x") for a, b in [*pairs, *pairs[:9]]] + [(None, "n001", "x"), ("n002", None, "x")]
    got = components.components(spark.createDataFrame(rows, "a string, b string, label string"))
    assert {(x["node"], x["label"]) for x in got.collect()} == _union_find([p for p in pairs if p[0] != p[1]])
    assert components.components(spark.createDataFrame([], "a string, b string")).count() == 0


DECISIONS = "action string, node_ids array<string>, affected_nodes array<string>, group_key string"


def test_decision_groups(spark):
    rows = [("merge", ["b", "a", None, "a"], None, "x"), ("merge", None, ["b", "c"], "x"), ("keep", ["a", "z"], ["a", "z"], "x"), ("merge", [], [], "x"), ("merge", ["solo"], None, "x"), ("merge", None, None, None)]
    got = components.decision_groups(spark.createDataFrame(rows, DECISIONS)).collect()
    assert {(r["group_key"], r["node_key"]) for r in got} == {("a", "a"), ("a", "b"), ("a", "c")}


NODES = "textbook_id string, node_id string, name string, definition string, aliases array<string>, source_textbook_id string, chapter_id string, node_type string, level string, category string, chapter_title string, page_start int, page_end int, frequency int, source_excerpt string, extractor string, updated_at timestamp, trust string, group_key string"


def _node(i, definition, extractor="llm", day=1, page=1, chapter="c"):
    return ("t", f"n{i}", f"name{i}", definition, [], "t", chapter, "concept", "content", None, "ch", page, page, 1, "e", extractor, datetime(2024, 1, day), "clash", "clash")


def test_survivors(spark):
    rows = [_node(1, "long definition"), _node(2, "none", day=1), _node(2, "none", day=1), _node(3, "same text here"), _node(4, "same text here"), _node(5, "abc", day=3), _node(6, "abcdef", day=1), _node(7, None, None)]
    groups = spark.createDataFrame([("g1", "t:n1"), ("g1", "t:n2"), ("g2", "t:n3"), ("g2", "t:n4"), ("g3", "t:n5"), ("g3", "t:n6"), ("g4", "t:n7"), ("g4", "t:gone")], "group_key string, node_key string")
    trust = spark.createDataFrame([("llm", 3)], "extractor string, trust int")
    out = {r["group_key"]: r for r in survivors.survivors(groups, spark.createDataFrame(rows, NODES), trust).collect()}
    assert {g: r["best_key"] for g, r in out.items()} == {"g1": "t:n1", "g2": None, "g3": None, "g4": "t:n7"}
    assert out["g1"]["definition"] == "long definition" and out["g1"]["pages_from"] == "t:n1" and out["g1"]["member_count"] == 2
    assert survivors.survivors(groups.limit(0), spark.createDataFrame(rows, NODES), trust).count() == 0


_CANDIDATES = st.lists(st.tuples(st.integers(0, 9), st.integers(0, 3)), min_size=4, max_size=9)


@given(_CANDIDATES, _CANDIDATES, _CANDIDATES)
def test_branch_and_bound_is_exact(places, pages, excerpts):
    """Against every consistent choice; each value that may be set has a candidate in each bundle that needs it."""
    every = [places] + [some + [(0, v) for v in range(4)] for some in (pages, excerpts)]
    bundles = [[(float(w), f"{b}{i:02d}", v if b == 0 else None, v if b else None) for i, (w, v) in enumerate(some)] for b, some in enumerate(every)]
    solutions = [(-(x[0] + y[0] + z[0]), [x[1], y[1], z[1]]) for x in bundles[0] for y in bundles[1] for z in bundles[2] if x[2] == y[3] == z[3]]
    worth, sources = min(solutions)
    assert survivors.branch_and_bound(bundles) == (-worth, sources)


def test_bundles_keep_to_their_dependencies(spark):
    """Bundle by bundle the best place, pages and excerpt are of three chapters; together they aren't consistent."""
    full = dict(chapter="good", page=None)
    rows = [
        (*_node(1, "a definition", "low", **full)[:14], None, "high", datetime(2024, 1, 1), "", ""),  # the best place: trusted, but no pages and no excerpt
        (*_node(2, "a definition", "mid", chapter="other", page=7)[:13], None, None, "mid", datetime(2024, 1, 1), "", ""),
        _node(3, "a definition", "mid", chapter="third", page=8),
        _node(4, "another definition of it", "low", chapter="third", page=None),
    ]
    groups = spark.createDataFrame([("g", f"t:n{i}") for i in (1, 2, 3, 4)], "group_key string, node_key string")
    trust = spark.createDataFrame([("low", 0), ("mid", 1), ("high", 4)], "extractor string, trust int")
    out = survivors.survivors(groups, spark.createDataFrame(rows, NODES), trust).first()
    chapter = {"t:n1": "good", "t:n2": "other", "t:n3": "third", "t:n4": "third"}
    assert {chapter[out[f"{b}_from"]] for b in ("place", "pages", "excerpt")} == {"third"}
    assert out["chapter_id"] == "third" and out["page_start"] == 8 and out["source_excerpt"] == "e" and out["best_key"] is None
    assert out["kind_from"] in ("t:n1", "t:n2", "t:n3") if out["definition"] == "a definition" else out["kind_from"] == "t:n4"


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab 。\n，；x", max_size=600), st.integers(20, 120), st.integers(0, 15))
def test_pieces_cover_and_overlap(text, limit, overlap):
    pieces = splitting.split(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(end - start <= limit for start, end, _ in pieces)
    if len(text) > limit:
        assert all(after[0] == before[1] - overlap for before, after in zip(pieces, pieces[1:]))


def test_pieces_end_at_sentences():
    text = "".join(f"第{i}句的内容在这里。" for i in range(60))
    assert all(text[end - 1] == "。" for _, end, _ in splitting.split(text, 100, 10))


def test_pieces_rows(spark):
    limits = spark.createDataFrame([("chunk", 50, 5, "characters"), ("container", 9, None, "tokens"), ("chapter", 60, None, "characters")], "item_kind string, max_size int, overlap int, unit string")
    rows = spark.createDataFrame([("chunk", "a", "x" * 120, 1), ("chunk", "b", "x" * 50, 1), ("chunk", "c", None, 1), ("chapter", "d", "", 1), ("chapter", "e", "y" * 61, 1)], "item_kind string, item_key string, text string, _limit int")
    out = splitting.pieces(rows, limits).collect()
    assert {r["item_key"] for r in out} == {"a", "e"} and max(len(r["text"]) for r in out if r["item_key"] == "a") <= 50
    assert splitting.pieces(rows.limit(0), limits).count() == 0


def _vectors(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=(120, 64))
    rows = [(f"v{i:03d}", b.astype(float).tolist()) for i, b in enumerate(base)]
    rows += [(f"w{i:03d}", (b * 3 + r.normal(size=64) * 0.2).tolist()) for i, b in enumerate(base[:40])]
    rows += [("v000", rows[0][1]), ("copy", (base[0] * 2).tolist()), ("none", None), ("zero", [0.0] * 64), ("cut", [1.0] * 32), ("blank", base[1].tolist())]
    vectors = spark.createDataFrame(rows, "chunk_id string, embedding array<float>")
    models = spark.createDataFrame([(k, " " if k == "blank" else "m", 1) for k, _ in rows], "chunk_id string, embedding_model string, grp int")
    return vectors, models, rows


def test_similar_pairs_match_brute_force(spark):
    vectors, models, rows = _vectors(spark)
    got = {(r["a"], r["b"]) for r in neighbours.similar_pairs(neighbours.usable(vectors, models), 0.9).collect()}
    unit = {k: np.array(v) / np.linalg.norm(v) for k, v in rows if v is not None and len(v) == 64 and any(v) and k != "blank"}
    keys = sorted(unit)
    assert got == {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if unit[a] @ unit[b] >= 0.9}
    assert neighbours.similar_pairs(neighbours.usable(vectors.limit(0), models), 0.9).count() == 0


def test_recall(spark):
    from pyspark.sql import functions as F

    vectors, models, _ = _vectors(spark)
    used = neighbours.usable(vectors, models)
    asked = F.col("id").endswith("3")
    exact = {(r["query"], r["id"]) for r in neighbours.brute_force(used, asked, 5).collect()}
    found = {(r["query"], r["id"]) for r in neighbours.neighbours(used, asked, 5).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_groups_dont_crowd_each_other_out(spark):
    from pyspark.sql import functions as F

    r = np.random.default_rng(12)
    base = r.normal(size=64)
    rows = [(f"{g}{i:03d}", (base + r.normal(size=64) * (0.1 if g == "n" else 0.6)).tolist(), g) for g in "mn" for i in range(150)]
    vectors = spark.createDataFrame(rows, "chunk_id string, embedding array<float>, embedding_model string")
    used = neighbours.usable(vectors.select("chunk_id", "embedding"), vectors.select("chunk_id", "embedding_model"))
    asked = F.col("id").endswith("7")
    exact = {(x["query"], x["id"]) for x in neighbours.brute_force(used, asked, 5).collect()}
    found = {(x["query"], x["id"]) for x in neighbours.neighbours(used, asked, 5, probes=300).collect()}
    # the shortlist by the tables is approximate; that of one group must not be filled by the other
    assert len(exact & found) / len(exact) >= 0.9 and len(found) == len(exact)


def test_neighbours_give_copies_back(spark):
    from pyspark.sql import functions as F

    r = np.random.default_rng(8)
    base = r.normal(size=(60, 64)).tolist()
    rows = [(f"a{i:02d}", v) for i, v in enumerate(base)] + [(f"b{i:02d}", v) for i, v in enumerate(base[:30])] + [(f"c{i:02d}", base[0]) for i in range(8)]
    vectors = spark.createDataFrame(rows, "chunk_id string, embedding array<float>")
    used = neighbours.usable(vectors, vectors.select("chunk_id", F.lit("m").alias("embedding_model")))
    keys = sorted(dict(rows))
    unit = np.array([np.array(dict(rows)[k]) / np.linalg.norm(dict(rows)[k]) for k in keys])
    exact = np.round(unit @ unit.T, 6)
    np.fill_diagonal(exact, -9)
    want = {(keys[i], keys[j]) for i in range(len(keys)) for j in np.argsort(-exact[i], kind="stable")[:5] if keys[i] > "b"}
    for of in (neighbours.neighbours, neighbours.brute_force):
        assert {(x["query"], x["id"]) for x in of(used, F.col("id") > "b", 5).collect()} == want


@pytest.mark.parametrize("levels", [1, 16])
def test_probes_grow_with_the_lists(levels):
    r = np.random.default_rng(2)
    x = r.normal(size=(12_000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    coarse = neighbours._kmeans(x, 1_024, 2, spherical=True)
    rest = x - coarse[(x @ coarse.T).argmax(1)]
    fine = neighbours._kmeans(rest, levels, 2, spherical=False) if levels > 1 else np.zeros((1, 64), dtype=np.float32)
    q = neighbours.Quantisers(coarse, fine, r.normal(size=(8, 256, 8)).astype(np.float32) * 0.1)
    grp = np.array(["m"] * len(x), dtype=object)
    some = x[-500:]
    y = (0.9 * some + np.sqrt(0.19) * _across(r, some)).astype(np.float32)
    neighbours.pair_probes(0.9)(q, x, grp)
    met = [bool(set(a) & {c} or set(b) & {d}) for a, b, c, d in zip(q.nearest(some), q.nearest(y), q.assign(y), q.assign(some))]
    assert np.mean(met) >= 0.995 and 4 < q.visits < 0.1 * q.lists
    exact = some @ x.T
    exact[np.arange(500), np.arange(len(x) - 500, len(x))] = -9
    top = np.argsort(-exact, axis=1)[:, :10]
    neighbours.nearest_probes(10)(q, x, grp)
    own, visited = q.assign(x), q.nearest(some)
    assert np.mean([own[j] in set(lists) for lists, row in zip(visited, top) for j in row]) >= 0.97


def test_bytes_bound_the_cosine():
    r = np.random.default_rng(4)
    x = r.normal(size=(500, 64)) * r.exponential(size=(1, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    small, scale = neighbours._small(x)
    y = small.astype(np.float32) * scale[:, None]
    assert (np.abs(x @ x.T - y @ y.T) <= (scale[:, None] + scale) * 4 * 1.05).all()


def test_any_number_of_partners_is_found(spark):
    """Far more partners than any shortlist holds, in one list that is longer than a block."""
    from pyspark.sql import functions as F

    r = np.random.default_rng(9)
    base = r.normal(size=64)
    rows = [(f"v{i:04d}", (base + r.normal(size=64) * 0.1).tolist()) for i in range(300)] + [(f"w{i:04d}", r.normal(size=64).tolist()) for i in range(100)]
    vectors = spark.createDataFrame(rows, "chunk_id string, embedding array<float>")
    used = neighbours.usable(vectors, vectors.select("chunk_id", F.lit("m").alias("embedding_model")))
    unit = np.array([np.array(v, dtype=np.float32) / np.linalg.norm(v) for _, v in rows])
    want = {(rows[i][0], rows[j][0]) for i, j in zip(*np.nonzero(np.triu(unit @ unit.T, 1) >= 0.95))}
    block, neighbours.BLOCK = neighbours.BLOCK, 64
    try:
        found, members = neighbours.similar_classes(used, 0.95)
        assert {(x["a"], x["b"]) for x in found.collect()} == want and members.count() == 0 and len(want) > 30_000
    finally:
        neighbours.BLOCK = block


def test_exact_vectors_are_shuffled_and_stored_once(spark):
    vectors, models, _ = _vectors(spark)
    base = neighbours.stage(neighbours.usable(vectors, models), "vectors")
    index, members, _ = neighbours.build_index(base, 4)
    assert "unit" not in index.columns
    # copies are told by a digest: no exchange of the membership carries vectors
    plan = members._jdf.queryExecution().sparkPlan().toString()
    assert "sha2" in plan and not [x for x in plan.splitlines() if "Join" in x and "unit" in x]
    assert sorted(map(tuple, members.select("rep", "id").collect())) == [("copy", "copy"), ("copy", "v000")]


def _across(r, x):
    z = r.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    return z / np.linalg.norm(z, axis=1, keepdims=True)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 100), st.integers(0, 100)), min_size=1, max_size=60))
def test_fill_respects_all_limits(items):
    size = np.array([(t, 1, min(t, loss, 90)) for t, loss in items], dtype=float)
    bins = packing.fill(size, np.array([100, 4, 90.0]))
    for b in set(bins):
        assert (size[bins == b].sum(0) <= [100, 4, 90]).all()
    with pytest.raises(ValueError):
        packing.fill(np.array([[95.0, 1, 95]]), np.array([100, 4, 90.0]))


def test_every_limit_holds(spark):
    r = random.Random(2)
    rows = [(i, "prompt here\n" * (i % 2) + " ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(r.choice((3, 40, 200, 480)))), 12 * (i % 2)) for i in range(400)]
    limits = spark.createDataFrame([("container", 256, None, "tokens")], "item_kind string, max_size int, overlap int, unit string")
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, prompt int")
    from pyspark.sql import functions as F

    for bounds in ({}, {"max_segments": 3, "max_loss": 150}):
        packed = packing.packed_documents(documents, limits, loss_from=F.col("prompt"), **bounds)
        got = packing.violations(packed, limits, **({"max_segments": packing.MAX_SEGMENTS} | bounds)).first().asDict()
        assert got == {"documents": 400, "blank": 0, "cut_though_fitting": 0, "over_tokens": 0, "over_segments": 0, "over_loss": 0}


def test_packed_documents(spark):
    r = random.Random(1)
    rows = [(i, "title\n" + " ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(r.randint(5, 400))), "x") for i in range(300)] + [(900, None, "x"), (901, " ", "x"), (902, "word " * 9000, "x")]
    limits = spark.createDataFrame([("container", 512, None, "tokens")], "item_kind string, max_size int, overlap int, unit string")
    packed = packing.packed_documents(spark.createDataFrame(rows, "doc_id bigint, text string, container string"), limits).collect()
    assert {p["doc_id"] for p in packed} == {i for i, *_ in rows}
    assert all(p["container"] is None for p in packed if p["doc_id"] in (900, 901))
    whole = {}
    for p in packed:
        whole.setdefault(p["doc_id"], []).append(p)
    assert all(len(v) == 1 for k, v in whole.items() if k < 900) and len(whole[902]) > 1
    used = {}
    for p in packed:
        if p["container"]:
            used[p["container"]] = used.get(p["container"], 0) + p["tokens"]
    assert max(used.values()) <= 512 and sum(used.values()) / (512 * len(used)) > 0.9


ITEMS = "question_id string, part string, text string"


def test_leaks(spark):
    asked = "某教研组用378只模型验证粲玥琰烃的作用，琮珣珮酰与颗粒沉积谁是因谁是果？"
    other = "某教研组用12只模型验证璘璟玥胺的作用，其结果对玥珮珉法有什么启发？"
    items = spark.createDataFrame([("q1", "question", asked), ("q1", "question", asked), ("q2", "question", other), ("q3", "question", None), ("q4", "question", "短")], ITEMS)
    filler = "固定染色后，上皮细胞呈梭形，胞核位于一侧。" * 30
    docs = [
        (1, filler + asked + filler, 0), (2, filler + asked[: len(asked) // 2 + 1] + filler, 0), (3, filler + asked[:9] + filler, 0), (4, "粲玥琰烃、琮珣珮酰。" + filler, 0),
        (5, asked.replace("，", " \n").replace("378", "３７８"), 0), (6, None, 0), (7, "", 0), (8, "某教研组用99只模型验证其他东西的作用，甲与乙谁是因谁是果？", 0), (9, filler + asked[:18] + "（插入一段话）" + asked[18:] + filler, 0),
    ]
    got = {(r["doc_id"], r["question_id"]) for r in leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string, share int"), items).collect()}
    assert got == {(1, "q1"), (2, "q1"), (5, "q1"), (9, "q1")}
    assert leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string, share int"), items.limit(0)).count() == 0


def test_prefix_loses_nothing():
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    pattern = " ".join(word() for _ in range(6))
    rows = [(f"q{i}", f"{pattern} " + " ".join(word() for _ in range(r.randint(2, 14)))) for i in range(40)]
    docs = []
    for _ in range(300):
        text = r.choice(rows)[1]
        a, b = sorted((r.randint(0, len(text)), r.randint(0, len(text))))
        docs.append(" ".join(word() for _ in range(20)) + text[a:b] + r.choice(("", word())) + text[b:][: r.randint(0, 30)])
    index = leakage.Items(rows)
    found = index.lookup(docs)
    frequency = np.zeros(len(index.keys), dtype=np.int64)
    for _, key in found:
        frequency[np.unique(key)] += 1
    index.order(frequency)
    assert index.leading.mean() < 1 and all(index.prefix[index.item == i].sum() == s - math.ceil(leakage.CONTAINED * s) + 1 for i, s in enumerate(index.size))
    got = index.matches(found)
    assert len(got) > 50 and set(got) == set(index.matches(found, prefix=False))


def test_an_interruption_may_be_long():
    text = "whether the inner layer of the cornea swells after repeated strain in young adults"
    plain = text.replace(" ", "")
    index = leakage.Items([("a", text)])
    for gap in (1, 200, 20_000):
        between = "".join(chr(0x4E00 + i % 900) for i in range(gap))
        assert [i for _, i, _ in index.matches(index.lookup([plain[:20] + between + plain[20:45]]))] == [0]
    assert not index.matches(index.lookup([plain[25:45] + plain[:20], plain[:16], ""]))


@pytest.mark.parametrize("text", ["ＡＢＣ，１２３", "abc 123"])
def test_folding(text):
    codes, _ = leakage.folded([text])
    assert "".join(map(chr, codes)) == "abc123"


def test_half_of_an_item_is_a_case_whoever_else_says_it():
    shared, one, two = "whether the inner layer of the cornea swells after repeated strain", "in young adults only", "among older patients"
    index = leakage.Items([("a", shared + one), ("b", shared + two), ("c", "quite another question about the healing of bones")])
    found = index.matches(index.lookup(["He asked " + shared + " and left.", "Nothing of that kind is said here."]))
    assert {(d, index.names[i]) for d, i, _ in found} == {(0, "a"), (0, "b")}


def test_every_window_of_a_document_is_verified():
    text = "whether the inner layer of the cornea swells after repeated strain in young adults"
    plain = text.replace(" ", "")
    pieces = [plain[i : i + 7] for i in range(0, len(plain), 7)]
    index = leakage.Items([("a", text)])
    mixed = "zq".join(reversed(pieces)) + "".join(chr(0x4E00 + i) for i in range(400))
    assert not index.matches(index.lookup([mixed]))
    assert [index.names[i] for _, i, _ in index.matches(index.lookup([mixed + plain[: int(0.6 * len(plain))]]))] == ["a"]


def test_estimates_dont_grow_along_a_chain(spark):
    # joins multiply the estimated sizes of checkpoints: 2 000 digits after a few rounds, megabytes of them after twenty
    chain = spark.range(300).selectExpr("format_string('%05d', id) a", "format_string('%05d', id + 1) b")
    out = components.components(chain)
    assert out.groupBy("label").count().collect() == [("00000", 301)]
    assert out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 64
