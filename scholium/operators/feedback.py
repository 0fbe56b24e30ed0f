"""Text commands on an integrated graph: keep, remove, split, merge, and explanations of its decisions.

Commands are applied in order, each to what the ones before left; a command is one set of DataFrame steps over the graph, cut
after it. The driver sees the commands and the few nodes that they name, never the graph.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..session import cut

# Words of a command that select its action; the first that matches wins.
ACTIONS = (("keep", "不要合并|保留|留下|单独"), ("remove", "删除|移除|去掉|不要"), ("split", "拆分|拆开|拆成|分成|分为"), ("merge", "合并|并入|归并"))
# Words that are no part of a node's name.
COMMAND_WORDS = "为什么|为何|原因|解释|依据|觉得|认为|应该|不应该|它们|他们|不是|同一个|这个|那个|请|把|将|节点|概念|知识点|保留|删除|移除|去掉|拆分|拆开|拆成|分成|分为|合并|并入|归并|不要|单独|了|吗|呢"
# Words that ask for an explanation, and the marks between and around names.
EXPLAIN = "为什么|为何|原因|解释|怎么判定|依据|凭什么"
_separators = re.compile(r"\s*(?:、|,|，|/|和|与|及|\+)\s*")
_edges = " ：:，,。？！?；;"

@dataclass
class Graph:
    """nodes: node_id, name, definition, aliases, teacher_feedback, split_from; edges: source, target, relation, weight."""

    nodes: DataFrame
    edges: DataFrame
    #: (action, sentence, number of nodes) of each applied command; the nodes themselves stand in decisions.
    log: list[tuple[str, str, int]] = field(default_factory=list)
    decisions: DataFrame | None = None
    unapplied: list[str] = field(default_factory=list)


def commands(text: str) -> list[str]:
    return [s.strip() for s in re.split(r"[\n。；;]+", text or "") if s.strip()]


def action(sentence: str) -> str:
    return next((name for name, words in ACTIONS if re.search(words, sentence)), "unknown")


def wants_explanation(message: str) -> bool:
    return bool(re.search(EXPLAIN, message))


def targets(sentence: str) -> list[str]:
    """Names in quotation marks, else what is left without command words, apart at separators."""
    quoted = [q.strip() for q in re.findall(r"[“\"'《]([^”\"'》]{1,40})[”\"'》]", sentence) if q.strip()]
    if quoted:
        return quoted
    parts = (p.strip(_edges) for p in _separators.split(re.sub(COMMAND_WORDS, " ", sentence)))
    return [p for p in parts if 1 <= len(p) <= 40]


def split_parts(sentence: str) -> list[str]:
    match = re.search(r"(?:拆成|分成|分为)\s*(.+)$", sentence)
    return [p.strip(" ：:，,。") for p in _separators.split(match.group(1)) if p.strip()] if match else []


def _keyed(nodes: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return nodes.withColumn("_k", T.name_key(F.col("name"))).withColumn("_a", F.coalesce("aliases", none))


def named(nodes: DataFrame, sentence: str) -> DataFrame:
    """The nodes that a sentence means: an exact name or alias, else one name inside the other; else names that it contains."""
    spark = nodes.sparkSession
    wanted = [t for t in targets(sentence)]
    keyed = _keyed(nodes)
    if wanted:
        t = spark.createDataFrame([(i, w) for i, w in enumerate(wanted)], "t int, target string").withColumn("_t", T.name_key(F.col("target"))).where("_t <> ''")
        own = keyed.select("node_id", F.col("_k").alias("_n")).union(keyed.select("node_id", F.explode("_a").alias("x")).select("node_id", T.name_key(F.col("x"))))
        exact = own.join(F.broadcast(t), F.col("_n") == F.col("_t")).select("node_id", "t").distinct()
        missing = t.join(exact.select("t").distinct(), "t", "left_anti")
        loose = keyed.join(F.broadcast(missing), (F.col("_k") != "") & (F.col("_k").contains(F.col("_t")) | F.col("_t").contains(F.col("_k")))).select("node_id", "t")
        found = exact.unionByName(loose).groupBy("node_id").agg(F.min("t").alias("t"))
        out = nodes.join(found, "node_id")
        if not out.isEmpty():
            return out
    key = spark.createDataFrame([(sentence,)], "s string").select(T.name_key(F.col("s"))).first()[0]
    return keyed.where((F.col("_k") != "") & F.lit(key).contains(F.col("_k"))).select(*nodes.columns, F.lit(0).alias("t"))


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Without loops, once for each unordered pair and relation: the first edge stays."""
    pair = Window.partitionBy(F.least("source", "target"), F.greatest("source", "target"), "relation").orderBy("edge_id")
    return edges.where("source <> target").withColumn("_r", F.row_number().over(pair)).where("_r = 1").drop("_r")


def next_number(ids: DataFrame, column: str) -> int:
    return int(ids.agg(F.max(F.try_to_number(F.regexp_extract(column, r"(\d+)$", 1), F.lit("999999999999")))).first()[0] or 0) + 1


def apply(graph: Graph, text: str) -> Graph:
    """All commands of a text, in order; what means no node is listed as unapplied."""
    for sentence in commands(text):
        kind = action(sentence)
        found = cut(named(graph.nodes, sentence)) if kind != "unknown" else None
        done = {"keep": _keep, "remove": _remove, "split": _split, "merge": _merge}[kind](graph, sentence, found) if found is not None and not found.isEmpty() else None
        if done is None:
            graph = replace(graph, unapplied=[*graph.unapplied, sentence])
        else:
            said = decided(found, kind, sentence, len(graph.log) + 1)
            made = said if graph.decisions is None else graph.decisions.unionByName(said)
            graph = Graph(cut(done.nodes), cut(done.edges), [*graph.log, (kind, sentence, found.count())], made, graph.unapplied)
    return graph


def decided(found: DataFrame, kind: str, sentence: str, number: int) -> DataFrame:
    """A row for each node that a command decides on, as decisions in rows: a command may name any number of nodes."""
    first = F.min_by("node_id", F.struct("t", "node_id"))
    result = found.agg(first.alias("_first"), F.min_by("name", F.struct("t", "node_id")).alias("canonical_name"))
    one = result.select(F.lit(f"feedback_{number:03d}").alias("decision_id"), F.lit(kind).alias("action"), F.lit(sentence).alias("reason"), "canonical_name", (F.col("_first") if kind == "merge" else F.lit(None).cast("string")).alias("result_node"))
    rows = found.select(F.lit(f"feedback_{number:03d}").alias("decision_id"), F.col("node_id").alias("affected_node"))
    return rows.join(one, "decision_id").withColumn("score", F.lit(1.0)).withColumn("confidence", F.lit(1.0))


def _keep(graph: Graph, sentence: str, found: DataFrame) -> Graph:
    marked = graph.nodes.join(found.select("node_id", F.lit(True).alias("_m")), "node_id", "left")
    return replace(graph, nodes=marked.withColumn("teacher_feedback", F.when(F.col("_m"), "keep").otherwise(F.col("teacher_feedback"))).drop("_m"))


def _remove(graph: Graph, sentence: str, found: DataFrame) -> Graph:
    ids = found.select("node_id")
    edges = graph.edges
    for end in ("source", "target"):
        edges = edges.join(ids.withColumnRenamed("node_id", end), end, "left_anti")
    return replace(graph, nodes=graph.nodes.join(ids, "node_id", "left_anti"), edges=edges.select(*graph.edges.columns))


def _split(graph: Graph, sentence: str, found: DataFrame) -> Graph | None:
    listed = split_parts(sentence)
    keyed = _keyed(found)
    key_of = F.array(*[F.struct(T.name_key(F.lit(p)).alias("k"), F.lit(p).alias("p")) for p in listed]) if listed else F.array().cast("array<struct<k:string,p:string>>")
    own = F.transform(F.filter(key_of, lambda s: (s["k"] != "") & (s["k"] != F.col("_k"))), lambda s: s["p"])
    aliases = F.array_sort(F.array_distinct(F.concat(F.array("name"), "_a")))
    parts = F.when(F.size(own) >= 2, own).when(F.size("_a") > 0, aliases).otherwise(F.array().cast("array<string>"))
    rows = keyed.withColumn("_parts", parts).where(F.size("_parts") >= 2)
    if rows.isEmpty():
        return None
    first = next_number(graph.nodes, "node_id")
    order = Window.orderBy("t", "old", "_i")
    made = rows.select(F.col("node_id").alias("old"), "t", "definition", F.posexplode("_parts").alias("_i", "name"))
    made = cut(made.withColumn("node_id", F.format_string("kg_node_%04d", F.row_number().over(order) - 1 + first)))
    gone = made.select(F.col("old").alias("node_id")).distinct()
    new = made.select("node_id", "name", "definition", F.array().cast("array<string>").alias("aliases"), F.lit("split").alias("teacher_feedback"), F.col("old").alias("split_from"))
    nodes = graph.nodes.join(gone, "node_id", "left_anti").unionByName(new, allowMissingColumns=True)
    edges = graph.edges
    for end in ("source", "target"):
        to = made.select(F.col("old").alias(end), F.col("node_id").alias("_new"))
        edges = edges.join(to, end, "left").withColumn(end, F.coalesce("_new", end)).drop("_new").select(*graph.edges.columns)
    return replace(graph, nodes=nodes, edges=distinct_edges(edges))


def _merge(graph: Graph, sentence: str, found: DataFrame) -> Graph | None:
    if found.count() < 2:
        return None
    rank = F.struct("t", "node_id")
    none = F.array().cast("array<string>")
    said = T.strip(T.blank_to_empty(F.col("definition")))
    base = found.agg(
        F.min_by("node_id", rank).alias("node_id"), F.min_by("name", rank).alias("_name"), F.flatten(F.collect_list(F.concat(F.array("name"), F.coalesce("aliases", none)))).alias("_names"),
        F.min_by(F.when(said != "", said), F.struct((-F.length(said)).alias("n"), rank.alias("r"))).alias("_def"),
    )
    base = cut(base.withColumn("_al", F.array_sort(F.array_distinct(F.filter("_names", lambda a: a != F.col("_name"))))).drop("_names"))
    others = cut(found.select("node_id").join(base.select("node_id"), "node_id", "left_anti"))
    nodes = graph.nodes.join(others, "node_id", "left_anti").join(base, "node_id", "left")
    mine = F.col("_name").isNotNull()
    nodes = nodes.withColumn("aliases", F.when(mine, F.col("_al")).otherwise(F.col("aliases"))).withColumn("definition", F.when(mine, F.col("_def")).otherwise(F.col("definition")))
    nodes = nodes.withColumn("teacher_feedback", F.when(mine, "merge").otherwise(F.col("teacher_feedback"))).drop("_name", "_al", "_def")
    to = others.crossJoin(base.select(F.col("node_id").alias("_new")))  # one row on the right
    edges = graph.edges
    for end in ("source", "target"):
        edges = edges.join(to.withColumnRenamed("node_id", end), end, "left").withColumn(end, F.coalesce("_new", end)).drop("_new").select(*graph.edges.columns)
    return replace(graph, nodes=nodes, edges=distinct_edges(edges))


def source_names(decisions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(decision_id, sources): the names that the nodes of a decision have in their own graphs; ``nodes`` has (qid, name)."""
    none = F.array().cast("array<string>")
    named = decisions.select("decision_id", F.explode(F.array_distinct(F.concat(F.coalesce("affected_nodes", none), F.coalesce("node_ids", none)))).alias("qid"))
    return named.join(nodes.select("qid", "name"), "qid").groupBy("decision_id").agg(F.array_sort(F.collect_set("name")).alias("sources"))


def rank_decisions(decisions: DataFrame, question: str, k: int = 3, sources: DataFrame | None = None) -> DataFrame:
    """The decisions that a question is about: 2 for the action it names, 4 for each name in the decision's text.

    ``sources`` of source_names() let a question name what was merged away.
    """
    # Words of a question that name an action.
    wanted = [a for a, words in (("merge", "合并|归并|并入"), ("remove", "删除|移除|去掉"), ("keep", "保留|单独|不应该")) if re.search(words, question)]
    none = F.array().cast("array<string>")
    names = targets(question)
    told = decisions.join(sources, "decision_id", "left") if sources is not None else decisions.withColumn("sources", none)
    text = T.name_key(F.concat_ws(" ", "canonical_name", "reason", "result_node", F.array_join(F.coalesce("affected_nodes", none), " "), F.array_join(F.coalesce("node_ids", none), " "), F.array_join(F.coalesce("sources", none), " ")))
    decisions = told
    score = F.when(F.col("action").isin(*wanted), 2).otherwise(0) if wanted else F.lit(0)
    rows = decisions.withColumn("_t", text)
    for name in names:
        key = T.name_key(F.lit(name))
        score = score + F.when((key != "") & (F.col("_t").contains(key) | key.contains(F.col("_t"))), 4).otherwise(0)
    if not names:
        score = F.when(score > 0, score + 1).otherwise(0)
    rows = rows.withColumn("match", score).where("match > 0").drop("_t")
    return rows.orderBy(F.desc("match"), F.desc("confidence"), F.desc("score"), "decision_ord").limit(k)


def explain(decisions: DataFrame, question: str) -> str:
    """Up to three decisions in words; the limit is part of the answer."""
    label = {"merge": "合并", "keep": "保留", "remove": "删除"}
    lines = [
        f"{r['canonical_name']}：{label.get(r['action'], r['action'])}；{r['reason'] or ''}；置信度 {r['confidence']:.2f}。" for r in rank_decisions(decisions, question).collect()
    ]
    return "\n".join(lines) or "没有找到相关的整合决策。"


def respond(graph: Graph, decisions: DataFrame, message: str) -> tuple[Graph, str]:
    """A message is a question or a set of commands; what can't be applied is answered as a question."""
    if not (message or "").strip():
        return graph, "请输入反馈。"
    if wants_explanation(message):
        return graph, explain(decisions, message)
    after = apply(replace(graph, log=[], decisions=None, unapplied=[]), message)
    if not after.log:
        return graph, explain(decisions, message)
    said = "；".join(f"{kind}：{n} 个节点" for kind, _, n in after.log)
    return after, said + (f"。未处理：{'；'.join(after.unapplied)}" if after.unapplied else "")
