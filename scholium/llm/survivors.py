"""Problem 4: one surviving record for each group of duplicate records.

Fields that depend on each other form bundles that are taken whole from one record: the name with its aliases; the
definition with its extractor and time; the kind (type, level, category); the place (book, chapter, chapter title); the
pages; the excerpt with its frequency. Functional dependencies bind bundles: pages and excerpt must come from a record of the
place chosen, the kind from a record with the definition chosen. A branch and bound assigns bundle after bundle
and maximises the summed worth (completeness, then trust, then recency); its bound is what is assigned so far plus the best free
value of each bundle that is left, dependencies aside. The bound of the root is what the best values of the group give,
criterion by criterion. The search opens whole records first: one that reaches the root's bound in every criterion, alone,
beats every other member and can't be improved by mixing. It is ``best_key``, and its bundles are the result.

Scale: only the best candidate for each value of what a bundle depends on can be part of a solution, so a group is reduced by
combinable aggregates to one row a place, one a definition and one a set of equal criteria. Trees of bundles without a
dependency between them add up, so a group with more than BLOCK rows is searched in blocks, each against the root's bound,
and the best of the blocks is the best of the group. No task sees a whole unbounded group.

Defined results: repeated rows count once; a node without a row has nothing filled; blanks and stand-in words
count as missing; without a member that beats all others best_key is null; ties choose the smallest key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

# Words that stand in for a missing value, folded and without punctuation.
STAND_INS = (
    "none null nil nan na nodefinition undefined unknown tbd tba todo empty missing keine unbekannt aucun aucune inconnu "
    "无 空 暂无 未知 未定 不详 待定 待补 待补充 待填 缺 缺失 未填 未命名 没有 略 同上"
).split()
BLOCK = 4_096
NODE_COLUMNS = (
    "textbook_id node_id name definition aliases source_textbook_id chapter_id node_type level category chapter_title page_start page_end frequency source_excerpt extractor updated_at".split()
)
COMPARED = ("definition", "chapter_title", "page_start", "page_end", "frequency", "source_excerpt")


def filled(column: str, stand_ins: bool = False) -> Column:
    """Whether a text column says something: not null, blank or, for stand_ins, a stand-in word."""
    text = F.lower(F.regexp_replace(F.col(column), r"[\s\p{P}\p{S}\p{Z}\p{Cf}\p{Cc}]+", ""))
    said = F.length(text) > 0
    return F.coalesce(said & ~text.isin(STAND_INS) if stand_ins else F.length(F.regexp_replace(column, r"[\s\p{Z}]+", "")) > 0, F.lit(False))


def members(groups: DataFrame, nodes: DataFrame, extractors: DataFrame) -> DataFrame:
    """One row a group member with its node's fields, what is filled, and its trust (null and unknown rank lowest)."""
    key = F.concat_ws(":", "textbook_id", "node_id")
    rows = nodes.select(*NODE_COLUMNS, key.alias("node_key")).dropDuplicates(["node_key"])
    trust = extractors.groupBy("extractor").agg(F.max("trust").alias("trust"))
    joined = groups.select("group_key", "node_key").join(rows, "node_key", "left").join(trust, "extractor", "left")
    flags = {
        "definition": filled("definition", stand_ins=True),
        "chapter_title": filled("chapter_title"),
        "source_excerpt": filled("source_excerpt"),
        **{c: F.col(c).isNotNull() for c in ("page_start", "page_end", "frequency")},
    }
    out = joined.withColumn("_trust", F.coalesce("trust", F.lit(-(2**31))))
    for column, flag in flags.items():
        out = out.withColumn(f"_has_{column}", flag.cast("int"))
    return out.withColumn("_length", F.when(F.col("_has_definition") == 1, F.length(F.trim("definition"))).otherwise(0)).withColumn(
        "_time", F.coalesce(F.col("updated_at").cast("timestamp_ntz"), F.lit("0001-01-01").cast("timestamp_ntz"))
    )


def _worth(*flags: str) -> Column:
    """Completeness before trust before recency, as one number that can be summed over bundles."""
    whole = sum((F.col(f"_has_{f}") for f in flags), F.lit(0)) / len(flags)
    days = F.datediff(F.col("_time").cast("date"), F.lit("2000-01-01").cast("date"))
    return whole * 100.0 + F.greatest(F.col("_trust"), F.lit(-1)) * 5.0 + F.greatest(F.lit(0), F.least(days, F.lit(36500))) / 36500.0


def _best(value: Column, worth: Column) -> Column:
    """max_by with the smallest key on ties."""
    return F.min_by(value, F.struct((-worth).alias("w"), F.col("node_key").alias("k")))


CRITERIA = [f"_has_{c}" for c in COMPARED] + ["_length", "_time", "_trust"]
#: The bundles of each tree, in the order they are assigned: the first is the one that the others depend on.
TREES = {"place": ("place", "pages", "excerpt"), "meaning": ("defining", "kind"), "naming": ("naming",)}
#: Rows a task of the search, whatever their bytes.
CALLS_A_TASK = 4
_CANDIDATE = "group_key string, tree string, value long, worth array<double>, source array<string>, bound array<double>, times long"


def survivors(groups: DataFrame, nodes: DataFrame, extractors: DataFrame) -> DataFrame:
    """One row a group: best_key, the chosen value of every bundle, and from which member each bundle came."""
    rows = stage(members(groups, nodes, extractors), "members")
    definition = F.when(F.col("_has_definition") == 1, F.xxhash64(F.trim("definition"))).otherwise(F.lit(0))
    rows = rows.withColumn("_place", F.xxhash64("textbook_id", "chapter_id")).withColumn("_definition", definition)
    trust = F.greatest(F.col("_trust"), F.lit(-1)) * 5.0
    worth = {
        "place": _worth("chapter_title"),
        "pages": _worth("page_start", "page_end"),
        "excerpt": _worth("source_excerpt", "frequency"),
        "defining": _worth("definition") + F.col("_length") / 1e6,
        "kind": F.col("category").isNotNull().cast("int") * 100.0 + trust,
        "naming": filled("name", stand_ins=True).cast("int") * 100.0 + trust,
    }
    vector = F.array(*[F.unix_micros(F.col(c).cast("timestamp")).cast("double") if c == "_time" else F.col(c).cast("double") for c in CRITERIA])
    rows = rows.withColumn("_vector", vector)
    root = rows.groupBy("group_key").agg(F.count("*").alias("member_count"), F.array(*[F.max(F.col("_vector")[i]) for i in range(len(CRITERIA))]).alias("bound"))

    def candidates(tree: str, value: Column) -> DataFrame:
        """The best candidate of every bundle of a tree for each value of what the bundles depend on."""
        best = rows.groupBy("group_key", value.alias("value")).agg(
            F.array(*[F.max(worth[b]) for b in TREES[tree]]).alias("worth"), F.array(*[_best(F.col("node_key"), worth[b]) for b in TREES[tree]]).alias("source")
        )
        return best.select("group_key", F.lit(tree).alias("tree"), "value", "worth", "source", F.lit(None).cast("array<double>").alias("bound"), F.lit(1).cast("long").alias("times"))

    whole = rows.groupBy("group_key", "_vector").agg(F.count("*").alias("times"), F.min("node_key").alias("node_key")).join(root, "group_key")
    whole = whole.select("group_key", F.lit("whole").alias("tree"), F.lit(0).cast("long").alias("value"), F.col("_vector").alias("worth"), F.array("node_key").alias("source"), "bound", "times")
    opened = whole
    for tree, value in (("place", F.col("_place")), ("meaning", F.col("_definition")), ("naming", F.lit(0).cast("long"))):
        opened = opened.unionByName(candidates(tree, value))
    opened = stage(opened, "candidates")
    counts = opened.groupBy("group_key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
    calls = max(1, opened.count() // BLOCK)
    spread = opened.join(counts, "group_key").withColumn(
        "_call",
        F.when(F.col("_blocks") == 1, F.pmod(F.xxhash64("group_key"), F.lit(calls))).otherwise(
            -1 - F.abs(F.xxhash64("group_key", F.pmod(F.xxhash64("tree", "value", "source"), F.col("_blocks")))) % (2**40)
        ),
    )
    # a set number of partitions isn't merged by bytes: the rows are short, the search isn't
    tasks = max(1, -(-calls // CALLS_A_TASK))
    chosen = spread.drop("_blocks").repartition(max(tasks, min(calls, opened.sparkSession.sparkContext.defaultParallelism)), "_call")
    chosen = chosen.groupBy("_call").applyInPandas(_search, "group_key string, tree string, reached long, worth double, source array<string>")
    first = F.struct((-F.col("worth")).alias("w"), F.col("source").alias("s"))
    solved = chosen.groupBy("group_key").agg(
        F.when(F.sum(F.when(F.col("tree") == "whole", F.col("reached"))) == 1, F.max(F.when(F.col("tree") == "whole", F.col("source")[0]))).alias("best_key"),
        *[F.min_by(F.when(F.col("tree") == t, F.col("source")), F.when(F.col("tree") == t, first)).alias(t) for t in TREES],
        *[F.max(F.when(F.col("tree") == t, F.col("worth"))).alias(f"_w{t}") for t in TREES],
    )
    taken = [F.when(F.col("best_key").isNotNull(), F.col("best_key")).otherwise(F.col(t)[i]).alias(f"{b}_from") if t != "naming" else F.col(t)[i].alias(f"{b}_from") for t, bundles in TREES.items() for i, b in enumerate(bundles)]
    solved = stage(solved.join(root.select("group_key", "member_count"), "group_key").select("group_key", "best_key", "member_count", sum((F.col(f"_w{t}") for t in TREES), F.lit(0.0)).alias("worth"), *taken), "solved")
    fields = {
        "naming": ("name", "aliases"),
        "defining": ("definition", "extractor", "updated_at"),
        "kind": ("node_type", "level", "category"),
        "place": ("textbook_id", "chapter_id", "chapter_title"),
        "pages": ("page_start", "page_end"),
        "excerpt": ("source_excerpt", "frequency"),
    }
    # the values of the chosen records: one row a group and record
    named = solved.select("group_key", F.explode(F.array(*[F.struct(F.lit(b).alias("b"), F.col(f"{b}_from").alias("k")) for b in fields])).alias("_"))
    values = named.select("group_key", "_.b", F.col("_.k").alias("node_key")).join(rows.select("group_key", "node_key", *[c for f in fields.values() for c in f]), ["group_key", "node_key"])
    picked = values.groupBy("group_key").agg(*[F.first(F.when(F.col("b") == b, F.col(c)), ignorenulls=True).alias(c) for b, f in fields.items() for c in f])
    return solved.join(picked, "group_key").select(
        "group_key", "best_key", "member_count", "worth", *[c for f in fields.values() for c in f],
        F.col("naming_from").alias("name_from"), F.col("defining_from").alias("definition_from"), "kind_from", "place_from", "pages_from", "excerpt_from",
    )


def _search(frame: pd.DataFrame) -> pd.DataFrame:
    """Branch and bound for every group of a call: whole records first, then bundle after bundle."""
    out = []
    for (key, tree), some in frame.groupby(["group_key", "tree"], sort=False):
        if tree == "whole":
            reached, source = whole_records(list(zip(some["worth"], some["source"], some["times"])), some["bound"].iloc[0])
            out.append((key, tree, reached, 0.0, [source]))
        else:
            bundles = [
                [(float(w[i]), s[i], v if i == 0 else None, v if i else None) for w, s, v in zip(some["worth"], some["source"], some["value"])] for i in range(len(TREES[tree]))
            ]
            out.append((key, tree, 0, *branch_and_bound(bundles)))
    return pd.DataFrame(out, columns=["group_key", "tree", "reached", "worth", "source"])


def whole_records(records: list, root) -> tuple[int, str | None]:
    """(how many, which): records that reach the bound of the root in every criterion; no mixture can better them.

    ``records`` are (criteria, [key], times). A record below the bound in one criterion is beaten by whoever sets it, or
    unable to beat it, so its branch is closed unopened.
    """
    reached, which = 0, None
    for criteria, source, times in records:
        if all(c >= b for c, b in zip(criteria, root)):
            reached += int(times)
            which = source[0] if which is None else min(which, source[0])
    return reached, which


def branch_and_bound(bundles: list[list[tuple]]) -> tuple[float, list[str]]:
    """(worth, source of each bundle) of the best consistent choice of one candidate a bundle.

    A candidate is (worth, source, value it sets, value it needs): a bundle that depends on another must need the value
    that the first bundle set; None needs nothing. Candidates are tried from the best on; a branch is closed when what it has plus the best
    free candidates of the bundles that are left can't pass the best solution so far. Ties choose the smallest sources.
    """
    ordered = [sorted(some, key=lambda c: (-c[0], c[1] or "")) for some in bundles]
    by_need = []
    for some in ordered:
        index: dict = {}
        for c in some:
            index.setdefault(c[3], []).append(c)
        by_need.append(index)
    rest = [0.0] * (len(bundles) + 1)
    for i in range(len(bundles) - 1, -1, -1):
        rest[i] = rest[i + 1] + ordered[i][0][0]
    best: list = [float("-inf"), None]

    def descend(i: int, worth: float, chosen: list, value) -> None:
        if i == len(bundles):
            if worth > best[0] or worth == best[0] and [c or "" for c in chosen] < [c or "" for c in best[1]]:
                best[:] = [worth, list(chosen)]
            return
        free, bound = by_need[i].get(None, []), by_need[i].get(value, [])
        some = ordered[i] if i == 0 else sorted(free + bound, key=lambda c: (-c[0], c[1] or "")) if free and bound and value is not None else bound or free
        for w, source, sets, _ in some:
            if worth + w + rest[i + 1] < best[0]:
                break
            descend(i + 1, worth + w, [*chosen, source], sets if i == 0 else value)

    descend(0, 0.0, [], None)
    return best[0], best[1]
