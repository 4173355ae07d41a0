"""Labels, tags, relations and page links: indexes, graphs, aliases, reachability, narrative checks."""

from __future__ import annotations

import uuid
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.text import beside, page_links, word_starts
from ..sources.tables import saved
from . import scans


def entity_index(labels: DataFrame) -> DataFrame:
    """(label, videos, rows): distinct videos and rows of each label (ws, label); counts first, no lists."""
    return labels.groupBy("label").agg(F.count_distinct("ws").alias("videos"), F.count("*").alias("rows"))


def appearances(claims: DataFrame, length: int = 80) -> DataFrame:
    """(label, ws, cp_id, s, e, status, role, situation): a row for each label of claims (speakers, entities: arrays), once for each list that names it.

    situation is cut to `length` characters; where it is empty the hypothesis
    stands in. Blank labels are left out; null lists have none.
    """
    said = F.substring(F.coalesce(F.nullif("situation", F.lit("")), "hypothesis", F.lit("")), 1, length)
    named = lambda column, role: F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda x: F.struct(F.trim(x).alias("label"), F.lit(role).alias("role")))
    each = claims.select("ws", "cp_id", "s", "e", "status", said.alias("situation"), F.explode(F.array_distinct(F.concat(named("speakers", "speaker"), named("entities", "entity")))).alias("x"))
    return each.select("x.label", "ws", "cp_id", "s", "e", "status", "x.role", "situation").filter("label <> ''")


def durable(index: DataFrame, quoted: DataFrame, related: DataFrame, least: int = 2, noted: DataFrame | None = None) -> DataFrame:
    """index with durable: enough appearances, a quote (label), a relation (label) or, where given, a written note (label, see `written_notes`)."""
    flag = lambda df, name: df.select("label").distinct().withColumn(name, F.lit(True))
    both = index.join(flag(quoted, "quoted"), "label", "left").join(flag(related, "related"), "label", "left").fillna(False, ["quoted", "related"])
    if noted is not None:
        both = both.join(flag(noted, "noted"), "label", "left").fillna(False, ["noted"])
    kept = (F.col("rows") >= least) | F.col("quoted") | F.col("related")
    return both.withColumn("durable", kept if noted is None else kept | F.col("noted"))


def written_notes(notes: DataFrame, placeholder: str) -> DataFrame:
    """Notes (label, note) that say something: not blank and not the placeholder."""
    body = F.trim("note")
    return notes.filter(body.isNotNull() & (body != "") & (body != placeholder.strip()))


def top_entities(index: DataFrame, labels: DataFrame, top: int = 400) -> DataFrame:
    """(ws, label): links to the `top` labels by videos, ties by label."""
    kept = index.orderBy(F.desc("videos"), "label").limit(top).select("label")
    return labels.join(kept, "label", "left_semi").select("ws", "label").distinct()


def graph_counts(index: DataFrame, top: int = 400) -> DataFrame:
    """One row (kept, dropped): labels of the index that `top_entities` keeps, and the others."""
    n = F.count("*")
    return index.agg(F.least(n, F.lit(top)).alias("kept"), F.greatest(n - top, F.lit(0)).alias("dropped"))


def relation_graph(triples: DataFrame, top: int = 60) -> DataFrame:
    """(subj, pred, obj, total, subj_node, obj_node): the first `top` distinct triples in order, with the number of all, and nodes n0, n1, ... by first use."""
    distinct = triples.filter("subj IS NOT NULL AND pred IS NOT NULL AND obj IS NOT NULL").select("subj", "pred", "obj").distinct()
    shown = distinct.orderBy("subj", "pred", "obj").limit(top)
    # windows over the `top` rows alone
    placed = shown.withColumn("at", F.row_number().over(Window.orderBy("subj", "pred", "obj")))
    ends = placed.select(F.posexplode(F.array("subj", "obj")).alias("side", "name"), "at").groupBy("name").agg(F.min(F.col("at") * 2 + F.col("side")).alias("first"))
    ids = ends.select("name", F.concat(F.lit("n"), F.row_number().over(Window.orderBy("first")) - 1).alias("node"))
    both = shown.join(ids.toDF("subj", "subj_node"), "subj").join(ids.toDF("obj", "obj_node"), "obj")
    total = distinct.agg(F.count("*")).scalar()
    return both.select("subj", "pred", "obj", total.alias("total"), "subj_node", "obj_node")


def relation_candidates(claims: DataFrame) -> DataFrame:
    """Claims (ws, cp_id, relations, labels: arrays) without a whole triple but with two labels or more."""
    whole = F.exists("relations", lambda r: (F.coalesce(r["s"], F.lit("")) != "") & (F.coalesce(r["p"], F.lit("")) != "") & (F.coalesce(r["o"], F.lit("")) != ""))
    names = F.array_distinct(F.filter(F.transform("labels", lambda x: F.trim(x)), lambda x: x != ""))
    return claims.filter(~F.coalesce(whole, F.lit(False)) & (F.size(names) >= 2)).select("ws", "cp_id", names.alias("labels"))


def label_tokens(label: Column) -> Column:
    """Distinct tokens of a label without what stands in parentheses, letter case kept; the label itself where nothing is left."""
    found = F.array_distinct(F.filter(F.split(F.regexp_replace(label, r"\([^)]*\)", " "), r"\s+"), lambda t: t != ""))
    return F.when(F.size(found) > 0, found).otherwise(F.array(label))


def alias_pairs(labels: DataFrame, least: float = 0.5) -> DataFrame:
    """(a, b): labels a < b (column label, distinct) whose token sets have Jaccard similarity `least` or more.

    Only the rarest n - ceil(least n) + 1 tokens of a label are joined: two
    labels that similar share one of them, and common tokens make no pairs.
    """
    sets = labels.select("label", label_tokens(F.col("label")).alias("tokens"))
    each = sets.select("label", "tokens", F.explode("tokens").alias("token"))
    counts = each.groupBy("token").agg(F.count("*").alias("n"))
    ranked = each.join(counts, "token").withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("n", "token")))
    prefix = ranked.filter(F.col("rank") <= F.size("tokens") - F.ceil(least * F.size("tokens")) + 1).select("token", "label", "tokens")
    a, b = prefix.toDF("token", "a", "ta"), prefix.toDF("token", "b", "tb")
    alike = F.size(F.array_intersect("ta", "tb")) / F.size(F.array_union("ta", "tb")) >= least
    return a.join(b, "token").filter((F.col("a") < F.col("b")) & alike).select("a", "b").distinct()


#: Links that one group follows, at most twice as many; a page with more has its links in no group.
BLOCK = 200_000


def link_blocks(links: DataFrame, size: int = BLOCK) -> DataFrame:
    """(page, block): pages that have links (src, dst), in their order, cut where a block has `size` links."""
    n = F.when(F.col("n") <= size, F.col("n"))
    each = saved(links.groupBy("src").agg(F.count("*").alias("n")).orderBy("src").select(F.col("src").alias("page"), n.alias("n"), F.spark_partition_id().alias("part")), "degrees")
    at = scans.running(each, "at", F.coalesce("n", F.lit(0)), ["page"], F.col("part"), [])
    return at.filter("n IS NOT NULL").select("page", F.floor((F.col("at") - 1) / size).cast("long").alias("block"))


def followed(links: pd.DataFrame, depths: pd.DataFrame) -> pd.DataFrame:
    """(page, depth, block) of pages that get a lower depth by links (src, dst) of a block, from its depths (page, depth, block, new)."""
    after: dict = {}
    for a, b in zip(links["src"], links["dst"], strict=True):
        after.setdefault(a, []).append(b)
    least, lower = {}, {}
    for page, depth in depths.loc[~depths["new"], ["page", "depth"]].itertuples(index=False):
        least[page] = min(depth, least.get(page, depth))
    heap = list(depths.loc[depths["new"], ["depth", "page"]].itertuples(index=False, name=None))
    heapify(heap)
    while heap:
        depth, page = heappop(heap)
        if page not in least or depth < least[page]:
            least[page] = lower[page] = depth
            for b in after.get(page, ()):
                if b not in least or depth + 1 < least[b]:
                    heappush(heap, (depth + 1, b))
    return pd.DataFrame({"page": list(lower), "depth": list(lower.values()), "block": depths["block"].iloc[0] if len(depths) else 0})


def reachable(links: DataFrame, roots: DataFrame, folder: str, size: int = BLOCK) -> DataFrame:
    """(page, depth): pages that links (src, dst) reach from roots (page), with the least number of links.

    Pages are cut in their order into blocks of about `size` links. A round
    follows the links inside the blocks where a depth has changed to their end,
    a group a block, and then joins what has changed with the links between
    blocks. So a long chain of pages near each other takes a round a block, and
    no graph takes more rounds than its depth. Rounds are written to `folder`
    (shared by all executors), which cuts the lineage.
    """
    spark: SparkSession = links.sparkSession
    path = f"{folder}/reach-{uuid.uuid4().hex}"
    held = saved(links.select("src", "dst"), "links")
    blocks = saved(link_blocks(held, size), "blocks")
    placed = held.join(blocks.toDF("src", "block"), "src", "left").join(blocks.toDF("dst", "to"), "dst", "left")
    placed = saved(placed.select("src", "dst", "block", "to"), "placed")
    placed.filter("block = to").select("src", "dst", "block").repartition("block").write.partitionBy("block").parquet(f"{path}/inside")
    inside = spark.read.schema(StructType([*held.schema.fields, StructField("block", LongType())])).parquet(f"{path}/inside")
    across = saved(placed.filter("NOT coalesce(block = to, false)").select("src", F.col("dst").alias("page"), F.col("to").alias("block")), "across")
    kind = f"page {roots.schema['page'].dataType.simpleString()}, depth long, block long"
    changed = roots.select("page").distinct().withColumn("depth", F.lit(0).cast("long")).join(blocks, "page", "left")
    depths, round_ = None, 0
    while True:
        changed = saved(changed.select("page", "depth", "block"), "changed")
        active = [r["block"] for r in changed.select("block").distinct().collect()]  # as many as blocks of links
        if not active:
            return depths.groupBy("page").agg(F.min("depth").alias("depth")) if depths else changed.select("page", "depth")
        some = F.col("block").isin([b for b in active if b is not None])
        marked = changed.filter("block IS NOT NULL").withColumn("new", F.lit(True))
        if depths:
            marked = marked.unionByName(depths.filter(some).withColumn("new", F.lit(False)))
        lower = inside.filter(some).groupBy("block").cogroup(marked.groupBy("block")).applyInPandas(followed, kind)
        lower.unionByName(changed.filter("block IS NULL")).write.parquet(f"{path}/depths/round={round_:06d}")
        last = spark.read.schema(kind).parquet(f"{path}/depths/round={round_:06d}")
        depths = spark.read.schema(kind).option("recursiveFileLookup", True).parquet(f"{path}/depths")
        told = across.join(last.select(F.col("page").alias("src"), "depth"), "src").groupBy("page", "block").agg((F.min("depth") + 1).alias("depth"))
        least = depths.groupBy("page").agg(F.min("depth").alias("least"))
        changed = told.join(least, "page", "left").filter("least IS NULL OR depth < least")
        round_ += 1


def link_rows(pages: DataFrame) -> DataFrame:
    """(src, raw, dst): links of Markdown pages (page, text) to .md files, dst as a path beside the page; null where the link cannot be resolved."""
    each = pages.select(F.col("page").alias("src"), F.explode(page_links(F.col("text"))).alias("x"))
    return each.select("src", "x.raw", beside(F.col("src"), F.col("x.target")).alias("dst"))


def broken_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """links (src, dst, ...) to pages that are not there, and those without dst."""
    return links.join(pages.select(F.col("page").alias("dst")).distinct(), "dst", "left_anti").select(*links.columns)


def orphan_pages(links: DataFrame, pages: DataFrame, roots: DataFrame, folder: str) -> DataFrame:
    """(page): pages that no chain of links (src, dst) from a root (page) reaches."""
    met = reachable(links.select("src", "dst").filter("dst IS NOT NULL").distinct(), roots, folder).select("page")
    return pages.select("page").distinct().join(met, "page", "left_anti")


def rewrite_map(moves: DataFrame) -> DataFrame:
    """(old, new): moves whose old name has one new name alone."""
    return moves.distinct().groupBy("old").agg(F.count("*").alias("n"), F.min("new").alias("new")).filter("n = 1").select("old", "new")


#: Pairs of labels that one group solves, at most.
GROUP = 500_000


def first_leaders(pairs: pd.DataFrame) -> pd.DataFrame:
    """(label, leader) of all labels of pairs (a, b), a < b: in order each joins the first leader it is alike to, or leads."""
    after: dict[str, list[str]] = {}
    for a, b in zip(pairs["a"], pairs["b"], strict=True):
        after.setdefault(a, []).append(b)
    leader: dict[str, str] = {}
    for label in sorted(set(pairs["a"]) | set(pairs["b"])):
        if leader.setdefault(label, label) == label:
            for b in after.get(label, ()):
                leader.setdefault(b, label)
    return pd.DataFrame({"label": list(leader), "leader": list(leader.values())})


def connected(pairs: DataFrame) -> DataFrame:
    """(label, root): the least label that each label of pairs (a, b) reaches, by rounds of joins with pointer jumps."""
    edges = saved(pairs.select("a", "b").union(pairs.select("b", "a")).toDF("label", "near").distinct(), "edges")
    roots = saved(edges.groupBy("label").agg(F.min("near").alias("near")).select("label", F.least("label", "near").alias("root")), "roots")
    while True:
        least = edges.join(roots.toDF("near", "other"), "near").groupBy("label").agg(F.min("other").alias("other"))
        lower = roots.join(least, "label").select("label", "root", F.least("root", "other").alias("low"))
        far = roots.toDF("low", "far")
        moved = saved(lower.join(far, "low").select("label", F.least("low", "far").alias("root"), (F.least("low", "far") < F.col("root")).alias("moved")), "roots")
        roots = moved.select("label", "root")
        if moved.filter("moved").isEmpty():
            return roots


def alias_leaders(labels: DataFrame, pairs: DataFrame, folder: str, group: int = GROUP) -> DataFrame:
    """(label, leader): each label in order joins the first leader it is alike to, or leads.

    labels: (label), distinct; pairs as `alias_pairs`. Up to `group` pairs are
    solved in one group; of more, each component with so few is a group of its
    own, and only larger ones take rounds of joins.
    """
    alone = labels.select("label", F.col("label").alias("leader"))
    found = "label string, leader string"
    if pairs.count() <= group:
        met = pairs.withColumn("root", F.lit(0)).groupBy("root").applyInPandas(first_leaders, found)
    else:
        root = saved(pairs.join(connected(pairs).toDF("a", "root"), "a"), "components")
        sizes = saved(root.groupBy("root").agg(F.count("*").alias("n")), "sizes")
        few = root.join(sizes.filter(F.col("n") <= group).select("root"), "root", "left_semi").groupBy("root").applyInPandas(first_leaders, found)
        many = saved(root.join(sizes.filter(F.col("n") > group).select("root"), "root", "left_semi").select("a", "b"), "large")
        met = few if many.isEmpty() else few.unionByName(leaders_by_rounds(many, folder))
    met = saved(met, "leaders")
    return met.unionByName(alone.join(met.select("label"), "label", "left_anti"))


def leaders_by_rounds(pairs: DataFrame, folder: str) -> DataFrame:
    """(label, leader) of all labels of pairs.

    Rounds of joins: a label with no open label before it that it is alike to
    leads, and those alike to it follow. Rounds are written to `folder` (shared
    by all executors), which cuts the lineage; a component of labels is spread
    over all tasks.
    """
    spark: SparkSession = pairs.sparkSession
    path = f"{folder}/alias-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    # a label without any open one before it leads; the first round has all those that are never second
    first = pairs.select(F.col("a").alias("label")).distinct().join(pairs.select(F.col("b").alias("label")).distinct(), "label", "left_anti")
    free = kept(first, "leaders/round=000000")
    open_, depth = pairs, 0
    while True:
        follows = open_.join(free.select(F.col("label").alias("a")), "a", "left_semi").select(F.col("b").alias("label")).distinct()
        follows = kept(follows, f"follows-{depth:06d}")
        gone = follows.unionByName(free.select("label"))
        rest = open_.join(gone.toDF("a"), "a", "left_anti").join(follows.toDF("b"), "b", "left_anti").select("a", "b")
        # second labels of open pairs that are left without one before them lead next
        waiting = open_.select(F.col("b").alias("label")).distinct().join(follows, "label", "left_anti")
        rest, depth = kept(rest, f"open-{depth:06d}"), depth + 1
        free = kept(waiting.join(rest.select(F.col("b").alias("label")).distinct(), "label", "left_anti"), f"leaders/round={depth:06d}")
        if free.isEmpty():
            break
        open_ = rest
    leaders = spark.read.schema("label string").option("recursiveFileLookup", True).parquet(f"{path}/leaders")
    joined = pairs.join(leaders.toDF("a"), "a", "left_semi").groupBy("b").agg(F.min("a").alias("leader")).toDF("label", "leader")
    followed = joined.join(leaders, "label", "left_anti")
    return leaders.select("label", F.col("label").alias("leader")).unionByName(followed)


#: Tokens that are watched: two Hangul syllables or more, three Latin letters or more (fixed values).
WATCHED = "[가-힣]{2,}|[A-Za-z]{3,}"


def has_marker(clause: Column, markers: list[str]) -> Column:
    """Whether a clause has a marker, as a word or inside one."""
    return F.greatest(F.lit(False), F.lit(False), *[F.contains(clause, F.lit(m)) for m in markers])


def qualified_only(clauses: DataFrame, markers: list[str], token: str = WATCHED) -> DataFrame:
    """(ws, term): tokens (a pattern) of clauses (ws, clause) with a marker that no clause without one has."""
    each = clauses.select("ws", has_marker(F.col("clause"), markers).alias("marked"), F.explode(F.array_distinct(F.regexp_extract_all("clause", F.lit(token), F.lit(0)))).alias("term"))
    return each.filter(~F.col("term").isin(*markers)).groupBy("ws", "term").agg(F.bool_and("marked").alias("only")).filter("only").select("ws", "term")


def qualifier_drops(only: DataFrame, narrative: DataFrame, markers: list[str]) -> DataFrame:
    """(ws, clause, term): narrative clauses (ws, clause) without a marker that have a word beginning with a term known only with one."""
    lengths = sorted(r["k"] for r in only.select(F.length("term").alias("k")).distinct().collect())  # as many as words have lengths
    heads = F.transform(F.lit(lengths) if lengths else F.array().cast("array<int>"), lambda k: F.when(F.length("word") >= k, F.substring("word", F.lit(1), k)))
    plain = narrative.filter(~has_marker(F.col("clause"), markers)).select("ws", "clause", F.explode(word_starts(F.col("clause"))).alias("word"))
    starts = plain.select("ws", "clause", F.explode(F.filter(heads, lambda x: x.isNotNull())).alias("term"))
    return starts.join(only, ["ws", "term"]).select("ws", "clause", "term").distinct()


def unique_slugs(labels: DataFrame, slug: Column) -> DataFrame:
    """(label, slug) of distinct labels: in label order each takes its slug, or the first of slug-2, slug-3, ... that no label before it has, whatever their case.

    Only slugs that are alike but for numbers at their ends can meet. Where
    none of them ends with a number the n-th label gets number n; else they
    are dealt out in order, in one group of such slugs.
    """
    based = labels.withColumn("base", slug).withColumn("root", F.regexp_replace(F.lower("base"), r"(-\d+)+$", ""))
    numbered = F.max((F.lower("base") != F.col("root")).cast("int")).over(Window.partitionBy("root"))
    marked = based.withColumn("numbered", numbered)
    n = F.row_number().over(Window.partitionBy("root").orderBy("label"))
    plain = marked.filter("numbered = 0").withColumn("n", n).select("label", F.when(F.col("n") > 1, F.concat("base", F.lit("-"), F.col("n").cast("string"))).otherwise(F.col("base")).alias("slug"))

    def dealt(part: pd.DataFrame) -> pd.DataFrame:
        used: set[str] = set()
        least: dict[str, int] = {}
        out = []
        for label, base in part.sort_values("label")[["label", "base"]].itertuples(index=False):
            k = least.get(base.casefold(), 1)
            while (name := base if k == 1 else f"{base}-{k}").casefold() in used:
                k += 1
            least[base.casefold()] = k + 1
            used.add(name.casefold())
            out.append((label, name))
        return pd.DataFrame(out, columns=["label", "slug"])

    return plain.unionByName(marked.filter("numbered = 1").groupBy("root").applyInPandas(dealt, "label string, slug string"))


def group_index(summary: DataFrame) -> DataFrame:
    """(grp, videos, hours, claims, converged): by group, and the total with null grp, from (ws, grp, duration, claims, advice of `evidence.readiness`)."""
    return summary.rollup("grp").agg(F.count("*").alias("videos"), F.round(F.sum("duration") / 3600, 4).alias("hours"), F.sum("claims").alias("claims"), F.count_if(F.col("advice") == "converged").alias("converged"))
