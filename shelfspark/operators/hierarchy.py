"""Category and niche trees: closure, descendants, path trees, move checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfspark.functions.text import clean_array, path_key, trim_all
from shelfspark.functions.urls import url_host
from shelfspark.session import cut_lineage

ROOT = "0"


def walk_down(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Closure from the given roots: id, name, parent_id, depth, path, ancestor_ids.

    Path doubling: every node knows the chain of its nearest ancestors, and each round puts the chain of the topmost one in
    front of it, so chains of 2, 4, 8 nodes reach a root in about log2(depth) rounds, each one equi-join and one
    checkpoint. A chain ends at a root or where the parent is unknown; only those that end at a root count. A chain that
    would run into itself is on a cycle, or hangs below one, and stops there.
    """
    edges = nodes.select("id", "name", "parent_id")
    root_rows = roots.select("id", "name", "parent_id")
    one = [F.array("id").alias("ids"), F.array("name").alias("names")]
    tops = root_rows.select("id", "name", "parent_id", F.lit(None).cast("string").alias("next"), *one, F.lit(True).alias("rooted"))
    # an edge from a node of the tree; a root that is also somebody's child is both
    inner = edges.where(F.col("parent_id") != F.col("id")).select("id", "name", "parent_id", F.col("parent_id").alias("next"), *one, F.lit(False).alias("rooted"))
    done = cut_lineage(tops)
    open_ = cut_lineage(inner)
    while not open_.isEmpty():
        # what a chain goes on with: the chains that end at its topmost parent
        heads = done.unionByName(open_).select(F.col("id").alias("next"), F.col("next").alias("_next"), F.col("ids").alias("_ids"), F.col("names").alias("_names"), F.col("rooted").alias("_rooted"))
        grown = open_.join(heads, "next").where(~F.arrays_overlap("_ids", "ids"))
        grown = grown.select(
            "id", "name", "parent_id", F.col("_next").alias("next"), F.concat("_ids", "ids").alias("ids"), F.concat("_names", "names").alias("names"), F.col("_rooted").alias("rooted")
        )
        grown = cut_lineage(grown)
        done = done.unionByName(grown.where("rooted"))
        open_ = grown.where("not rooted")
    return done.select("id", "name", "parent_id", F.size("ids").alias("depth"), F.col("names").alias("path"), F.col("ids").alias("ancestor_ids"))


def category_closure(tree: DataFrame) -> DataFrame:
    """Every category reachable from a root, with names and ids from the root down."""
    return walk_down(tree, tree.where(F.col("parent_id") == ROOT))


def descendant_pairs(closure: DataFrame) -> DataFrame:
    """(id, descendant_id), the node itself included."""
    return closure.select(F.explode("ancestor_ids").alias("id"), F.col("id").alias("descendant_id"))


def descendants(closure: DataFrame, category_id: str) -> DataFrame:
    return closure.where(F.array_contains("ancestor_ids", category_id)).select("id")


def niche_tree(niches: DataFrame, subjects: DataFrame) -> DataFrame:
    """Flat tree rows: kind, guid, name, depth and the sort key of the printed order.

    Roots are niches with no owner or an unknown one. Roots order by name,
    child niches by guid, subjects by name behind the child niches.
    """
    nodes = niches.select(F.col("guid").alias("id"), "name", F.col("owner_guid").alias("parent_id"))
    known = nodes.select(F.col("id").alias("parent_id"))
    roots = nodes.join(known, "parent_id", "left_anti").unionByName(nodes.where("parent_id = ''"), allowMissingColumns=True)
    closed = walk_down(nodes, roots.select("id", "name", "parent_id").distinct())
    head = F.concat(F.element_at("path", 1), F.lit("\u001f"), F.array_join("ancestor_ids", "\u001f"))
    niche_rows = closed.select(F.lit("niche").alias("kind"), F.col("id").alias("guid"), "name", "depth", head.alias("sort_key"))
    owners = closed.select(F.col("id").alias("owner_guid"), "depth", head.alias("_head"))
    subject_rows = subjects.join(owners, "owner_guid").select(
        F.lit("subject").alias("kind"),
        "guid",
        "name",
        (F.col("depth") + 1).alias("depth"),
        F.concat("_head", F.lit("\u001f~"), "name", F.lit("\u001f"), "guid").alias("sort_key"),
    )
    return niche_rows.unionByName(subject_rows)


def niche_descendants(niches: DataFrame, guid: str) -> DataFrame:
    """Guids of a niche and everything below it; a cycle of owners ends the walk."""
    nodes = niches.select(F.col("guid").alias("id"), "name", F.col("owner_guid").alias("parent_id"))
    return walk_down(nodes, nodes.where(F.col("id") == guid)).select(F.col("id").alias("guid"))


def subjects_for_niche(subjects: DataFrame, niches: DataFrame, guid: str) -> DataFrame:
    under = niche_descendants(niches, guid).select(F.col("guid").alias("owner_guid")).distinct()
    return subjects.join(under, "owner_guid", "left_semi")


def expand_categories(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """Ids plus all their descendants, once each; unknown ids stay."""
    return ids.join(pairs, "id", "left").select(F.coalesce("descendant_id", "id").alias("id")).distinct()


def path_tree(paths: DataFrame, prefix: str = "path:") -> DataFrame:
    """Nodes of all path prefixes: node_id, parent_node_id, name, depth, sort key by lower name."""
    clean = paths.select(clean_array("path").alias("path")).where(F.col("path").isNotNull())
    heads = F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", F.lit(1), n))
    nodes = clean.select(F.explode(heads).alias("path")).distinct()
    last = F.element_at("path", -1)
    shown = F.when(F.lower(last).rlike("^https?://[^/?#]"), url_host(last)).otherwise(trim_all(last))
    parent = F.slice("path", F.lit(1), F.size("path") - 1)
    return nodes.select(
        F.concat(F.lit(prefix), path_key("path")).alias("node_id"),
        F.when(F.size("path") > 1, F.concat(F.lit(prefix), path_key(parent))).alias("parent_node_id"),
        shown.alias("name"),
        F.size("path").alias("depth"),
        F.array_join(F.transform("path", lambda p: F.lower(p)), "\u001f").alias("sort_key"),
    )


def validate_moves(tree: DataFrame, closure: DataFrame, moves: DataFrame) -> DataFrame:
    """Moves (id, new_parent_id) with the reason a move is refused, null where it is fine."""
    target = F.coalesce(F.nullif(trim_all("new_parent_id"), F.lit("")), F.lit(ROOT))
    known = tree.select("id", F.lit(True).alias("_known")).distinct()
    parents = tree.select(F.col("id").alias("new_parent_id"), F.lit(True).alias("_parent_known")).distinct()
    above = closure.select(F.col("id").alias("new_parent_id"), "ancestor_ids")
    joined = (
        moves.withColumn("new_parent_id", target)
        .join(known, "id", "left")
        .join(parents, "new_parent_id", "left")
        .join(above, "new_parent_id", "left")
    )
    reason = (
        F.when(F.col("_known").isNull(), "category not found")
        .when(F.col("new_parent_id") == F.col("id"), "category cannot be its own parent")
        .when((F.col("new_parent_id") != ROOT) & F.col("_parent_known").isNull(), "parent category not found")
        .when(F.array_contains("ancestor_ids", F.col("id")), "cannot move category into its own subtree")
    )
    return joined.select("id", "new_parent_id", reason.alias("reason"))


def delete_category(tree: DataFrame, closure: DataFrame, category_id: str) -> tuple[DataFrame, DataFrame]:
    """(remaining tree, ids of the removed subtree)."""
    gone = descendants(closure, category_id)
    return tree.join(gone, "id", "left_anti"), gone


def category_paths(closure: DataFrame, changed: DataFrame) -> DataFrame:
    """New (category_id, path) of every category at or below the changed ones."""
    hit = closure.select("id", "path", F.explode("ancestor_ids").alias("_above")).join(
        changed.select(F.col("id").alias("_above")).distinct(), "_above", "left_semi"
    )
    return hit.select(F.col("id").alias("category_id"), "path").distinct()
