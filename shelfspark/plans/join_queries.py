"""Matching, diffs, hierarchies and commerce over the catalog shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.operators import commerce as K, facets as A, hierarchy as H, joins as J, merge as M
from shelfspark.plans.catalog_queries import NO_ISBN
from shelfspark.plans.registry import Tables, query
from shelfspark.plans.scalar_queries import trim_sql
from shelfspark.plans.shapes import category_tree, main_catalog, records, source_catalog, stock_feed, with_shapes

CODE = "upper(regexp_replace(barcode, '[^0-9A-Za-z]', '', 'g'))"
SHOP = "list_filter({}, lambda e: contains(lower(trim(e.shop)), 'main store'))"
STOCK_BEST = (
    "stock AS (SELECT code, quantity, price FROM (SELECT code, quantity, price, row_number() OVER (PARTITION BY code ORDER BY round(quantity, 6) DESC, price DESC) AS rn FROM ("
    f"SELECT {CODE} AS code, coalesce(list_sum(list_transform({SHOP.format('amounts')}, lambda e: TRY_CAST(e.amount AS DOUBLE))), 0.0) AS quantity,"
    f" coalesce(list_filter(list_transform({SHOP.format('prices')}, lambda e: TRY_CAST(e.amount AS DOUBLE)), lambda n: n > 0)[1],"
    f" list_transform({SHOP.format('prices')}, lambda e: TRY_CAST(e.amount AS DOUBLE))[-1], 0.0) AS price FROM stock_feed) WHERE code <> '') WHERE rn = 1)"
)


@query("a13_stock_by_barcode", with_shapes(f", {STOCK_BEST} SELECT code, quantity, price FROM stock", "stock_feed"))
def a13(t: Tables):
    return J.stock_by_barcode(stock_feed(t), " Main Store")


MATCHES = (
    "matches AS (SELECT id, s.code, c.quantity AS old_q, c.price AS old_p, s.quantity, s.price FROM (SELECT *, coalesce(nullif("
    f"{trim_sql('isbn_normalized')}, ''), nullif(upper(regexp_replace(isbn, '[^0-9A-Za-z]', '', 'g')), '')) AS c_code FROM main_catalog WHERE NOT {NO_ISBN}) c JOIN stock s ON c_code = s.code)"
)


@query(
    "j1_match_stock_to_catalog",
    with_shapes(
        f", {STOCK_BEST}, {MATCHES} SELECT id, code AS isbn_normalized, quantity, price FROM matches WHERE abs(old_q - quantity) >= 1e-6 OR abs(old_p - price) >= 1e-6",
        "main_catalog",
        "stock_feed",
    ),
)
def j1(t: Tables):
    return J.match_stock(main_catalog(t), J.stock_by_barcode(stock_feed(t), "Main Store"))


@query(
    "u5_apply_stock_updates",
    with_shapes(
        f", {STOCK_BEST}, {MATCHES}, u AS (SELECT * FROM matches WHERE abs(old_q - quantity) >= 1e-6 OR abs(old_p - price) >= 1e-6)"
        " SELECT m.id, coalesce(u.quantity, m.quantity) AS quantity, coalesce(u.price, m.price) AS price, coalesce(u.code, m.isbn_normalized) AS isbn_normalized,"
        " CASE WHEN u.id IS NULL THEN m.updated_at ELSE 1900000000 END AS updated_at FROM main_catalog m LEFT JOIN u ON m.id = u.id",
        "main_catalog",
        "stock_feed",
    ),
)
def u5(t: Tables):
    catalog = main_catalog(t).select("id", "isbn", "isbn_normalized", "quantity", "price", "updated_at")
    updates = J.match_stock(catalog, J.stock_by_barcode(stock_feed(t), "Main Store"))
    return M.apply_stock(catalog, updates, F.lit(1900000000).cast("bigint")).drop("isbn")


FEED_ORDER = ["order_key", "line_number", "part_key", "supplier_key"]
FEED_KEY = f"CASE WHEN trim(id) <> '' THEN 'id:' || trim(id) WHEN {CODE} <> '' THEN 'barcode:' || {CODE} END"


@query(
    "w4_unique_feed_products",
    with_shapes(
        "SELECT id, barcode, order_key, line_number, part_key, supplier_key FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY order_key, line_number, part_key, supplier_key) AS rn"
        f" FROM (SELECT *, {FEED_KEY} AS k FROM stock_feed) WHERE k IS NOT NULL) WHERE rn = 1",
        "stock_feed",
    ),
)
def w4(t: Tables):
    return J.unique_feed(stock_feed(t), [F.asc(c) for c in FEED_ORDER]).select("id", "barcode", *FEED_ORDER)


@query(
    "b2_union_feed_segments",
    with_shapes(
        f"SELECT count(DISTINCT {FEED_KEY}) AS found, 1000 AS expected, count(DISTINCT {FEED_KEY}) >= 1000 AS complete FROM stock_feed",
        "stock_feed",
    ).replace("1000 AS expected", "CAST(1000 AS BIGINT) AS expected"),
)
def b2(t: Tables):
    feed = stock_feed(t)
    # two overlapping extracts that together hold the whole feed
    segments = [feed.where("line_number <= 5"), feed.where("line_number >= 3")]
    return J.completeness(J.union_segments(segments, FEED_ORDER), 1000)


MAIN_KEY_SQL = (
    "coalesce('guidNom:' || nullif(source_guid_nom, ''), 'guid:' || nullif(source_guid, ''), 'nomcode:' || nullif(source_nomcode, ''), 'id:' || nullif(source_product_id, ''))"
)
SOURCE_KEY_SQL = "coalesce('guidNom:' || nullif(guid_nom, ''), 'guid:' || nullif(guid, ''), 'nomcode:' || nullif(nomcode, ''), 'id:' || nullif(id, ''))"
MAIN_KEYS = f"main_keys AS (SELECT DISTINCT {MAIN_KEY_SQL} AS k FROM main_catalog)"


@query(
    "j2_exists_in_main",
    with_shapes(f", {MAIN_KEYS} SELECT id, {SOURCE_KEY_SQL} IN (SELECT k FROM main_keys WHERE k IS NOT NULL) AS in_main FROM source_catalog", "main_catalog", "source_catalog"),
)
def j2(t: Tables):
    return J.flag_in_main(source_catalog(t), main_catalog(t)).select("id", "in_main")


@query(
    "b3_missing_keys",
    with_shapes(f", {MAIN_KEYS} SELECT DISTINCT {SOURCE_KEY_SQL} AS key FROM source_catalog WHERE key IS NOT NULL EXCEPT SELECT k FROM main_keys", "main_catalog", "source_catalog"),
)
def b3(t: Tables):
    return J.missing_keys(source_catalog(t), main_catalog(t))


@query(
    "b3_common_keys",
    with_shapes(f", {MAIN_KEYS} SELECT DISTINCT {SOURCE_KEY_SQL} AS key FROM source_catalog WHERE key IS NOT NULL INTERSECT SELECT k FROM main_keys", "main_catalog", "source_catalog"),
)
def b3_common(t: Tables):
    return J.common_keys(source_catalog(t), main_catalog(t))


@query(
    "b4_selection_minus_exclusions",
    with_shapes("SELECT id, name FROM main_catalog WHERE price > 950 AND id NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45)", "main_catalog"),
)
def b4(t: Tables):
    excluded = t.lineitem.where("l_returnflag = 'A' AND l_quantity > 45").select(F.col("l_partkey").alias("id"))
    kept, _ = M.delete_rows(main_catalog(t).where("price > 950"), ids=excluded)
    return kept.select("id", "name")


CLOSURE = (
    "closure AS (SELECT id, name, parent_id, 1 AS depth, [name] AS path, [id] AS ancestor_ids FROM category_tree WHERE parent_id = '0'"
    " UNION ALL SELECT t.id, t.name, t.parent_id, c.depth + 1, list_append(c.path, t.name), list_append(c.ancestor_ids, t.id)"
    " FROM category_tree t JOIN closure c ON t.parent_id = c.id)"
)


@query(
    "h1_category_closure",
    with_shapes(f", {CLOSURE} SELECT id, depth, array_to_string(path, '|') AS path, array_to_string(ancestor_ids, '|') AS ancestors FROM closure", "category_tree", recursive=True),
)
def h1(t: Tables):
    c = H.category_closure(category_tree(t))
    return c.select("id", "depth", F.array_join("path", "|").alias("path"), F.array_join("ancestor_ids", "|").alias("ancestors"))


@query(
    "h2_descendants",
    with_shapes(f", {CLOSURE} SELECT unnest(ancestor_ids) AS id, id AS descendant_id FROM closure", "category_tree", recursive=True),
)
def h2(t: Tables):
    return H.descendant_pairs(H.category_closure(category_tree(t)))


# Niches: regions own nations own suppliers; a customer is a subject of its supplier.
def niches(t: Tables):
    tree = category_tree(t).where("NOT id LIKE 'c%'")
    return tree.select(F.col("id").alias("guid"), "name", F.when(F.col("parent_id") == "0", "gone").otherwise(F.col("parent_id")).alias("owner_guid"))


def subjects(t: Tables):
    return t.customer.selectExpr("concat('c', CAST(c_custkey AS STRING)) AS guid", "c_name AS name", "concat('s', CAST(c_custkey % 150 AS STRING)) AS owner_guid")


NICHES = "niches AS (SELECT id AS guid, name, CASE parent_id WHEN '0' THEN 'gone' ELSE parent_id END AS owner_guid FROM category_tree WHERE id NOT LIKE 'c%')"
SUBJECTS = "subjects AS (SELECT concat('c', c_custkey) AS guid, c_name AS name, concat('s', c_custkey % 150) AS owner_guid FROM customer)"
NICHE_WALK = (
    "walk AS (SELECT guid, name, 1 AS depth, name AS head, guid AS chain FROM niches WHERE owner_guid NOT IN (SELECT guid FROM niches)"
    " UNION ALL SELECT n.guid, n.name, w.depth + 1, w.head, w.chain || chr(31) || n.guid FROM niches n JOIN walk w ON n.owner_guid = w.guid)"
)


@query(
    "h3_niche_tree",
    with_shapes(
        f", {NICHES}, {SUBJECTS}, {NICHE_WALK} SELECT 'niche' AS kind, guid, name, depth, head || chr(31) || chain AS sort_key FROM walk"
        " UNION ALL SELECT 'subject', s.guid, s.name, w.depth + 1, w.head || chr(31) || w.chain || chr(31) || '~' || s.name || chr(31) || s.guid FROM subjects s JOIN walk w ON s.owner_guid = w.guid",
        "category_tree",
        recursive=True,
    ),
)
def h3(t: Tables):
    return H.niche_tree(niches(t), subjects(t)).orderBy("sort_key")


@query(
    "h4_niche_descendants",
    with_shapes(f", {NICHES}, down AS (SELECT guid FROM niches WHERE guid = 'r1' UNION ALL SELECT n.guid FROM niches n JOIN down d ON n.owner_guid = d.guid) SELECT guid FROM down", "category_tree", recursive=True),
)
def h4(t: Tables):
    return H.niche_descendants(niches(t), "r1")


@query(
    "j9_subjects_under_niche",
    with_shapes(
        f", {NICHES}, {SUBJECTS}, down AS (SELECT guid FROM niches WHERE guid = 'r1' UNION ALL SELECT n.guid FROM niches n JOIN down d ON n.owner_guid = d.guid)"
        " SELECT guid, name FROM subjects WHERE owner_guid IN (SELECT guid FROM down)",
        "category_tree",
        recursive=True,
    ),
)
def j9(t: Tables):
    return H.subjects_for_niche(subjects(t), niches(t), "r1").select("guid", "name")


@query(
    "h5_path_tree",
    with_shapes(
        ", p AS (SELECT DISTINCT list_filter([coalesce(subject_name, ''), coalesce(niche_name, ''), 'HTTPS://Www.X.example/a'], lambda x: x <> '') AS path FROM main_catalog),"
        " n AS (SELECT DISTINCT path[1:i] AS path FROM (SELECT path, unnest(range(1, len(path) + 1)) AS i FROM p)),"
        " k AS (SELECT path, 'path:' || rtrim(replace(replace(to_base64(encode(array_to_string(path, chr(31)))), '+', '-'), '/', '_'), '=') AS node_id,"
        " 'path:' || rtrim(replace(replace(to_base64(encode(array_to_string(path[:-2], chr(31)))), '+', '-'), '/', '_'), '=') AS up FROM n)"
        " SELECT node_id, CASE WHEN len(path) > 1 THEN up END AS parent_node_id, CASE WHEN path[-1] LIKE 'HTTPS:%' THEN 'www.x.example' ELSE path[-1] END AS name,"
        " CAST(len(path) AS INTEGER) AS depth, lower(array_to_string(path, chr(31))) AS sort_key FROM k",
        "main_catalog",
    ),
)
def h5(t: Tables):
    paths = main_catalog(t).select(F.array("subject_name", "niche_name", F.lit("HTTPS://Www.X.example/a")).alias("path"))
    return H.path_tree(paths).orderBy("sort_key")


# A move per customer node: to its own nation, to itself, below itself, to an unknown node or to the root.
MOVES = (
    "SELECT concat('c', CAST(c_custkey AS STRING)) AS id, CASE c_custkey % 4 WHEN 0 THEN concat('n', CAST(c_nationkey AS STRING)) WHEN 1 THEN concat('c', CAST(c_custkey AS STRING))"
    " WHEN 2 THEN 'zz' ELSE ' ' END AS new_parent_id FROM customer UNION ALL SELECT concat('n', CAST(s_nationkey AS STRING)), concat('s', CAST(s_suppkey AS STRING)) FROM supplier"
    " UNION ALL SELECT concat('x', CAST(s_suppkey AS STRING)), '0' FROM supplier"
)


@query(
    "h6_validate_moves",
    with_shapes(
        f", {CLOSURE}, moves AS (SELECT id, coalesce(nullif(trim(new_parent_id), ''), '0') AS new_parent_id FROM ({MOVES}))"
        " SELECT m.id, m.new_parent_id, CASE WHEN m.id NOT IN (SELECT id FROM category_tree) THEN 'category not found' WHEN m.id = m.new_parent_id THEN 'category cannot be its own parent'"
        " WHEN m.new_parent_id <> '0' AND m.new_parent_id NOT IN (SELECT id FROM category_tree) THEN 'parent category not found'"
        " WHEN list_contains(c.ancestor_ids, m.id) THEN 'cannot move category into its own subtree' END AS reason FROM moves m LEFT JOIN closure c ON c.id = m.new_parent_id",
        "category_tree",
        recursive=True,
    ),
)
def h6(t: Tables):
    moves = t.customer.selectExpr(
        "concat('c', CAST(c_custkey AS STRING)) AS id",
        "CASE c_custkey % 4 WHEN 0 THEN concat('n', CAST(c_nationkey AS STRING)) WHEN 1 THEN concat('c', CAST(c_custkey AS STRING)) WHEN 2 THEN 'zz' ELSE ' ' END AS new_parent_id",
    )
    down = t.supplier.selectExpr("concat('n', CAST(s_nationkey AS STRING)) AS id", "concat('s', CAST(s_suppkey AS STRING)) AS new_parent_id")
    unknown = t.supplier.selectExpr("concat('x', CAST(s_suppkey AS STRING)) AS id", "'0' AS new_parent_id")
    tree = category_tree(t)
    return H.validate_moves(tree, H.category_closure(tree), moves.unionByName(down).unionByName(unknown))


@query(
    "j10_expand_category_filter",
    with_shapes(
        f", {CLOSURE}, pairs AS (SELECT unnest(ancestor_ids) AS id, id AS d FROM closure), ids AS (SELECT DISTINCT coalesce(category_id, 'none') AS id FROM main_catalog)"
        " SELECT DISTINCT coalesce(d, ids.id) AS id FROM ids LEFT JOIN pairs ON ids.id = pairs.id",
        "category_tree",
        "main_catalog",
        recursive=True,
    ),
)
def j10(t: Tables):
    ids = main_catalog(t).select(F.coalesce("category_id", F.lit("none")).alias("id")).distinct()
    return H.expand_categories(ids, H.descendant_pairs(H.category_closure(category_tree(t))))


LINKED = (
    f", {CLOSURE}, names AS (SELECT lower(trim(name)) AS name, min(id) AS cid FROM closure GROUP BY 1),"
    " terms AS (SELECT DISTINCT term FROM (SELECT lower(nullif(trim(subject_name), '')) AS term FROM source_catalog UNION ALL SELECT lower(nullif(trim(niche_name), '')) FROM source_catalog) WHERE term IS NOT NULL),"
    " exact AS (SELECT term, cid FROM terms JOIN names ON term = name),"
    " partial AS (SELECT term, cid FROM (SELECT term, cid, row_number() OVER (PARTITION BY term ORDER BY length(name) DESC, name, cid) AS rn FROM terms JOIN names ON contains(term, name) OR contains(name, term)"
    " WHERE term NOT IN (SELECT term FROM exact)) WHERE rn = 1),"
    " linked AS (SELECT s.id, coalesce(se.cid, ne.cid, sp.cid, np.cid) AS cid FROM source_catalog s"
    " LEFT JOIN exact se ON se.term = lower(nullif(trim(subject_name), '')) LEFT JOIN exact ne ON ne.term = lower(nullif(trim(niche_name), ''))"
    " LEFT JOIN partial sp ON sp.term = lower(nullif(trim(subject_name), '')) LEFT JOIN partial np ON np.term = lower(nullif(trim(niche_name), '')))"
)


@query(
    "j4_link_categories",
    with_shapes(
        LINKED + " SELECT l.id, array_to_string(c.ancestor_ids, '|') AS category_ids, array_to_string(c.path, '|') AS category_path FROM linked l LEFT JOIN closure c ON l.cid = c.id",
        "category_tree",
        "source_catalog",
        recursive=True,
    ),
)
def j4(t: Tables):
    linked = J.link_categories(source_catalog(t), H.category_closure(category_tree(t)))
    return linked.select("id", F.array_join("category_ids", "|").alias("category_ids"), F.array_join("category_path", "|").alias("category_path"))


@query(
    "a20_link_stats",
    with_shapes(
        LINKED + " SELECT 'total_categories' AS metric, count(DISTINCT lower(trim(name))) AS value FROM closure UNION ALL SELECT 'total_nodes', count(*) FROM closure"
        " UNION ALL SELECT 'linked_products', count(cid) FROM linked",
        "category_tree",
        "source_catalog",
        recursive=True,
    ),
)
def a20(t: Tables):
    closure = H.category_closure(category_tree(t))
    return A.link_stats(closure, J.link_categories(source_catalog(t), closure))


CARTS = (
    "SELECT l_orderkey AS user_id, l_partkey * 2 - 100 AS product_id, l_linenumber AS quantity,"
    " CASE l_returnflag WHEN 'R' THEN 0.0 ELSE floor(l_extendedprice) END AS price_at_add FROM lineitem"
)


def cart_lines(t: Tables):
    return t.lineitem.selectExpr(
        "l_orderkey AS user_id",
        "l_partkey * 2 - 100 AS product_id",
        "l_linenumber AS quantity",
        "CASE l_returnflag WHEN 'R' THEN CAST(0 AS DOUBLE) ELSE CAST(floor(l_extendedprice) AS DOUBLE) END AS price_at_add",
    )


@query(
    "j5_price_cart",
    f"WITH c AS ({CARTS}) SELECT user_id, count(*) AS lines, CAST(sum(quantity) AS BIGINT) AS units,"
    " CAST(sum(CAST(round(CASE WHEN price_at_add = 0 THEN p_retailprice ELSE price_at_add END * 100) AS BIGINT) * quantity) AS BIGINT) AS amount_cents"
    " FROM c JOIN part ON product_id = p_partkey GROUP BY user_id",
)
def j5(t: Tables):
    return J.order_totals(J.priced_items(cart_lines(t), main_catalog(t).select("id", "name", "price")))


@query(
    "j5_rejected_carts",
    f"WITH c AS ({CARTS}) SELECT DISTINCT user_id FROM c WHERE user_id NOT IN (SELECT user_id FROM c JOIN part ON product_id = p_partkey)",
)
def j5_rejected(t: Tables):
    carts = cart_lines(t)
    return J.rejected_carts(carts, J.priced_items(carts, main_catalog(t).select("id", "name", "price")))


# Runs: a run per day of events; every third day failed.
RUNS = (
    "runs AS (SELECT run_id, min(created_at) AS created_at, count(*) AS records, CASE CAST(substr(run_id, 13, 2) AS INTEGER) % 3 WHEN 0 THEN 'failed' ELSE 'finished' END AS status FROM records GROUP BY run_id)"
)
LAST_RUN = "last_run AS (SELECT max(run_id) AS run_id FROM records)"
PREVIOUS = (
    "previous AS (SELECT run_id FROM runs WHERE run_id <> 'run-2024-01-28' AND status = 'finished' AND records > 0 ORDER BY created_at DESC, run_id DESC LIMIT 1)"
)


def runs(t: Tables):
    grouped = records(t).groupBy("run_id").agg(F.min("created_at").alias("created_at"), F.count(F.lit(1)).alias("records"))
    failed = F.substring("run_id", 13, 2).cast("int") % 3 == 0
    return grouped.withColumn("status", F.when(failed, "failed").otherwise("finished"))


@query("w9_latest_previous_run", with_shapes(f", {RUNS}, {PREVIOUS} SELECT run_id FROM previous", "records"))
def w9(t: Tables):
    return J.previous_run(runs(t), "run-2024-01-28").select("run_id")


SORTED_DATA = "json_extract_string(data, '$.isbn') || '~' || json_extract_string(data, '$.price') || '~' || json_extract_string(data, '$.title') || '~' || json_extract_string(data, '$.props.k')"


@query(
    "j6_diff_run_vs_previous",
    with_shapes(
        f", {RUNS}, {PREVIOUS}, old AS (SELECT source_url, arg_max({SORTED_DATA}, record_id) AS d FROM records WHERE run_id IN (SELECT run_id FROM previous) GROUP BY source_url)"
        f" SELECT record_id, r.source_url, CASE WHEN old.d IS NULL THEN 'new' WHEN old.d = {SORTED_DATA} THEN 'unchanged' ELSE 'changed' END AS status"
        " FROM records r LEFT JOIN old ON r.source_url = old.source_url WHERE run_id = 'run-2024-01-28'",
        "records",
    ),
)
def j6(t: Tables):
    return J.diff_runs(records(t), runs(t), "run-2024-01-28")


# Every fifth record has no data and every seventh data that no reader takes; equal ones are unchanged all the same.
ODD_DATA = "CASE WHEN length(source_url) % 5 = 0 THEN NULL WHEN length(source_url) % 7 = 0 THEN concat('{', source_url) ELSE data END"


@query(
    "j6_diff_unreadable_records",
    with_shapes(
        f", {RUNS}, {PREVIOUS}, kept AS (SELECT * REPLACE ({ODD_DATA} AS data) FROM records), old AS (SELECT source_url, max(record_id) AS record_id FROM kept WHERE run_id IN (SELECT run_id FROM previous) GROUP BY source_url)"
        f" SELECT n.record_id, n.source_url, CASE WHEN old.record_id IS NULL THEN 'new' WHEN n.data IS NOT DISTINCT FROM o.data OR ({SORTED_DATA.replace('(data', '(CASE WHEN json_valid(n.data) THEN n.data END')}) = ({SORTED_DATA.replace('(data', '(CASE WHEN json_valid(o.data) THEN o.data END')}) THEN 'unchanged' ELSE 'changed' END AS status"
        " FROM kept n LEFT JOIN old ON n.source_url = old.source_url LEFT JOIN kept o ON o.record_id = old.record_id WHERE n.run_id = 'run-2024-01-28'",
        "records",
    ),
)
def j6_unreadable(t: Tables):
    return J.diff_runs(records(t).withColumn("data", F.expr(ODD_DATA)), runs(t), "run-2024-01-28")


RULES = {
    "source.isbn": ("isbn", ""),
    "source.name": ("title", "unused"),
    "main.price": ("price", ""),
    "main.brandName": ("", "House"),
    "main.absent": ("nothing", ""),
}


def remote_products(t: Tables):
    """Known products per ISBN: the mean customer of that user, in target fields."""
    data = F.to_json(
        F.struct(
            F.concat(F.lit("978"), (F.col("c_custkey") + 1000000000).cast("string")).alias("source.isbn"),
            F.when(F.col("c_custkey") % 2 == 0, "click").otherwise(" view ").alias("source.name"),
            (F.col("c_custkey") % 3).alias("main.price"),
        )
    )
    return t.customer.select(F.concat(F.lit("978"), (F.col("c_custkey") + 1000000000).cast("string")).alias("identifier"), data.alias("data"))


@query(
    "j7_diff_mapped_fields",
    with_shapes(
        ", l AS (SELECT record_id, json_extract_string(data, '$.title') AS title, CAST(json_extract_string(data, '$.price') AS BIGINT) AS price, json_extract_string(data, '$.isbn') AS isbn FROM records),"
        " r AS (SELECT concat('978', 1000000000 + c_custkey) AS identifier, CASE c_custkey % 2 WHEN 0 THEN 'click' ELSE 'view' END AS name, c_custkey % 3 AS price FROM customer),"
        " j AS (SELECT l.*, nullif(isbn, '') AS identifier, r.identifier AS rid, r.name AS rname, r.price AS rprice FROM l LEFT JOIN r ON nullif(l.isbn, '') = r.identifier)"
        " SELECT record_id, identifier, CASE WHEN rid IS NULL THEN 'new' ELSE 'changed' END AS status,"
        " CASE WHEN rid IS NULL THEN '' ELSE concat_ws(',', CASE WHEN title <> rname THEN 'source.name' END, CASE WHEN price <> rprice THEN 'main.price' END, 'main.brandName') END AS changed_fields FROM j",
        "records",
    ),
)
def j7(t: Tables):
    diff = J.diff_fields(records(t), remote_products(t), RULES)
    return diff.select("record_id", "identifier", "status", F.array_join(F.transform("changed", lambda e: e["field"]), ",").alias("changed_fields"))


@query(
    "j8_refresh_flags_after_delete",
    with_shapes(
        ", gone AS (SELECT *, coalesce('guidNom:' || nullif(source_guid_nom, ''), 'guid:' || nullif(source_guid, ''), 'nomcode:' || nullif(source_nomcode, '')) AS k FROM main_catalog WHERE price < 1000),"
        " rest AS (SELECT unnest(['guidNom:' || nullif(source_guid_nom, ''), 'guid:' || nullif(source_guid, ''), 'nomcode:' || nullif(source_nomcode, '')]) AS k FROM main_catalog WHERE NOT price < 1000),"
        " verdict AS (SELECT DISTINCT k, k IN (SELECT k FROM rest WHERE k IS NOT NULL) AS still FROM gone WHERE k IS NOT NULL),"
        " carried AS (SELECT id, unnest(['guidNom:' || nullif(guid_nom, ''), 'guid:' || nullif(guid, ''), 'nomcode:' || nullif(nomcode, '')]) AS k FROM source_catalog),"
        " flags AS (SELECT id, bool_or(still) AS f FROM carried JOIN verdict USING (k) GROUP BY id)"
        " SELECT s.id, coalesce(f, in_main) AS in_main FROM source_catalog s LEFT JOIN flags ON s.id = flags.id",
        "main_catalog",
        "source_catalog",
    ),
)
def j8(t: Tables):
    kept, gone = M.delete_rows(main_catalog(t), F.col("price") < 1000)
    return J.refresh_flags(source_catalog(t), gone, kept).select("id", "in_main")


@query(
    "j11_ownership_checks",
    "SELECT o_orderkey AS id, o_custkey AS user_id, o_orderkey * 2 AS address_id, CASE WHEN c.c_custkey IS NULL THEN 'not found' ELSE 'not owned by the user' END AS reason"
    " FROM orders LEFT JOIN customer c ON o_orderkey * 2 = c.c_custkey WHERE c.c_custkey IS NULL OR c.c_custkey % 100 <> o_custkey",
)
def j11(t: Tables):
    rows = t.orders.selectExpr("o_orderkey AS id", "o_custkey AS user_id", "o_orderkey * 2 AS address_id")
    addresses = t.customer.selectExpr("c_custkey AS id", "c_custkey % 100 AS user_id")
    return J.ownership_violations(rows, addresses, "address_id").select("id", "user_id", "address_id", "reason")


@query(
    "w7_first_record_per_url",
    with_shapes(
        "SELECT record_id, run_id, source_url FROM (SELECT *, row_number() OVER (PARTITION BY run_id, source_url ORDER BY created_at, record_id) AS rn FROM records) WHERE rn = 1",
        "records",
    ),
)
def w7(t: Tables):
    return K.first_record_per_url(records(t)).select("record_id", "run_id", "source_url")


@query("w10_top_k_popular", "SELECT o_orderkey AS id, o_totalprice AS view_count, o_orderpriority AS title FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def w10(t: Tables):
    posts = t.orders.selectExpr("o_orderkey AS id", "o_totalprice AS view_count", "o_orderpriority AS title", "o_orderstatus = 'O' AS is_published", "o_custkey AS content")
    return K.top_k(posts, "view_count", 25, flag="is_published", drop=["content"]).select("id", "view_count", "title")


@query(
    "w11_user_history_page",
    "SELECT user_id, order_id, CAST(position AS INTEGER) AS position, total FROM (SELECT o_custkey AS user_id, o_orderkey AS order_id,"
    " row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS position, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders) WHERE position > 5 AND position <= 10",
)
def w11(t: Tables):
    orders = t.orders.selectExpr("o_custkey AS user_id", "o_orderkey AS order_id", "o_orderdate AS created_at")
    return K.user_history(orders, page=2, limit=5).select("user_id", "order_id", "position", "total")


@query(
    "w12_library_from_orders",
    "SELECT DISTINCT o_custkey AS user_id, l_partkey AS product_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
    " WHERE (o_custkey, l_partkey) NOT IN (SELECT user_id, CAST(floor(value) AS BIGINT) FROM events WHERE event_type = 'purchase')",
)
def w12(t: Tables):
    sold = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr("o_custkey AS user_id", "l_partkey AS product_id")
    owned = t.events.where("event_type = 'purchase'").selectExpr("user_id", "CAST(floor(value) AS BIGINT) AS product_id")
    return K.library_from_orders(sold, owned)


CART_EVENTS = (
    "SELECT user_id, user_id * 3 + CAST(floor(value) AS BIGINT) % 3 AS product_id, CASE event_type WHEN 'click' THEN 'add' WHEN 'view' THEN 'add' WHEN 'purchase' THEN 'set'"
    " WHEN 'signup' THEN 'remove' ELSE CASE CAST(floor(value) AS BIGINT) % 4 WHEN 0 THEN 'clear' ELSE 'set' END END AS action, CAST(floor(value) AS BIGINT) % 7 + 1 AS quantity, event_id AS seq FROM events"
)


def cart_events(t: Tables):
    return t.events.selectExpr(
        "user_id",
        "user_id * 3 + CAST(floor(value) AS BIGINT) % 3 AS product_id",
        "CASE event_type WHEN 'click' THEN 'add' WHEN 'view' THEN 'add' WHEN 'purchase' THEN 'set' WHEN 'signup' THEN 'remove'"
        " ELSE CASE CAST(floor(value) AS BIGINT) % 4 WHEN 0 THEN 'clear' ELSE 'set' END END AS action",
        "CAST(floor(value) AS BIGINT) % 7 + 1 AS quantity",
        "event_id AS seq",
    )


FOLDED_CARTS = (
    f"WITH e AS ({CART_EVENTS}), cl AS (SELECT user_id, max(seq) AS c FROM e WHERE action = 'clear' GROUP BY 1),"
    " rm AS (SELECT user_id, product_id, max(seq) AS r FROM e WHERE action = 'remove' GROUP BY 1, 2),"
    " live AS (SELECT e.* FROM e LEFT JOIN cl USING (user_id) LEFT JOIN rm USING (user_id, product_id) WHERE action IN ('add', 'set') AND seq > greatest(coalesce(c, -1), coalesce(r, -1))),"
    " ent AS (SELECT user_id, product_id, min(seq) AS s FROM live WHERE action = 'add' GROUP BY 1, 2),"
    " ok AS (SELECT live.* FROM live JOIN ent USING (user_id, product_id) WHERE seq >= s),"
    " ls AS (SELECT user_id, product_id, max(seq) AS ss, arg_max(quantity, seq) AS sq FROM ok WHERE action = 'set' GROUP BY 1, 2)"
    " SELECT ok.user_id, ok.product_id, CAST(coalesce(any_value(sq), 0) + coalesce(sum(ok.quantity) FILTER (action = 'add' AND seq > coalesce(ss, -1)), 0) AS BIGINT) AS quantity"
    " FROM ok LEFT JOIN ls USING (user_id, product_id) GROUP BY 1, 2"
)


@query("u12_fold_cart_events", FOLDED_CARTS)
def u12(t: Tables):
    return K.fold_carts(cart_events(t))
