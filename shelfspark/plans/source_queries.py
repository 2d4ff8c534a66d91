"""Feeds, files and mapping: written from whole tables, read back, compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions.values import parse, source_price
from shelfspark.operators import mapping as G, search as S
from shelfspark.plans.join_queries import RUNS, runs
from shelfspark.plans.registry import Tables, query
from shelfspark.plans.scalar_queries import clean_list_sql
from shelfspark.plans.shapes import main_catalog, records, source_catalog, with_shapes
from shelfspark.session import fresh_path
from shelfspark.sources import catalog_csv as CSV, client_feed as CF, cursors as CU, publisher as PB, records as R, trees as TR


def _obj(**fields):
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def publisher_items(t: Tables):
    """A publisher item per part as JSON text."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    item = F.struct(
        F.concat(F.lit("G"), key).alias("GUID"),
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("GN"), key)).alias("GUID_NOM"),
        F.col("p_partkey").alias("NOMCODE"),
        F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise(F.col("p_name")).alias("NAME"),
        F.concat(F.lit("Price name "), "p_name").alias("NAME_FOR_PRICE"),
        _obj(GUID=F.concat(F.lit("s"), size), NAME=F.col("p_type"), OWNER_GUID=F.lit("o1")).alias("SUBJECT"),
        F.when(F.col("p_partkey") % 4 != 0, _obj(GUID=F.lit("k"), NAME=F.col("p_brand"))).alias("NICHE"),
        F.array(
            _obj(GUID=F.concat(F.lit("a"), size), CODE=size, NAME=F.col("p_brand"), IS_PISATEL=F.lit("1")),
            _obj(GUID=F.lit(""), CODE=F.lit(""), NAME=F.col("p_type"), IS_PISATEL=F.lit("0")),
        ).alias("AUTHOR"),
        F.array(_obj(GUID=F.lit(""), NAME=F.lit("T")), _obj(GUID=F.lit("t1"), NAME=F.lit(""))).alias("TAGS"),
        F.array(_obj(GUID=F.lit(""), NAME=F.col("p_type"))).alias("GENRE"),
        F.create_map(
            F.lit("cover1"), _obj(LINK=F.concat(F.lit("https://c.example/"), key)), F.lit("cover2"), _obj(LINK=F.lit(""))
        ).alias("COVERS"),
        size.alias("PAGES"),
    )
    return t.part.select(F.to_json(item).alias("value"))


@query(
    "s1_read_source_items",
    "SELECT 'G' || p_partkey AS guid, CASE p_partkey % 2 WHEN 0 THEN 'GN' || p_partkey ELSE '' END AS guid_nom, CAST(p_partkey AS VARCHAR) AS nomcode,"
    " CASE p_partkey % 3 WHEN 0 THEN 'Price name ' || p_name ELSE p_name END AS name, p_type AS subject_name, CASE WHEN p_partkey % 4 <> 0 THEN p_brand END AS niche_name,"
    " 'a' || p_size AS author_guids, p_brand || '|' || p_type AS author_names, true AS first_is_writer, 't1' AS tag_guids, 'T' AS tag_names, CAST(1 AS INTEGER) AS genre_refs,"
    " 'https://c.example/' || p_partkey AS cover_url, 'cover1' AS cover_keys, p_size AS pages FROM part",
)
def s1(t: Tables):
    path = fresh_path(t.spark, "items")
    publisher_items(t).write.text(path)
    items = PB.read_source_items(t.spark, path)
    return items.select(
        "guid", "guid_nom", "nomcode", "name", "subject_name", "niche_name",
        F.array_join(F.transform("author_refs", lambda a: a["guid"]), "|").alias("author_guids"),
        F.array_join("author_names", "|").alias("author_names"),
        F.get("author_refs", F.lit(0))["is_writer"].alias("first_is_writer"),
        F.array_join(F.transform("tag_refs", lambda a: a["guid"]), "|").alias("tag_guids"),
        F.array_join("tag_names", "|").alias("tag_names"),
        F.size("genre_refs").alias("genre_refs"),
        "cover_url",
        F.array_join(F.map_keys("covers"), "|").alias("cover_keys"),
        "pages",
    )


@query(
    "s2_read_reference_entities",
    "SELECT 'author' AS kind, 'a' || s_suppkey AS guid, s_name AS name, CASE s_suppkey % 2 WHEN 0 THEN s_suppkey % 3 = 0 ELSE s_nationkey % 2 = 1 END AS flag FROM supplier"
    " UNION ALL SELECT 'tag', 't' || c_custkey, c_name, c_custkey % 2 <> 1 FROM customer",
)
def s2(t: Tables):
    even = F.col("s_suppkey") % 2 == 0
    authors = t.supplier.select(
        F.to_json(
            F.struct(
                F.concat(F.lit("a"), F.col("s_suppkey").cast("string")).alias("GUID"),
                F.col("s_name").alias("NAME"),
                F.when(even, _obj(WRITER=F.col("s_suppkey") % 3 == 0)).alias("FLAGS"),
                (F.col("s_nationkey") % 2).alias("IS_PISATEL"),
            )
        ).alias("value")
    )
    tags = t.customer.select(
        F.to_json(
            F.struct(F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("GUID"), F.col("c_name").alias("NAME"), (F.col("c_custkey") % 2 == 1).alias("IS_NO_ACTIVE"))
        ).alias("value")
    )
    path = fresh_path(t.spark, "entities")
    authors.write.text(path + "/author")
    tags.write.text(path + "/tag")
    a = PB.read_entities(t.spark, path + "/author", "author").select(F.lit("author").alias("kind"), "guid", "name", F.col("is_writer").alias("flag"))
    g = PB.read_entities(t.spark, path + "/tag", "tag").select(F.lit("tag").alias("kind"), "guid", "name", F.col("is_active").alias("flag"))
    return a.unionByName(g)


# Client feed: a document per order line group is not needed; one item per line, its domain from the supplier.
FEED_ITEM = {
    "domain": "CASE l_linenumber WHEN 3 THEN '' ELSE concat('shop', CAST(l_suppkey % 5 AS STRING), '.example') END",
    "url": "CASE l_linenumber % 3 WHEN 0 THEN '' ELSE concat('https://x.example/', CAST(l_partkey AS STRING)) END",
    "name": "CASE WHEN l_quantity < 2 THEN ' ' ELSE concat(' Item ', CAST(l_partkey AS STRING)) END",
    "gtin": "CASE l_returnflag WHEN 'A' THEN concat('46 ', lpad(CAST(l_partkey AS STRING), 11, '0')) ELSE '' END",
    "code": "CASE l_returnflag WHEN 'N' THEN concat('C', CAST(l_partkey AS STRING)) ELSE '' END",
    "isbn": "CASE l_returnflag WHEN 'R' THEN concat('978-', lpad(CAST(l_partkey AS STRING), 10, '0')) ELSE '' END",
    "description": "CASE l_linestatus WHEN 'O' THEN 'About it' ELSE '' END",
    "price": "CASE WHEN l_discount > 0.05 THEN l_extendedprice ELSE CAST(0 AS DOUBLE) END",
    "cost": "CASE WHEN l_tax > 0.04 THEN l_quantity ELSE CAST(-1 AS DOUBLE) END",
    "brand": "CASE WHEN l_quantity > 25 THEN 'House' ELSE '' END",
    "category": "concat('Books', CASE l_linenumber % 4 WHEN 0 THEN ' / ' WHEN 1 THEN '>' WHEN 2 THEN '|' ELSE '' END, CAST(l_suppkey % 7 AS STRING))",
    "required_ok": "l_linenumber > 4",
}
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def feed_items(t: Tables):
    """Feed rows in the flattened shape: the order of lines stands for file and place."""
    missing = ["barcode", "code_type", "ean", "currency", "image", "availability", "source", "error"]
    rows = t.spread("lineitem").selectExpr(*[f"{e} AS {n}" for n, e in FEED_ITEM.items()], *LINE_ORDER)
    domain = F.coalesce(F.nullif(CF.field("domain"), F.lit("")), F.lit("bucket.example"))
    place = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return rows.withColumns(
        {**{c: F.lit(None).cast("string") for c in missing}, "row_domain": domain, "file": place, "domain_index": F.lit(0), "item_index": F.col("l_linenumber") - 1}
    )


NORM_SQL = (
    "raw AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in FEED_ITEM.items()) + ", l_linenumber, row_number() OVER (ORDER BY " + ", ".join(LINE_ORDER) + ") AS rn FROM lineitem),"
    " norm AS (SELECT *, coalesce(nullif(domain, ''), 'bucket.example') AS row_domain, trim(name) AS nm, replace(gtin, ' ', '') AS gt, replace(isbn, '-', '') AS ib FROM raw),"
    " keyed AS (SELECT *, coalesce(nullif(code, ''), nullif(gt, ''), nullif(ib, ''), CASE WHEN url <> '' THEN 'url-' || substr(sha1(url), 1, 16) END,"
    " CASE WHEN nm <> '' THEN 'name-' || substr(sha1(row_domain || '|' || nm), 1, 16) END, 'row-' || l_linenumber) AS nomcode,"
    " code || gt || ib = '' AS synthetic, CASE WHEN ib <> '' THEN ib WHEN gt <> '' THEN gt ELSE '' END AS isbn_out,"
    " CASE WHEN cost > 0 THEN cost WHEN price > 0 THEN price END AS price_out, " + clean_list_sql("CASE WHEN contains(category, ' / ') THEN string_split(category, ' / ') WHEN contains(category, '>') THEN string_split(category, '>') ELSE string_split(category, '|') END")
    + " AS path FROM norm),"
    " cand AS (SELECT *, 'client:' || row_domain || ':' || nomcode AS guid_nom, 'client_url:' || substr(sha1(CASE WHEN url <> '' THEN url ELSE row_domain || '|' || nomcode END), 1, 16) AS guid,"
    " (CASE WHEN nm <> '' THEN 100 ELSE 0 END) + (CASE WHEN description <> '' THEN 15 ELSE 0 END) + (CASE WHEN price_out IS NOT NULL THEN 20 ELSE 0 END) + (CASE WHEN brand <> '' THEN 10 ELSE 0 END)"
    " + (CASE WHEN isbn_out <> '' THEN 10 ELSE 0 END) + (CASE WHEN required_ok THEN 5 ELSE 0 END) AS score FROM keyed)"
)


@query(
    "m8_raw_item",
    f"WITH {NORM_SQL} SELECT guid_nom, row_domain AS domain, url AS source_url, nullif(gt, '') AS gtin, nullif(ib, '') AS isbn, nullif(code, '') AS code, CASE WHEN price > 0 THEN price END AS price,"
    " CASE WHEN cost > 0 AND (NOT price > 0 OR abs(price - cost) >= 1e-6) THEN cost END AS cost, coalesce(CASE WHEN cost > 0 THEN cost END, CASE WHEN price > 0 THEN price END) AS main_price,"
    " CASE WHEN nm = '' THEN 'Unnamed product ' || l_linenumber ELSE nm END AS name FROM cand",
)
def m8_raw(t: Tables):
    """The raw item of every feed row, nameless ones included, and the price a copy to the main catalog finds in it."""
    rows = CF.normalize_feed(feed_items(t), keep_empty_name=True)
    read = lambda k, n, kind="string": F.get_json_object("raw", f"$.{k}").cast(kind).alias(n)
    names = [("SOURCE_DOMAIN", "domain"), ("SOURCE_URL", "source_url"), ("GTIN", "gtin"), ("ISBN", "isbn"), ("CODE", "code")]
    return rows.select("guid_nom", *[read(k, n) for k, n in names], read("PRICE", "price", "double"), read("COST", "cost", "double"), source_price(parse("raw")).alias("main_price"), "name")


@query(
    "m8_normalize_client_item",
    f"WITH {NORM_SQL} SELECT guid_nom, guid, nomcode, isbn_out AS isbn, nm AS name, price_out AS price, split_part(path, '|', 1) AS subject_name, split_part(path, '|', 2) AS niche_name,"
    " replace(path, '|', ' / ') AS category_path, synthetic, score FROM cand",
)
def m8(t: Tables):
    return CF.normalize_feed(feed_items(t)).select(
        "guid_nom", "guid", "nomcode", "isbn", "name", "price", "subject_name", "niche_name", "category_path", "synthetic", "score"
    )


@query(
    "w2_best_record_dedup",
    f"WITH {NORM_SQL} SELECT guid_nom, name, isbn, price, score FROM (SELECT guid_nom, nm AS name, isbn_out AS isbn, price_out AS price, score, row_number() OVER (PARTITION BY guid_nom ORDER BY score DESC, rn) AS r FROM cand WHERE nm <> '') WHERE r = 1",
)
def w2(t: Tables):
    return CF.best_record(CF.normalize_feed(feed_items(t))).select("guid_nom", "name", "isbn", "price", "score")


@query(
    "a16_feed_stats",
    f"WITH {NORM_SQL}, used AS (SELECT *, max(score) OVER (PARTITION BY guid_nom ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,"
    " row_number() OVER (PARTITION BY guid_nom ORDER BY score DESC, rn) AS r FROM cand WHERE nm <> '')"
    " SELECT (SELECT count(*) FROM cand) AS input_items, (SELECT count(*) FROM cand WHERE nm = '') AS skipped_no_name, count(*) FILTER (synthetic) AS synthetic_identifiers,"
    " count(*) FILTER (r = 1) AS output_items, count(*) FILTER (r = 1 AND price_out IS NOT NULL) AS with_price, count(*) FILTER (r = 1 AND isbn_out <> '') AS with_isbn,"
    " count(*) FILTER (score > before) AS replaced, count(*) - count(*) FILTER (r = 1) - count(*) FILTER (score > before) AS discarded FROM used",
)
def a16(t: Tables):
    return CF.feed_stats(CF.normalize_feed(feed_items(t)))


@query(
    "s3_read_client_feed",
    "SELECT concat('shop', s_suppkey % 5, '.example') AS row_domain, 'Item ' || s_suppkey AS name, 1 AS item_index FROM supplier UNION ALL SELECT concat('own', s_nationkey), s_name, 0 FROM supplier",
)
def s3(t: Tables):
    """A feed document per supplier, two items each, one with a domain of its own."""
    item = lambda **f: F.struct(*[c.alias(n) for n, c in f.items()])
    bucket = F.struct(
        F.concat(F.lit(" shop"), (F.col("s_suppkey") % 5).cast("string"), F.lit(".example")).alias("domain"),
        F.array(
            item(domain=F.concat(F.lit("own"), F.col("s_nationkey").cast("string")), name=F.col("s_name")),
            item(domain=F.lit(""), name=F.concat(F.lit("Item "), F.col("s_suppkey").cast("string"))),
        ).alias("items"),
    )
    path = fresh_path(t.spark, "feed")
    t.supplier.select(F.to_json(F.struct(F.array(bucket).alias("domains"))).alias("value")).write.text(path)
    return CF.read_client_feed_lines(t.spark, path).select("row_domain", "name", "item_index")


CSV_FIELDS = ["name", "isbn", "author_cover", "author_names", "is_info_complete", "cover_url", "subject_name", "niche_name", "brand_name", "quantity", "price", "category_path", "source_guid_nom"]
CSV_SQL = (
    "SELECT trim(name) AS name, coalesce(trim(isbn), '') AS isbn, author_cover, array_to_string(list_filter(author_names, lambda a, i: list_position(author_names, a) = i), '|') AS author_names, coalesce(is_info_complete, false) AS is_info_complete,"
    " coalesce(cover_url, trim(covers['a'])) AS cover_url, array_to_string(list_filter([coalesce(cover_url, ''), trim(covers['a']), covers['b']], lambda u: u <> ''), '|') AS covers,"
    " coalesce(subject_name, '') AS subject_name, coalesce(niche_name, '') AS niche_name, brand_name, quantity, price, nullif(array_to_string(category_path, '|'), '') AS category_path, coalesce(source_guid_nom, '') AS source_guid_nom FROM main_catalog"
)


def _csv_back(df):
    return df.select(
        *[c for c in CSV_FIELDS if c not in ("author_names", "category_path")],
        F.array_join("author_names", "|").alias("author_names"),
        F.array_join(F.map_values("covers"), "|").alias("covers"),
        F.array_join("category_path", "|").alias("category_path"),
    )


@query("s4_read_catalog_csv", with_shapes(CSV_SQL, "main_catalog"))
def s4(t: Tables):
    """Catalog written with Russian headings and tabs, read back through the aliases."""
    path = fresh_path(t.spark, "csv")
    rows = CSV.catalog_csv_rows(main_catalog(t, costly=True))
    renamed = rows.withColumnsRenamed({"name": "Название товара", "price": "Цена", "brand_name": "Бренд", "author_names": "authors", "quantity": "Остаток"})
    renamed.write.option("header", True).option("sep", "\t").option("quote", '"').option("escape", '"').csv(path)
    return _csv_back(CSV.read_catalog_csv(t.spark, path))


@query(
    "s4_files_with_own_headings",
    with_shapes("SELECT trim(name) AS name, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN coalesce(trim(isbn), '') ELSE '' END AS isbn, price FROM main_catalog", "main_catalog"),
)
def s4_mixed(t: Tables):
    """One folder, two layouts: a quoted heading that holds the delimiter, and another order behind semicolons."""
    path = fresh_path(t.spark, "csv")
    rows = CSV.catalog_csv_rows(main_catalog(t))
    even = rows.where("CAST(id AS BIGINT) % 2 = 0").select(F.col("name").alias("Название"), F.lit("20, 30").alias("Размер, см"), F.col("price").alias("Цена"), F.col("isbn").alias("ISBN"))
    odd = rows.where("CAST(id AS BIGINT) % 2 = 1").select("price", "name")
    for name, part, sep in (("a", even, ","), ("b", odd, ";")):
        part.write.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').csv(f"{path}/{name}")
    return CSV.read_catalog_csv(t.spark, path, multi_line=False).select("name", "isbn", "price")


@query(
    "s4_split_inside_files",
    with_shapes("SELECT trim(name) AS name, coalesce(trim(isbn), '') AS isbn, 'two' || chr(10) || chr(10) || 'lines, \"' || trim(name) || '\"' AS annotation, price FROM main_catalog", "main_catalog"),
)
def s4_split(t: Tables):
    """Cells with line breaks, quotes and delimiters, read by lines."""
    path = fresh_path(t.spark, "csv")
    told = F.concat(F.lit("two\n\nlines, \""), F.trim("name"), F.lit('"'))
    rows = CSV.catalog_csv_rows(main_catalog(t)).select("name", told.alias("annotation"), "price", "isbn")
    rows.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return CSV.read_catalog_csv_split(t.spark, path).select("name", "isbn", "annotation", "price")


@query("s5_write_catalog_csv", with_shapes(CSV_SQL, "main_catalog"))
def s5(t: Tables):
    path = fresh_path(t.spark, "csv")
    CSV.write_catalog_csv(main_catalog(t), path)
    return _csv_back(CSV.read_catalog_csv(t.spark, path))


@query("s5_catalog_csv_rows", with_shapes("SELECT CAST(id AS VARCHAR) AS id, name, CASE WHEN is_info_complete THEN '1' ELSE '0' END AS is_info_complete, array_to_string(author_names, ' | ') AS author_names, array_to_string(category_path, ' / ') AS category_path,"
    " CASE category_id WHEN '000000000000000000000000' THEN '' ELSE coalesce(category_id, '') END AS category_id, CASE WHEN quantity = 0 THEN '' ELSE CAST(CAST(quantity AS BIGINT) AS VARCHAR) END AS quantity FROM main_catalog", "main_catalog"))
def s5_rows(t: Tables):
    return CSV.catalog_csv_rows(main_catalog(t)).select("id", "name", "is_info_complete", "author_names", "category_path", "category_id", "quantity")


@query(
    "s6_write_run_json",
    with_shapes(", m AS (SELECT max(run_id) AS r FROM records) SELECT 'record' AS kind, CAST(record_id AS VARCHAR) AS key FROM records WHERE run_id = 'run-2024-01-28' UNION ALL SELECT 'run', 'run-2024-01-28' FROM m", "records"),
)
def s6(t: Tables):
    path = fresh_path(t.spark, "run")
    R.export_run(runs(t), records(t), "run-2024-01-28", path)
    back = t.spark.read.schema("kind string, body string").json(path)
    key = F.when(F.col("kind") == "run", F.get_json_object("body", "$.run_id")).otherwise(F.get_json_object("body", "$.record_id"))
    return back.select("kind", key.alias("key"))


def record_feed(t: Tables):
    """Record JSON per event: good ones and four kinds of broken ones."""
    return t.events.selectExpr(
        "event_id",
        "CASE event_type WHEN 'view' THEN concat('{\"sourceUrl\": \" https://x/', CAST(event_id AS STRING), '\", \"data\": ', props, '}')"
        " WHEN 'click' THEN concat('{\"sourceUrl\": 5, \"data\": \"', CAST(user_id AS STRING), '\"}') WHEN 'purchase' THEN concat('{\"sourceUrl\": \"u\"', CASE WHEN value > 30 THEN ', \"data\": null' ELSE '' END, '}')"
        " WHEN 'signup' THEN concat('{\"data\": ', props) ELSE concat('[', CAST(user_id AS STRING), ']') END AS body",
    )


FEED_CASE = (
    "SELECT event_id, CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN 'record.data must be an object' WHEN 'purchase' THEN CASE WHEN value > 30 THEN 'record.data must be an object' ELSE 'record.data is required' END"
    " WHEN 'signup' THEN 'record is not valid json' ELSE 'record must be an object' END AS reason,"
    " CASE event_type WHEN 'view' THEN 'https://x/' || event_id WHEN 'click' THEN '5' WHEN 'purchase' THEN 'u' END AS source_url FROM events"
)


@query("s7_read_records_quarantine", FEED_CASE)
def s7(t: Tables):
    valid, invalid = R.split_records(record_feed(t), "body")
    return valid.select("event_id", F.lit(None).cast("string").alias("reason"), "source_url").unionByName(invalid.select("event_id", "reason", "source_url"))


@query("s7_read_rules", "SELECT 't' || s_suppkey AS target, CASE s_suppkey % 4 WHEN 0 THEN s_name ELSE '' END AS source, CASE s_suppkey % 4 WHEN 1 THEN '7' ELSE '' END AS constant FROM supplier WHERE s_suppkey % 4 < 2")
def s7_rules(t: Tables):
    """A rule per supplier: by source, by constant, empty, or no object at all."""
    rules = t.supplier.selectExpr(
        "concat(' t', CAST(s_suppkey AS STRING)) AS target",
        "CASE s_suppkey % 4 WHEN 0 THEN concat('{\"source\": \"', s_name, '\"}') WHEN 1 THEN '{\"constant\": 7}' WHEN 2 THEN '{}' ELSE '\"text\"' END AS rule",
    )
    return R.read_rules(rules)


@query("s8_quarantine_sink", f"SELECT 'feed' AS sync_source, reason AS error, count(*) AS rows FROM ({FEED_CASE}) WHERE reason IS NOT NULL GROUP BY reason")
def s8(t: Tables):
    path = fresh_path(t.spark, "quarantine")
    _, invalid = R.split_records(record_feed(t), "body")
    R.write_quarantine(R.quarantine_rows(invalid.withColumn("run_id", F.lit("r1")), "feed", "body"), path)
    back = t.spark.read.parquet(path)
    return back.groupBy("sync_source", "error").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "s9_resume_cursor",
    "WITH p AS (SELECT 'k' || user_id AS key, arg_max(CASE event_type WHEN 'purchase' THEN '' ELSE 'page-' || event_id END, event_id) AS next_url FROM events GROUP BY user_id)"
    " SELECT 'k' || c_custkey AS key, coalesce(next_url, '') AS next_url FROM customer LEFT JOIN p ON key = 'k' || c_custkey WHERE p.key IS NULL OR next_url <> ''",
)
def s9(t: Tables):
    start = t.customer.selectExpr("concat('k', CAST(c_custkey AS STRING)) AS key", "'' AS next_url", "false AS completed", "CAST(-1 AS BIGINT) AS updated_at")
    progress = t.events.selectExpr(
        "concat('k', CAST(user_id AS STRING)) AS key", "CASE event_type WHEN 'purchase' THEN '' ELSE concat('page-', CAST(event_id AS STRING)) END AS next_url", "event_id AS seq"
    )
    return CU.pending(CU.advance(start, progress), start.select("key"))


@query(
    "s10_flatten_category_seed",
    "SELECT 'root' AS level, r_name AS name, '0' AS parent_name FROM region UNION ALL SELECT 'child', n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
)
def s10(t: Tables):
    """A nested document per region with its nations, flattened and joined back to names."""
    nested = t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(F.col("n_name").alias("name")))).alias("children"))
    docs = t.region.join(nested, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(
        F.to_json(F.array(F.struct(F.col("r_name").alias("name"), "children"))).alias("value"), F.col("r_name")
    )
    flat = TR.flatten_tree(docs.select("value", "r_name").withColumn("value", F.col("value")), "value", place="r_name")
    up = flat.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))
    joined = flat.join(up, "parent_id", "left")
    root = F.col("parent_id") == "0"
    return joined.select(F.when(root, "root").otherwise("child").alias("level"), "name", F.when(root, "0").otherwise(F.col("parent_name")).alias("parent_name"))


@query("s11_read_sitemaps", "SELECT 'page' AS kind, url FROM pages UNION ALL SELECT 'sitemap', 'https://maps.example/' || s_suppkey || '.xml' FROM supplier")
def s11(t: Tables):
    """Sitemap files of at most 50,000 entries each, the protocol's own bound, gzip and plain."""

    def documents(entries, root: str, number: str):
        return entries.groupBy(F.floor(F.col(number) / 50000).alias("file")).agg(
            F.concat(F.lit(f"<{root}>"), F.array_join(F.collect_list("entry"), ""), F.lit(f"</{root}>")).alias("value")
        )

    escaped = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    urls = t.pages.select("page_id", F.concat(F.lit("<url><loc> "), escaped, F.lit("</loc></url>")).alias("entry"))
    maps = t.supplier.select(
        "s_suppkey", F.concat(F.lit("<sitemap><loc>https://maps.example/"), F.col("s_suppkey").cast("string"), F.lit(".xml</loc></sitemap>")).alias("entry")
    )
    path = fresh_path(t.spark, "sitemap")
    documents(urls, "urlset", "page_id").write.partitionBy("file").option("compression", "gzip").text(path + "/pages")
    documents(maps, "sitemapindex", "s_suppkey").write.partitionBy("file").text(path + "/index")
    return TR.read_sitemaps(t.spark, path + "/*/*")


RULES = {
    "source.name": G.Rule("title", ""),
    "source.isbn": G.Rule("isbn", ""),
    "source.brandName": G.Rule("", " House "),
    "source.pages": G.Rule("price", ""),
    "source.guid": G.Rule("absent", ""),
    "main.price": G.Rule("price", ""),
    "main.categoryPath": G.Rule("", "books > fiction > "),
    "main.sourceNomcode": G.Rule("isbn", ""),
}
FIELDS_SQL = (
    ", f AS (SELECT record_id, run_id, source_url, created_at, data, json_extract_string(data, '$.title') AS title, json_extract_string(data, '$.isbn') AS isbn, json_extract_string(data, '$.price') AS price FROM records)"
)


@query("m1_apply_rules", with_shapes(FIELDS_SQL + " SELECT record_id, title AS name, isbn, 'House' AS brand, price AS pages, CAST(4 AS INTEGER) AS mapped_fields FROM f", "records"))
def m1(t: Tables):
    from shelfspark.functions.values import to_text

    mapped = G.apply_rules(records(t, costly=True), RULES, G.SOURCE_PREFIX)
    m = lambda k: to_text(F.element_at("mapped", F.lit(k)))
    return mapped.select("record_id", m("name").alias("name"), m("isbn").alias("isbn"), m("brandName").alias("brand"), m("pages").alias("pages"), F.size("mapped").alias("mapped_fields"))


@query(
    "m2_build_source_product",
    with_shapes(
        FIELDS_SQL + " SELECT record_id, CASE WHEN title <> '' THEN 'source-' || substr(sha1(title), 1, 16) END AS guid_nom, isbn, title AS name, 'House' AS brand_name, CAST(price AS INTEGER) AS pages,"
        " CAST(price AS DOUBLE) AS raw_price, true AS valid FROM f",
        "records",
    ),
)
def m2(t: Tables):
    return G.map_records(records(t, costly=True), RULES).select("record_id", "guid_nom", "isbn", "name", "brand_name", "pages", "raw_price", "valid")


@query(
    "m3_build_main_product",
    with_shapes(
        FIELDS_SQL + " SELECT record_id, 'source-' || substr(sha1(title), 1, 16) AS source_guid_nom, isbn AS source_nomcode, isbn, title AS name, 'House' AS brand_name, CAST(price AS DOUBLE) AS price, 'books|fiction' AS category_path, 0.0::DOUBLE AS quantity FROM f",
        "records",
    ),
)
def m3(t: Tables):
    out = G.build_main(G.map_records(records(t, costly=True), RULES))
    return out.select("record_id", "source_guid_nom", "source_nomcode", "isbn", "name", "brand_name", "price", F.array_join("category_path", "|").alias("category_path"), "quantity")


@query(
    "m4_sync_run",
    with_shapes(
        f", {RUNS}, used AS (SELECT json_extract_string(data, '$.title') AS title FROM records WHERE run_id IN (SELECT run_id FROM runs WHERE status = 'finished'))"
        " SELECT target, count(DISTINCT title) AS inserted, CAST(0 AS BIGINT) AS updated, CAST(0 AS BIGINT) AS skipped, CAST(0 AS BIGINT) AS invalid FROM used, (SELECT unnest(['source', 'main']) AS target) GROUP BY target",
        "records",
    ),
)
def m4(t: Tables):
    source = source_catalog(t).select("id", "guid_nom", "guid", "nomcode", "isbn", "name", "brand_name", "updated_at")
    main = main_catalog(t).select(
        "id", "source_product_id", "source_guid_nom", "source_guid", "source_nomcode", "isbn", "isbn_normalized", "name", "brand_name", "price", "updated_at", F.col("updated_at").alias("created_at")
    )
    return synced(t, source, main)["counters"]


def synced(t: Tables, source, main):
    return G.sync_run(records(t, costly=True), runs(t), RULES, source, main, ["created_at", "record_id"], F.lit(2000000000).cast("bigint"))


M4_SOURCE = ["id", "guid_nom", "guid", "nomcode", "isbn", "name", "brand_name", "updated_at"]


@query(
    "m4_merged_tables",
    with_shapes(
        f", {RUNS}, used AS (SELECT json_extract_string(data, '$.title') AS title, json_extract_string(data, '$.isbn') AS isbn, created_at, record_id FROM records WHERE run_id IN (SELECT run_id FROM runs WHERE status = 'finished')),"
        " ids AS (SELECT *, 'source-' || substr(sha1(title), 1, 16) AS g FROM used),"
        " firsts AS (SELECT g, arg_min(isbn, (created_at, record_id)) FILTER (isbn <> '') AS any_isbn, arg_min(isbn, (created_at, record_id)) AS first_isbn, arg_max(isbn, (created_at, record_id)) FILTER (isbn <> '') AS last_isbn, min(title) AS title FROM ids GROUP BY g)"
        " SELECT 'source' AS side, id, guid_nom AS key, isbn, name, brand_name FROM source_catalog UNION ALL SELECT 'main', id, source_guid_nom, isbn, name, brand_name FROM main_catalog"
        " UNION ALL SELECT 'source', NULL, g, nullif(first_isbn, ''), title, 'House' FROM firsts UNION ALL SELECT 'main', NULL, g, last_isbn, title, 'House' FROM firsts",
        "records", "source_catalog", "main_catalog",
    ),
)
def m4_tables(t: Tables):
    """Both catalogs after the sync: untouched rows as they were, new ones with the first (source) or last (main) values."""
    source = source_catalog(t).select(*M4_SOURCE)
    main = main_catalog(t).select(
        "id", "source_product_id", "source_guid_nom", "source_guid", "source_nomcode", "isbn", "isbn_normalized", "name", "brand_name", "price", "updated_at", F.col("updated_at").alias("created_at")
    )
    out = synced(t, source, main)
    fields = ["isbn", "name", "brand_name"]
    return (
        out["source"].select(F.lit("source").alias("side"), F.col("id").cast("string").alias("id"), F.col("guid_nom").alias("key"), *fields)
        .unionByName(out["main"].select(F.lit("main").alias("side"), F.col("id").cast("string").alias("id"), F.col("source_guid_nom").alias("key"), *fields))
    )


FEED_ROWS = "SELECT 'own' || s_nationkey AS row_domain, s_name AS name, CAST(0 AS INTEGER) AS item_index FROM supplier UNION ALL SELECT 'shop' || (s_suppkey % 5) || '.example', 'Item ' || s_suppkey, 1 FROM supplier"


@query("s3_read_client_feed_files", FEED_ROWS)
def s3_files(t: Tables):
    """Whole-document feed files, named by a comma list that holds a pattern and a path twice."""
    path = fresh_path(t.spark, "feed")
    item = lambda **f: F.struct(*[c.alias(n) for n, c in f.items()])
    bucket = F.struct(
        F.concat(F.lit(" shop"), (F.col("s_suppkey") % 5).cast("string"), F.lit(".example")).alias("domain"),
        F.array(
            item(domain=F.concat(F.lit("own"), F.col("s_nationkey").cast("string")), name=F.col("s_name")),
            item(domain=F.lit(""), name=F.concat(F.lit("Item "), F.col("s_suppkey").cast("string"))),
        ).alias("items"),
    )
    rows = t.supplier.select("s_suppkey", F.to_json(F.struct(F.array(bucket).alias("domains"))).alias("value"))
    # one document per file: each holds the domains of up to 100 suppliers
    files = rows.select(F.concat(F.pmod("s_suppkey", F.lit(2)).cast("string"), F.lit("-"), F.floor(F.col("s_suppkey") / 200).cast("string")).alias("part"), F.from_json("value", CF.FEED_SCHEMA).alias("d"))
    merged = files.groupBy("part").agg(F.to_json(F.struct(F.flatten(F.collect_list("d.domains")).alias("domains"))).alias("value"))
    merged.write.partitionBy("part").text(path)
    found = CF.read_client_feed(t.spark, f"{path}/part=0-*/*, {path}/part=1-*/* ,{path}/part=0-*/*")
    return found.select("row_domain", "name", "item_index")


@query(
    "s10_read_category_seed",
    "SELECT 'root' AS level, r_name AS name FROM region UNION ALL SELECT 'child', n_name FROM nation",
)
def s10_file(t: Tables):
    """One seed file per region, read whole."""
    nested = t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(F.col("n_name").alias("name")))).alias("children"))
    docs = t.region.join(nested, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(
        F.to_json(F.array(F.struct(F.col("r_name").alias("name"), "children"))).alias("value"), "r_regionkey"
    )
    path = fresh_path(t.spark, "seed")
    docs.write.partitionBy("r_regionkey").text(path)
    flat = TR.read_category_seed(t.spark, path + "/*/*")
    return flat.select(F.when(F.col("parent_id") == "0", "root").otherwise("child").alias("level"), "name")


@query("s11_read_url_texts", "SELECT DISTINCT url FROM pages")
def s11_text(t: Tables):
    """Sitemaps that are no XML: addresses between other words, several on a line."""
    path = fresh_path(t.spark, "url-text")
    t.pages.select(F.concat(F.lit("see <"), "url", F.lit("> or \""), "url", F.lit("\" now"))).write.text(path)
    return TR.read_url_texts(t.spark, path)


@query(
    "f13_after_key",
    "SELECT event_id, user_id FROM events WHERE (ts, -event_id) < ((SELECT ts FROM events WHERE event_id = 50), -50) ORDER BY ts DESC, event_id LIMIT 40",
)
def f13_after(t: Tables):
    """The forty rows behind a given one, newest first."""
    last = t.events.where("event_id = 50").first()
    return S.after_key(t.events, "ts", "event_id", (last.ts, 50), 40).select("event_id", "user_id")


@query(
    "m5_suggest_mapping",
    "SELECT DISTINCT target, source FROM (VALUES ('source.name', 'title'), ('source.isbn', 'isbn'), ('source.barcode', 'isbn'), ('source.price', 'price'), ('main.annotation', 'long_description')) v(target, source) WHERE EXISTS (SELECT 1 FROM events)",
)
def m5(t: Tables):
    """Targets for the fields found in the event records and a few derived names."""
    maps = records(t).select(F.explode(F.map_keys(F.from_json("data", "map<string,string>"))).alias("field")).distinct()
    more = t.events.select(F.when(F.col("event_type") == "view", "long_description").otherwise("gadget").alias("field")).distinct()
    fields = maps.unionByName(more).distinct()
    ranked = fields.select("field", F.crc32("field").alias("position"))
    return G.suggest_mapping(ranked, ["source.name", "source.isbn", "source.barcode", "source.price", "main.annotation", "main.categoryId"])


@query(
    "m6_flatten_nested",
    "SELECT event_id AS id, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS \"a.b.c\", event_type || ', x' AS list, event_type AS \"objs.0.n\", json_extract_string(props, '$.k') AS \"props.k\", '{\"too\":{\"far\":1}}' AS \"a.b.deep\", CAST(6 AS INTEGER) AS leaves FROM events",
)
def m6(t: Tables):
    body = F.concat(
        F.lit('{"a": {"b": {"c": '), F.floor("value").cast("string"), F.lit('.0, "deep": {"too": {"far": 1}}}}, "list": ["'), "event_type", F.lit('", "x"], "objs": [{"n": "'), "event_type",
        F.lit('"}], "none": [], "props": '), "props", F.lit(', " flag ": true}'),
    )
    rows = G.flatten_records(t.events.select(F.col("event_id").alias("id"), body.alias("data")))
    at = lambda k: F.element_at("flat", F.lit(k)).alias(k)
    return rows.select("id", at("a.b.c"), at("list"), at("objs.0.n"), at("props.k"), at("a.b.deep"), F.size("flat").alias("leaves"))


NESTED = (
    "concat('{\"a\": {\"b\": {\"c\": ', CAST(CAST(floor(value) AS BIGINT) AS STRING), '.0, \"deep\": {\"too\": {\"far\": 1}}}}, \"list\": [\"', event_type, '\", \"x\"], \"objs\": [{\"n\": \"', event_type,"
    " '\"}, 5, null], \"none\": [], \"bare\": {}, \" flag \": true, \" \": 1, \"nil\": null}')"
)


@query(
    "m6_flatten_rows",
    "SELECT event_id AS id, unnest(['a.b.c', 'a.b.deep', 'list', 'objs.0.n', 'objs.1', 'objs.2', 'flag', 'nil']) AS path,"
    " unnest(['' || CAST(floor(value) AS BIGINT), '{\"too\":{\"far\":1}}', event_type || ', x', event_type, '5', '', 'true', '']) AS text FROM events",
)
def m6_rows(t: Tables):
    """One row per leaf, level by level through lateral explodes."""
    docs = t.events.select(F.col("event_id").alias("id"), F.try_parse_json(F.expr(NESTED)).alias("doc"))
    return G.flatten_rows(docs, "doc", ["id"]).select("id", "path", "text")
