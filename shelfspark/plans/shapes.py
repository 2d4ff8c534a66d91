"""Catalog-shaped views over the given tables.

Each shape is a select list that both engines can read, so a query and its
oracle start from the same rows. Every shape covers its whole base table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from shelfspark.plans.registry import Tables


class Spark:
    """Collection literals as Spark writes them."""

    @staticmethod
    def array(*items: str) -> str:
        return f"array({', '.join(items)})" if items else "CAST(array() AS array<string>)"

    @staticmethod
    def map(*pairs: tuple[str, str]) -> str:
        return "map(" + ", ".join(f"{k}, {v}" for k, v in pairs) + ")"

    @staticmethod
    def struct(**fields: str) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"

    words = staticmethod(lambda c: f"split({c}, ' ')")


class Duck:
    """The same literals as DuckDB writes them."""

    @staticmethod
    def array(*items: str) -> str:
        return f"[{', '.join(items)}]" if items else "CAST([] AS VARCHAR[])"

    @staticmethod
    def map(*pairs: tuple[str, str]) -> str:
        return "MAP {" + ", ".join(f"{k}: {v}" for k, v in pairs) + "}"

    @staticmethod
    def struct(**fields: str) -> str:
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    words = staticmethod(lambda c: f"string_split({c}, ' ')")


HOST = (
    "CASE p_partkey % 4 WHEN 0 THEN 'alpha-books.example' WHEN 1 THEN 'toys.example'"
    " WHEN 2 THEN 'shop.gamma.example' ELSE 'delta.example' END"
)


def key(c: str, width: int) -> str:
    return f"lpad(CAST({c} AS STRING), {width}, '0')"


def main_columns(d) -> dict[str, str]:
    """Main catalog over `part`: repeated codes, mixed ids, missing categories."""
    return {
        "id": "p_partkey",
        "name": "CASE p_partkey % 5 WHEN 0 THEN concat(' ', upper(p_name), ' ') WHEN 1 THEN concat('The ', p_name) ELSE p_name END",
        "isbn": "CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '  '"
        f" WHEN 2 THEN concat('978-5-', {key('p_partkey % 400', 6)}, '-x') ELSE concat('978', {key('p_partkey % 900', 10)}) END",
        "isbn_normalized": f"CASE p_partkey % 6 WHEN 3 THEN concat('978', {key('p_partkey % 900', 10)}) ELSE NULL END",
        "barcode": f"CASE p_partkey % 4 WHEN 1 THEN concat('46', {key('p_partkey % 700', 11)}) ELSE NULL END",
        "code": "concat('C-', CAST(p_size AS STRING), '/', CAST(p_partkey % 1000 AS STRING))",
        "gtin": f"CASE p_partkey % 9 WHEN 2 THEN concat('46', {key('p_partkey % 700', 11)}) ELSE '' END",
        "source_guid_nom": f"CASE p_partkey % 5 WHEN 0 THEN concat('client:', {HOST}, ':', CAST(p_partkey AS STRING))"
        f" WHEN 1 THEN concat('https://www.', {HOST}, '/item/', CAST(p_partkey AS STRING))"
        " WHEN 2 THEN NULL WHEN 3 THEN concat('GN-', CAST(p_partkey AS STRING)) ELSE '' END",
        "source_guid": "CASE p_partkey % 3 WHEN 0 THEN concat('G-', CAST(p_partkey AS STRING))"
        f" WHEN 1 THEN concat({HOST}, ':8080/x/', CAST(p_partkey AS STRING)) ELSE NULL END",
        "source_nomcode": "CASE p_partkey % 2 WHEN 0 THEN concat('N', CAST(p_partkey AS STRING)) ELSE NULL END",
        "source_product_id": "concat('sp', CAST(p_partkey AS STRING))",
        "cover_url": f"CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('https://img.', {HOST}, ':443/upload/', lower(p_type), '/', CAST(p_size AS STRING), '/c.jpg')"
        f" ELSE concat('http://www.', {HOST}, '/Catalog/', p_type, '/x?y=1') END",
        "covers": d.map(("'b'", f"concat('https://cdn.', {HOST}, '/2.png')"), ("'a'", "concat(' https://cdn.example/', CAST(p_size AS STRING), '.png ')"), ("'c'", "''")),
        "annotation": "concat('Note on ', p_name)",
        "subject_name": "CASE p_partkey % 8 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE p_type END",
        "niche_name": "CASE p_partkey % 3 WHEN 0 THEN concat('Niche ', CAST(p_size % 5 AS STRING)) ELSE NULL END",
        "brand_name": "p_brand",
        "category_id": "CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '000000000000000000000000' ELSE concat('n', CAST(p_partkey % 25 AS STRING)) END",
        "category_path": f"CASE p_partkey % 4 WHEN 2 THEN {d.array(chr(39) + 'Books' + chr(39), 'p_type')} WHEN 3 THEN {d.array('p_type')} ELSE {d.array()} END",
        "quantity": "CAST(p_size AS DOUBLE)",
        "price": "p_retailprice",
        "is_info_complete": "CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END",
        "author_cover": "concat('Author ', CAST(p_size AS STRING))",
        "author_names": d.words("p_name"),
        "updated_at": "1700000000 + (p_partkey * 7919) % 100000",
    }


def source_columns(d) -> dict[str, str]:
    """Publisher catalog over `part`: nested references, arrays, a free-form item."""
    return {
        "id": "concat('sp', CAST(p_partkey AS STRING))",
        "guid_nom": "CASE p_partkey % 4 WHEN 0 THEN concat('GN-', CAST(p_partkey AS STRING)) WHEN 1 THEN '' ELSE NULL END",
        "guid": "CASE p_partkey % 3 WHEN 0 THEN concat('G-', CAST(p_partkey AS STRING)) ELSE '' END",
        "nomcode": "CASE p_partkey % 2 WHEN 0 THEN concat('N', CAST(p_partkey AS STRING)) ELSE NULL END",
        "isbn": f"CASE p_partkey % 3 WHEN 0 THEN concat('978-', {key('p_partkey % 300', 10)}) ELSE NULL END",
        "name": "concat('  ', p_name, ' ')",
        "author_cover": "CASE p_partkey % 3 WHEN 1 THEN concat('Author ', CAST(p_size AS STRING)) ELSE '' END",
        "author_names": d.words("p_name"),
        "author_refs": d.array(
            d.struct(guid="concat('a', CAST(p_size AS STRING))", name="concat('Author ', CAST(p_size % 7 AS STRING), ' of ', p_brand)"),
            d.struct(guid="''", name="p_type"),
        ),
        "tag_refs": d.array(d.struct(guid="concat('t', CAST(p_size % 6 AS STRING))", name="concat('Tag ', CAST(p_size % 6 AS STRING))")),
        "tag_names": d.array("concat(' tag ', CAST(p_size % 6 AS STRING))", "''"),
        "genre_names": d.array("p_type", "concat('G', CAST(p_size % 3 AS STRING))"),
        "subject_guid": "concat('s', CAST(p_size % 10 AS STRING))",
        "subject_name": "CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN concat(' ', lower(p_type)) ELSE p_type END",
        "niche_guid": "concat('k', CAST(p_size % 4 AS STRING))",
        "niche_name": "concat('NATION_', CAST(p_size % 30 AS STRING))",
        "serie_name": "CASE p_partkey % 2 WHEN 0 THEN concat('Series ', p_brand) ELSE ' ' END",
        "publisher_name": "concat('Publisher ', CAST(p_size % 11 AS STRING))",
        "brand_name": "p_brand",
        "annotation": "CASE p_partkey % 3 WHEN 0 THEN '' ELSE concat('About ', p_name) END",
        "cover_url": "CASE p_partkey % 2 WHEN 0 THEN concat('https://cdn.example/', CAST(p_partkey AS STRING), '.jpg') ELSE '' END",
        "age_restriction": "concat(CAST(p_size % 4 * 6 AS STRING), '+')",
        "in_main": "p_partkey % 7 = 0",
        "updated_at": "1700000000 + (p_partkey * 104729) % 100000",
        "raw": "concat('{\"COST\": \"', CASE p_partkey % 3 WHEN 0 THEN '0' WHEN 1 THEN concat(CAST(p_size AS STRING), ',5') ELSE 'n/a' END,"
        " '\", \"PRICES\": {\"TYPES\": [{\"PRICE\": 0}, {\"baseprice\": ', CAST(p_size AS STRING), '}]}}')",
    }


def stock_columns(d) -> dict[str, str]:
    """Stock feed over `lineitem`: one item per line, two shops, text numbers."""
    return {
        "id": "CASE l_linenumber WHEN 7 THEN '' ELSE concat('i', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING)) END",
        "barcode": f"CASE l_partkey % 6 WHEN 0 THEN '' ELSE concat(' 978-', {key('l_partkey % 900', 10)}, ' ') END",
        "amounts": d.array(
            d.struct(shop="concat('Main Store ', CAST(l_suppkey % 3 AS STRING))", amount="CAST(CAST(l_quantity AS BIGINT) AS STRING)"),
            d.struct(shop="'Depot'", amount="'5'"),
            d.struct(shop="'the MAIN store annex'", amount="CASE l_linenumber WHEN 1 THEN 'none' ELSE '1' END"),
        ),
        "prices": d.array(
            d.struct(shop="'main store'", amount="CASE l_linenumber WHEN 2 THEN '0' ELSE CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING) END"),
            d.struct(shop="'Depot'", amount="'7'"),
        ),
        "order_key": "l_orderkey",
        "line_number": "l_linenumber",
        "part_key": "l_partkey",
        "supplier_key": "l_suppkey",
    }


def tree_columns() -> list[tuple[str, dict[str, str]]]:
    """Category tree: region, nation, supplier and customer levels."""
    return [
        ("region", {"id": "concat('r', CAST(r_regionkey AS STRING))", "name": "r_name", "parent_id": "'0'"}),
        (
            "nation",
            {
                "id": "concat('n', CAST(n_nationkey AS STRING))",
                "name": "n_name",
                "parent_id": "concat('r', CAST(n_regionkey AS STRING))",
            },
        ),
        (
            "supplier",
            {
                "id": "concat('s', CAST(s_suppkey AS STRING))",
                "name": "s_name",
                "parent_id": "concat('n', CAST(s_nationkey AS STRING))",
            },
        ),
        (
            "customer",
            {
                "id": "concat('c', CAST(c_custkey AS STRING))",
                "name": "c_name",
                "parent_id": "concat('s', CAST(c_custkey % 150 AS STRING))",
            },
        ),
    ]


def record_columns() -> dict[str, str]:
    """Parser records over `events`: a run per day, a URL per user and kind."""
    return {
        "record_id": "event_id",
        "run_id": "concat('run-', substr(CAST(ts AS STRING), 1, 10))",
        "source_url": "concat('https://shop.example/item/', CAST(user_id AS STRING), '/', event_type)",
        "created_at": "ts",
        "data": "concat('{\"title\": \"', event_type, '\", \"price\": ', CAST(CAST(floor(value) AS BIGINT) AS STRING),"
        " ', \"isbn\": \"', CASE event_type WHEN 'view' THEN '' ELSE concat('978', CAST(1000000000 + user_id AS STRING)) END,"
        " '\", \"props\": ', props, '}')",
    }


def _list(columns: dict[str, str]) -> list[str]:
    return [f"{expr} AS {name}" for name, expr in columns.items()]


def _select(columns: dict[str, str], table: str) -> str:
    return "SELECT " + ",\n  ".join(_list(columns)) + f"\nFROM {table}"


def main_catalog(t: Tables, costly: bool = False) -> DataFrame:
    """Main catalog of all parts; dealt out first where a task's share of it is written to one file."""
    return (t.spread("part") if costly else t.part).selectExpr(*_list(main_columns(Spark)))


def source_catalog(t: Tables, costly: bool = False) -> DataFrame:
    """Publisher catalog of all parts; dealt out first where a task would sort its whole share of it."""
    return (t.spread("part") if costly else t.part).selectExpr(*_list(source_columns(Spark)))


def stock_feed(t: Tables) -> DataFrame:
    return t.lineitem.selectExpr(*_list(stock_columns(Spark)))


def category_tree(t: Tables) -> DataFrame:
    parts = [getattr(t, table).selectExpr(*_list(columns)) for table, columns in tree_columns()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def records(t: Tables, costly: bool = False) -> DataFrame:
    """Records of all events; dealt out first where the work on each is costly."""
    return (t.spread("events") if costly else t.events).selectExpr(*_list(record_columns()))


MAIN_SQL = _select(main_columns(Duck), "part")
SOURCE_SQL = _select(source_columns(Duck), "part")
STOCK_SQL = _select(stock_columns(Duck), "lineitem")
TREE_SQL = "\nUNION ALL\n".join(_select(columns, table) for table, columns in tree_columns())
RECORDS_SQL = _select(record_columns(), "events")


def with_shapes(body: str, *names: str, recursive: bool = False) -> str:
    """Oracle statement: the named shapes as CTEs in front of the body.

    A body that starts with its own CTEs begins with a comma.
    """
    shapes = {
        "main_catalog": MAIN_SQL,
        "source_catalog": SOURCE_SQL,
        "stock_feed": STOCK_SQL,
        "category_tree": TREE_SQL,
        "records": RECORDS_SQL,
    }
    ctes = ",\n".join(f"{n} AS ({shapes[n]})" for n in names)
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{body}"
