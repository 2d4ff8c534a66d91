"""Table maintenance: upserts, edits, deletes and flag updates as new snapshots.

Every function returns a new DataFrame; the caller writes it to a new path and
never over its own input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, MapType, NumericType, StringType

from shelfspark.functions.keys import (
    MAIN_KEY,
    SOURCE_KEY,
    book_key,
    identities,
    import_key,
    own_key,
    source_key,
    source_key_with_id,
)
from shelfspark.functions.numbers import positive
from shelfspark.functions.text import clean_array, non_blank, norm_code_ascii, norm_size, or_empty, trim_all
from shelfspark.functions.values import parse, source_price
from shelfspark.operators.filters import NO_ID, sure
from shelfspark.operators.skew import first_by
from shelfspark.session import cut_lineage, written

# Identifiers no two main-catalog rows may share.
UNIQUE_IN_MAIN = [("guidNom", "source_guid_nom"), ("id", "source_product_id")]


def filled(c: Column, kind: DataType) -> Column:
    """The value, or null where it is the empty value of its type."""
    if isinstance(kind, StringType):
        return F.nullif(c, F.lit(""))
    if isinstance(kind, (ArrayType, MapType)):
        return F.when(F.size(c) > 0, c)
    if isinstance(kind, BooleanType):
        return F.when(c, c)
    if isinstance(kind, NumericType):
        return F.when(c != 0, c)
    return c


def first_in_batch(batch: DataFrame, key: Column, order: Sequence[Column]) -> DataFrame:
    """First row per key; rows without a key are left out. The key stays as `_key`."""
    return first_by(batch.withColumn("_key", key).where(F.col("_key").isNotNull()), ["_key"], order)


def fold_rows(rows: DataFrame, key: str, order: Sequence[str], always: Sequence[str] = ()) -> DataFrame:
    """All rows of a key applied one after the other: per column the last filled value.

    A plain aggregate (one max_by per column), so a key with very many rows
    is reduced on the map side before the shuffle.
    """
    rank = F.struct(*order)
    picks = []
    for f in rows.schema.fields:
        if f.name == key:
            continue
        value = F.col(f.name) if f.name in always else filled(F.col(f.name), f.dataType)
        seen = rank if f.name in always else F.when(value.isNotNull(), rank)
        picks.append(F.max_by(value, seen).alias(f.name))
    return rows.groupBy(key).agg(*picks)


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Stored rows with `_at`, one number that stands for their order.

    A fold carries the rank of every column's pick along; as a number it is a fraction of the columns it stands for.
    """
    return written(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")


def locate(current: DataFrame, row_id: str, answers_to: Column, keys: DataFrame) -> DataFrame:
    """(_key, _target): the stored row, by smallest id, that carries each looked-up key."""
    carried = current.select(F.col(row_id).alias("_target"), F.explode(answers_to).alias("_key"))
    return carried.join(keys.select("_key").distinct(), "_key", "left_semi").groupBy("_key").agg(F.min("_target").alias("_target"))


def _slot(target: Column) -> Column:
    return F.concat(F.lit("row:"), target.cast("string"))


def merge_slots(
    current: DataFrame, batch: DataFrame, row_id: str, always: Sequence[str], insert_only: Sequence[str]
) -> DataFrame:
    """The table with a batch merged in, one batch row per `_slot`; `_new` tells which slots the table lacks.

    Empty incoming values keep what is stored, `always` columns are taken as
    they come, `insert_only` columns are set on new rows alone. `_action`
    says inserted, updated or kept. The table meets the batch in a left join,
    which the planner makes a broadcast where the batch is small: rows that
    the batch doesn't touch then pass without an exchange.
    """
    batch = written(batch, "merge-batch")
    left = current.select(_slot(F.col(row_id)).alias("_slot"), F.struct(*current.columns).alias("old"))
    fields = [c for c in batch.columns if c not in ("_slot", "_new")]
    right = batch.where(~F.col("_new")).select("_slot", F.struct(*fields).alias("new"))
    merged, fresh = [], []
    for f in current.schema.fields:
        old, new = F.col("old")[f.name], F.col("new")[f.name]
        if f.name not in fields:
            value, first = old, F.lit(None).cast(f.dataType)
        elif f.name == row_id:
            value, first = F.coalesce(old, new), F.col(f.name)
        elif f.name in insert_only:
            value, first = old, F.col(f.name)
        elif f.name in always:
            value, first = F.when(F.col("new").isNotNull(), new).otherwise(old), F.col(f.name)
        else:
            value, first = F.coalesce(filled(new, f.dataType), old), filled(F.col(f.name), f.dataType)
        merged.append(value.alias(f.name))
        fresh.append(first.alias(f.name))
    action = F.when(F.col("new").isNotNull(), "updated").otherwise("kept")
    kept = left.join(right, "_slot", "left").select(*merged, action.alias("_action"))
    return kept.unionByName(batch.where("_new").select(*fresh, F.lit("inserted").alias("_action")))


def upsert(
    current: DataFrame,
    batch: DataFrame,
    answers_to: Column,
    order: Sequence[str],
    row_id: str = "id",
    always: Sequence[str] = ("name", "synced_at", "updated_at"),
    insert_only: Sequence[str] = (),
) -> DataFrame:
    """Merge batch rows, each with its look-up `_key`, into a table.

    A key finds any stored row that carries it, also one whose own first
    identifier is another; rows that meet in one stored row apply in `order`.
    """
    batch = numbered(written(batch, "merge-rows"), order)
    found = locate(current, row_id, answers_to, batch)
    slotted = batch.join(found, "_key", "left").withColumn("_slot", F.coalesce(_slot(F.col("_target")), F.col("_key")))
    # a slot's rows all have a target or none
    slotted = slotted.withColumn("_new", F.col("_target").isNull())
    folded = fold_rows(slotted.drop("_key", "_target"), "_slot", ["_at"], (*always, "_new"))
    keep = [c for c in folded.columns if c in ("_slot", "_new") or c in current.columns]
    return merge_slots(current, folded.select(*keep), row_id, always, insert_only)


def upsert_counters(merged: DataFrame) -> DataFrame:
    """inserted and updated totals of a merge."""
    return merged.agg(
        *[F.coalesce(F.sum(F.when(F.col("_action") == a, 1).otherwise(0)), F.lit(0)).alias(a) for a in ("inserted", "updated", "kept")]
    )


def skipped_in_batch(batch: DataFrame, key: Column) -> DataFrame:
    """Rows of a batch that a merge will not look at: no key, or a repeat of one."""
    keyed = batch.select(key.alias("_key"))
    per_key = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("n"))
    lost = F.when(F.col("_key").isNull(), F.col("n")).otherwise(F.col("n") - 1)
    return per_key.agg(F.coalesce(F.sum(lost), F.lit(0)).alias("skipped"))


def upsert_source(current: DataFrame, batch: DataFrame, order: Sequence[str]) -> DataFrame:
    """Publisher catalog merge by guidNom, guid, nomcode; the first row per key of a batch wins."""
    picked = first_in_batch(batch, source_key(), [F.asc(c) for c in order])
    return upsert(current, picked, identities(SOURCE_KEY), order)


def project_source(
    source: DataFrame, as_of: Column, category: tuple[str, list[str]] | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Publisher row to main-catalog row: names, price out of the item, last real category."""
    real = F.filter("category_ids", lambda c: c.isNotNull() & (c != "") & (c != NO_ID))
    if category is None:
        category_id = F.when(F.size(real) > 0, F.element_at(real, -1))
        category_path = clean_array("category_path")
    else:
        category_id = F.lit(category[0])
        category_path = clean_array(F.array(*[F.lit(p) for p in category[1]]))
    return source.select(
        F.col("id").alias("source_product_id"),
        F.col("guid").alias("source_guid"),
        F.col("guid_nom").alias("source_guid_nom"),
        F.col("nomcode").alias("source_nomcode"),
        "isbn",
        norm_code_ascii("isbn").alias("isbn_normalized"),
        "name",
        "author_cover",
        "author_names",
        F.col("annotation").alias("description"),
        "annotation",
        "cover_url",
        "subject_name",
        "niche_name",
        "brand_name",
        F.col("serie_name").alias("series_name"),
        "publisher_name",
        source_price(parse("raw")).alias("price"),
        category_id.alias("category_id"),
        category_path.alias("category_path"),
        as_of.alias("created_at"),
        as_of.alias("updated_at"),
        *keep,
    )


def upsert_main(
    current: DataFrame,
    source: DataFrame,
    order: Sequence[str],
    as_of: Column,
    category: tuple[str, list[str]] | None = None,
) -> DataFrame:
    """Main catalog merge from publisher rows; created_at is set on insert alone."""
    picked = first_in_batch(source, source_key_with_id(), [F.asc(c) for c in order])
    places = [f"_place{i}" for i in range(len(order))]
    placed = picked.withColumns({p: F.col(c) for p, c in zip(places, order)})
    batch = project_source(placed, as_of, category, keep=["_key", *places])
    return upsert(
        current, batch, identities(MAIN_KEY), places, always=("name", "updated_at"), insert_only=("created_at",)
    )


def sanitize_import(rows: DataFrame) -> DataFrame:
    """Trimmed text, cleaned lists, mirrored description and annotation, normalized ISBN and size."""
    out = rows
    for f in rows.schema.fields:
        if isinstance(f.dataType, StringType):
            out = out.withColumn(f.name, trim_all(f.name))
        elif isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StringType):
            out = out.withColumn(f.name, clean_array(f.name))
    columns: dict[str, Column] = {}
    if "isbn" in rows.columns:
        columns["isbn_normalized"] = norm_code_ascii("isbn")
    if "size" in rows.columns:
        columns["size"] = norm_size("size")
    if {"description", "annotation"} <= set(rows.columns):
        columns["description"] = F.coalesce(non_blank("description"), non_blank("annotation"))
        columns["annotation"] = F.coalesce(non_blank("annotation"), non_blank("description"))
    return out.withColumns(columns) if columns else out


def _chain_rows(named: DataFrame, known: DataFrame, order: Sequence[str]) -> DataFrame:
    """(_key, _root): keys that an earlier row of the same import already answers to.

    A row that introduces a product makes all its identifiers findable, so a
    later row looked up by another of them lands in the same product. Chains
    point to strictly earlier rows; they are followed by pointer jumping.
    """
    rank = F.struct(*order)
    first = named.groupBy("_key").agg(F.min(rank).alias("_first"))
    answers = named.select("_key", rank.alias("_rank"), F.explode(identities(MAIN_KEY, book_key())).alias("_other"))
    givers = (
        answers.where(F.col("_other") != F.col("_key"))
        .groupBy(F.col("_other").alias("_key"))
        .agg(F.min(F.struct("_rank", "_key")).alias("_giver"))
    )
    links = (
        first.join(known, "_key", "left_anti")
        .join(givers, "_key")
        .where(F.col("_giver._rank") < F.col("_first"))
        .select("_key", F.col("_giver._key").alias("_root"))
    )
    links = cut_lineage(links)
    while True:
        upper = links.select(F.col("_key").alias("_root"), F.col("_root").alias("_next"))
        jumped = links.join(upper, "_root", "left").select("_key", F.coalesce("_next", "_root").alias("_root"), F.col("_next").isNotNull().alias("_moved"))
        jumped = cut_lineage(jumped)
        links = jumped.drop("_moved")
        if jumped.where("_moved").isEmpty():
            return links


def _judged_import(current: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows without any key, rows to apply, skipped rows with a reason) of an import, cleaned and keyed once.

    Only rows that name their own id can clash, so no other row is looked at for it.
    """
    clean = sanitize_import(rows).withColumns({"_key": import_key(), "_rid": F.monotonically_increasing_id()})
    clean = written(clean, "import-rows")
    named = clean.where(or_empty("name") != "")
    nameless = clean.where(or_empty("name") == "").select(*rows.columns, F.lit("name is required").alias("reason"))
    loose = named.where(F.col("_key").isNull()).drop("_rid")
    keyed = named.where(F.col("_key").isNotNull())

    owners = current.select(F.col("id").alias("_owner"), F.explode(identities(UNIQUE_IN_MAIN)).alias("_ident"))
    claims = keyed.where(F.col("_key").startswith("own:")).select(
        "_rid", "_key", F.col("id").alias("_claimer"), F.explode(identities(UNIQUE_IN_MAIN)).alias("_ident")
    )
    claims = written(claims, "claims")
    clashing = claims.join(owners, "_ident").where(F.col("_owner") != F.col("_claimer")).select("_key", "_ident").distinct()
    refused = written(claims.join(clashing, ["_key", "_ident"], "left_semi").select("_rid").distinct(), "refused")
    clash_rows = keyed.join(refused, "_rid", "left_semi").select(*rows.columns, F.lit("duplicate key").alias("reason"))
    applied = keyed.join(refused, "_rid", "left_anti").drop("_rid")
    return loose, applied, nameless.unionByName(clash_rows)


def skipped_imports(current: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of an import that a merge would skip, with a reason; nothing is merged for it."""
    return _judged_import(current, rows)[2]


def upsert_imported(
    current: DataFrame, rows: DataFrame, order: Sequence[str], as_of: Column
) -> tuple[DataFrame, DataFrame]:
    """Imported rows applied in their order: (merged table with _action, skipped rows with a reason).

    Rows without a name are skipped; rows without any key are inserted; rows
    of one product fold into one. A row that names its own id but carries a
    source identifier owned by another stored row is skipped as a clash.
    """
    loose, applied, skipped = _judged_import(current, rows)
    answers_to = identities(MAIN_KEY, own_key(), book_key())
    known = locate(current, "id", answers_to, applied)
    roots = _chain_rows(applied, known, order)
    rooted = applied.join(roots, "_key", "left").withColumn("_key", F.coalesce("_root", "_key")).drop("_root")
    stamped = rooted.withColumns({"created_at": as_of, "updated_at": as_of})
    merged = upsert(
        current, stamped, answers_to, order, always=("name", "updated_at"), insert_only=("created_at",)
    )
    fresh = loose.withColumns({"created_at": as_of, "updated_at": as_of, "_action": F.lit("inserted")})
    shared = [c for c in merged.columns if c in fresh.columns]
    return merged.unionByName(fresh.select(*shared), allowMissingColumns=True), skipped


def key_clashes(table: DataFrame, unique: Sequence[str]) -> DataFrame:
    """Rows beyond the first per unique value, by id: what a unique index would refuse."""
    checks = []
    for c in unique:
        present = table.where(or_empty(c) != "")
        owner = present.groupBy(c).agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("kept_id"))
        checks.append(owner.where(F.col("rows") > 1).select(F.lit(c).alias("column"), F.col(c).alias("value"), "rows", "kept_id"))
    out = checks[0]
    for more in checks[1:]:
        out = out.unionByName(more)
    return out


def upsert_entities(current: DataFrame, batch: DataFrame, order: Sequence[str]) -> DataFrame:
    """Reference entities by guid: all fields from the batch's last row, synced_at on insert alone."""
    fields = [c for c in batch.columns if c in current.columns]
    rank = F.struct(*order)
    picked = batch.where(or_empty("guid") != "").groupBy("guid").agg(
        F.max_by(F.struct(*[c for c in fields if c != "guid"]), rank).alias("last")
    )
    picked = written(picked, "entities")
    stored = current.select("guid").join(picked.select("guid"), "guid", "left_semi").distinct().withColumn("_stored", F.lit(True))
    known = picked.join(stored, "guid", "left")
    incoming = known.select(_slot(F.col("guid")).alias("_slot"), F.col("_stored").isNull().alias("_new"), "guid", "last.*")
    always = [c for c in fields if c not in ("guid", "synced_at")]
    return merge_slots(current, incoming, "guid", always, ("synced_at",))


def apply_stock(catalog: DataFrame, updates: DataFrame, as_of: Column) -> DataFrame:
    """Quantity, price and time from the updates; the code only when it is filled."""
    new = updates.select("id", *[F.col(c).alias(f"_{c}") for c in ("quantity", "price", "isbn_normalized")], F.lit(True).alias("_hit"))
    hit = F.coalesce("_hit", F.lit(False))
    joined = catalog.join(new, "id", "left")
    return joined.select(
        *[
            {
                "quantity": F.when(hit, F.col("_quantity")).otherwise(F.col("quantity")).alias("quantity"),
                "price": F.when(hit, F.col("_price")).otherwise(F.col("price")).alias("price"),
                "isbn_normalized": F.coalesce(F.nullif("_isbn_normalized", F.lit("")), "isbn_normalized").alias("isbn_normalized"),
                "updated_at": F.when(hit, as_of).otherwise(F.col("updated_at")).alias("updated_at"),
            }.get(c, F.col(c))
            for c in catalog.columns
        ]
    )


def replace_rows(current: DataFrame, edits: DataFrame, always: Sequence[str] = ("quantity", "price", "is_info_complete")) -> DataFrame:
    """Full edit by id: an empty text, list or map and a number <= 0 clear the field."""
    new = edits.select("id", F.struct(*[c for c in edits.columns if c != "id"]).alias("new"))
    hit = F.col("new").isNotNull()
    columns = []
    for f in current.schema.fields:
        if f.name == "id" or f.name not in edits.columns:
            columns.append(F.col(f.name))
            continue
        value = F.col("new")[f.name]
        if f.name not in always:
            kept = positive(value) if isinstance(f.dataType, NumericType) else filled(value, f.dataType)
        else:
            kept = value
        columns.append(F.when(hit, kept).otherwise(F.col(f.name)).alias(f.name))
    return current.join(new, "id", "left").select(*columns)


def assign_category(
    df: DataFrame, hit: Column, category_id: str | None, path: Sequence[str], as_of: Column
) -> DataFrame:
    """Set (or clear, with no id) category, path and time on the rows a condition hits."""
    chosen = sure(hit)
    new_path = F.array(*[F.lit(p) for p in path]).cast("array<string>")
    return df.withColumns(
        {
            "category_path": F.when(chosen, new_path).otherwise(F.col("category_path")),
            "category_id": F.when(chosen, F.lit(category_id)).otherwise(F.col("category_id")),
            "updated_at": F.when(chosen, as_of).otherwise(F.col("updated_at")),
            "_matched": chosen,
            "_modified": chosen & ~F.col("category_id").eqNullSafe(F.lit(category_id)),
        }
    )


def assign_category_by_ids(df: DataFrame, ids: DataFrame, category_id: str | None, path: Sequence[str], as_of: Column) -> DataFrame:
    """The same for a table of ids."""
    marked = df.join(ids.select("id").distinct().withColumn("_listed", F.lit(True)), "id", "left")
    return assign_category(marked, F.col("_listed"), category_id, path, as_of).drop("_listed")


def refresh_paths(df: DataFrame, paths: DataFrame, as_of: Column) -> DataFrame:
    """New category path for every product of the listed categories (category_id, path)."""
    new = paths.select("category_id", F.col("path").alias("_path"))
    joined = df.join(new, "category_id", "left")
    hit = F.col("_path").isNotNull()
    return joined.select(
        *[
            {
                "category_path": F.when(hit, F.col("_path")).otherwise(F.col("category_path")).alias("category_path"),
                "updated_at": F.when(hit, as_of).otherwise(F.col("updated_at")).alias("updated_at"),
            }.get(c, F.col(c))
            for c in df.columns
        ]
    )


def clear_categories(df: DataFrame, gone: DataFrame, as_of: Column) -> DataFrame:
    """Products of deleted categories lose category and path."""
    marked = df.join(gone.select(F.col("id").alias("category_id")).distinct().withColumn("_gone", F.lit(True)), "category_id", "left")
    hit = sure(F.col("_gone"))
    return marked.select(
        *[
            {
                "category_id": F.when(~hit, F.col("category_id")).alias("category_id"),
                "category_path": F.when(~hit, F.col("category_path")).alias("category_path"),
                "updated_at": F.when(hit, as_of).otherwise(F.col("updated_at")).alias("updated_at"),
            }.get(c, F.col(c))
            for c in df.columns
        ]
    )


def delete_rows(df: DataFrame, hit: Column | None = None, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, deleted) by a condition or by a table of ids; unknown conditions keep the row."""
    if ids is not None:
        listed = ids.select("id").distinct()
        return df.join(listed, "id", "left_anti"), df.join(listed, "id", "left_semi")
    gone = sure(hit)
    return df.where(~gone), df.where(gone)


def apply_increments(df: DataFrame, events: DataFrame, counter: str = "view_count") -> DataFrame:
    """Add per-id sums of the events to a counter."""
    sums = events.groupBy("id").agg(F.sum("n").alias("_n"))
    return df.join(sums, "id", "left").withColumn(counter, F.col(counter) + F.coalesce("_n", F.lit(0))).drop("_n")


def set_flag(df: DataFrame, ids: DataFrame, flag: str, value: bool = True) -> DataFrame:
    """Flag on the listed ids."""
    listed = ids.select("id").distinct().withColumn("_listed", F.lit(True))
    return df.join(listed, "id", "left").withColumn(flag, F.when(F.col("_listed"), F.lit(value)).otherwise(F.col(flag))).drop("_listed")


def append_records(existing: DataFrame, batch: DataFrame, as_of: Column) -> DataFrame:
    """Records of a run added; a missing created_at becomes the given time."""
    return existing.unionByName(batch.withColumn("created_at", F.coalesce("created_at", as_of)))


def replace_run(existing: DataFrame, batch: DataFrame, as_of: Column) -> DataFrame:
    """All records of the runs in the batch replaced."""
    kept = existing.join(batch.select("run_id").distinct(), "run_id", "left_anti")
    return append_records(kept.select(*existing.columns), batch, as_of)


def finish_runs(runs: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """Status of finished runs: failed where an error is present, else finished."""
    new = results.select("run_id", F.col("error").alias("_error"), F.lit(True).alias("_done"))
    status = F.when(F.col("_done"), F.when(or_empty("_error") != "", "failed").otherwise("finished")).otherwise(F.col("status"))
    return runs.join(new, "run_id", "left").select(
        *[
            {
                "status": status.alias("status"),
                "error": F.coalesce("_error", "error").alias("error"),
                "finished_at": F.when(F.col("_done"), as_of).otherwise(F.col("finished_at")).alias("finished_at"),
            }.get(c, F.col(c))
            for c in runs.columns
        ]
    )
