"""Field-level three-way merge, conflicts and their resolution, and sync decisions.

Sides are wide tables: ``record_id``, optionally ``ord`` and ``label``, and the fields.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.semantic import decision_flags, normalize_for_comparison
from curatrix.functions.text import blank_if_null


def to_long(side: DataFrame, fields: list[str]) -> DataFrame:
    """(record_id, field, value)."""
    return side.unpivot("record_id", [F.col(f).cast("string").alias(f) for f in fields], "field", "value")


def _sides(base: DataFrame | None, local: DataFrame, remote: DataFrame, fields: list[str]) -> DataFrame:
    """One row per record and field, null where a side lacks the record. The three inputs are
    joined on the record first, so a record costs one shuffled row, not one per field."""
    base = local.limit(0) if base is None else base

    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.select("record_id", F.struct(*[blank_if_null(F.col(f).cast("string")).alias(f) for f in fields]).alias(name))

    joined = packed(base, "base").join(packed(local, "local"), "record_id", "full").join(packed(remote, "remote"), "record_id", "full")
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f).alias("field"), F.col("base")[f].alias("b"), F.col("local")[f].alias("l"), F.col("remote")[f].alias("r")) for i, f in enumerate(fields)])
    cells = F.transform(
        rows,
        lambda x: F.struct(
            x["field"].alias("field"), x["b"].alias("b"), x["l"].alias("l"), x["r"].alias("r"),
            *[F.when(x[s].isNotNull(), normalize_for_comparison(x["field"], x[s])).alias(f"n{s}") for s in "blr"],
        ),
    )
    return joined.select("record_id", *[F.col(s).isNotNull().alias(f"in_{s}") for s in ("base", "local", "remote")], cells.alias("cells"))


def three_way_merge(base: DataFrame | None, local: DataFrame, remote: DataFrame, fields: list[str], deletions_meaningful: bool = False, first_sync: bool = False) -> DataFrame:
    """One row per record: ``outcome`` (added_local, added_remote, conflict, removed, auto_merged,
    unchanged), ``kept`` (whether the record stays), merged ``values`` (map) and ``conflicts``
    (array<struct<field, base, local, remote, kind>>)."""
    rows = _sides(None if first_sync else base, local, remote, fields)
    b, l, r = F.col("in_base"), F.col("in_local"), F.col("in_remote")
    differ = lambda x, s, t: ~x[f"n{s}"].eqNullSafe(x[f"n{t}"])
    any_lr = F.exists("cells", lambda x: differ(x, "l", "r"))
    # A surviving side that differs from the base, where the other side lacks the record.
    edited = F.exists("cells", lambda x: F.when(l, differ(x, "l", "b")).otherwise(differ(x, "r", "b")))
    both, one = l & r, l != r
    clash_added = ~b & both & any_lr
    clash_deleted = b & one & edited & F.lit(deletions_meaningful)
    kind = F.when(clash_added, "FIRST_SYNC" if first_sync else "ADDED_BOTH").when(clash_deleted, "DELETE_VS_EDIT").otherwise("FIELD")

    def conflicting(x: Column) -> Column:
        per_field = b & both & differ(x, "l", "b") & differ(x, "r", "b") & differ(x, "l", "r")
        lone = clash_deleted & (F.coalesce(x["nl"], normalize_for_comparison(x["field"], F.lit(""))) != F.coalesce(x["nr"], normalize_for_comparison(x["field"], F.lit(""))))
        return per_field | (clash_added & differ(x, "l", "r")) | lone

    def merged(x: Column) -> Column:
        per_field = F.when(differ(x, "l", "b") & differ(x, "r", "b") & differ(x, "l", "r"), x["b"]).when(differ(x, "r", "b") & ~differ(x, "l", "b"), x["r"]).otherwise(x["l"])
        return F.when(b & both, per_field).when(clash_deleted, x["b"]).when(l, x["l"]).when(r, x["r"]).otherwise(x["b"])

    found = F.transform(
        F.filter("cells", conflicting),
        lambda x: F.struct(x["field"].alias("field"), blank_if_null(x["b"]).alias("base"), blank_if_null(x["l"]).alias("local"), blank_if_null(x["r"]).alias("remote"), kind.alias("kind")),
    )
    values = F.transform("cells", lambda x: F.struct(x["field"].alias("k"), merged(x).alias("v")))
    moved = F.exists("cells", lambda x: ~merged(x).eqNullSafe(x["b"]))
    outcome = (
        F.when(F.size("conflicts") > 0, "conflict")
        .when(~b & l, "added_local")
        .when(~b, "added_remote")
        .when(~both, "removed")
        .when(F.col("moved"), "auto_merged")
        .otherwise("unchanged")
    )
    kept = ~(b & ~both & F.lit(deletions_meaningful) & ~clash_deleted)
    full = rows.select("record_id", b, l, r, found.alias("conflicts"), F.map_from_entries(values).alias("values"), moved.alias("moved"), kept.alias("kept"))
    return full.select("record_id", outcome.alias("outcome"), "kept", "values", "conflicts")


def merge_first_sync(local: DataFrame, remote: DataFrame, fields: list[str]) -> DataFrame:
    return three_way_merge(None, local, remote, fields, first_sync=True)


def merged_rows(merged: DataFrame, fields: list[str]) -> DataFrame:
    """The merged table, wide."""
    return merged.where("kept").select("record_id", *[F.col("values")[f].alias(f) for f in fields])


def conflict_rows(merged: DataFrame, artifact: str = "review", sheet: str = "") -> DataFrame:
    """One row per conflict, the choice left empty. A first sync has no base: a marker stands there."""
    rows = merged.select("record_id", F.explode("conflicts").alias("c"))
    base = F.when(F.col("c.kind") == "FIRST_SYNC", NO_BASELINE).otherwise(F.col("c.base"))
    return rows.select(
        F.lit(artifact).alias("artifact"), F.lit(sheet).alias("sheet"), "record_id", "c.field", base.alias("base"), "c.local", "c.remote", "c.kind",
        F.lit("").alias("choice"), F.lit("").alias("custom_value"),
    )


NO_BASELINE = "(no baseline: first sync)"


def read_conflicts(sheet: DataFrame) -> DataFrame:
    """What a person filled in: choices upper-cased, the no-baseline marker read back as kind and
    empty base, rows without id or field skipped."""
    named = sheet.where("coalesce(record_id, '') <> '' AND coalesce(field, '') <> ''")
    first = F.col("base") == NO_BASELINE
    return named.withColumn("choice", F.upper(F.trim(blank_if_null(F.col("choice"))))).withColumn("kind", F.when(first, "FIRST_SYNC").otherwise(F.col("kind"))).withColumn("base", F.when(first, "").otherwise(F.col("base")))


def unresolved_conflicts(merged: DataFrame, resolutions: DataFrame) -> DataFrame:
    """(record_id, field, reason): no resolution, unknown choice, CUSTOM without a value, or BASE
    where there is none."""
    rows = merged.select("record_id", F.explode("conflicts").alias("c")).select("record_id", "c.*")
    joined = rows.join(resolutions.select("record_id", "field", "choice", "custom_value"), ["record_id", "field"], "left")
    choice = blank_if_null(F.col("choice"))
    reason = (
        F.when(choice == "", "missing")
        .when(~choice.isin("LOCAL", "DRIVE", "BASE", "CUSTOM"), "unknown")
        .when((choice == "CUSTOM") & (blank_if_null(F.col("custom_value")) == ""), "no value")
        .when((choice == "BASE") & (F.col("kind") == "FIRST_SYNC"), "no base")
    )
    return joined.select("record_id", "field", reason.alias("reason")).where("reason IS NOT NULL")


def apply_resolutions(merged: DataFrame, resolutions: DataFrame, fields: list[str], expected_hash: str | None = None, current_hash: str | None = None) -> DataFrame:
    """The resolved table, wide; it is the next baseline. Every row carries ``state``: INCOMPLETE if
    any conflict is open, REMOTE_CHANGED if the remote moved meanwhile, else RESOLVED; unknown
    keys in ``resolutions`` are ignored."""
    open_ = unresolved_conflicts(merged, resolutions).agg(F.count("*").alias("open"))
    chosen = (
        merged.select("record_id", F.explode("conflicts").alias("c")).select("record_id", "c.*")
        .join(resolutions.select("record_id", "field", "choice", "custom_value"), ["record_id", "field"])
    )
    c = F.col("choice")
    value = F.when(c == "LOCAL", F.col("local")).when(c == "DRIVE", F.col("remote")).when(c == "BASE", F.col("base")).when(c == "CUSTOM", F.col("custom_value"))
    overrides = chosen.where(value.isNotNull()).groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct("field", value.alias("v")))).alias("over"))
    state = F.when(F.col("open") > 0, "INCOMPLETE").when(F.lit(expected_hash != current_hash), "REMOTE_CHANGED").otherwise("RESOLVED")
    joined = merged.where("kept").join(overrides, "record_id", "left").crossJoin(F.broadcast(open_))  # one row
    return joined.select("record_id", *[F.coalesce(F.try_element_at("over", F.lit(f)), F.col("values")[f]).alias(f) for f in fields], state.alias("state"))


def baselines_equal(a: DataFrame, b: DataFrame, fields: list[str], by: list[str] | None = None) -> DataFrame:
    """Per artifact (the columns ``by``): whether both sides have the same records and all fields
    agree in meaning."""
    by = by or []
    norm = lambda df, n: df.select(*by, "record_id", F.concat_ws("\u001e", *[normalize_for_comparison(F.lit(f), F.col(f)) for f in fields]).alias(n))
    joined = norm(a, "x").join(norm(b, "y"), [*by, "record_id"], "full")
    return joined.groupBy(*by).agg((F.count_if(~F.col("x").eqNullSafe(F.col("y"))) == 0).alias("equal"))


def decide_sync(local: DataFrame, remote: DataFrame, state: DataFrame, equal: DataFrame | None = None) -> DataFrame:
    """(path, action, is_first_sync, is_conflict, changes_content) from (path, hash) of both sides
    and (path, last_common_hash); ``equal``: (path, equal) tells which differing files mean the same."""
    joined = (
        local.select("path", F.col("hash").alias("l")).join(remote.select("path", F.col("hash").alias("r")), "path", "full")
        .join(state.select("path", F.col("last_common_hash").alias("c")), "path", "full")
    )
    joined = joined.withColumn("equal", F.lit(False)) if equal is None else joined.join(equal.select("path", "equal"), "path", "left")
    l, r, c = F.col("l"), F.col("r"), F.col("c")
    l_moved, r_moved = ~l.eqNullSafe(c), ~r.eqNullSafe(c)
    first = (
        F.when(r.isNull(), "adopt_local").when(l.isNull(), "adopt_remote").when(l == r, "adopt_baseline")
        .when(F.coalesce("equal", F.lit(False)), "adopt_baseline_with_upload").otherwise("first_sync_conflict")
    )
    later = (
        F.when(~l_moved & ~r_moved, "noop").when(l_moved & ~r_moved, "upload").when(~l_moved, "download")
        .when(l.eqNullSafe(r), "noop").otherwise("conflict")
    )
    action = F.when(l.isNull() & r.isNull(), "noop").when(c.isNull(), first).otherwise(later)
    out = joined.select("path", l.alias("local_hash"), r.alias("remote_hash"), c.alias("last_common_hash"), action.alias("action"))
    return out.withColumn("is_first_sync", F.col("last_common_hash").isNull()).withColumns(decision_flags(F.col("action")))


def record_sync(state: DataFrame, transferred: DataFrame, at: Column) -> DataFrame:
    """Sync state after transfers that succeeded: (path, hash, remote_file_id)."""
    joined = state.join(transferred.select("path", F.col("hash").alias("new"), F.col("remote_file_id").alias("new_id")), "path", "full")
    return joined.select(
        "path", F.coalesce("new", "last_common_hash").alias("last_common_hash"), F.coalesce("new_id", "remote_file_id").alias("remote_file_id"),
        F.when(F.col("new").isNotNull(), at).otherwise(F.col("last_sync")).alias("last_sync"),
    )


def merge_order(base: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """(record_id, side, ord): base order, then local additions, then remote ones."""
    sides = reduce(DataFrame.unionByName, [df.select("record_id", F.lit(i).alias("side"), "ord") for i, df in enumerate((base, local, remote))])
    return sides.groupBy("record_id").agg(F.min(F.struct("side", "ord")).alias("k")).select("record_id", "k.side", "k.ord")


def baseline_from_rows(rows: DataFrame, fields: list[str], record_id: Column, ord_: Column, label: Column, sheet: str = "") -> DataFrame:
    """Long form: (record_id, ord, label, sheet, field, value)."""
    kept = rows.select(record_id.alias("record_id"), ord_.alias("ord"), label.alias("label"), F.lit(sheet).alias("sheet"), *[blank_if_null(F.col(f).cast("string")).alias(f) for f in fields])
    return kept.unpivot(["record_id", "ord", "label", "sheet"], fields, "field", "value")


def baseline_from_catalog(entities: DataFrame, fields: list[str], sheet: str) -> DataFrame:
    return baseline_from_rows(entities, fields, F.concat_ws(":", F.lit(sheet), F.col("entity_id")), F.col("ord"), F.col("canonical"), sheet)
