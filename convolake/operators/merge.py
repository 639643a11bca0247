"""Table-to-table changes: every operator returns the new snapshot, or the rows that changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def anonymous(prefix: str, kind: str, ident: Column, salt: str = "salt") -> Column:
    """Stable public id: the same id always gives the same name, whatever the order of the rows."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat(F.lit(f"{salt}|{kind}|"), ident), 256), 1, 21))


def metadata_hash(entries: Column) -> Column:
    """SHA-256 over id-sorted, key-sorted metadata; ``entries`` is array<struct<id, meta map<string, json>>>."""

    def one(e: Column) -> Column:
        body = F.array_join(
            F.transform(F.array_sort(F.map_entries(e["meta"])), lambda kv: F.concat_ws(":", kv["key"], kv["value"])), ","
        )
        return F.concat(e["id"], F.lit(":"), F.coalesce(F.concat(F.lit("{"), body, F.lit("}")), F.lit("null")))

    ordered = F.array_sort(entries, lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0))
    return F.when(F.size(entries) > 0, F.sha2(F.array_join(F.transform(ordered, one), ";"), 256)).otherwise("")


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """New snapshot: source fields that are given win, absent ones (null) keep the stored value."""
    fields = [c for c in target.columns if c not in keys]
    given = source.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in source.columns if c not in keys])
    merged = [
        F.coalesce(F.col(f"_s_{c}"), F.col(c)).alias(c) if c in source.columns else F.col(c) for c in fields
    ]
    return target.join(given, keys, "full_outer").select(*keys, *merged)


def insert_absent(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows stay as they are; only unknown keys are added."""
    return target.unionByName(source.join(target.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def delete_matching(target: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(doomed.select(*keys).distinct(), keys, "left_anti")


def update_by_key(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Given fields of known keys replaced; unknown source keys are ignored."""
    given = source.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in source.columns if c not in keys])
    fields = [
        F.coalesce(F.col(f"_s_{c}"), F.col(c)).alias(c) if c in source.columns and c not in keys else F.col(c)
        for c in target.columns
    ]
    return target.join(given, keys, "left").select(*fields)


def add_counts(target: DataFrame, deltas: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Counters raised by summed deltas; unknown keys start at their delta. ``deltas`` is (keys, delta)."""
    summed = deltas.groupBy(*keys).agg(F.sum("delta").alias("_d"))
    zero = F.lit(0)
    return target.join(summed, keys, "full_outer").withColumn(
        count, F.coalesce(F.col(count), zero) + F.coalesce(F.col("_d"), zero)
    ).drop("_d")


def delete_since(messages: DataFrame, marks: DataFrame) -> DataFrame:
    """Messages not newer than their conversation's mark; ``marks`` is (conv_id, msg). No mark: nothing is deleted."""
    from convolake.operators import scan

    times = messages.join(marks, ["conv_id", "msg"], "left_semi").select("conv_id", F.col("created_at").alias("_mark"))
    return (
        scan.with_key_row(messages, times, ["conv_id"], F.floor(F.col("msg") / 512), "left")
        .filter(F.col("_mark").isNull() | (F.col("created_at") <= F.col("_mark")))
        .drop("_mark")
    )


def purge_user(tables: dict[str, tuple[DataFrame, str]], users: DataFrame, user: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Snapshots without the users' rows, and a report (table, deleted). ``tables`` maps name to (frame, user column)."""
    kept, reports = {}, None
    ids = users.select(user).distinct()
    for name, (df, column) in tables.items():
        doomed = ids.select(F.col(user).alias(column))
        kept[name] = df.join(doomed, column, "left_anti")
        n = df.join(doomed, column, "left_semi").agg(F.count("*").alias("deleted"))
        n = n.select(F.lit(name).alias("table_name"), "deleted")
        reports = n if reports is None else reports.unionByName(n)
    return kept, reports


def bits_changed(bits: Column, add: int = 0, remove: int = 0) -> Column:
    return bits.bitwiseOR(F.lit(add)).bitwiseAND(F.bitwise_not(F.lit(remove)))


def merged_permissions(stored: Column, given: Column) -> Column:
    """Nested maps ``type → (permission → flag)`` merged one level down; given flags win."""
    empty = F.create_map().cast("map<string,boolean>")
    return F.map_zip_with(
        stored,
        given,
        lambda _, a, b: F.map_zip_with(
            F.coalesce(a, empty), F.coalesce(b, empty), lambda __, x, y: F.coalesce(y, x)
        ),
    )


def same_map(a: Column, b: Column) -> Column:
    canon = lambda m: F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("k"), F.array_sort(F.map_entries(e["value"])).alias("v"))))
    return canon(a) == canon(b)


def version_rows(history: DataFrame, keys: list[str], order: list[str], bucket: Column, fields: list[str]) -> DataFrame:
    """Rows of a change stream that differ from the version before them, numbered from 1."""
    from convolake.operators import scan

    state = history.withColumn("_state", F.struct(*fields))
    changed = scan.with_previous(state, keys, order, bucket, {"_before": "_state"}).filter(
        ~F.col("_before").eqNullSafe(F.col("_state"))
    )
    return scan.with_number(changed.drop("_before", "_state"), keys, order, bucket, "version")


def reverted(versions: DataFrame, wanted: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """The outcome of going back to a numbered version: (keys, wanted, fields, status, version).

    ``versions`` is (keys, version, fields), ``wanted`` (keys, wanted). The fields of the wanted version become the
    current ones: appended as a new version unless they equal the last one's (status ``appended`` or ``unchanged``, with
    the number that then is the last). A version that the key does not have changes nothing: ``missing``, null fields.
    """
    state = versions.select(*keys, "version", F.struct(*fields).alias("_state"))
    last = state.join(wanted.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.max_by("_state", "version").alias("_last"), F.max("version").alias("_n"))
    target = state.withColumnsRenamed({"version": "wanted", "_state": "_target"})
    found = wanted.join(target, [*keys, "wanted"], "left").join(last, keys, "left")
    same, known = F.col("_target").eqNullSafe(F.col("_last")), F.col("_target").isNotNull()
    return found.select(
        *keys, "wanted", *[F.col(f"_target.{f}").alias(f) for f in fields],
        F.when(~known, "missing").when(same, "unchanged").otherwise("appended").alias("status"),
        F.when(known & ~same, F.col("_n") + 1).otherwise(F.col("_n")).alias("version"),
    )


def repaired_pointer(parents: DataFrame, children: DataFrame, key: str, child: str, order: str) -> DataFrame:
    """(key, child) pointing at the stored child if it remains, else at the latest one; empty parents go.

    ``parents`` is (key, pointer); ``children`` the remaining (key, child, order).
    """
    latest = children.groupBy(key).agg(F.max_by(child, F.struct(order, child)).alias("_latest"))
    alive = children.select(key, F.col(child).alias("pointer"), F.lit(True).alias("_alive"))
    return (
        parents.join(latest, key)
        .join(alive, [key, "pointer"], "left")
        .select(key, F.when(F.col("_alive"), F.col("pointer")).otherwise(F.col("_latest")).alias("pointer"))
    )


def single_default(df: DataFrame, user: str, ident: str, flag: str, order: str) -> DataFrame:
    """Only the newest default of a user stays one."""
    newest = (
        df.filter(F.col(flag)).groupBy(user).agg(F.max_by(ident, F.struct(order, ident)).alias("_new"))
    )
    return df.join(newest, user, "left").withColumn(flag, F.col(flag) & (F.col(ident) == F.col("_new"))).drop("_new")


def changed_fields(rows: DataFrame, stored: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, changed): names of fields whose wanted value differs from the stored one; only rows with a change."""
    old = stored.select(key, *[F.col(f).alias(f"_o_{f}") for f in fields])
    differs = F.array_compact(
        F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_o_{f}")), F.lit(f)) for f in fields])
    )
    return rows.join(old, key, "left").withColumn("changed", differs).filter(F.size("changed") > 0).select(key, "changed")


def moved(position: Column, old: Column, new: Column) -> Column:
    """Dense positions after one element moves from ``old`` to ``new``."""
    return (
        F.when(position == old, new)
        .when((new > old) & (position > old) & (position <= new), position - 1)
        .when((new < old) & (position >= new) & (position < old), position + 1)
        .otherwise(position)
    )


def after_delete(position: Column, removed: Column) -> Column:
    return F.when(position > removed, position - 1).otherwise(position)


def share_requests(requests: DataFrame, conversations: DataFrame, shares: DataFrame) -> DataFrame:
    """Each request with ``reject_reason``, null when a share is made.

    ``requests`` is (conv_id, user), ``conversations`` (conv_id, owner, n_messages), ``shares`` (conv_id, user).
    """
    have = shares.select("conv_id", "user").distinct().withColumn("_have", F.lit(True))
    reason = (
        F.when(F.col("_have"), "exists")
        .when(F.col("owner").isNull() | (F.col("owner") != F.col("user")), "not_owner")
        .when(F.coalesce("n_messages", F.lit(0)) == 0, "empty")
    )
    return (
        requests.join(conversations, "conv_id", "left")
        .join(have, ["conv_id", "user"], "left")
        .select("conv_id", "user", "n_messages", reason.alias("reject_reason"))
    )
