"""Access control: principals of users, effective access, grants and revocations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolake.functions.fixed import DELETE, EDIT, SHARE, VIEW
from convolake.operators.predicates import has_bits
from convolake.session import broadcast_if_small, cut_lineage, spread


def principals(users: DataFrame, members: DataFrame) -> DataFrame:
    """(user_id, principal_type, principal_id): the user, their role, their groups and the public.

    ``users`` is (user_id, source_id, role); ``members`` is (group_id, member), where a member is the outside id of the
    user if there is one, else the id itself.
    """
    row = lambda df, kind, ident: df.select(
        "user_id", F.lit(kind).alias("principal_type"), ident.cast("string").alias("principal_id")
    )
    groups = users.withColumn("member", F.coalesce("source_id", F.col("user_id").cast("string"))).join(members, "member")
    return (
        row(users, "user", F.col("user_id"))
        .unionByName(row(users.filter("role IS NOT NULL"), "role", F.col("role")))
        .unionByName(row(groups, "group", F.col("group_id")).distinct())
        .unionByName(row(users, "public", F.lit(None)))
    )


BROADCAST_GRANTS = 1_000_000


def _reached(principals_: DataFrame, entries: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(user_id, resource_id, bits): all bits that ``entries`` grant to any principal of the user, each pair once.

    ``more`` (resource_id, public_bits) is added to the bits of its resources. Users with the same role and groups reach the same
    resources by them, so grants are gathered per such class of users and then handed to its members. No table of pairs of users and
    resources is shuffled; the users' own grants, as many as the entries, are taken out of their class by lists of exceptions.
    """
    entries = entries.withColumn("principal_id", F.col("principal_id").cast("string"))
    held = principals_.filter(~F.col("principal_type").isin("user", "public"))
    kinds = (
        held.groupBy("user_id")
        .agg(F.sort_array(F.collect_set(F.struct("principal_type", "principal_id"))).alias("held"))
    )
    kinds = cut_lineage(kinds)
    classes = cut_lineage(kinds.groupBy("held").agg(F.min("user_id").alias("class")))
    members = cut_lineage(kinds.join(classes, "held").select("user_id", "class"))
    by_class = (
        classes.select("class", F.inline("held"))
        .join(entries.filter("principal_type <> 'user'"), ["principal_type", "principal_id"])
        .groupBy("class", "resource_id")
        .agg(F.bit_or("perm_bits").alias("bits"))
    )
    own = (
        principals_.filter("principal_type = 'user'")
        .join(entries.filter("principal_type = 'user'"), ["principal_type", "principal_id"])
        .groupBy("user_id", "resource_id")
        .agg(F.bit_or("perm_bits").alias("bits"))
    )
    if more is not None:
        added = F.col("bits").bitwiseOR(F.coalesce("public_bits", F.lit(0))).alias("bits")
        by_class = by_class.join(more, "resource_id", "left").select("class", "resource_id", added)
        own = own.join(more, "resource_id", "left").select("user_id", "resource_id", added)
    by_class = cut_lineage(by_class)
    own = cut_lineage(
        own.join(members, "user_id", "left")
        .join(by_class.withColumnRenamed("bits", "class_bits"), ["class", "resource_id"], "left")
        .select("user_id", "class", "resource_id", F.col("bits").bitwiseOR(F.coalesce("class_bits", F.lit(0))).alias("bits"), F.col("class_bits").isNotNull().alias("twice"))
    )
    taken = own.filter("twice").groupBy("class", "resource_id").agg(F.collect_list("user_id").alias("taken"))
    handed = broadcast_if_small(by_class.join(taken, ["class", "resource_id"], "left"), BROADCAST_GRANTS)
    others = spread(members).join(handed, "class").filter(F.coalesce(~F.array_contains("taken", F.col("user_id")), F.lit(True)))
    return others.select("user_id", "resource_id", "bits").unionByName(own.select("user_id", "resource_id", "bits"))


def effective(principals_: DataFrame, acl: DataFrame) -> DataFrame:
    """(user_id, resource_id, bits): all bits granted to any principal of the user, everybody's included.

    What a resource grants to everybody is also given once with a null user, instead of for every user.
    """
    public = public_bits(acl)
    met = _reached(principals_, acl.filter("principal_type <> 'public'"), public)
    user = met.schema["user_id"].dataType
    return met.unionByName(
        public.select(F.lit(None).cast(user).alias("user_id"), "resource_id", F.col("public_bits").alias("bits"))
    )


def public_bits(acl: DataFrame) -> DataFrame:
    return acl.filter("principal_type = 'public'").groupBy("resource_id").agg(F.bit_or("perm_bits").alias("public_bits"))


def accessible(principals_: DataFrame, acl: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """(personal, public): resources a user reaches by own grants, and resources everybody reaches.

    A grant counts on its own: one entry must carry all the bits.
    """
    fit = acl.filter(has_bits("perm_bits", bits))
    personal = _reached(principals_, fit.filter("principal_type <> 'public'")).select("user_id", "resource_id")
    return personal, fit.filter("principal_type = 'public'").select("resource_id").distinct()


# The level that a set bit gives, strongest first.
LEVELS = ((DELETE, "owner"), (EDIT, "editor"), (VIEW, "viewer"))


def role_label(bits: Column) -> Column:
    """Label of permission bits: the strongest level of which the bit is set, whatever the other bits."""
    given = [F.when(bits.bitwiseAND(F.lit(bit)) != 0, label) for bit, label in LEVELS]
    return F.coalesce(*given, F.lit("none"))


TASK_WAYS = 500_000  # attachments per part whose ways meet in a task


def file_access(files: DataFrame, attached: DataFrame, agents: DataFrame, edits: DataFrame) -> DataFrame:
    """(file_id, user_id, reason) of all ways into a file: owner, author of an agent with it, EDIT on such an agent.

    ``files`` (file_id, owner), ``attached`` (agent_id, file_id), ``agents`` (agent_id, author), ``edits`` (agent_id,
    user_id). Several ways keep the strongest reason.
    """
    way = lambda df, user, rank: df.select("file_id", F.col(user).alias("user_id"), F.lit(rank).alias("rank"))
    ways = (
        way(files, "owner", 0)
        .unionByName(way(attached.join(agents, "agent_id"), "author", 1))
        .unionByName(way(attached.join(edits, "agent_id"), "user_id", 2))
    )
    # Repeated attachments fall to the one aggregate. Ways are dealt before it, as few of a task's rows share a file and user; the
    # number of parts grows with them, so that a task's table of groups does not.
    parts = max(ways.sparkSession.sparkContext.defaultParallelism, -(-attached.count() // TASK_WAYS))
    least = ways.repartition(parts, "file_id", "user_id").groupBy("file_id", "user_id").agg(F.min("rank").alias("rank"))
    reason = F.element_at(F.array(*map(F.lit, ("owner", "author", "editor"))), F.col("rank") + 1)
    return least.select("file_id", "user_id", reason.alias("reason"))


def apply_grants(acl: DataFrame, changes: DataFrame, roles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new snapshot, rejected): upserts by role name and removals.

    ``changes`` is (resource_type, resource_id, principal_type, principal_id, action, role).
    """
    keys = ["resource_type", "resource_id", "principal_type", "principal_id"]
    known = roles.select("resource_type", "role", "role_bits")
    checked = changes.join(known, ["resource_type", "role"], "left")
    grants = checked.filter("action = 'grant'")
    rejected = grants.filter("role_bits IS NULL").select(*keys, F.lit("role_not_found").alias("problem"))
    valid = grants.filter("role_bits IS NOT NULL").groupBy(*keys).agg(F.max("role_bits").alias("_new"))
    revoked = changes.filter("action = 'revoke'").select(*keys).distinct()
    snapshot = (
        acl.join(valid, keys, "full_outer")
        .select(*keys, F.coalesce("_new", "perm_bits").alias("perm_bits"))
        .join(revoked, keys, "left_anti")
    )
    return snapshot, rejected
