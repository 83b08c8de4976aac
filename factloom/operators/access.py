"""Rights of members on cassettes, row filters, and checks of the access configuration.

Configuration tables (cassettes, roles, members) are as small as the people and folders they describe. Allowed ids are
broadcast where their counted number permits; nothing is collected. Only wildcards are expanded to all cassettes.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab as v
from ..session import small

_WILDCARD = "*"


def visible(rows: DataFrame, allowed: Iterable[str] | DataFrame, column: str = "cassette_id", system: bool = True) -> DataFrame:
    """Rows of the allowed cassettes; ``system`` adds those of the built-in one.

    ``allowed`` is a list of ids, pushed to the scan, or a DataFrame whose first column holds them.
    """
    if isinstance(allowed, DataFrame):
        ids = allowed.select(F.col(allowed.columns[0]).alias(column))
        if system:
            ids = ids.unionByName(ids.sparkSession.range(1).select(F.lit(v.SYSTEM_CASSETTE).alias(column)))
        return rows.join(small(ids), column, "left_semi")
    ids = list(allowed) + ([v.SYSTEM_CASSETTE] if system else [])
    return rows.where(F.col(column).isin(*ids))


def _member_roles(members: DataFrame, roles: DataFrame) -> DataFrame:
    return members.select("user_id", F.explode("roles").alias("role")).join(roles, "role")


def project_rights(members: DataFrame, roles: DataFrame) -> DataFrame:
    """(user_id, right): union of the project rights of a member's roles."""
    return (_member_roles(members, roles)
            .select("user_id", F.explode("project_rights").alias("right")).distinct())


def cassette_rights(members: DataFrame, roles: DataFrame, cassettes: DataFrame) -> DataFrame:
    """(user_id, cassette_id, right): effective rights.

    Default read and the rights of all roles add up; a member's override, exact before wildcard, replaces
    them; disabled cassettes grant nothing and read-only ones no write right.
    """
    folders = cassettes.select(F.col("id").alias("cassette_id"), "enabled", "default_access", "allow_write")
    readers = project_rights(members, roles).where(F.col("right") == v.READ).select("user_id")
    by_default = (folders.where((F.col("default_access") == v.READ) & F.col("enabled"))
                  .crossJoin(readers).select("user_id", "cassette_id", F.lit(v.READ).alias("right")))

    granted = _member_roles(members, roles).select("user_id", F.explode("cassette_rights").alias("key", "rights"))
    exact = granted.join(folders.select(F.col("cassette_id").alias("key")), "key")
    wild = granted.where(F.col("key") == _WILDCARD).drop("key").crossJoin(folders.select(F.col("cassette_id").alias("key")))
    by_role = exact.unionByName(wild).select(
        "user_id", F.col("key").alias("cassette_id"), F.explode("rights").alias("right"))

    listed = members.select("user_id", F.explode("cassette_overrides").alias("cassette_id", "rights")).where("rights is not null")
    named = listed.join(folders.select("cassette_id"), "cassette_id").select("user_id", "cassette_id", "rights")
    anywhere = (listed.where(F.col("cassette_id") == _WILDCARD).drop("cassette_id").crossJoin(folders.select("cassette_id"))
                .join(named, ["user_id", "cassette_id"], "left_anti").select("user_id", "cassette_id", "rights"))
    over = named.unionByName(anywhere)
    kept = by_default.unionByName(by_role).join(over, ["user_id", "cassette_id"], "left_anti")
    replaced = over.select("user_id", "cassette_id", F.explode("rights").alias("right"))

    writes = F.col("right").isin(*v.WRITE_RIGHTS)
    return (kept.unionByName(replaced).where(F.trim("right") != "").distinct()
            .join(folders, "cassette_id").where(F.col("enabled") & (F.col("allow_write") | ~writes))
            .select("user_id", "cassette_id", "right"))


def readable_cassettes(rights: DataFrame, granted: DataFrame, search: bool = False) -> DataFrame:
    """(user_id, cassette_id) a member may read; with ``search`` the project right to search is needed too."""
    out = rights.where(F.col("right") == v.READ).select("user_id", "cassette_id")
    for needed in (v.READ,) + ((v.SEARCH,) if search else ()):
        out = out.join(granted.where(F.col("right") == needed).select("user_id"), "user_id", "left_semi")
    return out.distinct()


def writable_cassettes(rights: DataFrame, granted: DataFrame, cassettes: DataFrame, right: str) -> DataFrame:
    """(user_id, cassette_id) where a member may read and has the write right."""
    writable = cassettes.where("enabled and allow_write").select(F.col("id").alias("cassette_id"))
    return (readable_cassettes(rights, granted)
            .join(rights.where(F.col("right") == right).select("user_id", "cassette_id"), ["user_id", "cassette_id"], "left_semi")
            .join(writable, "cassette_id", "left_semi").select("user_id", "cassette_id"))


def default_write_cassette(rights: DataFrame, members: DataFrame, cassettes: DataFrame) -> DataFrame:
    """(user_id, cassette_id): the one writable cassette, null where the member has no write right on it.

    A project with none or several writable cassettes is an error.
    """
    only = cassettes.where("enabled and allow_write").agg(F.count("*").alias("n"), F.min("id").alias("cassette_id"))
    only = only.select(F.when(F.col("n") == 1, F.col("cassette_id")).otherwise(F.raise_error(F.concat(
        F.lit("exactly one writable cassette is needed, found "), F.col("n").cast("string"))).cast("string")).alias("cassette_id"))
    able = rights.where(F.col("right").isin(*v.WRITE_RIGHTS)).select("user_id", "cassette_id").distinct()
    found = able.join(only, "cassette_id", "left_semi")
    return members.select("user_id").join(found, "user_id", "left").select("user_id", "cassette_id")


def cassette_overview(members: DataFrame, rights: DataFrame, granted: DataFrame, cassettes: DataFrame) -> DataFrame:
    """Cassettes shown to each member: readable ones the member administers or may write to, with the rights to list."""
    admins = granted.where(F.col("right") == v.REBUILD_INDEX).select("user_id", F.lit(True).alias("admin")).distinct()
    per = (rights.groupBy("user_id", "cassette_id")
           .agg(F.array_sort(F.collect_set("right")).alias("rights"))  # seven rights at most
           .join(admins, "user_id", "left").join(cassettes.where("enabled").withColumnRenamed("id", "cassette_id"), "cassette_id")
           .withColumn("admin", F.coalesce("admin", F.lit(False))))
    write = F.array(*[F.lit(r) for r in v.WRITE_RIGHTS])
    can_write = F.col("allow_write") & F.arrays_overlap("rights", write)
    shown = per.where(F.array_contains("rights", v.READ) & (F.col("admin") | can_write))
    listed = F.when(F.col("admin"), F.col("rights")).otherwise(F.array_sort(F.array_intersect("rights", write)))
    return shown.select("user_id", "cassette_id", "name", "allow_write", listed.alias("rights"), "admin")


def _duplicates(rows: DataFrame, keys: list[str], code: str, subject: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(
        F.lit(code).alias("code"), subject.alias("subject"))


def check_configuration(cassettes: DataFrame, roles: DataFrame, members: DataFrame) -> DataFrame:
    """(code, subject) of every fault: unknown or repeated rights, cassettes and roles, blank ids, writable count."""
    role_project = roles.select("role", F.explode("project_rights").alias("right"))
    role_cassette = roles.select("role", F.explode("cassette_rights").alias("cassette_id", "rights"))
    override = members.select("user_id", F.explode("cassette_overrides").alias("cassette_id", "rights"))
    member_role = members.select("user_id", F.explode("roles").alias("role"))
    known = cassettes.select(F.col("id").alias("cassette_id"))

    def fault(rows: DataFrame, code: str, *subject: str) -> DataFrame:
        return rows.select(F.lit(code).alias("code"), F.concat_ws("/", *subject).alias("subject"))

    def unknown_cassette(rows: DataFrame) -> DataFrame:
        return rows.where(F.col("cassette_id") != _WILDCARD).join(known, "cassette_id", "left_anti")

    def bad_right(rows: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
        return rows.where(~F.col("right").isin(*allowed))

    pairs = [(role_cassette, "role"), (override, "user_id")]
    out = [
        fault(bad_right(role_project, v.PROJECT_RIGHTS), "unknown_right", "role", "right"),
        _duplicates(role_project, ["role", "right"], "repeated_right", F.concat_ws("/", "role", "right")),
        _duplicates(cassettes, ["id"], "repeated_cassette", F.col("id")),
        _duplicates(members, ["user_id"], "repeated_member", F.col("user_id")),
        _duplicates(member_role, ["user_id", "role"], "repeated_role", F.concat_ws("/", "user_id", "role")),
        fault(member_role.join(roles, "role", "left_anti"), "unknown_role", "user_id", "role"),
        fault(cassettes.where("trim(id) = '' or trim(name) = ''"), "blank_cassette", "id"),
        fault(members.where("trim(user_id) = ''"), "blank_member", "user_id"),
        fault(roles.where("trim(role) = ''"), "blank_role", "role"),
        fault(cassettes.where(~F.col("default_access").isin("none", v.READ)), "unknown_default_access", "id", "default_access"),
        cassettes.agg(F.count(F.when(F.expr("enabled and allow_write"), 1)).alias("n")).where("n <> 1")
        .select(F.lit("writable_cassettes").alias("code"), F.col("n").cast("string").alias("subject")),
    ]
    for rows, owner in pairs:
        each = rows.select(owner, "cassette_id", F.explode("rights").alias("right"))
        out += [
            fault(unknown_cassette(rows), "unknown_cassette", owner, "cassette_id"),
            fault(bad_right(each, v.CASSETTE_RIGHTS), "unknown_right", owner, "cassette_id", "right"),
            _duplicates(each, [owner, "cassette_id", "right"], "repeated_right", F.concat_ws("/", owner, "cassette_id", "right")),
        ]
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found
