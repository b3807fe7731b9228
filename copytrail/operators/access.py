"""Tenant scoping, job lists and recipient records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copytrail.skew import SALTS, lookup_join, sparse_join

# Which role sees its own rows, per kind of row (fixed values).
OWN_ROLE = {"issuances": "issuer", "verifications": "verifier"}
WHOLE_TENANT = ("administrator", "auditor")


def scope_rows(rows: DataFrame, kind: str, actor_id, organization_id: str, role: str) -> DataFrame:
    """Rows one actor may see. Everything is a filter, so it reaches the scan and prunes tenant partitions."""
    scoped = rows.filter(F.col("organization_id") == organization_id)
    if role in WHOLE_TENANT:
        return scoped
    own = scoped.filter(F.col("owner_id") == actor_id)
    if kind == "jobs":
        wanted = {"issuer": "issuance", "verifier": "verification"}.get(role)
        return own.filter(F.col("kind") == wanted) if wanted else own.filter(F.lit(False))
    return own if role == OWN_ROLE[kind] else own.filter(F.lit(False))


def scope_uploads(rows: DataFrame, actor_id, organization_id: str, role: str) -> DataFrame:
    """Uploads one actor may see: an administrator the tenant's, everybody else only their own."""
    scoped = rows.filter(F.col("organization_id") == organization_id)
    return scoped if role == "administrator" else scoped.filter(F.col("requested_by") == actor_id)


def _visible(kind: str, role: Column, row_kind: Column, own: Column) -> Column:
    if kind == "uploads":
        return (role == "administrator") | own
    if kind == "jobs":
        fits = ((role == "issuer") & (row_kind == "issuance")) | ((role == "verifier") & (row_kind == "verification"))
    else:
        fits = role == OWN_ROLE[kind]
    return role.isin(*WHOLE_TENANT) | (fits & own)


def visible_totals(actors: DataFrame, rows: DataFrame, kind: str) -> DataFrame:
    """How many rows each actor may see and the newest of them, without pairing actors with rows.

    Rows are reduced per tenant and per owner first; each actor then meets at most one row of each.
    """
    slices = [("issuance", F.col("kind") == "issuance"), ("verification", F.col("kind") == "verification")] if kind == "jobs" else []
    cells = [F.count("*").alias("n"), F.max("created_at").alias("t")]
    for name, test in slices:
        cells += [F.count_if(test).alias(f"n_{name}"), F.max(F.when(test, F.col("created_at"))).alias(f"t_{name}")]
    tenant = rows.groupBy("organization_id").agg(*[c for c in cells[:2]]).select("organization_id", F.struct("n", "t").alias("_tenant"))
    names = ["n", "t"] + [f"{p}_{name}" for name, _ in slices for p in ("n", "t")]
    owned = rows.groupBy("organization_id", F.col("owner_id").alias("actor_id")).agg(*cells).select(
        "organization_id", "actor_id", F.struct(*names).alias("_own"))
    joined = lookup_join(actors, tenant, ["organization_id"], spread=["actor_id"]).join(owned, ["organization_id", "actor_id"], "left")
    role = F.col("role")
    wide = role == "administrator" if kind == "uploads" else role.isin(*WHOLE_TENANT)

    def pick(part: str) -> Column:
        value = F.when(wide, F.col(f"_tenant.{part}"))
        if kind == "uploads":
            return value.otherwise(F.col(f"_own.{part}"))
        if kind == "jobs":
            return value.when(role == "issuer", F.col(f"_own.{part}_issuance")).when(role == "verifier", F.col(f"_own.{part}_verification"))
        return value.when(role == OWN_ROLE[kind], F.col(f"_own.{part}"))

    return joined.select("actor_id", "organization_id", "role", F.coalesce(pick("n"), F.lit(0)).alias("visible_rows"), pick("t").alias("newest"))


def check_access(requests: DataFrame, actors: DataFrame, rows: DataFrame, kind: str, key: str) -> DataFrame:
    """Whether each (actor, row) request is within the actor's scope; unknown actors or rows are not."""
    who = actors.select("actor_id", F.col("organization_id").alias("_aorg"), F.col("role").alias("_role"))
    what = rows.select(key, F.col("organization_id").alias("_rorg"), F.col("owner_id").alias("_owner"),
                       (F.col("kind") if kind == "jobs" else F.lit(None).cast("string")).alias("_kind"))
    joined = lookup_join(lookup_join(requests, who, ["actor_id"]), what, [key], counted=requests)
    seen = (F.col("_aorg") == F.col("_rorg")) & _visible(kind, F.col("_role"), F.col("_kind"), F.col("_owner") == F.col("actor_id"))
    return joined.withColumn("visible", F.coalesce(seen, F.lit(False))).drop("_aorg", "_role", "_rorg", "_owner", "_kind")


def _with_subjects(jobs: DataFrame, recipients: DataFrame, verifications: DataFrame) -> DataFrame:
    named = sparse_join(jobs, recipients, ["issuance_id"], ["job_id"])
    return sparse_join(named, verifications, ["verification_id"], ["job_id"])


def job_list(jobs: DataFrame, recipients: DataFrame, verifications: DataFrame, actor_id, organization_id: str, role: str,
             kind: str | None = None, limit: int = 50) -> DataFrame:
    """One actor's newest jobs; the names are joined to the listed rows only. An unknown kind is ignored."""
    scoped = scope_rows(jobs, "jobs", actor_id, organization_id, role)
    if kind in ("issuance", "verification"):
        scoped = scoped.filter(F.col("kind") == kind)
    head = scoped.orderBy(F.col("created_at").desc(), F.col("job_id").desc()).limit(limit)
    return _with_subjects(head, recipients, verifications).orderBy(F.col("created_at").desc(), F.col("job_id").desc())


def job_lists(actors: DataFrame, jobs: DataFrame, recipients: DataFrame, verifications: DataFrame, limit: int = 50) -> DataFrame:
    """Every actor's newest jobs. Heads are taken per tenant and per owner, first in slices of their jobs, whatever the input's splits hold."""
    newest = [F.col("created_at").desc(), F.col("job_id").desc()]
    sliced = jobs.withColumn("_slice", F.pmod(F.xxhash64("job_id"), F.lit(SALTS))).repartition("organization_id", "_slice")

    def heads(keys: list[str]) -> DataFrame:
        first = sliced.withColumn("_at", F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*newest))).filter(F.col("_at") <= limit)
        return first.drop("_slice", "_at").withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))).filter(
            F.col("position") <= limit)

    tenant, owner = heads(["organization_id"]), heads(["organization_id", "owner_id", "kind"])
    wide = lookup_join(actors.filter(F.col("role").isin(*WHOLE_TENANT)), tenant, ["organization_id"], "inner", spread=["actor_id"]).select("actor_id", *tenant.columns)
    wanted = F.when(F.col("role") == "issuer", "issuance").when(F.col("role") == "verifier", "verification")
    own = actors.withColumn("kind", wanted).filter(F.col("kind").isNotNull()).withColumn("owner_id", F.col("actor_id")).drop("role").join(
        owner, ["organization_id", "owner_id", "kind"]).select("actor_id", *tenant.columns)
    return _with_subjects(wide.unionByName(own), recipients, verifications)


def recipient_upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Recipients after an import: the stored record wins, a blank name takes the first non-blank one offered."""
    name = F.trim(F.coalesce("display_name", F.lit("")))
    offered = incoming.withColumn("_name", name).groupBy(
        "organization_id", F.lower(F.trim("email")).alias("external_reference")).agg(
        F.min_by(F.when(F.col("_name") != "", F.col("_name")), F.when(F.col("_name") != "", F.struct("ordinal", "_name"))).alias("_offered"))
    stored = existing.select("organization_id", F.lower("external_reference").alias("external_reference"),
                             F.col("display_name").alias("_stored"), F.lit(True).alias("_known"))
    joined = stored.join(offered.withColumn("_asked", F.lit(True)), ["organization_id", "external_reference"], "full_outer")
    blank = F.trim(F.coalesce("_stored", F.lit(""))) == ""
    final = F.when(blank & F.col("_offered").isNotNull(), F.col("_offered")).otherwise(F.coalesce("_stored", F.lit("")))
    action = F.when(F.col("_known").isNull(), "created").when(blank & F.col("_offered").isNotNull(), "filled").otherwise("kept")
    return joined.select("organization_id", "external_reference", final.alias("display_name"), action.alias("action"))


def tenant_violations(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose related row belongs to another tenant."""
    owner = parents.select(key, F.col("organization_id").alias("parent_organization_id"))
    return lookup_join(children, owner, [key], "inner").filter(F.col("organization_id") != F.col("parent_organization_id"))
