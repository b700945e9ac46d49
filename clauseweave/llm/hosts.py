"""Hosts and addresses of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# First labels that name a service, not an owner.
SERVICE_LABELS = ["www", "cdn", "api", "sdk", "ads", "apps", "app", "static", "img", "mail", "m", "go"]


def host_of(url: Column) -> Column:
    """The host of a URL, however it is written: lower case, without scheme, port, path or service label."""
    h = F.lower(F.trim(url))
    h = F.regexp_replace(h, r"^[a-z][a-z0-9+.-]*://", "")
    h = F.regexp_replace(h, r"^[^/@]*@", "")
    h = F.regexp_extract(h, r"^([^/?#:\s]+)", 1)
    h = F.regexp_replace(h, rf"^(?:(?:{'|'.join(SERVICE_LABELS)})\.)+(?=[^.]+\.)", "")
    return F.when(h != "", F.regexp_replace(h, r"\.+$", ""))


def hosts_of(records: DataFrame, families: DataFrame | None = None, most: int = 40) -> DataFrame:
    """(entity_id, token, lent) of all hosts of each record; lent: the host is a platform's, which lends itself to many.

    A host below a parent that more than ``most`` families of names share (a platform) says nothing
    about its owner, unless one family has at least half of the records there: then the parent is
    its own, however many records it has. families: (entity_id, family), with no row for a record
    without a usable name; where they aren't given, each record counts as a family.
    """
    d = records.select("entity_id", F.explode("domains").alias("d")).select("entity_id", host_of(F.col("d")).alias("token")).where("token is not null").distinct()
    d = d.withColumn("parent", F.regexp_extract("token", r"([^.]+\.[^.]+)$", 1))
    users = d.select("parent", "entity_id").distinct()
    users = users.withColumn("family", F.col("entity_id")) if families is None else users.join(families.select("entity_id", "family"), "entity_id")
    shares = users.groupBy("parent", "family").agg(F.count("*").alias("n")).groupBy("parent").agg(F.count("*").alias("families"), F.max("n").alias("top"), F.sum("n").alias("n"))
    platforms = shares.where((F.col("families") > most) & (F.col("top") * 2 < F.col("n")))
    return d.join(platforms.select("parent", F.lit(True).alias("lent")), "parent", "left").select("entity_id", "token", F.coalesce("lent", F.lit(False)).alias("lent"))


def evidence_of(records: DataFrame, families: DataFrame | None = None, most: int = 40) -> DataFrame:
    """(entity_id, token) of the hosts of each record that tell its owner: those of ``hosts_of`` that aren't lent."""
    return hosts_of(records, families, most).where("not lent").select("entity_id", "token")
