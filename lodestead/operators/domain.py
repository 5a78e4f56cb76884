"""Features of a host's certificate and a domain's registration record, from tables of what was looked up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestead.config import PRIVACY_WORDS


def tls_features(hosts: DataFrame, certs: DataFrame, as_of: Column) -> DataFrame:
    """hosts(site_key, hostname) -> the ssl_ columns; a host without a good handshake has ssl_ok false."""
    ok = F.coalesce("handshake_ok", F.lit(False))
    return hosts.join(certs, "hostname", "left").select(
        "site_key", ok.alias("ssl_ok"), F.when(ok, F.col("issuer_org")).alias("ssl_issuer_org"), F.when(ok, F.col("subject_org").isNotNull()).alias("ssl_org_validated"),
        F.when(ok, F.floor((F.unix_timestamp("not_after") - F.unix_timestamp(as_of)) / 86400).cast("int")).alias("ssl_days_to_expiry"), F.col("error").alias("ssl_cert_error"))


def whois_features(domains: DataFrame, whois: DataFrame, as_of: Column) -> DataFrame:
    """domains(site_key, registered_domain) -> age in days, privacy flag, organisation; nulls where nothing is known."""
    blob = F.lower(F.coalesce("raw_text", F.lit("")))
    created = F.array_min(F.filter("creation_dates", lambda d: d.isNotNull()))
    private = F.when(F.col("domain").isNotNull(), blob.rlike("|".join(PRIVACY_WORDS)))
    return domains.join(whois, domains["registered_domain"] == whois["domain"], "left").select(
        "site_key", F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(created)) / 86400).cast("int").alias("domain_age_days"), private.alias("whois_privacy_protected"), F.col("org").alias("whois_registrant_org"))
