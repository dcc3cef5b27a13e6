"""Domain-name expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Second-level labels under which names are registered one level deeper.
REGISTRY_LABELS = ("com", "net", "org", "co")
# Shape of a fully qualified name.
FQDN_PATTERN = r"^(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}$"
# Suffixes that never leave the local network.
LOCAL_SUFFIXES = (".arpa", ".local")


def _as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def registrable_domain(fqdn: Column | str) -> Column:
    """Last two labels, or three below a registry label; '' when there is no dot.

    A rule over label positions, not the public-suffix list.
    """
    fqdn = _as_col(fqdn)
    labels = F.split(fqdn, r"\.")
    n = F.size(labels)
    depth = F.when((n >= 3) & F.get(labels, n - 2).isin(*REGISTRY_LABELS), 3).otherwise(2)
    return F.when(n < 2, F.lit("")).otherwise(
        F.array_join(F.slice(labels, F.greatest(n - depth + 1, F.lit(1)), depth), ".")
    )


def suffixes(fqdn: Column | str, tld: Column | str) -> Column:
    """Every suffix of a name, from its registrable domain up to the full name."""
    labels = F.split(_as_col(fqdn), r"\.")
    n, base = F.size(labels), F.size(F.split(_as_col(tld), r"\."))
    return F.transform(
        F.sequence(F.least(base, n), n),
        lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."),
    )


def is_fqdn(name: Column | str) -> Column:
    return _as_col(name).rlike(FQDN_PATTERN)


def is_exportable_domain(tld: Column | str) -> Column:
    """Not empty and not a reverse-lookup or local suffix."""
    tld = _as_col(tld)
    keep = tld != ""
    for suffix in LOCAL_SUFFIXES:
        keep = keep & ~tld.endswith(suffix)
    return keep


def matches_domain_list(name: Column | str, patterns: tuple[str, ...]) -> Column:
    """Exact names, or ``*.x`` matching every name below ``x`` and ``x`` itself."""
    name = _as_col(name)
    hit = F.lit(False)
    exact = sorted({p for p in patterns if "*" not in p})
    if exact:
        hit = hit | name.isin(*exact)
    for pattern in sorted({p for p in patterns if "*" in p}):
        tail = pattern.removeprefix("*")
        hit = hit | name.endswith(tail) | (name == tail.removeprefix("."))
    return F.coalesce(hit, F.lit(False))


def filter_domain(name: Column | str, allow: tuple[str, ...], deny: tuple[str, ...]) -> Column:
    """True when the name is dropped: denied and not explicitly allowed."""
    return ~matches_domain_list(name, allow) & matches_domain_list(name, deny)


def drop_denied_domains(df: DataFrame, name: str, patterns: DataFrame) -> DataFrame:
    """Join form of the deny list for lists too long to inline.

    ``patterns`` has one column ``pattern``. Distinct names are exploded to their
    suffixes and matched by equality, so neither side is ever paired up wholesale.
    """
    rules = patterns.select(
        F.regexp_replace("pattern", r"^\*\.?", "").alias("_rule"),
        F.col("pattern").startswith("*").alias("_wild"),
    ).dropDuplicates()
    labels = F.split(F.col(name), r"\.")
    n = F.size(labels)
    denied = (
        df.select(name)
        .dropDuplicates()
        .select(
            name,
            F.explode(
                F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))
            ).alias("_rule"),
        )
        .join(rules, "_rule")
        .filter(F.col("_wild") | (F.col("_rule") == F.col(name)))
        .select(name)
        .dropDuplicates()
    )
    return df.join(denied, name, "left_anti")


def candidate_label(domain: Column | str) -> Column:
    """Leftmost label of a cleaned, lower-cased name."""
    clean = F.lower(F.regexp_replace(F.trim(_as_col(domain)), r"\.+$", ""))
    return F.get(F.split(clean, r"\."), F.lit(0))
