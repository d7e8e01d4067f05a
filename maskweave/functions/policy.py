"""The four masking policies, their order, and the checks on a policy entry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ALLOW, SCAN, TOKEN, REDACT = "allow", "scan", "token", "redact"

#: From weakest to strictest; the position is the rank.
POLICIES = (ALLOW, SCAN, TOKEN, REDACT)

#: Type of one catalog entry: a policy, its token namespace, and policies of JSON paths inside it.
ENTRY_FIELDS = "policy string, namespace string, paths map<string, struct<policy: string, namespace: string>>"


def rank(policy: Column) -> Column:
    """0 to 3, and -1 for a policy nobody knows, which keeps it out of every comparison."""
    out = F.lit(-1)
    for i, name in enumerate(POLICIES):
        out = F.when(policy == name, F.lit(i)).otherwise(out)
    return out


def by_rank(position: Column) -> Column:
    """The policy at a rank; below 0 there is none, so nothing restrictive was found."""
    out = F.lit(ALLOW)
    for i, name in enumerate(POLICIES[1:], start=1):
        out = F.when(position == i, F.lit(name)).otherwise(out)
    return out


def strictest(*policies: Column) -> Column:
    ranks = [rank(p) for p in policies] + [F.lit(0)]
    return by_rank(F.greatest(*ranks))


def strictest_of_group(policy: Column) -> Column:
    """Aggregate form of :func:`strictest`."""
    return by_rank(F.max(F.greatest(rank(policy), F.lit(0))))


def inherited(policy: Column) -> Column:
    """What a computed column gets: it has no namespace to make tokens under, so token is redact."""
    return F.when(policy.isin(TOKEN, REDACT), F.lit(REDACT)).when(policy == SCAN, F.lit(SCAN)).otherwise(F.lit(ALLOW))


def known(policy: Column) -> Column:
    """A policy nobody knows behaves as redact."""
    return F.when(rank(policy) >= 0, policy).otherwise(F.lit(REDACT))


def known_namespace(policy: Column, namespace: Column) -> Column:
    return F.when(rank(policy) >= 0, namespace).otherwise(F.lit(""))


def known_paths(paths: Column) -> Column:
    return F.transform_values(
        paths,
        lambda _, p: F.struct(
            known(p["policy"]).alias("policy"),
            known_namespace(p["policy"], p["namespace"]).alias("namespace"),
        ),
    )


def valid_namespace(namespace: Column) -> Column:
    """A token must read back: no digit at the end, no delimiter inside, not empty."""
    return namespace.rlike("^[^:⟨⟩]*[^:⟨⟩0-9]$")


def invalid_reason(policy: Column, namespace: Column) -> Column:
    """Why an entry cannot be used; null when it can."""
    empty = F.coalesce(namespace, F.lit("")) == ""
    return (
        F.when(F.coalesce(rank(policy), F.lit(-1)) < 0, F.concat(F.lit("unknown policy "), F.coalesce(policy, F.lit(""))))
        .when((policy == TOKEN) & empty, F.lit("token requires a namespace"))
        .when((policy != TOKEN) & ~empty, F.lit("namespace applies to token only"))
        .when((policy == TOKEN) & ~valid_namespace(namespace), F.lit("namespace cannot be read back"))
    )


def invalid_entry_reason(policy: Column, namespace: Column, paths: Column) -> Column:
    """:func:`invalid_reason` of the entry itself, then of its first invalid path by name."""
    bad = F.array_sort(
        F.filter(
            F.transform(
                F.map_entries(paths),
                lambda e: F.concat(e["key"], F.lit(": "), invalid_reason(e["value"]["policy"], e["value"]["namespace"])),
            ),
            lambda r: r.isNotNull(),
        )
    )
    return F.coalesce(invalid_reason(policy, namespace), F.get(bad, F.lit(0)))


def floor_policy(policy: Column, floor: Column, text_like: Column) -> Column:
    """Raise a policy to ``floor`` where the column could carry a text value."""
    return F.when(text_like, strictest(policy, floor)).otherwise(policy)


def any_true(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
