"""Scope predicates: what a caller may see."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scope:
    """A console user's tenants, or one application's credential."""

    tenants: tuple | None = None
    tenant_id: int | str | None = None
    application_id: int | str | None = None
    user_id: str | None = None
    credential_id: str | None = None

    def tenant_predicate(self, column: str = "tenant_id") -> Column:
        if self.tenants is None:
            return F.col(column) == self.tenant_id
        return F.col(column).isin(*self.tenants) if self.tenants else F.lit(False)

    def application_predicate(self, column: str = "application_id") -> Column:
        return F.lit(True) if self.tenants is not None else F.col(column) == self.application_id

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.tenant_predicate()).where(self.application_predicate())

    def triggered_by(self) -> dict[str, Column]:
        """Columns that attribute a row to its caller."""
        by_user = self.tenants is not None
        return {
            "triggered_by_kind": F.lit("user" if by_user else "credential"),
            "triggered_by_user_id": F.lit(self.user_id if by_user else None).cast("string"),
            "triggered_by_credential_id": F.lit(None if by_user else self.credential_id).cast("string")}


def filtered(df: DataFrame, roots_only: bool = False, **equal) -> DataFrame:
    """Equality on the given columns where a value is given; ``roots_only`` keeps rows without parent."""
    out = reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), ((k, v) for k, v in equal.items() if v is not None), df)
    return out.where(F.col("parent_subject_id").isNull()) if roots_only else out


def between(df: DataFrame, column: str, start, end) -> DataFrame:
    """start <= column < end, open where a bound is None."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast("timestamp"))
    return df if end is None else df.where(F.col(column) < F.lit(end).cast("timestamp"))


def in_application(rows: DataFrame, actors: DataFrame) -> DataFrame:
    """Rows whose actor is of another application than they are."""
    other = actors.select(F.col("id").alias("actor_id"), F.col("application_id").alias("_owner"))
    return rows.join(other, "actor_id", "left").where(~F.coalesce(F.col("_owner") == F.col("application_id"), F.lit(False))).drop("_owner")
