"""Lists over catalog, dashboard and chart tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# --- fixed values -----------------------------------------------------------
LIST_DATASETS = 100  # default page sizes
LIST_CHARTS = 1000
# ----------------------------------------------------------------------------


def _newest(df: DataFrame, time: str, id: str | None) -> DataFrame:
    """Newest first; equal times are ordered by the id, so that pages neither repeat nor miss rows."""
    keys = [F.desc(time)] + ([F.asc(id)] if id in df.columns else [])
    return df.orderBy(*keys)


def list_datasets(catalog: DataFrame, n: int | None = None, created: str = "created_at", id: str = "dataset") -> DataFrame:
    """Newest datasets first."""
    return _newest(catalog, created, id).limit(n or LIST_DATASETS)


def search_datasets(catalog: DataFrame, term: str = "", sort: str = "created_at", order: str = "desc",
                    fields: tuple[str, ...] = ("name", "dataset")) -> DataFrame:
    """Datasets whose name or id contains the term, in any case, sorted by any column."""
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(F.lower(F.col(f)).contains(term.lower()), F.lit(False))
    ties = [f for f in ("dataset", *fields) if f in catalog.columns and f != sort]
    return catalog.filter(hit).orderBy(F.asc(sort) if order == "asc" else F.desc(sort), *ties[:1])


def visible_to(df: DataFrame, user: str | None, role: str | None, status: str = "status",
               owner: str = "created_by") -> DataFrame:
    """Admins see all, editors what is published or their own, others what is published."""
    if user and role == "admin":
        return df
    published = F.col(status) == "published"
    return df.filter(published | (F.col(owner) == user) if user and role != "viewer" else published)


def list_charts(charts: DataFrame, dataset: str | None = None, limit: int | None = None, offset: int = 0,
                key: str = "dataset", updated: str = "updated_at", id: str = "chart_id") -> tuple[DataFrame, DataFrame]:
    """(one page of chart specs, newest first; one row with the total)."""
    rows = charts.filter(F.col(key) == dataset) if dataset else charts
    page = _newest(rows, updated, id).offset(max(offset, 0)).limit(limit or LIST_CHARTS)
    return page, rows.agg(F.count(F.lit(1)).alias("total"))
