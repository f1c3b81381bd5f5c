"""Keyed writes as new state = f(old state, batch).

Old rows are never grouped or sorted: the batch is reduced to its last row per key and
written, old rows whose key is in it are dropped by an anti-join that sees only
keys, and the rest stream through. Null keys are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townhall.functions.text import blank_to_null, limit_text, trim_all
from townhall.operators import skew
from townhall.operators.skew import by_key, by_rows, key_id
from townhall.session import settle


def _same(left: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of the keys with columns of the other side, called _k0, _k1, ..."""
    on = F.lit(True)
    for i, k in enumerate(keys):
        on &= left[k].eqNullSafe(F.col(f"_k{i}"))
    return on


def _without(old: DataFrame, newest: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``old`` whose key ``newest``, a written table, does not have.

    Few keys meet every old row. Many are dealt out on both sides, as two numbers (``key_id``) where they hold text.
    """
    if newest.count() <= skew.FEW_ROWS:
        return old.join(newest.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]), _same(old, keys), "left_anti")
    types = dict(old.dtypes)
    kinds = dict(newest.select(*keys).dtypes)
    if "string" not in kinds.values() or any(types[k] != t or t in ("float", "double") or "<" in t for k, t in kinds.items()):
        return old.join(by_key(newest.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])), _same(old, keys), "left_anti")
    ids = key_id(*[F.col(k) for k in keys])
    return old.select("*", *ids).join(by_key(newest.select(*ids)), ["_id0", "_id1"], "left_anti").select(*old.columns)


def upsert(old: DataFrame, batch: DataFrame, keys: list[str], order: str, keep: list[str] = (), first: bool = False) -> DataFrame:
    """Rows of ``batch`` replace rows of ``old`` with equal keys; the last one by ``order`` wins.

    Columns in ``keep`` are not written by the batch and keep their old value. Keys are unique in
    ``old``. The reduced batch is written, so its size is known: if its keys are few, no old row is shuffled; else
    old rows are dealt out by key once. ``first`` says that ``old`` is known to have no rows: the reduced batch is the result.
    """
    written = [c for c in old.columns if c not in keys and c not in keep]
    values = F.struct(*written) if written else F.struct(F.lit(True).alias("_none"))
    newest = batch.groupBy(*keys).agg(F.max_by(values, order).alias("_w")).select(*keys, *[F.col("_w")[c].alias(c) for c in written])
    if first:
        types = dict(old.dtypes)
        return newest.withColumns({k: F.lit(None).cast(types[k]) for k in keep}).select(*old.columns)
    newest = settle(newest)
    rest = _without(old, newest, keys)
    if keep:
        sent = by_rows(newest.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]))
        held = old.join(sent, _same(old, keys), "left_semi").select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(k).alias(f"_h{i}") for i, k in enumerate(keep)])
        newest = newest.join(held, _same(newest, keys), "left").withColumns({k: F.col(f"_h{i}") for i, k in enumerate(keep)})
    return rest.unionByName(newest.select(*old.columns))


def replace_groups(old: DataFrame, batch: DataFrame, group: list[str], touched: DataFrame | None = None,
                   replaceable: Column | None = None) -> DataFrame:
    """Old rows of the touched groups go, batch rows come.

    ``touched`` names the groups; it defaults to the groups of the batch and must be
    given when a group may be written empty. ``replaceable`` limits which old rows go. Null groups are equal.

    The batch and its groups are reduced and written as in ``upsert``; rows that may not go, and those of other groups, stream through.
    """
    columns = old.columns
    batch = settle(batch.select(*columns))
    groups = by_rows(settle((batch if touched is None else touched).select(*[F.col(g).alias(f"_k{i}") for i, g in enumerate(group)]).distinct()))
    if replaceable is None:
        return old.join(groups, _same(old, group), "left_anti").unionByName(batch)
    may_go = F.coalesce(replaceable, F.lit(False))
    open_ = old.filter(may_go)
    return old.filter(~may_go).unionByName(open_.join(groups, _same(open_, group), "left_anti")).unionByName(batch)


def article_rows(items: DataFrame) -> DataFrame:
    """Item rows with the defaults an article is written with."""
    text = trim_all(F.col("cleaned_text"))
    filled = F.when(F.length(text) > 0, limit_text(text, 200))
    return items.withColumns({
        "summary": F.coalesce(F.nullif(F.col("summary"), F.lit("")), filled, F.col("summary")),
        "content_type": F.coalesce("content_type", F.lit("unknown")),
        "status": F.lit("published"),
    })


def search_documents(articles: DataFrame, bodies: DataFrame, scrapers: DataFrame, sources: DataFrame, body_chars: int | None = None) -> DataFrame:
    """Flat search rows: body (cut where the caller says so; ``body_cut`` counts what went), organisation of the scraper, oldest source URL, ISO dates."""
    first_source = sources.groupBy("article_id").agg(
        F.min_by("source_url", F.struct("created_at", "id")).alias("source_url"))
    iso = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    text = F.col("cleaned_text")
    body = bodies.select("article_id", (text if body_chars is None else F.substring(text, 1, body_chars)).alias("body"),
                         (F.lit(0) if body_chars is None else F.greatest(F.length(text) - body_chars, F.lit(0))).alias("body_cut"), "extraction_status")
    org = scrapers.select(F.col("id").alias("scraper_id"), "organization_id")
    # Ids meet first; the text joins last.
    return (
        articles.join(org, "scraper_id", "left")
        .join(first_source.withColumnRenamed("article_id", "id"), "id", "left")
        .join(body.withColumnRenamed("article_id", "id"), "id", "left")
        .select("id", "city_id", "title", "summary", F.coalesce("body", F.lit("")).alias("body"), F.coalesce("body_cut", F.lit(0)).alias("body_cut"),
                iso("published_at").alias("published_at"), iso("created_at").alias("created_at"),
                "organization_id", "scraper_id", "extraction_status", "source_url")
    )
