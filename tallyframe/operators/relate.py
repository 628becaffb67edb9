"""Relationships between datasets: value overlap, scoring and the edge set."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.cleaning import comparison_key, trimmed
from ..functions.names import (
    is_foreign_key, is_generic_id, is_key_like, is_primary_key, points_to, snake_case,
)
from .columns import ColumnMeta

# --- fixed values -----------------------------------------------------------
NUMERIC_KINDS = ("number", "int", "integer", "float", "double", "decimal")
TEXT_KINDS = ("string", "text", "varchar", "char")
NAME_MATCH = 0.40
FK_PATTERN = 0.50
OVERLAP_HIGH = (0.8, 0.30)
OVERLAP_SOME = (0.5, 0.20)
TYPES_FIT = 0.05
TYPES_CLASH = -0.20
TO_PRIMARY_KEY = 0.10
FROM_FOREIGN_KEY = 0.05
MANY_VALUES = (10, 0.05)
THRESHOLD = 0.45
MANUAL = "manual"
INFERRED = "inferred"
# ----------------------------------------------------------------------------

EDGE_COLUMNS = ("from_dataset", "from_column", "to_dataset", "to_column", "confidence", "source")
_BITS = 63  # columns one long mask can hold


def types_compatible(a: str | None, b: str | None) -> bool:
    a, b = (a or "").lower(), (b or "").lower()
    if not a or not b or a == b:
        return True
    return (a in NUMERIC_KINDS and b in TEXT_KINDS) or (a in TEXT_KINDS and b in NUMERIC_KINDS)


def _text(df: DataFrame, name: str) -> Column:
    """Value as text; only text can carry outer white space."""
    c = F.col(f"`{name}`")
    text = isinstance(df.schema[name].dataType, T.StringType)
    if isinstance(df.schema[name].dataType, (T.FractionalType, T.DecimalType)):
        # A whole number has one text, whatever type holds it.
        return F.coalesce(F.when(c == F.floor(c), c.try_cast("decimal(38,0)").cast("string")), c.cast("string"))
    return comparison_key(trimmed(c)) if text else c.cast("string")


def column_masks(frames: dict[str, DataFrame], columns: list[tuple[str, str]]) -> DataFrame:
    """How many distinct values occur in exactly which of the columns.

    Every distinct value gets a bit mask of the columns holding it (one shuffle
    over pre-aggregated values); values are then counted per mask. The result is
    small and answers the overlap of every pair, so no pair of rows is formed.
    """
    words = -(-len(columns) // _BITS)
    parts = []
    for dataset in dict.fromkeys(d for d, _ in columns):  # one scan per dataset
        df = frames[dataset]
        cells = []
        for i, (d, name) in enumerate(columns):
            if d == dataset:
                mask = [F.lit(1 << (i % _BITS) if w == i // _BITS else 0).cast("long").alias(f"m{w}") for w in range(words)]
                cells.append(F.struct(_text(df, name).alias("value"), *mask))
        parts.append(df.select(F.inline(F.array(*cells))).filter(F.col("value").isNotNull()))
    union = reduce(DataFrame.unionAll, parts)
    names = [f"m{w}" for w in range(words)]
    per_value = union.groupBy("value").agg(*(F.bit_or(m).alias(m) for m in names))
    return per_value.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))


def overlaps(frames: dict[str, DataFrame], columns: list[tuple[str, str]],
             pairs: list[tuple[int, int]] | None = None) -> DataFrame:
    """Per pair of columns (by position): shared and distinct values and their overlap.

    The overlap is shared / the smaller distinct count. ``pairs`` defaults to all
    pairs of columns of different datasets.
    """
    if pairs is None:
        pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))
                 if columns[i][0] != columns[j][0]]
    masks = column_masks(frames, columns)
    words = F.array(*(c for c in masks.columns if c != "n"))
    # the pairs are one constant; each of the few mask rows is checked against it
    pair = F.explode(F.from_json(F.lit(json.dumps(pairs)), "array<array<int>>")).alias("pair")
    cells = masks.select("n", words.alias("words"), pair).select(
        "n", "words", F.col("pair")[0].alias("a"), F.col("pair")[1].alias("b"))

    def total(*sides: str) -> Column:
        held = reduce(lambda x, y: x & y, (_has(F.col(c)) for c in sides))
        return F.coalesce(F.sum(F.when(held, F.col("n"))), F.lit(0)).cast("long")

    out = cells.groupBy("a", "b").agg(total("a", "b").alias("shared"), total("a").alias("a_values"),
                                      total("b").alias("b_values"))
    smaller = F.least("a_values", "b_values")
    return out.withColumn("overlap", F.when(smaller > 0, F.col("shared") / smaller).otherwise(F.lit(0.0)))


def _has(i: Column) -> Column:
    word = F.element_at(F.col("words"), (F.floor(i / _BITS) + 1).cast("int"))
    return F.getbit(word, (i % _BITS).cast("int")) == 1


def value_overlap(df_a: DataFrame, a: str, df_b: DataFrame, b: str) -> DataFrame:
    """One row: shared values, distinct values of both sides and their overlap."""
    names = [("a", a), ("b", b)]
    return overlaps({"a": df_a, "b": df_b}, names, [(0, 1)]).drop("a", "b")


def sample_overlap(a: ColumnMeta, b: ColumnMeta) -> float:
    """Overlap of the example values kept in the metadata."""
    sides = [{str(v).strip() for v in c.sample_values if v is not None and str(v).strip()} for c in (a, b)]
    smaller = min(map(len, sides))
    return len(sides[0] & sides[1]) / smaller if smaller else 0.0


def _features(datasets: dict[str, list[ColumnMeta]], names: dict[str, str]) -> list[dict]:
    """Name-based facts per column; metadata only."""
    out = []
    for position, (dataset, schema) in enumerate(datasets.items()):
        shown = names.get(dataset, dataset)
        for c in schema:
            out.append({
                "id": len(out), "position": position, "dataset": dataset, "column": c.name, "meta": c,
                "norm": snake_case(c.name), "kind": (c.type or "").lower(), "unique_count": int(c.unique_count or 0),
                "key_like": is_key_like(c.name), "generic": is_generic_id(c.name),
                "is_pk": is_primary_key(c.name, shown), "is_fk": is_foreign_key(c.name, shown),
                "points_to": [d for d in datasets if points_to(c.name, names.get(d, d))],
            })
    return out


def candidate_pairs(features: list[dict]) -> list[tuple[int, int]]:
    """Column pairs of different datasets with a key-like side or the same name."""
    keyed = [f for f in features if f["key_like"]]
    by_norm: dict[str, list[dict]] = {}
    for f in features:
        by_norm.setdefault(f["norm"], []).append(f)
    found = {(a["id"], b["id"]) for same in by_norm.values() for a in same for b in same}
    found |= {(a["id"], b["id"]) for a in keyed for b in features}
    out = set()
    for i, j in found:
        a, b = features[min(i, j)], features[max(i, j)]
        if a["position"] != b["position"] and not (a["generic"] and b["generic"]):
            out.add((a["id"], b["id"]))
    return sorted(out)


def score_pair(a: str, b: str) -> Column:
    """Score of the direction ``a`` -> ``b`` over the pair columns of ``_pair_frame``."""
    def s(flag: str, side: str) -> Column:
        return F.col(f"{side}_{flag}")

    overlap_counts = s("is_fk", a) | s("is_pk", a) | s("is_pk", b) | F.col("same_name")
    overlap = F.col("overlap")
    none = F.lit(0.0)
    return F.greatest(none, (
        F.when(F.col("same_name"), NAME_MATCH).otherwise(none)
        + F.when(s("is_fk", a) & s("is_pk", b) & s("points", a), FK_PATTERN).otherwise(none)
        + F.when(~overlap_counts, none)
           .when(overlap >= OVERLAP_HIGH[0], OVERLAP_HIGH[1])
           .when(overlap >= OVERLAP_SOME[0], overlap * OVERLAP_SOME[1]).otherwise(none)
        + F.when(F.col("types_fit"), TYPES_FIT).otherwise(F.lit(TYPES_CLASH))
        + F.when(s("is_pk", b), TO_PRIMARY_KEY).otherwise(none)
        + F.when(s("is_fk", a), FROM_FOREIGN_KEY).otherwise(none)
        + F.when((s("unique", a) > MANY_VALUES[0]) & (s("unique", b) > MANY_VALUES[0]), MANY_VALUES[1]).otherwise(none)
    ))


def _pair_frame(spark: SparkSession, features: list[dict], pairs: list[tuple[int, int]],
                overlap: dict[tuple[int, int], float]) -> DataFrame:
    rows = []
    for i, j in pairs:
        a, b = features[i], features[j]
        rows.append((i, j, a["dataset"], a["column"], b["dataset"], b["column"],
                     a["norm"] == b["norm"] and not a["generic"], types_compatible(a["kind"], b["kind"]),
                     a["is_fk"], a["is_pk"], b["dataset"] in a["points_to"], a["unique_count"],
                     b["is_fk"], b["is_pk"], a["dataset"] in b["points_to"], b["unique_count"],
                     float(overlap.get((i, j), 0.0))))
    return spark.createDataFrame(rows, (
        "i int, j int, a_dataset string, a_column string, b_dataset string, b_column string, "
        "same_name boolean, types_fit boolean, a_is_fk boolean, a_is_pk boolean, a_points boolean, a_unique long, "
        "b_is_fk boolean, b_is_pk boolean, b_points boolean, b_unique long, overlap double"))


def detect_relationships(spark: SparkSession, datasets: dict[str, list[ColumnMeta]],
                         frames: dict[str, DataFrame] | None = None,
                         names: dict[str, str] | None = None) -> DataFrame:
    """Likely foreign keys between datasets, best first.

    ``datasets`` maps a dataset to its column metadata. With ``frames`` the overlap
    and distinct counts come from all rows of the candidate columns; without, from
    the example values in the metadata. ``names`` gives the readable dataset names.
    """
    features = _features(datasets, names or {})
    pairs = candidate_pairs(features)
    if not pairs:
        return spark.createDataFrame([], "from_dataset string, from_column string, to_dataset string, "
                                         "to_column string, confidence double, source string")
    if frames is None:
        seen = {(i, j): sample_overlap(features[i]["meta"], features[j]["meta"]) for i, j in pairs}
        frame = _pair_frame(spark, features, pairs, seen)
    else:
        ids = sorted({i for p in pairs for i in p})
        at = {i: k for k, i in enumerate(ids)}
        measured = overlaps(frames, [(features[i]["dataset"], features[i]["column"]) for i in ids],
                            [(at[i], at[j]) for i, j in pairs])
        base = _pair_frame(spark, features, pairs, {})
        position = F.create_map(*(F.lit(x) for k, i in enumerate(ids) for x in (k, i)))
        measured = measured.select(position[F.col("a")].alias("i"), position[F.col("b")].alias("j"),
                                   F.col("overlap"), F.col("a_values").alias("a_unique"),
                                   F.col("b_values").alias("b_unique"))
        frame = base.drop("overlap", "a_unique", "b_unique").join(measured, ["i", "j"], "left")
        # Columns without any value have no overlap, but may be linked by their names.
        frame = frame.fillna({"overlap": 0.0, "a_unique": 0, "b_unique": 0})
    ab, ba = score_pair("a", "b"), score_pair("b", "a")
    forward = ab >= ba

    def pick(x: str, y: str) -> Column:
        return F.when(forward, F.col(x)).otherwise(F.col(y))

    edges = frame.select(
        pick("a_dataset", "b_dataset").alias("from_dataset"), pick("a_column", "b_column").alias("from_column"),
        pick("b_dataset", "a_dataset").alias("to_dataset"), pick("b_column", "a_column").alias("to_column"),
        F.greatest(ab, ba).alias("confidence"), F.lit(INFERRED).alias("source"))
    best = Window.partitionBy("from_dataset", "from_column", "to_dataset", "to_column").orderBy(F.desc("confidence"))
    return (
        edges.filter(F.col("confidence") >= THRESHOLD)
        .withColumn("__r", F.row_number().over(best)).filter("__r = 1").drop("__r")
        .withColumn("confidence", F.round(F.least("confidence", F.lit(1.0)), 2))
        .orderBy(F.desc("confidence"), "from_dataset", "from_column", "to_dataset", "to_column")
    )


# --- edge sets ---------------------------------------------------------------

def _edge_key() -> Column:
    """The same for both orientations of an edge."""
    ends = F.array(F.concat_ws("\x01", "from_dataset", "from_column"), F.concat_ws("\x01", "to_dataset", "to_column"))
    return F.concat_ws("\x02", F.array_sort(ends))


def merge_edges(old: DataFrame, inferred: DataFrame, datasets: list[str]) -> DataFrame:
    """Edge set after a refresh of ``datasets``.

    Old edges stay when one end lies outside the set or when they were made by
    hand (source manual, or confidence 1). New ones are added unless the same
    link is there in either orientation.
    """
    inside = F.col("from_dataset").isin(datasets) & F.col("to_dataset").isin(datasets)
    manual = F.coalesce((F.col("source") == MANUAL) | (F.col("confidence") == 1.0), F.lit(False))
    kept = old.filter(~inside | manual).select(*EDGE_COLUMNS)
    new = inferred.select(*EDGE_COLUMNS).withColumn("__k", _edge_key()).join(
        kept.select(_edge_key().alias("__k")), "__k", "left_anti").drop("__k")
    return kept.unionByName(new)


def _same_link(a: tuple[str, str], b: tuple[str, str]) -> Column:
    def ends(x, y):
        return ((F.col("from_dataset") == x[0]) & (F.col("from_column") == x[1])
                & (F.col("to_dataset") == y[0]) & (F.col("to_column") == y[1]))
    return ends(a, b) | ends(b, a)


def add_relationship(edges: DataFrame, schemas: dict[str, list[ColumnMeta]], from_dataset: str, from_column: str,
                     to_dataset: str, to_column: str) -> DataFrame:
    """Edge set with one link made by hand (confidence 1)."""
    kinds = []
    for dataset, column in ((from_dataset, from_column), (to_dataset, to_column)):
        if dataset not in schemas:
            raise ValueError(f"dataset {dataset!r} not found")
        meta = next((c for c in schemas[dataset] if c.name == column), None)
        if meta is None:
            raise ValueError(f"column {column!r} not found in {dataset!r}")
        kinds.append(meta.type)
    if not types_compatible(*kinds):
        raise ValueError(f"cannot link {kinds[0]} to {kinds[1]}")
    if not edges.filter(_same_link((from_dataset, from_column), (to_dataset, to_column))).isEmpty():
        raise ValueError("the relationship exists")
    new = edges.sparkSession.createDataFrame(
        [(from_dataset, from_column, to_dataset, to_column, 1.0, MANUAL)],
        "from_dataset string, from_column string, to_dataset string, to_column string, confidence double, source string")
    return edges.select(*EDGE_COLUMNS).unionByName(new)


def remove_relationship(edges: DataFrame, from_dataset: str, from_column: str, to_dataset: str,
                        to_column: str) -> DataFrame:
    """Edge set without the link, in either orientation."""
    return edges.filter(~_same_link((from_dataset, from_column), (to_dataset, to_column)))


def edges_with_names(edges: DataFrame, catalog: DataFrame) -> DataFrame:
    """Edges with the readable names of both datasets (the id where there is none)."""
    out = edges
    for side in ("from", "to"):
        named = catalog.select(F.col("dataset").alias(f"{side}_dataset"), F.col("name").alias(f"{side}_name"))
        out = out.join(named, f"{side}_dataset", "left").withColumn(
            f"{side}_name", F.coalesce(F.nullif(F.col(f"{side}_name"), F.lit("")), F.col(f"{side}_dataset")))
    return out


def edges_of(edges: DataFrame, dataset: str) -> DataFrame:
    """Edges with the dataset at either end."""
    return edges.filter((F.col("from_dataset") == dataset) | (F.col("to_dataset") == dataset))
