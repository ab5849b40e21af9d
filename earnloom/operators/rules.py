"""Wildcard rules over a composite key, e.g. ``*/*/north/*/late`` -> ``watch``.

A rule matches when every part of its pattern is ``*`` or equals the column of that place (as text; a null
equals nothing). Of several matching rules the one with the most fixed parts counts, then the one listed first; rows
without a match get the default.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

WILDCARD = "*"
# A document of more rules than this is joined as a table.
FEW_RULES = 50


def classify(df: DataFrame, rule_set: Mapping) -> DataFrame:
    """Add the rule set's target column.

    A short document becomes one CASE expression: no join, no extra rows. A long one is a table of rules (see
    ``classify_from``).
    """
    columns = list(rule_set["columns"])
    separator = rule_set.get("rule_separator", "/")
    listed = list(rule_set.get("rules", []))
    ranked = []
    for position, rule in enumerate(listed):
        parts = rule["pattern"].split(separator)
        if len(parts) != len(columns):
            raise ValueError(f"rule {rule['pattern']!r} has {len(parts)} parts for {len(columns)} columns")
        fixed = [(c, p) for c, p in zip(columns, parts) if p != WILDCARD]
        ranked.append((-len(fixed), position, fixed, rule["value"]))
    if len(listed) > FEW_RULES:
        rows = [(position, rule["pattern"], rule["value"]) for position, rule in enumerate(listed)]
        table = df.sparkSession.createDataFrame(rows, "position long, pattern string, value string")
        return classify_from(df, table, columns, rule_set["target_column"], rule_set.get("default"), separator)
    default = F.lit(rule_set.get("default"))
    result: Column | None = None
    for _, _, fixed, value in sorted(ranked, key=lambda r: r[:2]):
        test = F.lit(True)
        for name, part in fixed:
            test = test & (F.col(f"`{name}`").cast("string") == part)
        result = F.when(test, F.lit(value)) if result is None else result.when(test, F.lit(value))
    chosen = default if result is None else result.otherwise(default)
    return df.withColumn(rule_set["target_column"], chosen)


def classify_from(
    df: DataFrame,
    rules: DataFrame,
    columns: Sequence[str],
    target: str,
    default: str | None = None,
    separator: str = "/",
    pattern: str = "pattern",
    value: str = "value",
    position: str = "position",
) -> DataFrame:
    """Add ``target`` by a table of rules of any length (pattern, value, position in the list).

    Rules with wildcards in the same places are one look-up table, so a row takes one equality join per
    set of places that occurs: at most 2 to the number of columns, however many rules there are. Spark broadcasts
    the small ones and shuffles by the fixed parts for the others. Patterns with another number of parts are an error.
    """
    columns = list(columns)
    parts = F.split(F.col(pattern), "\\Q" + separator + "\\E")
    checked = F.when(F.size(parts) == len(columns), parts).otherwise(
        F.raise_error(F.concat(F.lit(f"a rule needs {len(columns)} parts: "), F.coalesce(F.col(pattern), F.lit("null")))).cast("array<string>")
    )
    split = rules.select(
        checked.alias("_parts"), F.col(position).cast("long").alias("_position"), F.col(value).cast("string").alias("_value")
    ).withColumn("_mask", F.array_join(F.transform("_parts", lambda p: F.when(p == WILDCARD, WILDCARD).otherwise("x")), ""))
    # at most 2 ** columns rows, and of the mask without fixed parts one rule
    masks = sorted(r["_mask"] for r in split.select("_mask").distinct().collect())
    packed = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"),
        *[F.col(f"`{c}`").cast("string").alias(f"_c{i}") for i, c in enumerate(columns)],
    )
    best = F.min(F.struct("_position", "_value"))
    candidates = []
    for mask in masks:
        places = [i for i, mark in enumerate(mask) if mark != WILDCARD]
        own = split.filter(F.col("_mask") == mask)
        rank = F.lit(-len(places))
        if not places:
            only = own.agg(best.alias("b")).first()["b"]
            candidates.append(F.struct(rank.alias("fixed"), F.lit(only[0]).cast("long").alias("position"), F.lit(only[1]).cast("string").alias("value")))
            continue
        name = f"_m{len(candidates)}"
        keys = [f"_c{i}" for i in places]
        lookup = own.groupBy(*[F.col("_parts")[i].alias(f"_c{i}") for i in places]).agg(best.alias(name))
        packed = packed.join(lookup, keys, "left")
        candidates.append(
            F.when(
                F.col(name).isNotNull(),
                F.struct(rank.alias("fixed"), F.col(f"{name}._position").alias("position"), F.col(f"{name}._value").alias("value")),
            )
        )
    fallback = F.lit(default).cast("string")
    if candidates:
        chosen = F.array_min(F.array_compact(F.array(*candidates)))
        fallback = F.when(chosen.isNotNull(), chosen["value"]).otherwise(fallback)
    rest = [F.col(f"_row.`{c}`").alias(c) for c in df.columns if c != target]
    return packed.select(*rest, fallback.alias(target))
