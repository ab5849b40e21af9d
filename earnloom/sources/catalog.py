"""The metadata catalogue: assets, attributes, mappings and rules, and the queries over them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from .tables import create_table

# Catalogue tables and their columns (the rule columns that the queries read are included).
TABLES = {
    "pattern.scenario": "scenario_id int, uuid string, scenario_group string, scenario_name string, "
    "scenario_description string, releasable string",
    "pattern.scenario_parameter": "parameter_id int, scenario_id int, period string, distribution float",
    "data_language.domains": "domain_id int, uuid string, domain string, domain_description string",
    "data_language.data_assets": "data_asset_id int, uuid string, domain string, asset_name string, "
    "asset_description string, medallion_layer string, container string, feed_path string",
    "data_language.data_attributes": "data_attribute_id int, uuid string, attribute_name string, "
    "attribute_description string, attribute_type string, attribute_length int, external_source string",
    "data_language.data_asset_attributes": "data_asset_id int, data_attribute_id int, mandatory boolean, "
    "is_key boolean, default_value string, format_string string, valid_from date, valid_to date",
    "data_language.attribute_values": "data_attribute_id int, attribute_value string, attribute_value_label string, "
    "is_default boolean, valid_from date, valid_to date",
    "data_language.mappings": "map_id int, uuid string, map_name string, map_description string, from_asset_id int, "
    "to_asset_id int, trigger_message string, success_message string, fail_message string, target_attr_value_id int",
    "data_language.mapping_rule_groups": "rule_group_id int, uuid string, group_name string, "
    "group_name_description string, transformation_type string, default_value string",
    "data_language.mapping_rules": "rule_id int, uuid string, rule_group_id int, step_number int, rule_name string, "
    "rule_description string, rule_type string, target_attribute_id int, target_value string, "
    "target_attribute_value string, valid_from date, valid_to date",
    "data_language.mapping_rule_parts": "rule_id int, step_number int, comparison_operator string, "
    "feed_attribute_id int, feed_attribute_value string",
    "data_language.mapping_rule_assignments": "map_id int, rule_group_id int, rule_id int, step_number int",
    "data_language.data_tranformations": "data_trnsformation_id int, uuid string, domain string, map_id int",
}


def create_catalogue(spark: SparkSession, folder: str | None = None, overwrite: bool = False) -> list[str]:
    """Create the two schemas and their empty tables; ``folder`` places them outside the warehouse."""
    for schema in sorted({name.split(".")[0] for name in TABLES}):
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}")
    for name, columns in TABLES.items():
        if overwrite or not spark.catalog.tableExists(name):
            path = f"{folder}/{name.replace('.', '/')}" if folder else None
            create_table(spark, name, columns, path=path, overwrite=overwrite)
    return list(TABLES)


ASSET_COLUMNS = (
    "data_asset_id", "domain", "asset_name", "asset_description", "medallion_layer", "container", "feed_path",
)
ATTRIBUTE_COLUMNS = (
    "data_attribute_id", "attribute_name", "attribute_description", "attribute_type", "attribute_length", "external_source",
)
MAPPING_COLUMNS = ("map_id", "map_name", "map_description", "from_asset_id", "to_asset_id", "target_attr_value_id")
RULE_COLUMNS = (
    "rule_id", "rule_name", "rule_description", "rule_type", "target_attribute_id", "target_attribute_value",
    "valid_from", "valid_to",
)
PART_COLUMNS = ("rule_id", "step_number", "comparison_operator", "feed_attribute_id", "feed_attribute_value")


class Catalogue:
    """Queries over the catalogue tables. An argument left out means all rows instead of one key."""

    def __init__(self, tables: Mapping[str, DataFrame]):
        self.tables = dict(tables)

    @classmethod
    def of(cls, spark: SparkSession, schema: str = "data_language") -> Catalogue:
        return cls({n.split(".")[1]: spark.table(n) for n in TABLES if n.startswith(f"{schema}.")})

    def _read(self, table: str, columns, **keys) -> DataFrame:
        df = self.tables[table]
        for name, value in keys.items():
            if value is not None:
                df = df.filter(F.col(name) == F.lit(value))
        return df.select(*columns)

    def assets(self, data_asset_id=None) -> DataFrame:
        return self._read("data_assets", ASSET_COLUMNS, data_asset_id=data_asset_id)

    def attributes(self, data_attribute_id=None) -> DataFrame:
        return self._read("data_attributes", ATTRIBUTE_COLUMNS, data_attribute_id=data_attribute_id)

    def mappings(self, map_id=None) -> DataFrame:
        return self._read("mappings", MAPPING_COLUMNS, map_id=map_id)

    def rules(self, rule_id=None) -> DataFrame:
        return self._read("mapping_rules", RULE_COLUMNS, rule_id=rule_id)

    def parts(self, rule_id=None) -> DataFrame:
        """Parts of a rule in step order."""
        return self._read("mapping_rule_parts", PART_COLUMNS, rule_id=rule_id).orderBy("rule_id", "step_number")

    def asset_attributes(self, data_asset_id=None) -> DataFrame:
        bridge = self._read("data_asset_attributes", ("data_asset_id", "data_attribute_id"), data_asset_id=data_asset_id)
        return bridge.join(self.attributes(), "data_attribute_id").select("data_asset_id", *ATTRIBUTE_COLUMNS)

    def mapper_rules(self, map_id=None) -> DataFrame:
        """Rules assigned to a mapping."""
        assigned = self._read("mapping_rule_assignments", ("map_id", "rule_id"), map_id=map_id)
        return assigned.join(self.rules(), "rule_id").select("map_id", *RULE_COLUMNS)

    def lineage(self, map_name=None) -> DataFrame:
        """Source asset, target asset and rules of a mapping, in rule order."""
        named = self._read("mappings", ("map_id", "map_name", "from_asset_id", "to_asset_id"), map_name=map_name)
        asset = self.tables["data_assets"]
        sources = asset.select(F.col("data_asset_id").alias("from_asset_id"), F.col("asset_name").alias("from_asset_name"))
        targets = asset.select(F.col("data_asset_id").alias("to_asset_id"), F.col("asset_name").alias("to_asset_name"))
        assigned = self.tables["mapping_rule_assignments"].select(
            "map_id", "rule_id", F.col("step_number").alias("rule_priority")
        )
        rules = self.tables["mapping_rules"].select("rule_id", "rule_name", "rule_type", "target_attribute_id")
        attributes = self.tables["data_attributes"].select(
            F.col("data_attribute_id").alias("target_attribute_id"),
            F.col("attribute_name").alias("target_attribute_name"),
            F.col("attribute_type").alias("target_attribute_type"),
        )
        return (
            named.join(sources, "from_asset_id")
            .join(targets, "to_asset_id")
            .join(assigned, "map_id")
            .join(rules, "rule_id")
            .join(attributes, "target_attribute_id")
            .select(
                "map_name", "from_asset_id", "from_asset_name", "to_asset_id", "to_asset_name", "rule_priority",
                "rule_id", "rule_name", "rule_type", "target_attribute_name", "target_attribute_type",
            )
            .orderBy("map_name", "rule_priority")
        )

    def rule_parts(self, rule_id=None) -> DataFrame:
        """Parts of a rule with the attributes they read and the attribute the rule sets, in step order."""
        rules = self._read("mapping_rules", ("rule_id", "rule_name", "rule_type", "target_attribute_id"), rule_id=rule_id)
        parts = self.tables["mapping_rule_parts"].select(*PART_COLUMNS).withColumnRenamed("step_number", "rule_part_priority")

        def attributes(role: str, key: str) -> DataFrame:
            return self.tables["data_attributes"].select(
                F.col("data_attribute_id").alias(key),
                F.col("attribute_name").alias(f"{role}_attribute_name"),
                F.col("attribute_type").alias(f"{role}_attribute_type"),
            )

        return (
            parts.join(rules, "rule_id")
            .join(attributes("rule_part_", "feed_attribute_id"), "feed_attribute_id")
            .join(attributes("target", "target_attribute_id"), "target_attribute_id")
            .select(
                "rule_id", "rule_name", "rule_type", "rule_part_priority", "comparison_operator",
                "target_attribute_name", "target_attribute_type",
                "rule_part__attribute_name", "rule_part__attribute_type", "feed_attribute_value",
            )
            .orderBy("rule_id", "rule_part_priority")
        )
