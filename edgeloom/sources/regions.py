"""Libraries of regions and market zones from tables of their codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import LEVELS, iso_country, parent_region, region_id
from ..model import Model
from .networks import Parts


def region_rows(codes: DataFrame) -> DataFrame:
    """entity_id, level, name, long_name, code, iso and parent of regions (NUTS_ID, LEVL_CODE, CNTR_CODE, NAME_LATN)."""
    level, code = F.col("LEVL_CODE").cast("int"), F.col("NUTS_ID")
    name = F.when(level == 0, iso_country(F.col("CNTR_CODE"))).otherwise(code)
    rows = codes.where(level.between(0, 3))
    return rows.select(region_id(level, code).alias("entity_id"), F.get(F.array(*map(F.lit, LEVELS)), level).alias("region_level"), name.alias("name"), F.coalesce("NAME_LATN", code).alias("long_name"), F.when(level == 0, F.col("CNTR_CODE")).otherwise(code).alias("nuts_code"), iso_country(F.col("CNTR_CODE")).alias("iso_country_code"), parent_region(level, code).alias("parent"))


def regions(m: Model, codes: DataFrame) -> Model:
    parts = Parts()
    parts.add(region_rows(codes), "GeographicalRegion", ["name", "long_name", "region_level", "nuts_code", "iso_country_code"], {"isSubRegionOf": "parent"})
    return parts.into(m)


def market_zones(m: Model, zones: DataFrame) -> Model:
    """Zones (code, long_name, countries) with the country regions that the model has among those they cover."""
    parts = Parts()
    rows = zones.select(F.concat(F.lit("market_zone."), "code").alias("entity_id"), F.col("code").alias("name"), "long_name", F.col("code").alias("market_zone_code"), F.lit("carrier.electricity").alias("carrier"))
    parts.add(rows, "MarketZone", ["name", "long_name", "market_zone_code"], {"hasCarrier": "carrier"})
    known = m.entity.where("entity_class = 'GeographicalRegion'").select(F.col("entity_id").alias("region"))
    covered = zones.select(F.concat(F.lit("market_zone."), "code").alias("entity_id"), F.explode("countries").alias("iso")).withColumn("region", F.concat(F.lit("region.country."), "iso")).join(known, "region", "left_semi")
    parts.add(covered, "MarketZone", [], {"coversRegion": "region"})
    return parts.into(m)
