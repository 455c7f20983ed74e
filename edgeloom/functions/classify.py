"""Classes of technologies, carriers and regions by what their names hold, as column expressions.

What a name means is data: ordered tables of (pattern, result), of which the first pattern that a name holds decides.
One function reads them all. Names are looked at in lower case with `_` for the signs between their parts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of the naming convention, as regular expressions.
RIVER = r"run_of_river|runofriver|_ror|ror\z"
PUMPED = r"phs|pumped|pump_?storage|pump_hydro|open_loop|closed_loop"
HYDROGEN = "hydrogen|h2"
#: Kind of the water body of a hydro technology.
STORAGE = [(RIVER, "run_of_river"), ("closed_?loop", "phs_closed_loop"), ("open_?loop", "phs_open_loop"), (PUMPED, "phs_closed_loop"), ("pondage", "pondage"), ("reservoir|dam", "reservoir"), ("", "hydro")]
#: Kind of its machine, as far as the name tells.
MACHINE = [(f"reversible|{PUMPED}", "reversible"), (r"pump_only|_pump\z|\Apump\z", "pump")]
#: Class of a generator. Hydrogen holds the word hydro, so it comes first.
ASSET = [(HYDROGEN, "GenerationUnit"), ("hydro|run_of_river|runofriver|reservoir|pondage|pump(ed)?_storage|phs", "HydroGenerationUnit"), ("", "GenerationUnit")]
#: Efficiency of generators on hydrogen that give none.
EFFICIENCY = [("fuel_?cell", 0.55), ("ccgt|combined_cycle", 0.58)]
#: Domain of a carrier's id.
DOMAIN = [
    (r"\Acarrier\.electricity\z", "electricity"), (r"fossil\.gas", "gas"), (r"fossil\.coal", "coal"), (r"fossil\.oil", "oil"), ("nuclear", "nuclear"), ("biofuel", "biofuel"),
    ("renewable", "electricity"), ("water", "water"), ("hydrogen", "hydrogen"), ("heat", "heat"),
]
#: What holds of a technology: it must have the first pattern and must not have the second.
FACTS = {
    "pumped": (PUMPED, None),
    "stored": (f"reservoir|dam|pondage|{PUMPED}", RIVER),
    "natural_inflow": (f"reservoir|pondage|open_?loop|{RIVER}", "closed_?loop"),
}
#: Words of generators that cannot be dispatched.
VARIABLE = "wind|solar|pv|ror|run_of_river"
#: Country codes of regions that differ from ISO.
ISO = {"EL": "GR", "UK": "GB"}
LEVELS = ("country", "nuts1", "nuts2", "nuts3")


def token(name: Column, signs: str = "-./") -> Column:
    """The name in lower case with `_` for each of the signs; an empty one for null."""
    return F.translate(F.lower(F.trim(F.coalesce(name.cast("string"), F.lit("")))), signs, "_" * len(signs))


def generator_token(carrier: Column, technology: Column) -> Column:
    return F.concat_ws("_", token(carrier, " -./"), token(technology, " -./"))


def decided(name: Column, table: list[tuple[str, object]]) -> Column:
    """The result of the first pattern of the table that the name holds, else null."""
    return reduce(lambda chain, row: chain.when(name.rlike(row[0]), row[1]), table[1:], F.when(name.rlike(table[0][0]), table[0][1]))


def fact(which: str, technology: Column) -> Column:
    """Whether one of the FACTS holds of a technology."""
    has, bars = FACTS[which]
    name = token(technology)
    return name.rlike(has) if bars is None else name.rlike(has) & ~name.rlike(bars)


def storage_kind(technology: Column) -> Column:
    return decided(token(technology), STORAGE)


def machine_kind(technology: Column, reversible: Column | None = None, pumping: Column | None = None, generation: Column | None = None) -> Column:
    """reversible, pump or turbine: by the technology, else by what else is known of the machine. One that pumps is
    reversible if it generates too."""
    yes = lambda c: F.lit(False) if c is None else F.coalesce(c.cast("double") > 0, F.lit(False))
    known = F.when(yes(reversible) | (yes(pumping) & yes(generation)), "reversible").when(yes(pumping), "pump")
    return F.coalesce(decided(token(technology), MACHINE), known, F.lit("turbine"))


def asset_class(carrier: Column, technology: Column) -> Column:
    return decided(generator_token(carrier, technology), ASSET)


def is_variable(carrier: Column, technology: Column) -> Column:
    return token(carrier, " -").rlike(VARIABLE) | token(technology, " -").rlike(VARIABLE)


def efficiency(carrier: Column, technology: Column, raw: Column) -> Column:
    """The given efficiency, 1 where it is no finite positive number; a generator on hydrogen that would have 1 has the
    one of its kind (EFFICIENCY)."""
    x, name = raw.try_cast("double"), generator_token(carrier, technology)
    usable = F.coalesce(x.between(5e-324, 1.7976931348623157e308), F.lit(False))
    given = F.when(usable, x).otherwise(1.0)
    return F.when(name.rlike(HYDROGEN) & (F.abs(given - 1) < 1e-12), F.coalesce(decided(name, EFFICIENCY), given)).otherwise(given)


def carrier_id(name: Column, known: dict[str, str]) -> Column:
    """The id of a carrier's name: by the given table (names in lower case), else `carrier.` and the name in dots."""
    low = F.lower(F.trim(name))
    slug = F.concat(F.lit("carrier."), F.btrim(F.regexp_replace(low, "[^a-z0-9]+", "."), F.lit(".")))
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair)) if known else None
    return slug if table is None else F.coalesce(F.try_element_at(table, low), slug)


def domain_id(carrier: Column) -> Column:
    """By the table, else the first part of the id behind `carrier.`."""
    return F.concat(F.lit("domain."), F.coalesce(decided(carrier, DOMAIN), F.split_part(F.replace(carrier, F.lit("carrier."), F.lit("")), F.lit("."), F.lit(1))))


def region_parts(region: Column) -> tuple[Column, Column]:
    """Level and code of a region's id (`region.<level>.<code>` or `<level>.<code>`), both empty for other ids."""
    part = lambda k: F.regexp_extract(region, r"(?i)\A(?:region\.)?(country|nuts\d?)\.(.*)\z", k)
    return F.lower(part(1)), part(2)


def region_country(region: Column) -> Column:
    """The country code of a region's id, or null."""
    level, code = region_parts(region)
    return F.when(level == "country", F.upper(code)).when(level != "", F.upper(F.left(code, F.lit(2))))


def region_nuts3(region: Column) -> Column:
    """The code of a region of that level in lower case, or null."""
    level, code = region_parts(region)
    return F.when((level == "nuts3") & (code != ""), F.lower(code))


def asset_region_key(bus: Column, split_voltage: bool, identity: Column) -> tuple[Column, Column]:
    """Region token and voltage suffix in the id of what is merged at a bus `node.<region>.<kv>`; a bus that is kept as
    it is (`identity`) gives all that follows `node.`, so that no two share a name."""
    parts = F.split(bus, r"\.")
    tag = F.btrim(F.regexp_replace(F.lower(bus), "[^a-z0-9]+", "."), F.lit("."))
    whole = F.when(bus.startswith("node."), F.regexp_replace(bus, r"^node\.", "")).otherwise(tag)
    suffix = F.when((F.size(parts) >= 3) & F.lit(split_voltage), F.concat(F.lit("."), F.get(parts, F.lit(2)))).otherwise("")
    return F.when(identity, whole).otherwise(F.coalesce(F.get(parts, F.lit(1)), tag)), F.when(identity, "").otherwise(suffix)


def iso_country(code: Column) -> Column:
    """The ISO code of a region code's first two letters."""
    two = F.upper(F.left(code, F.lit(2)))
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in ISO.items() for x in pair)), two), two)


def region_id(level: Column, code: Column) -> Column:
    name = F.get(F.array(*map(F.lit, LEVELS)), level)
    return F.concat(F.lit("region."), name, F.lit("."), F.when(level == 0, iso_country(code)).otherwise(code))


def parent_region(level: Column, code: Column) -> Column:
    """The region one level up, null for a country."""
    return F.when(level == 1, region_id(F.lit(0), code)).when(level > 1, region_id(level - 1, F.left(code, F.length(code) - 1)))


def default_type(labels: list[Column], types: dict[str, str]) -> Column:
    """The library type of the first label that the table knows: by its whole key, else by the longest key inside it."""
    key = lambda c: F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))
    table = F.create_map(*(F.lit(x) for pair in types.items() for x in pair))
    order = sorted(types, key=len, reverse=True)
    parts = [x for c in labels for x in (F.try_element_at(table, key(c)), *(F.when(key(c).contains(k), types[k]) for k in order))]
    return F.coalesce(*parts)
