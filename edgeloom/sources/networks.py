"""Grids as component tables (buses, lines, transformers, loads, generators, storage) into a model and back.

Each function takes DataFrames with the columns of the tools' own tables; what a table lacks counts as its default. No
package of those tools is needed: tables come from CSV, Parquet or a catalogue.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import asset_class, fact, is_variable, machine_kind
from ..functions.numbers import nf_to_us, rating_mva
from ..functions.text import underscored
from ..model import ATTRIBUTE, RELATION, Model, attribute_rows, relation_rows
from ..operators.navigation import asset_nodes, branch_ends, entities, first_target, wide
from .readers import read_rows

ELECTRICITY = "carrier.electricity"
#: Fixed names of the component tables that bear carriers.
CARRIER_TABLES = ("generators", "storage_units", "stores", "loads", "links")
#: Columns of the matrices of a MATPOWER case, in order.
BUS = ("number", "type", "pd", "qd", "gs", "bs", "area", "vm", "va", "base_kv", "zone", "vmax", "vmin")
GEN = ("bus", "pg", "qg", "qmax", "qmin", "vg", "mbase", "status", "pmax", "pmin")
BRANCH = ("from_bus", "to_bus", "r", "x", "b", "rate_a", "rate_b", "rate_c", "ratio", "angle", "status")
SLACK, PV, PQ = 3, 2, 1


def column(rows: DataFrame, name: str, default: object = None) -> Column:
    """A column, with the default for nulls and where the table has none."""
    c = F.col(f"`{name}`") if name in rows.columns else F.lit(None)
    return c if default is None else F.coalesce(c, F.lit(default))


def _number(rows: DataFrame, name: str, default: float | None = None) -> Column:
    return column(rows, name, default).cast("double")


class Parts:
    """Entities, values and relations of a model that is being put together."""

    def __init__(self) -> None:
        self.ids: list[DataFrame] = []
        self.values: list[DataFrame] = []
        self.edges: list[DataFrame] = []

    def add(self, rows: DataFrame, entity_class: str, attributes: list[str], relations: dict[str, str], order: str = "seq") -> None:
        """`rows` with `entity_id`; the named columns become values, those of `relations` (relation -> column) targets."""
        rows = rows.where("entity_id IS NOT NULL")
        self.ids.append(rows.select(F.lit(entity_class).alias("entity_class"), "entity_id", (F.col(order) if order in rows.columns else F.lit(0)).cast("long").alias("seq")))
        if attributes:
            self.values.append(attribute_rows(rows, entity_class, F.col("entity_id"), {a: a for a in attributes}))
        self.edges += [relation_rows(rows, entity_class, F.col("entity_id"), r, F.col(c)) for r, c in relations.items()]

    def unknown(self, m: Model) -> DataFrame:
        """entity_class, field_id, n: how many values and targets were there for fields that the class does not have."""
        known = m.field_def.select(F.col("class_name").alias("entity_class"), "field_id")
        rows = [v.select("entity_class", F.col("attribute_id").alias("field_id")) for v in self.values] + [e.select("entity_class", F.col("relation_id").alias("field_id")) for e in self.edges]
        if not rows:
            return m.spark.createDataFrame([], "entity_class string, field_id string, n long")
        counts = reduce(DataFrame.union, rows).groupBy("entity_class", "field_id").agg(F.count("*").alias("n"))
        return counts.join(F.broadcast(known), ["entity_class", "field_id"], "left_anti")

    def into(self, m: Model) -> Model:
        """With the attributes and relations that the classes of the schema know; `unknown` counts the others."""
        known = m.field_def.select(F.col("class_name").alias("entity_class"), F.col("field_id"), "kind")
        of = lambda kind, name: F.broadcast(known.where(F.col("kind") == kind).select("entity_class", F.col("field_id").alias(name)))
        union = lambda parts, schema: reduce(DataFrame.unionByName, parts) if parts else m.spark.createDataFrame([], schema)
        values = union(self.values, ATTRIBUTE).join(of("attribute", "attribute_id"), ["entity_class", "attribute_id"], "left_semi")
        edges = union(self.edges, RELATION).join(of("relation", "relation_id"), ["entity_class", "relation_id"], "left_semi")
        return read_rows(m, union(self.ids, "entity_class string, entity_id string, seq long"), values, edges)


def _pp(kind: str, index: Column) -> Column:
    return F.concat(F.lit(f"pp.{kind}."), index.cast("string"))


def from_pandapower(m: Model, tables: dict[str, DataFrame], region: str = "region.default", hertz: float = 50.0) -> Model:
    """bus, load, shunt, gen, sgen, ext_grid, line and trafo tables (with `index`) as a model. What is out of service,
    or stands at a bus that is, is left out."""
    bus = tables["bus"].where(column(tables["bus"], "in_service", True))
    place = tables.get("bus_geodata")
    rows = bus.select("index", _pp("bus", F.col("index")).alias("entity_id"), F.col("index").alias("seq"), column(bus, "name").cast("string").alias("name"), _number(bus, "vn_kv").alias("nominal_voltage"), F.lit(region).alias("region"), F.lit("domain.electricity").alias("domain"))
    if place is not None:
        rows = rows.join(place.select("index", F.col("x").cast("double").alias("longitude"), F.col("y").cast("double").alias("latitude")), "index", "left")
    live = bus.select(F.col("index").alias("bus"), _number(bus, "vn_kv").alias("kv"))
    parts = Parts()

    def standing(name: str) -> DataFrame | None:
        """The rows of a table that are in service at a live bus, with its voltage."""
        t = tables.get(name)
        return None if t is None else t.where(column(t, "in_service", True)).join(live, "bus").withColumn("seq", F.col("index"))

    generators = []
    for kind, flow in (("gen", "PV"), ("sgen", "PQ"), ("ext_grid", "slack")):
        t = standing(kind)
        if t is None:
            continue
        p, top = _number(t, "p_mw", 0.0), _number(t, "max_p_mw")
        nominal = F.coalesce(top, F.abs(p))
        generators.append(t.select(
            _pp(kind, F.col("index")).alias("entity_id"), "seq", "bus", F.lit(flow).alias("flow"), _pp("bus", F.col("bus")).alias("node"), column(t, "name").cast("string").alias("name"),
            F.when(nominal > 0, nominal).alias("nominal_power_capacity"), p.alias("active_power_setpoint"), _number(t, "q_mvar", 0.0).alias("reactive_power_setpoint"), _number(t, "max_q_mvar").alias("maximum_reactive_power_output"),
            _number(t, "min_q_mvar").alias("minimum_reactive_power_output"), _number(t, "vm_pu", 1.0).alias("voltage_magnitude_setpoint"), top.alias("maximum_power_output"), _number(t, "min_p_mw").alias("minimum_power_output"),
            F.lit("Generation.ExternalGrid" if kind == "ext_grid" else "Generation.Generic.Pandapower").alias("technology"), F.lit(ELECTRICITY).alias("carrier"),
        ))
    if generators:
        all_ = reduce(DataFrame.unionByName, generators)
        rank = F.when(F.col("flow") == "slack", 2).when(F.col("flow") == "PQ", 1).otherwise(0)  # the table that is read last decides
        rows = rows.join(all_.groupBy(F.col("bus").alias("index")).agg(F.max_by("flow", rank).alias("powerflow_bus_type")), "index", "left")
        values = ["name", "nominal_power_capacity", "active_power_setpoint", "reactive_power_setpoint", "maximum_reactive_power_output", "minimum_reactive_power_output", "voltage_magnitude_setpoint", "maximum_power_output", "minimum_power_output"]
        parts.add(all_, "GenerationUnit", values, {"atNode": "node", "hasTechnology": "technology", "hasOutputCarrier": "carrier"})
    parts.add(rows, "ElectricalBus", [c for c in ("name", "nominal_voltage", "longitude", "latitude", "powerflow_bus_type") if c in rows.columns], {"belongsToGeographicalRegion": "region", "belongsToCarrierDomain": "domain"})
    if (t := standing("load")) is not None:
        rows = t.select(_pp("load", F.col("index")).alias("entity_id"), "seq", _pp("bus", F.col("bus")).alias("node"), column(t, "name").cast("string").alias("name"), _number(t, "p_mw", 0.0).alias("active_power_demand"), _number(t, "q_mvar", 0.0).alias("reactive_power_demand"), F.lit(ELECTRICITY).alias("carrier"))
        parts.add(rows, "DemandUnit", ["name", "active_power_demand", "reactive_power_demand"], {"atNode": "node", "hasInputCarrier": "carrier"})
    if (t := standing("shunt")) is not None:
        rows = t.select(_pp("shunt", F.col("index")).alias("entity_id"), "seq", _pp("bus", F.col("bus")).alias("node"), column(t, "name").cast("string").alias("name"), _number(t, "p_mw", 0.0).alias("active_power_injection"), (-_number(t, "q_mvar", 0.0)).alias("reactive_power_injection"))
        parts.add(rows, "ShuntUnit", ["name", "active_power_injection", "reactive_power_injection"], {"atNode": "node"})

    def between(name: str, a: str, b: str) -> DataFrame | None:
        t = tables.get(name)
        if t is None:
            return None
        t = t.where(column(t, "in_service", True)).join(live.toDF(a, "kv"), a).join(live.select(F.col("bus").alias(b)), b)
        return t.withColumns({"entity_id": _pp(name, F.col("index")), "seq": F.col("index"), "from_node": _pp("bus", F.col(a)), "to_node": _pp("bus", F.col(b)), "name": column(t, "name").cast("string")})

    if (t := between("line", "from_bus", "to_bus")) is not None:
        rows = t.select("entity_id", "seq", "from_node", "to_node", "name", _number(t, "length_km").alias("line_length"), _number(t, "r_ohm_per_km").alias("series_resistance_per_km"), _number(t, "x_ohm_per_km").alias("series_reactance_per_km"), nf_to_us(_number(t, "c_nf_per_km", 0.0), hertz).alias("shunt_susceptance_per_km"), _number(t, "parallel").alias("parallel_circuit_count"), rating_mva(F.col("kv"), _number(t, "max_i_ka")).alias("thermal_capacity_rating"), F.lit("physical").alias("line_parameter_basis"))
        parts.add(rows, "TransmissionLine", [c for c in rows.columns if c not in ("entity_id", "seq", "from_node", "to_node")], {"fromNode": "from_node", "toNode": "to_node"})
    if (t := between("trafo", "hv_bus", "lv_bus")) is not None:
        mva, kv, vk, vkr = _number(t, "sn_mva", 0.0), _number(t, "vn_hv_kv", 0.0), _number(t, "vk_percent", 0.0), _number(t, "vkr_percent", 0.0)
        z = F.when((mva > 0) & (kv > 0), kv * kv / F.nullif(mva, F.lit(0.0))).otherwise(1.0)
        x = F.sqrt(F.greatest((vk / 100) * (vk / 100) - (vkr / 100) * (vkr / 100), F.lit(0.0))) * z
        tap = 1 + _number(t, "tap_pos", 0.0) * _number(t, "tap_step_percent", 0.0) / 100
        rows = t.select("entity_id", "seq", "from_node", "to_node", "name", F.lit(1.0).alias("line_length"), (vkr / 100 * z).alias("series_resistance_per_km"), x.alias("series_reactance_per_km"), F.lit(0.0).alias("shunt_susceptance_per_km"), mva.alias("thermal_capacity_rating"), kv.alias("rated_primary_voltage"), _number(t, "vn_lv_kv", 0.0).alias("rated_secondary_voltage"), vk.alias("short_circuit_voltage_in_percentage"), tap.alias("tap_ratio"), _number(t, "shift_degree", 0.0).alias("phase_shift_angle"), F.lit("physical").alias("line_parameter_basis"))
        parts.add(rows, "Transformer", [c for c in rows.columns if c not in ("entity_id", "seq", "from_node", "to_node")], {"fromNode": "from_node", "toNode": "to_node"})
    return parts.into(m)


def to_pandapower(m: Model, hertz: float = 50.0) -> dict[str, DataFrame]:
    """Component tables of a model: bus, load, gen, line and trafo, indexed by rank of the entity's id."""
    indexed = lambda rows: rows.join(_numbers(rows.select("entity_id")), "entity_id")
    bus = indexed(wide(m, "ElectricalBus", ["nominal_voltage"]))
    names = wide(m, "ElectricalBus", ["name"], number=False).select("entity_id", "name")
    numbers = bus.select(F.col("entity_id").alias("node"), F.col("index").alias("bus"))
    at = asset_nodes(m).join(numbers, "node").select("entity_id", "bus")
    ends = branch_ends(m).join(numbers.toDF("from_node", "a"), "from_node").join(numbers.toDF("to_node", "b"), "to_node").select("entity_id", "a", "b")
    load = indexed(wide(m, "DemandUnit", ["active_power_demand", "reactive_power_demand"]).join(at, "entity_id"))
    gen = indexed(wide(m, "GenerationUnit", ["active_power_setpoint", "voltage_magnitude_setpoint", "maximum_power_output", "minimum_power_output", "nominal_power_capacity"]).join(at, "entity_id"))
    fields = ["line_length", "series_resistance_per_km", "series_reactance_per_km", "shunt_susceptance_per_km", "parallel_circuit_count", "thermal_capacity_rating"]
    line = indexed(wide(m, "TransmissionLine", fields).join(ends, "entity_id")).join(bus.select(F.col("index").alias("a"), F.col("nominal_voltage").alias("kv")), "a")
    trafo = indexed(wide(m, "Transformer", ["thermal_capacity_rating", "rated_primary_voltage", "rated_secondary_voltage", "short_circuit_voltage_in_percentage", "series_resistance_per_km", "phase_shift_angle"]).join(ends, "entity_id"))
    z = F.col("rated_primary_voltage") * F.col("rated_primary_voltage") / F.nullif("thermal_capacity_rating", F.lit(0.0))
    farad = nf_to_us(F.lit(1.0), hertz)
    return {
        "bus": bus.join(names, "entity_id", "left").select("index", F.coalesce("name", "entity_id").alias("name"), F.col("nominal_voltage").alias("vn_kv"), F.lit(True).alias("in_service")),
        "load": load.select("index", "bus", F.coalesce("active_power_demand", F.lit(0.0)).alias("p_mw"), F.coalesce("reactive_power_demand", F.lit(0.0)).alias("q_mvar")),
        "gen": gen.select("index", "bus", F.coalesce("active_power_setpoint", F.lit(0.0)).alias("p_mw"), F.coalesce("voltage_magnitude_setpoint", F.lit(1.0)).alias("vm_pu"), F.coalesce("maximum_power_output", "nominal_power_capacity").alias("max_p_mw"), F.col("minimum_power_output").alias("min_p_mw")),
        "line": line.select("index", F.col("a").alias("from_bus"), F.col("b").alias("to_bus"), F.coalesce("line_length", F.lit(1.0)).alias("length_km"), F.col("series_resistance_per_km").alias("r_ohm_per_km"), F.col("series_reactance_per_km").alias("x_ohm_per_km"), (F.coalesce("shunt_susceptance_per_km", F.lit(0.0)) / farad).alias("c_nf_per_km"), F.coalesce("parallel_circuit_count", F.lit(1.0)).cast("int").alias("parallel"), (F.col("thermal_capacity_rating") / rating_mva(F.col("kv"), F.lit(1.0))).alias("max_i_ka")),
        "trafo": trafo.select("index", F.col("a").alias("hv_bus"), F.col("b").alias("lv_bus"), F.col("thermal_capacity_rating").alias("sn_mva"), F.col("rated_primary_voltage").alias("vn_hv_kv"), F.col("rated_secondary_voltage").alias("vn_lv_kv"), F.col("short_circuit_voltage_in_percentage").alias("vk_percent"), (F.col("series_resistance_per_km") / z * 100).alias("vkr_percent"), F.coalesce("phase_shift_angle", F.lit(0.0)).alias("shift_degree")),
    }


def _numbers(ids: DataFrame) -> DataFrame:
    """entity_id and index from 0 in the order of ids, without one task that sees all: ids are sorted in ranges, ranges
    are counted, and a row's number is its place plus the count of the ranges before."""
    from ..lineage import cut

    ranged = cut(ids.distinct().repartitionByRange("entity_id").sortWithinPartitions("entity_id").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.alias("x").join(sizes.alias("y"), F.col("y.part") < F.col("x.part"), "left").groupBy(F.col("x.part").alias("part")).agg(F.coalesce(F.sum("y.n"), F.lit(0)).alias("before"))  # partitions, not rows
    return ranged.join(F.broadcast(before), "part").select("entity_id", (F.col("at") + F.col("before")).alias("index"))


def carriers_of(tables: dict[str, DataFrame]) -> DataFrame:
    """The distinct carriers that the component tables and the table of carriers name."""
    parts = [tables[t].select(F.col("carrier").cast("string").alias("carrier")) for t in CARRIER_TABLES if t in tables and "carrier" in tables[t].columns]
    if "carriers" in tables:
        parts.append(tables["carriers"].select(F.col("name").cast("string").alias("carrier")))
    return reduce(DataFrame.union, parts).where("carrier IS NOT NULL AND carrier <> ''").distinct()


def usable_generators(generators: DataFrame, series: DataFrame | None = None) -> DataFrame:
    """Without the variable ones that can never give anything: without capacity, or with a series (name, t, value) that
    is nowhere positive, or without a series and with a p_max_pu of 0 or less."""
    variable = is_variable(column(generators, "carrier"), column(generators, "type"))
    rows = generators
    positive = F.coalesce(_number(generators, "p_max_pu", 1.0) > 0, F.lit(True))
    if series is not None:
        best = series.groupBy("name").agg(F.max(F.coalesce("value", F.lit(0.0))).alias("best"))
        rows, positive = rows.join(best, "name", "left"), F.coalesce(F.col("best") > 0, positive)
    capable = F.coalesce(_number(generators, "p_nom", 0.0) > 0, F.lit(False)) & positive
    return rows.where(~variable | capable).select(*generators.columns)


def _id(kind: str, c: str = "name") -> Column:
    return F.concat(F.lit(f"{kind}."), underscored(F.col(c).cast("string")))


def _inflows(inflows: DataFrame | None, m: Model) -> DataFrame:
    """name and inflow, the sum of a series (name, t, value) with steps of an hour, where it is positive."""
    if inflows is None:
        return m.spark.createDataFrame([], "name string, inflow double")
    return inflows.groupBy(F.col("name").cast("string").alias("name")).agg(F.sum("value").alias("inflow")).where("inflow > 0")


def _stores(m: Model, t: DataFrame, inflows: DataFrame | None) -> DataFrame:
    """stores with hydro, pumped, inflow and `left`, why one does not come into the model: a reservoir that nothing flows
    into and that is not pumped stands for nothing."""
    carrier = F.lower(F.coalesce(column(t, "carrier").cast("string"), F.lit("")))
    has = lambda *words: reduce(lambda a, b: a | b, (carrier.contains(w) for w in words))
    pumped = has("pumped", "phs", "pump_storage")
    rows = t.withColumn("name", F.col("name").cast("string")).join(_inflows(inflows, m), "name", "left")
    rows = rows.withColumns({"pumped": pumped, "hydro": pumped | has("reservoir", "pondage", "dam", "hydro")})
    return rows.withColumn("left", F.when(F.col("hydro") & ~F.col("pumped") & F.col("inflow").isNull(), "reservoir without inflow"))


def _links(t: DataFrame, buses: DataFrame) -> DataFrame:
    """links with the carriers of their buses (a, b) and `left`, why one does not come into the model."""
    at = buses.select(F.col("name").cast("string").alias("bus"), F.coalesce(column(buses, "carrier").cast("string"), F.lit("AC")).alias("c"))
    end = lambda rows, bus, c: rows.join(at.toDF("there", c), F.col(bus).cast("string") == F.col("there"), "left").drop("there")
    rows = end(end(t, "bus0", "a"), "bus1", "b")
    return rows.withColumn("left", F.when(F.col("a").isNull() | F.col("b").isNull(), "unknown bus"))


def _add_stores(parts: Parts, rows: DataFrame) -> None:
    carrier = column(rows, "carrier").cast("string")
    rows = rows.where("left IS NULL").select(_id("store").alias("entity_id"), "name", _id("node", "bus").alias("node"), carrier.alias("storage_technology_type"), _number(rows, "e_nom").alias("energy_storage_capacity"), F.col("inflow").alias("annual_natural_inflow_energy"), "hydro", "pumped", F.when(F.col("pumped"), "true").alias("has_active_charging"), F.concat(F.lit("carrier."), underscored(carrier)).alias("carrier"))
    rows = rows.withColumn("profile", F.when(F.col("hydro") & F.col("annual_natural_inflow_energy").isNotNull(), F.concat(F.lit("profile.inflow."), "entity_id")))
    parts.add(rows.where("NOT hydro"), "StorageUnit", ["name", "energy_storage_capacity", "storage_technology_type"], {"atNode": "node", "storesCarrier": "carrier"})
    water = rows.where("hydro").withColumn("resource", F.lit("resource.water"))
    parts.add(water, "HydraulicStorageUnit", ["name", "energy_storage_capacity", "annual_natural_inflow_energy", "storage_technology_type", "has_active_charging"], {"storesResource": "resource", "hasNaturalInflowProfile": "profile"})
    unit = water.select(F.concat(F.lit("hydro."), "entity_id").alias("entity_id"), "node", F.col("entity_id").alias("reservoir"), F.lit("dispatchable").alias("dispatch_type"), F.when(F.col("pumped"), "reversible").otherwise("turbine").alias("hydro_machine_kind"), F.lit(ELECTRICITY).alias("carrier"))
    parts.add(unit, "HydroGenerationUnit", ["dispatch_type", "hydro_machine_kind"], {"atNode": "node", "drawsFromHydraulicStorage": "reservoir", "hasOutputCarrier": "carrier"})
    parts.add(rows.where("profile IS NOT NULL").select(F.col("profile").alias("entity_id"), F.lit("as_normalized_annual_energy").alias("profile_kind")), "Profile", ["profile_kind"], {})


def _add_links(parts: Parts, rows: DataFrame, buses: DataFrame) -> None:
    """Between buses of one carrier a link is a line of direct current; between two it is a converter, with a port for its
    input and one for each of up to three outputs."""
    rows = rows.where("left IS NULL")
    cost, same = _number(rows, "marginal_cost").alias("variable_operating_cost"), F.col("a") == F.col("b")
    lines = rows.where(same).select(_id("link").alias("entity_id"), F.col("name").cast("string").alias("name"), _id("node", "bus0").alias("from"), _id("node", "bus1").alias("to"), (_number(rows, "p_nom") * F.coalesce(F.nullif(_number(rows, "p_max_pu"), F.lit(0.0)), F.lit(1.0))).alias("max_flow"), cost)
    parts.add(lines, "HVDCLink", ["name", "max_flow", "variable_operating_cost"], {"fromNode": "from", "toNode": "to"})
    rows = rows.where(~same)
    unit = _id("converter")
    port = lambda k: F.concat(F.lit("port."), unit, F.lit(f".{k}"))
    made = rows.select(unit.alias("entity_id"), F.col("name").cast("string").alias("name"), _number(rows, "p_nom").alias("nominal_power_capacity"), cost, port("input").alias("input"))
    parts.add(made, "GenericConversionUnit", ["name", "nominal_power_capacity", "variable_operating_cost"], {"referencePort": "input"})
    output = lambda k, efficiency: F.struct(port(f"output{k}").alias("entity_id"), F.lit("output").alias("port_direction"), efficiency.alias("flow_coefficient"), F.nullif(column(rows, f"bus{k}").cast("string"), F.lit("")).alias("bus"))
    ports = F.array(
        F.struct(port("input").alias("entity_id"), F.lit("input").alias("port_direction"), F.lit(-1.0).alias("flow_coefficient"), F.col("bus0").cast("string").alias("bus")),
        output(1, F.coalesce(F.nullif(_number(rows, "efficiency"), F.lit(0.0)), F.lit(1.0))), *(output(k, _number(rows, f"efficiency{k}", 0.0)) for k in (2, 3)),
    )
    known = buses.select(F.col("name").cast("string").alias("bus"), F.concat(F.lit("carrier."), underscored(F.coalesce(column(buses, "carrier").cast("string"), F.lit("AC")))).alias("carrier"))
    ports = rows.select(unit.alias("unit"), F.explode(ports).alias("p")).select("unit", "p.*").join(known, "bus").withColumn("node", _id("node", "bus"))
    parts.add(ports, "ConversionPort", ["port_direction", "flow_coefficient"], {"belongsToUnit": "unit", "atNode": "node", "hasCarrier": "carrier"})


def left_out(m: Model, tables: dict[str, DataFrame], series: DataFrame | None = None, inflows: DataFrame | None = None) -> DataFrame:
    """component, name, reason: the rows of the component tables that from_components makes no entity of."""
    parts = [m.spark.createDataFrame([], "component string, name string, reason string")]
    row = lambda rows, component, reason: rows.select(F.lit(component).alias("component"), F.col("name").cast("string").alias("name"), reason.alias("reason"))
    if (t := tables.get("generators")) is not None:
        parts.append(row(t.join(usable_generators(t, series).select("name"), "name", "left_anti"), "generators", F.lit("never gives anything")))
    if (t := tables.get("stores")) is not None:
        parts.append(row(_stores(m, t, inflows).where("left IS NOT NULL"), "stores", F.col("left")))
    if (t := tables.get("links")) is not None:
        parts.append(row(_links(t, tables["buses"]).where("left IS NOT NULL"), "links", F.col("left")))
    return reduce(DataFrame.union, parts)


def from_components(m: Model, tables: dict[str, DataFrame], series: DataFrame | None = None, inflows: DataFrame | None = None) -> Model:
    """buses, lines, transformers, loads, generators, storage_units, stores and links (with `name`) as a model; `series`
    (name, t, value) are what generators can give, `inflows` those of stores, which become normalised profiles. Variable
    generators without capacity or series, reservoirs without inflow and links to no bus are left out, and `left_out`
    lists them; hydro storage becomes a reservoir with a generator that draws from it. Fields that the schema does not
    have are counted by component_parts(...).unknown(m)."""
    out = component_parts(m, tables, series, inflows).into(m)
    if inflows is None or "stores" not in tables:
        return out
    kept = _stores(m, tables["stores"], inflows).where("hydro AND left IS NULL AND inflow IS NOT NULL")
    rows = kept.select("name", "inflow", F.concat(F.lit("profile.inflow."), _id("store")).alias("profile_id"))
    values = inflows.withColumn("name", F.col("name").cast("string")).join(rows, "name").select("profile_id", F.col("t").cast("int").alias("t"), (F.col("value") / F.col("inflow")).alias("value"))
    return out.but(profile_value=out.profile_value.unionByName(values))


def component_parts(m: Model, tables: dict[str, DataFrame], series: DataFrame | None = None, inflows: DataFrame | None = None) -> Parts:
    """The entities, values and relations that from_components makes, before the schema is looked at."""
    parts = Parts()
    id_ = _id
    if (t := tables.get("buses")) is not None:
        rows = t.select(id_("node").alias("entity_id"), F.col("name").cast("string").alias("name"), _number(t, "v_nom").alias("nominal_voltage"), _number(t, "x").alias("longitude"), _number(t, "y").alias("latitude"), F.when(column(t, "country").isNotNull(), F.concat(F.lit("region.country."), column(t, "country").cast("string"))).alias("region"))
        parts.add(rows, "ElectricalBus", ["name", "nominal_voltage", "longitude", "latitude"], {"belongsToGeographicalRegion": "region"})
    for name, kind, class_ in (("lines", "line", "TransmissionLine"), ("transformers", "transformer", "Transformer")):
        if (t := tables.get(name)) is not None:
            rows = t.select(id_(kind).alias("entity_id"), id_("node", "bus0").alias("a"), id_("node", "bus1").alias("b"), F.col("name").cast("string").alias("name"), _number(t, "length", 1.0).alias("line_length"), (_number(t, "r", 0.0) / F.greatest(_number(t, "length", 1.0), F.lit(1e-9))).alias("series_resistance_per_km"), (_number(t, "x", 0.0) / F.greatest(_number(t, "length", 1.0), F.lit(1e-9))).alias("series_reactance_per_km"), _number(t, "s_nom").alias("thermal_capacity_rating"), _number(t, "num_parallel").alias("parallel_circuit_count"))
            parts.add(rows, class_, [c for c in rows.columns if c not in ("entity_id", "a", "b")], {"fromNode": "a", "toNode": "b"})
    if (t := tables.get("loads")) is not None:
        rows = t.select(id_("load").alias("entity_id"), id_("node", "bus").alias("node"), F.col("name").cast("string").alias("name"), _number(t, "p_set").alias("active_power_demand"), F.lit(ELECTRICITY).alias("carrier"))
        parts.add(rows, "DemandUnit", ["name", "active_power_demand"], {"atNode": "node", "hasInputCarrier": "carrier"})
    if (t := tables.get("generators")) is not None:
        t = usable_generators(t, series)
        carrier = column(t, "carrier").cast("string")
        rows = t.select(id_("generator").alias("entity_id"), id_("node", "bus").alias("node"), F.col("name").cast("string").alias("name"), _number(t, "p_nom").alias("nominal_power_capacity"), _number(t, "efficiency").alias("energy_conversion_efficiency"), _number(t, "marginal_cost").alias("variable_operating_cost"), F.when(is_variable(carrier, column(t, "type")), "nondispatchable").otherwise("dispatchable").alias("dispatch_type"), carrier.alias("generator_technology_type"), F.lit(ELECTRICITY).alias("carrier"), asset_class(carrier, F.lit(None)).alias("class"))
        for class_ in ("GenerationUnit", "HydroGenerationUnit"):
            parts.add(rows.where(F.col("class") == class_), class_, ["name", "nominal_power_capacity", "energy_conversion_efficiency", "variable_operating_cost", "dispatch_type", "generator_technology_type"], {"atNode": "node", "hasOutputCarrier": "carrier"})
    if (t := tables.get("storage_units")) is not None:
        carrier = column(t, "carrier").cast("string")
        hydro = asset_class(carrier, F.lit(None)) == "HydroGenerationUnit"
        power, hours = _number(t, "p_nom", 0.0), _number(t, "max_hours", 1.0)
        rows = t.select("name", id_("node", "bus").alias("node"), carrier.alias("storage_technology_type"), hydro.alias("hydro"), power.alias("nominal_power_capacity"), (power * hours).alias("energy_storage_capacity"), F.when(fact("natural_inflow", carrier), _number(t, "inflow")).alias("annual_natural_inflow_energy"), _number(t, "efficiency_store").alias("charging_efficiency"), _number(t, "efficiency_dispatch").alias("discharging_efficiency"))
        parts.add(rows.where("NOT hydro").withColumn("entity_id", id_("storage")), "StorageUnit", ["nominal_power_capacity", "energy_storage_capacity", "charging_efficiency", "discharging_efficiency", "storage_technology_type"], {"atNode": "node"})
        water = rows.where("hydro").withColumn("entity_id", id_("reservoir"))
        parts.add(water, "HydraulicStorageUnit", ["energy_storage_capacity", "annual_natural_inflow_energy", "storage_technology_type"], {})
        unit = water.select(F.concat(F.lit("hydro."), "entity_id").alias("entity_id"), "node", F.col("entity_id").alias("reservoir"), "nominal_power_capacity", F.lit("dispatchable").alias("dispatch_type"), machine_kind(F.col("storage_technology_type")).alias("hydro_machine_kind"), F.lit(ELECTRICITY).alias("carrier"))
        parts.add(unit, "HydroGenerationUnit", ["nominal_power_capacity", "dispatch_type", "hydro_machine_kind"], {"atNode": "node", "drawsFromHydraulicStorage": "reservoir", "hasOutputCarrier": "carrier"})
    if any(t in tables for t in (*CARRIER_TABLES, "carriers")):
        names = carriers_of(tables).select(F.concat(F.lit("carrier."), underscored(F.col("carrier"))).alias("entity_id"), F.col("carrier").alias("name"))
        parts.add(names, "Carrier", ["name"], {})
    if (t := tables.get("stores")) is not None:
        _add_stores(parts, _stores(m, t, inflows))
    if (t := tables.get("links")) is not None:
        _add_links(parts, _links(t, tables["buses"]), tables["buses"])
    return parts


def matpower_case(m: Model, base_mva: float = 100.0) -> dict[str, DataFrame]:
    """bus, gen and branch matrices of a model, as tables with the columns of a MATPOWER case. Impedances are per unit of
    `base_mva`; the bus of a generator is of type 2, a bus marked slack of type 3; without any the first one is."""
    bus = wide(m, "ElectricalBus", ["nominal_voltage"]).join(_numbers(entities(m, "ElectricalBus").select("entity_id")), "entity_id")
    number = bus.select(F.col("entity_id").alias("node"), (F.col("index") + 1).cast("int").alias("number"), F.col("nominal_voltage").alias("kv"))
    at = asset_nodes(m).join(number, "node").select("entity_id", "number")
    load = wide(m, "DemandUnit", ["active_power_demand", "reactive_power_demand"]).join(at, "entity_id").groupBy("number").agg(F.sum("active_power_demand").alias("pd"), F.sum("reactive_power_demand").alias("qd"))
    shunt = wide(m, "ShuntUnit", ["active_power_injection", "reactive_power_injection"]).join(at, "entity_id").groupBy("number").agg(F.sum("active_power_injection").alias("gs"), F.sum("reactive_power_injection").alias("bs"))
    units = wide(m, "GenerationUnit", ["active_power_setpoint", "reactive_power_setpoint", "maximum_reactive_power_output", "minimum_reactive_power_output", "voltage_magnitude_setpoint", "maximum_power_output", "minimum_power_output", "nominal_power_capacity"]).join(at, "entity_id")
    kinds = wide(m, "ElectricalBus", ["powerflow_bus_type"], number=False).select(F.col("entity_id").alias("node"), F.lower("powerflow_bus_type").alias("kind"))
    rows = number.join(load, "number", "left").join(shunt, "number", "left").join(kinds, "node", "left").join(units.select("number").distinct().withColumn("has", F.lit(1)), "number", "left")
    marked = rows.agg(F.coalesce(F.bool_or(F.col("kind") == "slack"), F.lit(False)).alias("marked"), F.min(F.when(F.col("has") == 1, F.col("number"))).alias("first_unit"), F.min("number").alias("first"))
    slack = (F.col("kind") == "slack") | (~F.col("marked") & (F.col("number") == F.coalesce("first_unit", "first")))
    type_ = F.when(slack, SLACK).when(F.col("has") == 1, PV).otherwise(PQ)
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    buses = rows.crossJoin(F.broadcast(marked)).select("number", type_.alias("type"), *map(zero, ("pd", "qd", "gs", "bs")), F.lit(1).alias("area"), F.lit(1.0).alias("vm"), F.lit(0.0).alias("va"), F.col("kv").alias("base_kv"), F.lit(1).alias("zone"), F.lit(1.1).alias("vmax"), F.lit(0.9).alias("vmin"))  # marked is one row
    top = F.coalesce("maximum_power_output", "nominal_power_capacity", F.lit(0.0))
    gen = units.select(F.col("number").alias("bus"), F.coalesce("active_power_setpoint", F.lit(0.0)).alias("pg"), F.coalesce("reactive_power_setpoint", F.lit(0.0)).alias("qg"), F.coalesce("maximum_reactive_power_output", F.lit(0.0)).alias("qmax"), F.coalesce("minimum_reactive_power_output", F.lit(0.0)).alias("qmin"), F.coalesce("voltage_magnitude_setpoint", F.lit(1.0)).alias("vg"), F.lit(base_mva).alias("mbase"), F.lit(1).alias("status"), top.alias("pmax"), F.coalesce("minimum_power_output", F.lit(0.0)).alias("pmin"))
    fields = ["line_length", "series_resistance_per_km", "series_reactance_per_km", "shunt_susceptance_per_km", "parallel_circuit_count", "thermal_capacity_rating", "tap_ratio", "phase_shift_angle"]
    ends = branch_ends(m).join(number.toDF("from_node", "a", "kv"), "from_node").join(number.select(F.col("node").alias("to_node"), F.col("number").alias("b")), "to_node")
    wires = wide(m, "TransmissionLine", fields).withColumn("ratio", F.lit(0.0)).unionByName(wide(m, "Transformer", fields).withColumn("ratio", F.coalesce("tap_ratio", F.lit(1.0))))
    n, km = F.coalesce(F.nullif("parallel_circuit_count", F.lit(0.0)), F.lit(1.0)), F.coalesce("line_length", F.lit(1.0))
    z = F.col("kv") * F.col("kv") / base_mva
    rate = F.coalesce("thermal_capacity_rating", F.lit(0.0))
    branch = wires.join(ends, "entity_id").select(F.col("a").alias("from_bus"), F.col("b").alias("to_bus"), (F.coalesce("series_resistance_per_km", F.lit(0.0)) * km / n / z).alias("r"), (F.coalesce("series_reactance_per_km", F.lit(0.0)) * km / n / z).alias("x"), (F.coalesce("shunt_susceptance_per_km", F.lit(0.0)) * 1e-6 * km * n * z).alias("b"), rate.alias("rate_a"), rate.alias("rate_b"), rate.alias("rate_c"), "ratio", F.coalesce("phase_shift_angle", F.lit(0.0)).alias("angle"), F.lit(1).alias("status"))
    return {"bus": buses, "gen": gen, "branch": branch}


def from_matpower(m: Model, matrices: DataFrame, base_mva: float = 100.0) -> Model:
    """The matrices of a case (matrix, row, cells) as a model: buses, loads, shunts, generators in service, and branches,
    of which those with a ratio other than 0 and 1 are transformers."""
    cell = lambda names: [F.get("cells", F.lit(k)).alias(n) for k, n in enumerate(names)]
    of = lambda matrix, names: matrices.where(F.col("matrix") == matrix).select("row", *cell(names))
    node = lambda c: F.concat(F.lit("mp.bus."), F.col(c).cast("long").cast("string"))
    bus, parts = of("bus", BUS), Parts()
    flow = F.when(F.col("type") == SLACK, "slack").when(F.col("type") == PV, "PV").otherwise("PQ")
    parts.add(bus.select(node("number").alias("entity_id"), F.col("row").alias("seq"), F.col("base_kv").alias("nominal_voltage"), flow.alias("powerflow_bus_type")), "ElectricalBus", ["nominal_voltage", "powerflow_bus_type"], {})
    at = lambda kind: F.concat(F.lit(f"mp.{kind}."), F.col("number").cast("long").cast("string"))
    loads = bus.where("pd <> 0 OR qd <> 0").select(at("load").alias("entity_id"), F.col("row").alias("seq"), node("number").alias("node"), F.col("pd").alias("active_power_demand"), F.col("qd").alias("reactive_power_demand"))
    parts.add(loads, "DemandUnit", ["active_power_demand", "reactive_power_demand"], {"atNode": "node"})
    shunts = bus.where("gs <> 0 OR bs <> 0").select(at("shunt").alias("entity_id"), F.col("row").alias("seq"), node("number").alias("node"), F.col("gs").alias("active_power_injection"), F.col("bs").alias("reactive_power_injection"))
    parts.add(shunts, "ShuntUnit", ["active_power_injection", "reactive_power_injection"], {"atNode": "node"})
    gen = of("gen", GEN).where("status > 0")
    gen = gen.select(F.concat(F.lit("mp.gen."), F.col("row").cast("string")).alias("entity_id"), F.col("row").alias("seq"), node("bus").alias("node"), F.col("pg").alias("active_power_setpoint"), F.col("qg").alias("reactive_power_setpoint"), F.col("qmax").alias("maximum_reactive_power_output"), F.col("qmin").alias("minimum_reactive_power_output"), F.col("vg").alias("voltage_magnitude_setpoint"), F.col("pmax").alias("maximum_power_output"), F.col("pmin").alias("minimum_power_output"), F.col("pmax").alias("nominal_power_capacity"))
    parts.add(gen, "GenerationUnit", [c for c in gen.columns if c not in ("entity_id", "seq", "node")], {"atNode": "node"})
    kv = bus.select(F.col("number").alias("from_bus"), F.col("base_kv").alias("kv"))
    z = F.col("kv") * F.col("kv") / base_mva
    branch = of("branch", BRANCH).where("status > 0").join(kv, "from_bus")
    branch = branch.select(F.concat(F.lit("mp.branch."), F.col("row").cast("string")).alias("entity_id"), F.col("row").alias("seq"), node("from_bus").alias("a"), node("to_bus").alias("b_node"), F.lit(1.0).alias("line_length"), (F.col("r") * z).alias("series_resistance_per_km"), (F.col("x") * z).alias("series_reactance_per_km"), (F.col("b") / z * 1e6).alias("shunt_susceptance_per_km"), F.col("rate_a").alias("thermal_capacity_rating"), F.col("ratio").alias("tap_ratio"), F.col("angle").alias("phase_shift_angle"))
    tapped = (F.col("tap_ratio") != 0) & (F.col("tap_ratio") != 1)
    for class_, keep in (("TransmissionLine", ~tapped), ("Transformer", tapped)):
        parts.add(branch.where(keep), class_, [c for c in branch.columns if c not in ("entity_id", "seq", "a", "b_node")], {"fromNode": "a", "toNode": "b_node"})
    return parts.into(m)


def case_problems(case: dict[str, DataFrame], buses: int | None = None, branches: int | None = None, generators: int = 0) -> DataFrame:
    """problem: what is wrong with the structure of a case: counts, no slack bus, references to buses that are not there."""
    spark = case["bus"].sparkSession
    number = case["bus"].select("number").distinct()
    counts = {t: case[t].agg(F.count("*").alias("n")) for t in ("bus", "branch", "gen")}
    text = lambda rows, when, *words: rows.where(when).select(F.concat_ws(" ", *words).alias("problem"))
    parts = [text(counts["gen"], F.col("n") < generators, F.lit(f"at least {generators} generators, not"), F.col("n"))]
    parts += [text(counts[t], F.col("n") != n, F.lit(f"{n} rows of {t}, not"), F.col("n")) for t, n in (("bus", buses), ("branch", branches)) if n is not None]
    parts.append(text(case["bus"].agg(F.count(F.when(F.col("type") == SLACK, 1)).alias("n")), F.col("n") == 0, F.lit("no slack bus")))
    for table, ends in (("gen", ["bus"]), ("branch", ["from_bus", "to_bus"])):
        for end in ends:
            lost = case[table].select(F.col(end).alias("number")).distinct().join(number, "number", "left_anti")
            parts.append(text(lost, F.lit(True), F.lit(f"{table} refers to the missing bus"), F.col("number").cast("long")))
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], "problem string")


def imported_problems(m: Model) -> DataFrame:
    """problem: branches without two ends and assets without a bus, among what a model has of a grid."""
    buses = entities(m, "ElectricalBus").select(F.col("entity_id").alias("node"))
    wires = m.entity.where(F.col("entity_class").isin("TransmissionLine", "Transformer")).select("entity_id").join(branch_ends(m), "entity_id", "left")
    loose = wires.join(buses.toDF("from_node").withColumn("a", F.lit(1)), "from_node", "left").join(buses.toDF("to_node").withColumn("b", F.lit(1)), "to_node", "left").where("a IS NULL OR b IS NULL")
    units = m.entity.where(F.col("entity_class").isin("GenerationUnit", "DemandUnit")).select("entity_id").join(first_target(m, "atNode", "node"), "entity_id", "left").join(buses, "node", "left_anti")
    return loose.select(F.concat(F.lit("loose branch "), "entity_id").alias("problem")).union(units.select(F.concat(F.lit("asset without a bus "), "entity_id")))
