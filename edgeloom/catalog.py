"""Named queries over the star-schema tables, each through the library's operators, with the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import classify, numbers, text
from .operators import country, etl, market, mutation, navigation, profiles, reports, rolled_model, rollup, subset
from .model import relation_rows
from .plans import conditions, validation
from .plans.schema import Schema, empty_model
from .sources import hierarchical, networks, readers, regions, writers
from .sources.star import ENERGY_SCHEMA, SCHEMA, energy_model, key, star_model, table, violating_model
from .streaming import events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
M2 = "DECIMAL(18,2)"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def located(spark: SparkSession, sf_dir: str, name: str, prefix: str) -> DataFrame:
    """A table of suppliers or customers with nation and region names."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = table(spark, sf_dir, name).join(nation, F.col(f"{prefix}_nationkey") == F.col("n_nationkey"))
    return rows.join(region, F.col("n_regionkey") == F.col("r_regionkey"))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with the nation that ships (a) and the one that receives (b)."""
    read = lambda n: table(spark, sf_dir, n)
    a = read("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("ka"))
    b = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("l_orderkey"), F.col("c_nationkey").alias("kb"))
    n = read("nation")
    rows = read("lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice").join(b, "l_orderkey").join(a, "l_suppkey")
    return rows.join(n.select(F.col("n_nationkey").alias("ka"), F.col("n_name").alias("a")), "ka").join(n.select(F.col("n_nationkey").alias("kb"), F.col("n_name").alias("b")), "kb")


_FLOWS = """flows AS (SELECT na.n_name AS a, nb.n_name AS b, l.l_quantity, l.l_extendedprice FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
 JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation na ON s.s_nationkey = na.n_nationkey JOIN nation nb ON c.c_nationkey = nb.n_nationkey)"""


_ENERGY = """b AS (SELECT n_nationkey, code, country, 'node.' || code || '.' || n_nationkey AS bus FROM (SELECT n_nationkey, lower(substr(n_name, 1, 2)) || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS code, upper(substr(n_name, 1, 2)) AS country FROM nation)),
g AS (SELECT s.*, b.bus, b.country, s_suppkey % 3 = 0 AS hydro, s_suppkey % 2 = 0 AS variable, CASE WHEN s_suppkey % 3 = 0 THEN 'HydroGenerationUnit' ELSE 'GenerationUnit' END AS class,
 coalesce(CASE s_suppkey % 5 WHEN 0 THEN 'wind_onshore' WHEN 1 THEN 'solar_pv' END, CASE WHEN s_suppkey % 7 = 0 THEN 'tech.' || s_suppkey END, CASE WHEN s_suppkey % 3 = 0 THEN 'HydroGenerationUnit' ELSE 'GenerationUnit' END) AS tech FROM supplier s JOIN b ON s_nationkey = n_nationkey),
fed AS (SELECT 'res.' || (s_suppkey % 4 * 50 + 50) AS id, arg_min(bus, s_suppkey) AS first_node, arg_max(bus, s_suppkey) AS last_node, arg_min(country, s_suppkey) AS country, bool_or(s_suppkey % 9 = 0) AS pumped FROM g WHERE hydro AND NOT variable GROUP BY 1),
c AS (SELECT customer.*, b.bus, b.country FROM customer JOIN b ON c_nationkey = n_nationkey),
res AS (SELECT c_custkey, c_acctbal, 'res.' || c_custkey AS id, bus, coalesce(CASE WHEN c_custkey % 150 = 0 THEN c.country END, fed.country, '??') AS country FROM c LEFT JOIN fed ON fed.id = 'res.' || c_custkey WHERE c_custkey % 50 = 0)"""


# entities, values, hops


@query("""SELECT 'GeographicalRegion' AS entity_class, count(*) AS n FROM region UNION ALL SELECT 'NetworkNode', count(*) FROM nation UNION ALL SELECT 'GenerationUnit', count(*) FROM supplier
 UNION ALL SELECT 'DemandUnit', count(*) FROM customer UNION ALL SELECT 'GeneratorType', count(*) FROM part""")
def entity_counts(spark, d):
    return reports.entity_counts(star_model(spark, d))


@query("SELECT CASE WHEN k = 1 THEN 'DemandUnit' ELSE 'GenerationUnit' END AS label, CASE WHEN k = 1 THEN (SELECT count(*) FROM customer) ELSE (SELECT count(*) FROM supplier) END AS n FROM (VALUES (1), (2)) t(k)")
def summary(spark, d):
    return reports.summary(star_model(spark, d))


@query("""SELECT 'gen.' || s_suppkey AS entity_id, 'nominal_power_capacity' AS attribute_id, s_acctbal AS v FROM supplier
 UNION ALL SELECT 'load.' || c_custkey, 'annual_energy_demand', c_acctbal FROM customer UNION ALL SELECT 'tech.' || p_partkey, 'size', CAST(p_size AS DOUBLE) FROM part
 UNION ALL SELECT 'tech.' || p_partkey, 'price', p_retailprice FROM part""")
def attr_long(spark, d):
    return star_model(spark, d).attr.where("value_num is not null").select("entity_id", "attribute_id", F.col("value_num").alias("v"))


@query("""SELECT 'node.' || n_nationkey AS entity_id, 'belongsToGeographicalRegion' AS relation_id, 'region.' || n_regionkey AS target_id FROM nation
 UNION ALL SELECT 'gen.' || s_suppkey, 'atNode', 'node.' || s_nationkey FROM supplier UNION ALL SELECT 'gen.' || s_suppkey, 'hasTechnology', 'tech.' || s_suppkey FROM supplier WHERE s_acctbal > 5000
 UNION ALL SELECT 'load.' || c_custkey, 'atNode', 'node.' || c_nationkey FROM customer""")
def rel_long(spark, d):
    return star_model(spark, d).rel.select("entity_id", "relation_id", "target_id")


@query("SELECT 'gen.' || s_suppkey AS entity_id, 'node.' || s_nationkey AS node FROM supplier")
def asset_to_node(spark, d):
    return navigation.asset_nodes(star_model(spark, d), ["GenerationUnit"])


@query("SELECT 'node.' || n_nationkey AS node, 'region.' || n_regionkey AS country FROM nation")
def node_to_country(spark, d):
    return navigation.node_countries(star_model(spark, d))


@query("""SELECT 'gen.' || s_suppkey AS entity_id, CASE WHEN s_acctbal > 5000 THEN 'tech.' || s_suppkey END AS technology, p_name AS technology_name
 FROM supplier LEFT JOIN part ON s_acctbal > 5000 AND p_partkey = s_suppkey""")
def technology_of_asset(spark, d):
    m = star_model(spark, d)
    technology = navigation.first_target(m, navigation.TECHNOLOGY, "technology")
    names = navigation.values(m, "name").toDF("technology", "technology_name")
    return navigation.entities(m, "GenerationUnit").select("entity_id").join(technology, "entity_id", "left").join(names, "technology", "left").select("entity_id", "technology", "technology_name")


@query("""SELECT 'gen.' || s_suppkey AS entity_id, CASE WHEN s_acctbal > 5000 THEN p_brand END AS value FROM supplier LEFT JOIN part ON p_partkey = s_suppkey""")
def technology_cascade(spark, d):
    m = star_model(spark, d)
    return navigation.effective_values(m, "brand").join(navigation.entities(m, "GenerationUnit").select("entity_id"), "entity_id", "left_semi")


@query("SELECT 'node.' || s_nationkey AS node, count(*) AS n, min(s_suppkey) AS first_key FROM supplier GROUP BY 1")
def assets_at_node(spark, d):
    rows = navigation.sources(star_model(spark, d), "atNode").where("entity_id like 'gen.%'")
    return rows.groupBy(F.col("target_id").alias("node")).agg(F.count("*").alias("n"), F.min(F.regexp_extract("entity_id", r"(\d+)", 1).cast("long")).alias("first_key"))


_OWN = """own AS (SELECT 'GeographicalRegion' AS class_name, count(*) AS n FROM region UNION ALL SELECT 'NetworkNode', count(*) FROM nation UNION ALL SELECT 'GenerationUnit', count(*) FROM supplier
 UNION ALL SELECT 'DemandUnit', count(*) FROM customer UNION ALL SELECT 'GeneratorType', count(*) FROM part)"""


def _with_counts(m, classes: DataFrame, column: str = "class_name") -> DataFrame:
    """Rows about classes with the number of entities that a class has itself."""
    return classes.join(reports.entity_counts(m).withColumnRenamed("entity_class", column), column, "left").fillna(0, ["n"])


@query(f"""WITH RECURSIVE p(c, a) AS (VALUES ('EnergyAssetInstance','SemanticEntity'),('GenerationUnit','EnergyAssetInstance'),('DemandUnit','EnergyAssetInstance'),('NetworkNode','SemanticEntity'),
 ('GeographicalRegion','SemanticEntity'),('GeneratorType','SemanticEntity')), k(class_name, ancestor, depth) AS (SELECT c, c, 0 FROM (SELECT c FROM p UNION SELECT a FROM p)
 UNION ALL SELECT k.class_name, p.a, k.depth + 1 FROM k JOIN p ON k.ancestor = p.c), {_OWN}
 SELECT class_name, ancestor, CAST(depth AS INTEGER) AS depth, coalesce(n, 0) AS n FROM k LEFT JOIN own USING (class_name)""")
def class_closure(spark, d):
    m = star_model(spark, d)
    return _with_counts(m, m.class_closure)


@query(f"WITH {_OWN} SELECT class_name, 1 AS depth, n FROM own WHERE class_name IN ('GenerationUnit', 'DemandUnit') UNION ALL SELECT 'EnergyAssetInstance', 0, 0")
def is_derived_from(spark, d):
    m = star_model(spark, d)
    return _with_counts(m, navigation.class_tree(m, "EnergyAssetInstance"))


@query("""SELECT 'region.' || r_regionkey AS entity_id FROM region UNION ALL SELECT 'node.' || n_nationkey FROM nation UNION ALL SELECT 'gen.' || s_suppkey FROM supplier
 UNION ALL SELECT 'load.' || c_custkey FROM customer UNION ALL SELECT 'tech.' || p_partkey FROM part WHERE p_partkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)""")
def library_scope_referenced(spark, d):
    return navigation.library_scope(star_model(spark, d))


@query(f"WITH {_ENERGY} SELECT id AS reservoir, first_node, last_node FROM fed")
def first_and_last_wins(spark, d):
    m = energy_model(spark, d)
    first, last = (navigation.reservoir_nodes(m, last=x).toDF("reservoir", f"{name}_node") for x, name in ((False, "first"), (True, "last")))
    return first.join(last, "reservoir")


@query(f"""WITH {_ENERGY}, alone AS (SELECT bus, min(id) AS reservoir FROM res WHERE c_custkey % 150 = 0 GROUP BY 1 HAVING count(*) = 1),
 e AS (SELECT 'res.' || (s_suppkey % 4 * 50 + 50) AS reservoir, s_acctbal FROM g WHERE hydro AND NOT variable UNION ALL SELECT reservoir, s_acctbal FROM g JOIN alone USING (bus) WHERE hydro AND variable)
 SELECT reservoir, round(CAST(sum(CAST(s_acctbal AS {M2})) AS DOUBLE), 2) AS power FROM e GROUP BY 1""")
def same_node_single_fallback(spark, d):
    return navigation.reservoir_power(energy_model(spark, d), "nominal_power_capacity").withColumn("power", F.round("power", 2))


@query(f"WITH {_ENERGY} SELECT id AS reservoir, pumped FROM fed")
def phs_flag(spark, d):
    return navigation.pumped_reservoirs(energy_model(spark, d), F.col("seq") % 9 == 0)


# reports


@query(f"SELECT r_name, c_mktsegment, CAST(sum(CAST(c_acctbal AS {M2})) AS DOUBLE) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def totals_by_country_and_tech(spark, d):
    return reports.totals(located(spark, d, "customer", "c"), ["r_name", "c_mktsegment"], F.col("c_acctbal"))


@query(f"""SELECT r_name, c_mktsegment, CAST(sum(CAST(c_acctbal AS {M2})) AS DOUBLE) AS total, CAST(grouping(r_name) + grouping(c_mktsegment) AS BIGINT) AS level
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, c_mktsegment)""")
def totals_rollup(spark, d):
    return reports.totals_with_subtotals(located(spark, d, "customer", "c"), ["r_name", "c_mktsegment"], F.col("c_acctbal"))


@query(f"SELECT CAST(coalesce(sum(CAST(s_acctbal AS {M2})), 0) AS DOUBLE) AS total FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1")
def total_capacity_region(spark, d):
    return reports.total_capacity(star_model(spark, d), "GenerationUnit", "region.1")


@query("SELECT CAST(round_even(c_acctbal / 1000, 0) AS BIGINT) AS bin, count(*) AS n FROM customer GROUP BY 1")
def histogram_levels(spark, d):
    return reports.histogram(table(spark, d, "customer"), F.col("c_acctbal") / 1000)


@query(f"""WITH {_FLOWS} SELECT least(a, b) AS country_a, greatest(a, b) AS country_b,
 CAST(coalesce(sum(CAST(CASE WHEN a < b THEN l_extendedprice ELSE l_quantity END AS {M2})), 0) AS DOUBLE) AS fwd,
 CAST(coalesce(sum(CAST(CASE WHEN a < b THEN l_quantity ELSE l_extendedprice END AS {M2})), 0) AS DOUBLE) AS bwd FROM flows WHERE a <> b GROUP BY 1, 2""")
def cross_border_capacity(spark, d):
    return reports.cross_border(flows(spark, d), "a", "b", F.col("l_extendedprice"), F.col("l_quantity"))


@query(f"""WITH {_FLOWS} SELECT least(a, b) AS country_a, greatest(a, b) AS country_b, CAST(coalesce(sum(CAST(l_extendedprice AS {M2})), 0) AS DOUBLE) AS fwd,
 CAST(coalesce(sum(CAST(l_quantity AS {M2})), 0) AS DOUBLE) AS bwd FROM flows WHERE a <> b GROUP BY 1, 2""")
def cross_border_as_listed(spark, d):
    return reports.cross_border(flows(spark, d), "a", "b", F.col("l_extendedprice"), F.col("l_quantity"), oriented=False)


@query(f"WITH {_FLOWS} SELECT a, b, count(*) AS n FROM flows GROUP BY 1, 2")
def interconnector_flows(spark, d):
    return reports.pair_counts(flows(spark, d), "a", "b")


@query("""SELECT l_returnflag, round(CAST(sum(CAST(l_discount AS DECIMAL(9,2)) * CAST(l_quantity AS DECIMAL(9,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(9,2))) AS DOUBLE), 6) AS average
 FROM lineitem WHERE l_quantity <> 0 GROUP BY 1""")
def weighted_average(spark, d):
    value, weight = (F.col(c).cast("decimal(9,2)") for c in ("l_discount", "l_quantity"))
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(reports.weighted_average(value, weight), 6).alias("average"))


@query("""SELECT n_name, c_mktsegment, n FROM (SELECT n_name, c_mktsegment, count(*) AS n, row_number() OVER (PARTITION BY n_name ORDER BY count(*) DESC, min(c_custkey)) AS r
 FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) WHERE r = 1""")
def dominant_value(spark, d):
    return reports.dominant(located(spark, d, "customer", "c"), ["n_name"], "c_mktsegment", "c_custkey")


@query(f"""WITH t AS (SELECT r_name, c_mktsegment, sum(CAST(c_acctbal AS {M2})) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)
 SELECT r_name, c_mktsegment, round(CAST(total AS DOUBLE) / CAST(sum(total) OVER (PARTITION BY r_name) AS DOUBLE), 6) AS share FROM t""")
def shares_of_total(spark, d):
    rows = reports.totals(located(spark, d, "customer", "c"), ["r_name", "c_mktsegment"], F.col("c_acctbal"))
    return reports.shares(rows, ["r_name"], "total").select("r_name", "c_mktsegment", F.round("share", 6).alias("share"))


@query(f"""WITH t AS (SELECT r_name AS country, 'generation' AS category, 'supplier' AS technology, s_acctbal AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT r_name, 'potential', 'supplier', s_acctbal * 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
 SELECT country, technology, category, CAST(sum(CAST(v AS {M2})) AS DOUBLE) AS total FROM t GROUP BY ALL""")
def country_totals(spark, d):
    rows = located(spark, d, "supplier", "s").select(F.col("r_name").alias("country"), F.lit("supplier").alias("technology"), "s_acctbal")
    return reports.country_totals(rows, {"generation": F.col("s_acctbal"), "potential": F.col("s_acctbal") * 2})


@query(f"SELECT count(*) AS n, CAST(sum(CAST(l_quantity * greatest(l_linenumber, 1) AS {M2})) AS DOUBLE) AS km, CAST(sum(CAST(l_extendedprice AS {M2})) AS DOUBLE) AS mva FROM lineitem")
def branch_summary(spark, d):
    return reports.branch_summary(table(spark, d, "lineitem"), F.col("l_quantity"), F.col("l_linenumber"), F.col("l_extendedprice"))


@query(f"""WITH b AS (SELECT n_regionkey, n_nationkey, CAST(c_acctbal AS {M2}) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey), x AS (SELECT n_regionkey, CAST(sum(v) AS DOUBLE) AS before FROM b GROUP BY 1),
 y AS (SELECT n_regionkey, CAST(sum(v) AS DOUBLE) AS after FROM b WHERE n_nationkey <> 3 GROUP BY 1) SELECT n_regionkey, round(coalesce(before, 0), 2) AS before, round(coalesce(after, 0), 2) AS after, abs(coalesce(before, 0) - coalesce(after, 0)) < 0.01 AS ok FROM x FULL JOIN y USING (n_regionkey)""")
def conservation_check(spark, d):
    rows = located(spark, d, "customer", "c")
    merged = rows.where("n_nationkey <> 3").groupBy("n_regionkey", "n_nationkey").agg(F.sum("c_acctbal").alias("c_acctbal"))
    out = reports.conservation(rows, merged, ["n_regionkey"], "c_acctbal")
    return out.select("n_regionkey", F.round("before", 2).alias("before"), F.round("after", 2).alias("after"), "ok")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50")
def top_balances(spark, d):
    return reports.top(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", 50)


@query(f"""WITH t AS (SELECT r_name AS country, s_suppkey % 4 AS k, s_acctbal AS capacity, s_acctbal * 2 AS energy FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT r_name, 9, NULL, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
 c AS (SELECT country, CASE WHEN k IN (0, 2) THEN CAST(capacity * 8760 AS {M2}) END AS a, CASE WHEN k = 1 THEN CAST(energy AS {M2}) END AS b, CASE WHEN k = 3 THEN CAST(energy AS {M2}) END AS h, CASE WHEN k = 9 THEN CAST(energy AS {M2}) END AS e FROM t)
 SELECT country, CAST(coalesce(sum(a), 0) AS DOUBLE) AS dispatchable, CAST(coalesce(sum(b), 0) AS DOUBLE) AS variable, CAST(coalesce(sum(h), 0) AS DOUBLE) AS hydro, CAST(coalesce(sum(e), 0) AS DOUBLE) AS demand FROM c GROUP BY ROLLUP (country)""")
def energy_balance(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("dispatchable", "variable", "dispatchable", "hydro"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    rows = located(spark, d, "supplier", "s").select(F.col("r_name").alias("country"), kind.alias("kind"), F.col("s_acctbal").alias("capacity"), (F.col("s_acctbal") * 2).alias("energy"))
    rows = rows.union(located(spark, d, "customer", "c").select("r_name", F.lit("demand"), F.lit(None).cast("double"), "c_acctbal"))
    return market.energy_balance(rows)


@query("SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN starts_with(c_mktsegment, 'MACH') THEN 0 WHEN starts_with(c_mktsegment, 'B') THEN 1 ELSE 2 END, c_mktsegment) AS r FROM (SELECT c_nationkey, c_mktsegment, min(c_custkey) AS c_custkey FROM customer GROUP BY 1, 2)) WHERE r = 1")
def winner_by_prefix(spark, d):
    rows = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("c_custkey"))
    return market.winners(rows, "c_nationkey", "c_mktsegment", ["MACH", "B"]).select("c_nationkey", "c_custkey")


@query("SELECT 'attribute' AS kind, 'label' AS field_id")
def unused_schema_fields(spark, d):
    return validation.unused_fields(star_model(spark, d))


_AUDITED = {
    "relations": {"hasTariff": {"target": "GeneratorType"}, "hasOwner": {"target": "NetworkNode"}},
    "classes": {
        "MarketDemand": {"parents": ["DemandUnit"], "abstract": True, "relations": ["hasTariff"]},
        "FlexibleDemand": {"parents": ["MarketDemand"]},
        "FixedDemand": {"parents": ["MarketDemand"]},
        "Depot": {"parents": ["NetworkNode"], "relations": ["hasOwner"]},
    },
}


@query("""WITH RECURSIVE p(c, a) AS (VALUES ('EnergyAssetInstance', 'SemanticEntity'), ('GenerationUnit', 'EnergyAssetInstance'), ('DemandUnit', 'EnergyAssetInstance'), ('NetworkNode', 'SemanticEntity'), ('GeographicalRegion', 'SemanticEntity'), ('GeneratorType', 'SemanticEntity'),
 ('MarketDemand', 'DemandUnit'), ('FlexibleDemand', 'MarketDemand'), ('FixedDemand', 'MarketDemand'), ('Depot', 'NetworkNode')), k(c, a, depth) AS (SELECT c, c, 0 FROM (SELECT c FROM p UNION SELECT a FROM p) UNION ALL SELECT k.c, p.a, k.depth + 1 FROM k JOIN p ON k.a = p.c),
 f(c, kind, field) AS (VALUES ('EnergyAssetInstance', 'attribute', 'name'), ('GenerationUnit', 'attribute', 'nominal_power_capacity'), ('DemandUnit', 'attribute', 'annual_energy_demand'), ('DemandUnit', 'attribute', 'segment'), ('DemandUnit', 'attribute', 'price'), ('DemandUnit', 'attribute', 'label'),
 ('GeneratorType', 'attribute', 'brand'), ('GeneratorType', 'attribute', 'size'), ('GenerationUnit', 'relation', 'atNode'), ('GenerationUnit', 'relation', 'hasTechnology'), ('DemandUnit', 'relation', 'atNode'), ('NetworkNode', 'relation', 'belongsToGeographicalRegion'), ('MarketDemand', 'relation', 'hasTariff'), ('Depot', 'relation', 'hasOwner')),
 cu AS (SELECT *, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'FlexibleDemand' ELSE 'DemandUnit' END AS c FROM customer),
 inst AS (SELECT 'GeographicalRegion' AS c FROM region UNION SELECT 'NetworkNode' FROM nation UNION SELECT 'GenerationUnit' FROM supplier UNION SELECT c FROM cu UNION SELECT 'GeneratorType' FROM part),
 u(kind, c, field) AS (SELECT 'attribute', 'GenerationUnit', 'name' FROM supplier UNION SELECT 'attribute', 'GenerationUnit', 'nominal_power_capacity' FROM supplier WHERE s_acctbal IS NOT NULL UNION SELECT 'attribute', c, 'annual_energy_demand' FROM cu WHERE c_acctbal IS NOT NULL
 UNION SELECT 'attribute', c, 'segment' FROM cu WHERE c_mktsegment IS NOT NULL UNION SELECT 'attribute', 'GeneratorType', v FROM part, (VALUES ('brand'), ('size'), ('price')) t(v) UNION SELECT 'relation', 'GenerationUnit', 'atNode' FROM supplier UNION SELECT 'relation', 'GenerationUnit', 'hasTechnology' FROM supplier WHERE s_acctbal > 5000
 UNION SELECT 'relation', c, 'atNode' FROM cu UNION SELECT 'relation', 'NetworkNode', 'belongsToGeographicalRegion' FROM nation UNION SELECT 'relation', c, 'hasTariff' FROM cu WHERE c = 'FlexibleDemand')
 SELECT 'dead ' || kind AS finding, NULL AS class_name, field AS field_id, NULL AS used_by FROM (SELECT DISTINCT kind, field FROM f) WHERE (kind, field) NOT IN (SELECT kind, field FROM u)
 UNION ALL SELECT unnest(['orphan class', 'unused stable class']), c, NULL, NULL FROM (SELECT DISTINCT c FROM p WHERE c NOT IN ('EnergyAssetInstance', 'MarketDemand')) WHERE c NOT IN (SELECT c FROM inst)
 UNION ALL SELECT 'single descendant', f.c, f.field, min(u.c) FROM f JOIN u ON f.kind = 'relation' AND u.kind = 'relation' AND u.field = f.field LEFT JOIN k ON k.c = u.c AND k.a = f.c GROUP BY f.c, f.field HAVING count(DISTINCT u.c) = 1 AND bool_and(coalesce(k.depth > 0, false))""")
def schema_audit(spark, d):
    """Customers of one segment are of a class below demand, and have a relation that a class between declares."""
    m, customer = star_model(spark, d), table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'")
    flexible = customer.select(key("load", "c_custkey").alias("entity_id"), F.lit("FlexibleDemand").alias("new"))
    of = lambda t: t.join(flexible, "entity_id", "left").withColumn("entity_class", F.coalesce("new", "entity_class")).select(*t.columns)
    tariffs = relation_rows(customer, "FlexibleDemand", key("load", "c_custkey"), "hasTariff", key("tech", "c_custkey"))
    classes = dict(zip(("class_def", "class_closure", "field_def"), Schema.composed([SCHEMA, _AUDITED]).frames(spark), strict=True))
    m = m.but(entity=of(m.entity), attr=of(m.attr), rel=of(m.rel).unionByName(tariffs), **classes)
    return validation.audit(m, stable=["Depot", "FixedDemand", "GenerationUnit"])


# rules


def violations(rule, model=star_model):
    return lambda spark, d: rule(model(spark, d)).select("entity_id", "field_id")


QUERIES |= {
    f"validate_{name}": violations(rule)
    for name, rule in {
        "required": validation.missing_required,
        "minimum": validation.out_of_range,
        "enum": validation.not_in_enum,
        "pattern": validation.pattern_mismatch,
    }.items()
}
QUERIES |= {
    f"validate_{name}": violations(rule, violating_model)
    for name, rule in {"type": validation.wrong_types, "unit": validation.wrong_units, "dangling": validation.dangling, "target_class": validation.wrong_target_class}.items()
}
SQL |= {
    "validate_required": "SELECT 'gen.' || s_suppkey AS entity_id, 'hasTechnology' AS field_id FROM supplier WHERE s_acctbal <= 5000",
    "validate_minimum": """SELECT 'gen.' || s_suppkey AS entity_id, 'nominal_power_capacity' AS field_id FROM supplier WHERE s_acctbal < 0
 UNION ALL SELECT 'load.' || c_custkey, 'annual_energy_demand' FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'tech.' || p_partkey, 'size' FROM part WHERE p_size > 45""",
    "validate_enum": "SELECT 'load.' || c_custkey AS entity_id, 'segment' AS field_id FROM customer WHERE c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD')",
    "validate_pattern": "SELECT 'tech.' || p_partkey AS entity_id, 'brand' AS field_id FROM part WHERE NOT regexp_full_match(p_brand, 'Brand#[0-9]')",
    "validate_type": "SELECT 'load.' || c_custkey AS entity_id, 'label' AS field_id FROM customer WHERE c_custkey % 11 = 0",
    "validate_unit": "SELECT 'gen.' || s_suppkey AS entity_id, 'nominal_power_capacity' AS field_id FROM supplier WHERE s_suppkey % 5 = 0",
    "validate_dangling": "SELECT 'gen.' || s_suppkey AS entity_id, 'hasTechnology' AS field_id FROM supplier WHERE s_acctbal > 5000 AND s_suppkey NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT 'gen.' || s_suppkey, 'hasTechnology' FROM supplier WHERE s_suppkey % 17 = 0",
    "validate_target_class": "SELECT 'gen.' || s_suppkey AS entity_id, 'atNode' AS field_id FROM supplier WHERE s_suppkey % 13 = 0",
}


@query("SELECT 'load.' || c_custkey AS entity_id, 'price' AS field_id FROM customer WHERE c_custkey % 10 = 0")
def group_gated_required(spark, d):
    m = star_model(spark, d)
    tagged = table(spark, d, "customer").where("c_custkey % 10 = 0").withColumn("label", F.lit(1))
    from .model import attribute_rows

    m = m.but(attr=m.attr.unionByName(attribute_rows(tagged, "DemandUnit", key("load", "c_custkey"), {"label": "label"})))
    return validation.missing_required(m).where("entity_class = 'DemandUnit'").select("entity_id", "field_id")


def _customers(spark, d) -> tuple[DataFrame, conditions.Fields]:
    rows = table(spark, d, "customer")
    return rows, conditions.Fields(dict(rows.dtypes))


@query("SELECT c_custkey FROM customer WHERE (c_acctbal < -100 OR c_mktsegment = 'BUILDING') AND NOT c_nationkey >= 20")
def analysis_when_expr(spark, d):
    rows, fields = _customers(spark, d)
    return rows.where(conditions.compiled("(c_acctbal < -100 or c_mktsegment == 'BUILDING') and not c_nationkey >= 20", fields)).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal >= 5000")
def analysis_when_dict(spark, d):
    rows, fields = _customers(spark, d)
    both = [{"attribute_equals": {"attribute": "c_mktsegment", "value": "MACHINERY"}}, {"attribute_compare": {"attribute": "c_acctbal", "op": ">=", "value": 5000}}, {"attribute_unset": "no_such_field"}]
    return rows.where(conditions.when(both, fields)).select("c_custkey")


@query("""SELECT 'load.' || c_custkey AS entity_id, 'annual_energy_demand' AS field_id, 'minimum' AS rule FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 100
 UNION ALL SELECT 'load.' || c_custkey, 'price', 'required' FROM customer WHERE c_mktsegment = 'BUILDING'""")
def validate_for_analysis(spark, d):
    checks = [{"attribute": "annual_energy_demand", "constraints": {"minimum": 100}}, {"attribute": "price"}]
    profile = {"requirements": [{"entity_class": "DemandUnit", "when": "segment == 'BUILDING'", "checks": checks}]}
    return validation.validate_for_analysis(star_model(spark, d), profile).select("entity_id", "field_id", "rule")


# roll-up


def buses(spark, d) -> DataFrame:
    """Nations as buses with a made-up region code, two voltages and a place."""
    n = table(spark, d, "nation")
    code = F.concat(F.substring(F.lower("r_name"), 1, 2), F.lpad(F.col("n_nationkey").cast("string"), 3, "0"))
    rows = n.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(key("bus", "n_nationkey").alias("bus"), code.alias("nuts3"), F.when(F.col("n_nationkey") % 2 == 0, 380.0).otherwise(220.0).alias("kv"), F.col("n_nationkey").cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), "n_nationkey")


_BUS = """bus AS (SELECT n_nationkey, 'bus.' || n_nationkey AS bus, lower(substr(r_name, 1, 2)) AS rc, upper(substr(r_name, 1, 2)) AS country, CASE WHEN n_nationkey % 2 = 0 THEN 380 ELSE 220 END AS kv,
 'node.' || lower(substr(r_name, 1, 2)) || '.' || CASE WHEN n_nationkey % 2 = 0 THEN 380 ELSE 220 END AS agg FROM nation JOIN region ON n_regionkey = r_regionkey)"""


@query(f"WITH {_BUS} SELECT agg, country, 'country.' || rc AS region, CAST(max(kv) AS INTEGER) AS kv, avg(n_nationkey) AS lat, count(*) AS n FROM bus GROUP BY agg, country, rc")
def rollup_buses(spark, d):
    return rollup.rolled_buses(rollup.bus_map(buses(spark, d))).drop("lon")


@query(f"""WITH {_BUS} SELECT 'demand.agg.' || rc || '.' || kv AS id, agg, country, CAST(sum(CAST(c_acctbal AS {M2})) AS DOUBLE) AS annual, count(*) AS n FROM customer JOIN bus ON c_nationkey = n_nationkey GROUP BY rc, kv, agg, country""")
def rollup_demand(spark, d):
    rows = table(spark, d, "customer").select(key("bus", "c_nationkey").alias("bus"), F.col("c_acctbal").alias("annual"))
    return rollup.rolled_demand(rollup.member(rows, rollup.bus_map(buses(spark, d)), F.lit("demand")))


_GROUPS = {"eco": ["econ*"], "mid": ["medium", "m*"], "large": ["large"]}


@query(f"""WITH {_BUS}, g AS (SELECT s.*, p_size, CASE WHEN lower(p_type) = 'medium' THEN 'mid' WHEN lower(p_type) = 'large' THEN 'large' WHEN lower(p_type) LIKE 'econ%' THEN 'eco' WHEN lower(p_type) LIKE 'm%' THEN 'mid' ELSE lower(p_type) END AS tag,
 CASE WHEN s_suppkey % 3 = 0 THEN p_size * 10.0 END AS pumping, p_size / 50.0 AS eff, CASE WHEN s_suppkey % 5 > 0 THEN p_size * 2.0 END AS cost FROM supplier s JOIN part ON p_partkey = s_suppkey)
 SELECT 'gen.' || tag || '.agg.' || rc || '.' || kv AS id, agg, country, tag, CAST(sum(CAST(s_acctbal AS {M2})) AS DOUBLE) AS capacity, CAST(coalesce(sum(CAST(pumping AS {M2})), 0) AS DOUBLE) AS pumping, count(*) AS n,
 round(sum(CASE WHEN s_acctbal <> 0 THEN eff * s_acctbal END) / nullif(sum(CASE WHEN s_acctbal <> 0 THEN s_acctbal END), 0), 5) AS efficiency,
 round(sum(CASE WHEN s_acctbal <> 0 AND cost IS NOT NULL THEN cost * s_acctbal END) / nullif(sum(CASE WHEN s_acctbal <> 0 AND cost IS NOT NULL THEN s_acctbal END), 0), 5) AS variable_cost,
 round(coalesce(sum(CASE WHEN pumping <> 0 THEN eff * pumping END) / nullif(sum(CASE WHEN pumping <> 0 THEN pumping END), 0), sum(CASE WHEN s_acctbal <> 0 THEN eff * s_acctbal END) / nullif(sum(CASE WHEN s_acctbal <> 0 THEN s_acctbal END), 0)), 5) AS pumping_efficiency
 FROM g JOIN bus ON s_nationkey = n_nationkey GROUP BY tag, rc, kv, agg, country""")
def rollup_generation(spark, d):
    rows = table(spark, d, "supplier").join(table(spark, d, "part"), F.col("p_partkey") == F.col("s_suppkey"))
    size, s = F.col("p_size").cast("double"), F.col("s_suppkey")
    rows = rows.select(key("bus", "s_nationkey").alias("bus"), "p_type", F.lit("other").alias("bucket"), F.col("s_acctbal").alias("capacity"), F.lit(None).cast("double").alias("potential"), F.when(s % 3 == 0, size * 10).alias("pumping"), (size / 50).alias("efficiency"), F.when(s % 5 > 0, size * 2).alias("variable_cost"), (size / 50).alias("pumping_efficiency"))
    out = rollup.rolled_generation(rollup.member(rows, rollup.bus_map(buses(spark, d)), F.col("p_type"), _GROUPS))
    return out.select("id", "agg", "country", "tag", "capacity", "pumping", "n", *(F.round(c, 5).alias(c) for c in ("efficiency", "variable_cost", "pumping_efficiency")))


@query(f"""WITH {_BUS}, m AS (SELECT c.*, bus.*, CASE WHEN c_custkey % 2 = 0 THEN 3.0 END AS charging, c_custkey % 9 / 10.0 AS eff FROM customer c JOIN bus ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING')
 SELECT 'storage.unit.agg.' || rc || '.' || kv AS id, agg, country, CAST(sum(CAST(c_acctbal AS {M2})) AS DOUBLE) AS energy, CAST(sum(CAST(c_acctbal * 2 AS {M2})) AS DOUBLE) AS power, count(*) AS n,
 CAST(nullif(coalesce(sum(CAST(charging AS {M2})), 0), 0) AS DOUBLE) AS charging, round(sum(CASE WHEN charging <> 0 THEN eff * charging END) / sum(CASE WHEN charging <> 0 THEN charging END), 5) AS charging_efficiency,
 round(sum(CASE WHEN c_acctbal <> 0 THEN eff * c_acctbal * 2 END) / nullif(sum(c_acctbal * 2), 0), 5) AS discharging_efficiency FROM m GROUP BY rc, kv, agg, country""")
def rollup_storage(spark, d):
    rows = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    part = F.col("c_custkey") % 9 / 10
    rows = rows.select(key("bus", "c_nationkey").alias("bus"), F.lit("StorageUnit").alias("entity_class"), F.col("c_acctbal").alias("energy"), (F.col("c_acctbal") * 2).alias("power"), F.when(F.col("c_custkey") % 2 == 0, 3.0).alias("charging"), F.lit(None).cast("double").alias("inflow"), part.alias("charging_efficiency"), part.alias("discharging_efficiency"))
    out = rollup.rolled_storage(rollup.member(rows, rollup.bus_map(buses(spark, d)), F.lit("unit")))
    return out.select("id", "agg", "country", "energy", "power", "n", "charging", *(F.round(c, 5).alias(c) for c in ("charging_efficiency", "discharging_efficiency")))


@query(f"""WITH {_BUS}, br AS (SELECT l_orderkey * 10 + l_linenumber AS id, o_custkey % 30 AS f, l_suppkey % 25 AS t, l_linenumber AS sw FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
 SELECT id, x.agg AS from_node, y.agg AS to_node, CASE WHEN x.agg IS NULL OR y.agg IS NULL THEN 'outside' WHEN sw = 7 THEN 'switched_off' WHEN x.agg = y.agg THEN 'internal' END AS dropped
 FROM br LEFT JOIN bus x ON f = x.n_nationkey LEFT JOIN bus y ON t = y.n_nationkey""")
def remap_branches(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    number = lambda c: F.concat(F.lit("bus."), c.cast("string"))
    rows = rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), number(F.col("o_custkey") % 30).alias("from_bus"), number(F.col("l_suppkey") % 25).alias("to_bus"), F.lit(1).alias("from_on"), F.when(F.col("l_linenumber") == 7, 0).otherwise(1).alias("to_on"))
    return rollup.remapped_branches(rows, rollup.bus_map(buses(spark, d))).select("id", "from_node", "to_node", "dropped")


@query("""WITH RECURSIVE p(node, parent, k) AS (SELECT 'region.' || r_regionkey, NULL, 'region.' || r_regionkey FROM region UNION ALL SELECT 'nation.' || n_nationkey, 'region.' || n_regionkey, 'nation.' || n_nationkey FROM nation
 UNION ALL SELECT 'customer.' || c_custkey, 'nation.' || c_nationkey, 'customer.' || c_custkey FROM customer UNION ALL SELECT 'order.' || o_orderkey, 'customer.' || o_custkey, 'order.' || o_orderkey FROM orders),
 t(node, depth, path) AS (SELECT node, 0, k FROM p WHERE parent IS NULL OR parent NOT IN (SELECT node FROM p) UNION ALL SELECT p.node, t.depth + 1, t.path || '/' || p.k FROM p JOIN t ON p.parent = t.node) SELECT node, depth, path FROM t""")
def asset_tree(spark, d):
    level = lambda name, node, c, parent, up: table(spark, d, name).select(key(node, c).alias("node"), (key(parent, up) if up else F.lit(None).cast("string")).alias("parent"), key(node, c).alias("key"))
    levels = [("region", "region", "r_regionkey", "", ""), ("nation", "nation", "n_nationkey", "region", "n_regionkey"), ("customer", "customer", "c_custkey", "nation", "c_nationkey"), ("orders", "order", "o_orderkey", "customer", "o_custkey")]
    return navigation.tree(readers.union_all([level(*x) for x in levels]))


# profiles


def hourly(spark, d) -> DataFrame:
    """Event values by type and hour of the day."""
    rows = table(spark, d, "events").select(F.col("event_type").alias("profile_id"), F.hour("ts").alias("t"), F.col("value").cast("decimal(18,2)").alias("value"))
    return rows.groupBy("profile_id", "t").agg(F.sum("value").cast("double").alias("value"))


_HOURLY = f"hourly AS (SELECT event_type AS profile_id, CAST(hour(ts) AS INTEGER) AS t, CAST(sum(CAST(value AS {M2})) AS DOUBLE) AS value FROM events GROUP BY 1, 2)"


@query(f"WITH {_HOURLY} SELECT profile_id, t, round(value / sum(value) OVER (PARTITION BY profile_id), 9) AS value FROM hourly")
def normalize_profile(spark, d):
    return profiles.normalised(hourly(spark, d)).withColumn("value", F.round("value", 9))


@query(f"WITH {_HOURLY} SELECT profile_id, t, round(-value / abs(sum(-value) OVER (PARTITION BY profile_id)), 9) AS value FROM hourly")
def normalize_profile_neg(spark, d):
    return profiles.normalised(hourly(spark, d).withColumn("value", -F.col("value")), negative=True).withColumn("value", F.round("value", 9))


@query(f"""WITH {_HOURLY} SELECT 'all' AS profile_id, t, round(sum(value * length(profile_id)) / (SELECT sum(length(profile_id)) FROM (SELECT DISTINCT profile_id FROM hourly)), 6) AS value FROM hourly GROUP BY t""")
def aggregate_profile_weighted(spark, d):
    rows = hourly(spark, d)
    members = rows.select("profile_id").distinct().select(F.lit("all").alias("group_id"), "profile_id", F.length("profile_id").cast("double").alias("weight"))
    return profiles.combined(rows, members).withColumn("value", F.round("value", 6))


@query(f"WITH {_HOURLY} SELECT profile_id, round(sum(value), 2) AS annual FROM hourly GROUP BY 1")
def annual_energy(spark, d):
    return profiles.annual(hourly(spark, d)).withColumn("annual", F.round("annual", 2))


@query("""SELECT p_partkey, CAST(t AS INTEGER) AS t, CASE t WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 1 THEN p_retailprice ELSE 0 END AS value FROM part, range(3) r(t)""")
def unpivot_hours(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("0"), F.col("p_retailprice").alias("1"), F.col("p_name").alias("2"))
    return profiles.from_hours(rows, ["p_partkey"], ["0", "1", "2"])


@query("""WITH n AS (SELECT 'profile.' || c_nationkey AS profile_id, count(*) AS k, CASE WHEN c_nationkey % 2 = 0 THEN 72 ELSE 48 END AS n FROM customer GROUP BY c_nationkey),
 s AS (SELECT profile_id, n, CAST(t AS INTEGER) AS t, CAST(t * k AS DOUBLE) AS value FROM n, range(96) r(t) WHERE t < n)
 SELECT profile_id, t, value FROM s UNION ALL SELECT profile_id, CAST(t + 24 AS INTEGER), value FROM s WHERE n = 72 AND t >= 48""")
def pad_last_day(spark, d):
    counts = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("k"))
    steps = F.explode(F.sequence(F.lit(0), F.when(F.col("c_nationkey") % 2 == 0, 71).otherwise(47)))
    rows = counts.select(key("profile", "c_nationkey").alias("profile_id"), "k", steps.alias("t")).select("profile_id", "t", (F.col("t") * F.col("k")).cast("double").alias("value"))
    return profiles.padded(rows, ["profile_id"], 96)


@query(f"WITH {_HOURLY} SELECT p.profile_id, CAST(t AS INTEGER) AS t, coalesce(h.value, 0) AS value FROM (SELECT DISTINCT profile_id FROM hourly) p CROSS JOIN range(26) r(t) LEFT JOIN hourly h USING (profile_id, t)")
def complete_axis(spark, d):
    return profiles.on_axis(hourly(spark, d), 26).select("profile_id", "t", "value")


# pipelines


@query("""WITH o AS (SELECT o_orderkey, o_custkey, year(o_orderdate) AS y FROM orders), w AS (SELECT *, coalesce(max(CASE WHEN y <= 1997 THEN y END) OVER (PARTITION BY o_custkey), min(y) OVER (PARTITION BY o_custkey)) AS k FROM o)
 SELECT o_orderkey, o_custkey, CAST(y AS INTEGER) AS y FROM w WHERE y = k""")
def carry_forward_year(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))
    return etl.carry_forward(rows, ["o_custkey"], "y", 1997)


@query(f"SELECT s_suppkey, CAST(CAST(s_acctbal AS {M2}) + coalesce(q, 0) AS DOUBLE) AS v FROM supplier LEFT JOIN (SELECT l_suppkey, sum(CAST(l_quantity AS {M2})) AS q FROM lineitem WHERE l_linenumber = 7 GROUP BY 1) ON s_suppkey = l_suppkey")
def ntc_increment(spark, d):
    base = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").cast(M2).alias("v"))
    more = table(spark, d, "lineitem").where("l_linenumber = 7").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_quantity").cast(M2).alias("v"))
    return etl.with_increments(base, more, ["s_suppkey"], "v").select("s_suppkey", F.col("v").cast("double").alias("v"))


@query(f"SELECT k, CAST(sum(v) AS DOUBLE) AS v FROM (SELECT s_nationkey AS k, CAST(s_acctbal AS {M2}) AS v FROM supplier UNION ALL SELECT c_nationkey, CAST(c_acctbal AS {M2}) FROM customer) GROUP BY 1")
def union_then_sum(spark, d):
    parts = [table(spark, d, t).select(F.col(f"{p}_nationkey").alias("k"), F.col(f"{p}_acctbal").cast(M2).alias("v")) for t, p in (("supplier", "s"), ("customer", "c"))]
    return etl.summed_union(parts, ["k"], "v").withColumn("v", F.col("v").cast("double"))


@query("SELECT c_custkey, c_mktsegment || printf('.%02d', row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey)) AS new_id FROM customer")
def counter_ids(spark, d):
    return etl.numbered(table(spark, d, "customer"), ["c_mktsegment", "c_nationkey"], "c_custkey", F.col("c_mktsegment")).select("c_custkey", "new_id")


@query("SELECT count(*) AS entities, (SELECT count(*) FROM customer WHERE c_acctbal >= 0) AS relations FROM (SELECT 1 FROM supplier UNION ALL SELECT 1 FROM nation UNION ALL SELECT 1 FROM region UNION ALL SELECT 1 FROM part UNION ALL SELECT 1 FROM customer WHERE c_acctbal >= 0)")
def prune_without_inflow(spark, d):
    gone = table(spark, d, "customer").where("c_acctbal < 0").select(key("load", "c_custkey").alias("entity_id"))
    m = etl.pruned(star_model(spark, d), gone)
    n = m.rel.where("entity_class = 'DemandUnit'").agg(F.count("*").alias("relations"))
    return m.entity.agg(F.count("*").alias("entities")).join(n)


@query("SELECT bus, coalesce(CASE WHEN kv > 1 THEN kv END, line_kv, kv) AS kv FROM (SELECT n_nationkey AS bus, CASE WHEN n_nationkey % 3 = 0 THEN 380.0 ELSE 0.4 END::DOUBLE AS kv FROM nation) LEFT JOIN (SELECT s_nationkey AS bus, arg_min(CASE WHEN s_suppkey % 2 = 0 THEN 220.0 ELSE 110.0 END::DOUBLE, s_suppkey) AS line_kv FROM supplier GROUP BY 1) USING (bus)")
def voltage_from_lines(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("bus"), F.when(F.col("n_nationkey") % 3 == 0, 380.0).otherwise(0.4).alias("kv"))
    lines = table(spark, d, "supplier").select(F.col("s_nationkey").alias("from_bus"), F.col("s_nationkey").alias("to_bus"), F.when(F.col("s_suppkey") % 2 == 0, 220.0).otherwise(110.0).alias("kv"), F.col("s_suppkey").alias("seq"))
    return etl.bus_voltages(rows, lines)


@query("SELECT p_partkey, CASE WHEN abs(p_size * 10 - 110) <= abs(p_size * 10 - 220) THEN 110.0 WHEN abs(p_size * 10 - 220) <= abs(p_size * 10 - 380) THEN 220.0 ELSE 380.0 END::DOUBLE AS kv FROM part")
def nearest_voltage(spark, d):
    return table(spark, d, "part").select("p_partkey", numbers.nearest(F.col("p_size") * 10, [380.0, 110.0, 220.0]).alias("kv"))


@query("SELECT p_partkey, round(p_size / 1444.0, 9) AS r, round(p_retailprice / 1444.0, 9) AS x, round(p_size * 1e-6 * 1444.0, 9) AS b FROM part")
def branch_per_unit(spark, d):
    r, x, b = numbers.to_per_unit(F.col("p_size").cast("double"), F.col("p_retailprice"), F.col("p_size") * F.lit(1e-6), F.lit(380.0), 100.0)
    return table(spark, d, "part").select("p_partkey", F.round(r, 9).alias("r"), F.round(x, 9).alias("x"), F.round(b, 9).alias("b"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'transformer' ELSE 'line' END AS kind FROM part")
def branch_kind(spark, d):
    return table(spark, d, "part").select("p_partkey", F.when(etl.is_transformer(F.when(F.col("p_size") % 3 == 0, 1.05).otherwise(1.0)), "transformer").otherwise("line").alias("kind"))


# scalars


@query("""SELECT p_partkey, trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '.', 'g'), '.') AS tag, regexp_replace(lower(p_name), '[ -]+', '_', 'g') AS slug,
 trim(regexp_replace(lower(p_brand), '[^-a-z0-9._/]+', '-', 'g'), '-') AS slug_name, regexp_replace(lower(p_brand || '.' || p_type), '^[^.]*\\.', '') AS code FROM part""")
def identifier_functions(spark, d):
    code = F.concat_ws(".", "p_brand", "p_type")
    return table(spark, d, "part").select("p_partkey", text.id_tag(F.col("p_name")).alias("tag"), text.slugify(F.col("p_name")).alias("slug"), text.slug_name(F.col("p_brand")).alias("slug_name"), text.normalize_code(code).alias("code"))


@query("SELECT p_partkey, p_type FROM part WHERE lower(p_type) LIKE 'econ%' OR lower(p_type) LIKE 'pro__'")
def glob_match(spark, d):
    c = F.col("p_type")
    return table(spark, d, "part").where(text.technology_matches(c, "econ*") | text.technology_matches(c, "PRO??")).select("p_partkey", "p_type")


@query("SELECT p_partkey, CASE WHEN lower(p_type) = 'medium' THEN 'mid' WHEN lower(p_type) = 'large' THEN 'large' WHEN lower(p_type) LIKE 'econ%' THEN 'eco' WHEN lower(p_type) LIKE 'm%' THEN 'mid' ELSE p_type END AS grp FROM part")
def longest_pattern_wins(spark, d):
    return table(spark, d, "part").select("p_partkey", text.longest_pattern(F.col("p_type"), _GROUPS).alias("grp"))


@query("""SELECT n_nationkey, c, left(c, length(c) - 1) AS nuts2, left(c, length(c) - 2) AS nuts1, left(c, 2) AS country FROM (SELECT n_nationkey, lower(substr(r_name, 1, 2)) || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS c
 FROM nation JOIN region ON n_regionkey = r_regionkey) WHERE left(c, 2) = 'af' OR starts_with(c, 'as01')""")
def region_levels(spark, d):
    c = F.col("nuts3")
    return buses(spark, d).where(text.selected_region(c, ["af", "as01"])).select("n_nationkey", c.alias("c"), *(text.nuts_level(c, level).alias(level) for level in ("nuts2", "nuts1", "country")))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_attr_parse(spark, d):
    return table(spark, d, "events").select("event_id", numbers.to_long(F.get_json_object("props", "$.k")).alias("k"))


@query("SELECT event_id, CASE WHEN event_id % 3600 = 0 THEN 'PT' || event_id // 3600 || 'H' WHEN event_id % 60 = 0 THEN 'PT' || event_id // 60 || 'M' ELSE 'PT' || event_id || 'S' END AS step FROM events WHERE event_id > 0")
def iso_durations(spark, d):
    return table(spark, d, "events").where("event_id > 0").select("event_id", numbers.iso_duration(F.col("event_id")).alias("step"))


# sets and exports


@query("SELECT s_nationkey AS k, 'both' AS side FROM supplier WHERE s_acctbal > 8000 INTERSECT SELECT c_nationkey, 'both' FROM customer WHERE c_acctbal > 9500 UNION ALL (SELECT s_nationkey, 'only' FROM supplier WHERE s_acctbal > 8000 EXCEPT SELECT c_nationkey, 'only' FROM customer WHERE c_acctbal > 9500)")
def set_operations(spark, d):
    a = table(spark, d, "supplier").where("s_acctbal > 8000").select(F.col("s_nationkey").alias("k"))
    return reports.both_and_only(a, table(spark, d, "customer").where("c_acctbal > 9500").select("c_nationkey"))


@query("SELECT 'gen.' || s_suppkey AS entity_id, s_name AS name, 'node.' || s_nationkey AS \"atNode\", CASE WHEN s_acctbal > 5000 THEN 'tech.' || s_suppkey END AS \"hasTechnology\" FROM supplier")
def export_wide_pivot(spark, d):
    return writers.wide_rows(star_model(spark, d), "GenerationUnit", ["name", "atNode", "hasTechnology"])


@query("""SELECT 'node.' || n_nationkey AS entity_id, 'name' AS attribute_id, n_name AS attribute_value, NULL::VARCHAR AS relation_type, NULL::VARCHAR AS relation_id FROM nation
 UNION ALL SELECT 'node.' || n_nationkey, NULL, NULL, 'belongsToGeographicalRegion', 'region.' || n_regionkey FROM nation""")
def export_long(spark, d):
    rows = writers.long_rows(star_model(spark, d)).where("entity_class = 'NetworkNode'")
    return rows.select("entity_id", "attribute_id", "attribute_value", "relation_type", "relation_id")


@query("SELECT 'node.' || n_nationkey AS entity_id, 'name' AS attribute, n_name AS value, NULL::VARCHAR AS relation FROM nation UNION ALL SELECT 'node.' || n_nationkey, NULL, 'region.' || n_regionkey, 'belongsToGeographicalRegion' FROM nation")
def export_narrow(spark, d):
    return writers.narrow_rows(star_model(spark, d)).where("entity_class = 'NetworkNode'").drop("entity_class")


@query("SELECT 'gen.' || s_suppkey AS entity_id, CASE WHEN s_suppkey % 2 = 0 THEN 'renamed' ELSE s_name END AS name FROM supplier")
def upsert_attributes(spark, d):
    from .model import attribute_rows

    m = star_model(spark, d)
    new = table(spark, d, "supplier").where("s_suppkey % 2 = 0").withColumn("name", F.lit("renamed"))
    m = mutation.set_attributes(m, attribute_rows(new, "GenerationUnit", key("gen", "s_suppkey"), {"name": "name"}))
    return navigation.wide(m, "GenerationUnit", ["name"], number=False).select("entity_id", "name")


def _written(spark, d):
    """Values for customers and parts, of which some break a rule."""
    c, p = table(spark, d, "customer"), table(spark, d, "part")
    none, k = F.lit(None).cast("string"), F.col("c_custkey")
    load, text_ = key("load", "c_custkey"), lambda x: F.col(x).cast("string")
    row = lambda t, id_, name, value, unit=none: t.select(id_.alias("entity_id"), F.lit(name).alias("attribute_id"), value.alias("value_str"), unit.alias("unit"))
    parts = [
        row(c, load, "segment", F.col("c_mktsegment")),
        row(c.where("c_custkey % 11 = 0"), load, "label", F.concat(F.lit("x"), text_("c_custkey"))),
        row(c, load, "annual_energy_demand", F.replace(text_("c_acctbal"), F.lit("."), F.lit(",")), F.when(k % 5 == 0, "kg")),
        row(c.where("c_custkey % 7 = 0"), load, "colour", F.lit("red")),
        row(c.where("c_custkey % 13 = 0"), key("lost", "c_custkey"), "segment", F.lit("BUILDING")),
        row(p.where("p_partkey % 4 < 2"), key("tech", "p_partkey"), "brand", F.when(F.col("p_partkey") % 4 == 0, F.concat("p_brand", F.lit("x"))).otherwise("Brand#5")),
    ]
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.union(x)
    return mutation.write_attributes(star_model(spark, d), rows)


@query("""SELECT 'load.' || c_custkey AS entity_id, 'segment' AS field_id, 'enum' AS rule, 'reported' AS policy FROM customer WHERE c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD')
 UNION ALL SELECT 'load.' || c_custkey, 'label', 'type', 'rejected' FROM customer WHERE c_custkey % 11 = 0 UNION ALL SELECT 'load.' || c_custkey, 'annual_energy_demand', 'minimum', 'reported' FROM customer WHERE c_acctbal < 0
 UNION ALL SELECT 'load.' || c_custkey, 'annual_energy_demand', 'unit', 'rejected' FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT 'load.' || c_custkey, 'colour', 'field', 'rejected' FROM customer WHERE c_custkey % 7 = 0
 UNION ALL SELECT 'lost.' || c_custkey, 'segment', 'entity', 'rejected' FROM customer WHERE c_custkey % 13 = 0 UNION ALL SELECT 'tech.' || p_partkey, 'brand', 'pattern', 'rejected' FROM part WHERE p_partkey % 4 = 0""")
def written_violations(spark, d):
    return _written(spark, d)[1].select("entity_id", "field_id", "rule", "policy")


@query("""SELECT 'load.' || c_custkey AS entity_id, 'annual_energy_demand' AS attribute_id, NULL AS text, c_acctbal AS number, CASE WHEN c_custkey % 5 > 0 THEN 'MWh' END AS unit FROM customer
 UNION ALL SELECT 'tech.' || p_partkey, 'brand', CASE WHEN p_partkey % 4 = 1 THEN 'Brand#5' ELSE p_brand END, NULL, NULL FROM part UNION ALL SELECT 'load.' || c_custkey, 'segment', c_mktsegment, NULL, NULL FROM customer""")
def written_values(spark, d):
    rows = _written(spark, d)[0].attr.where("attribute_id IN ('annual_energy_demand', 'brand', 'segment')")
    return rows.select("entity_id", "attribute_id", F.when(F.col("attribute_id") != "annual_energy_demand", F.col("value_str")).alias("text"), F.col("value_num").alias("number"), "unit")


@query("SELECT entity_id FROM (SELECT 'lib.tech.' || p_partkey AS entity_id FROM part WHERE p_size > 25)")
def import_library_namespaced(spark, d):
    m = star_model(spark, d)
    ids = table(spark, d, "part").where("p_size > 25").select(key("tech", "p_partkey").alias("entity_id"))
    cut = lambda t: t.join(ids, "entity_id", "left_semi").select(*t.columns)
    out = mutation.import_library(m, m.but(entity=cut(m.entity), attr=cut(m.attr), rel=cut(m.rel)), "lib")
    return out.entity.where("entity_id like 'lib.%'").select("entity_id")


# events


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def tumbling_event_counts(spark, d):
    return events.tumbling(table(spark, d, "events"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
 s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_events(spark, d):
    return events.sessions(table(spark, d, "events"))


@query("""SELECT e.event_id, (SELECT arg_max(p.value, p.ts) FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.ts <= e.ts) AS latest_value FROM events e WHERE e.event_type = 'click'""")
def as_of_join(spark, d):
    rows = table(spark, d, "events")
    left = rows.where("event_type = 'click'").select("event_id", "user_id", "ts")
    return events.as_of(left, rows.where("event_type = 'purchase'").select("user_id", "ts", "value"), "user_id", "ts", "value", blocks=8).select("event_id", "latest_value")


@query("SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events")
def running_number(spark, d):
    return events.numbered(table(spark, d, "events").select("user_id", "ts", "event_id"), "user_id", ["ts", "event_id"], blocks=8)


# the energy model: places, links, countries, parts


@query(f"""WITH {_ENERGY} SELECT 'gen.' || s_suppkey AS entity_id, country FROM g UNION ALL SELECT id, country FROM res UNION ALL SELECT 'store.' || c_custkey, country FROM c WHERE c_custkey % 50 = 1
 UNION ALL SELECT 'load.' || c_custkey, country FROM c WHERE c_custkey % 50 > 1""")
def asset_countries(spark, d):
    rows = country.asset_countries(energy_model(spark, d))
    return rows.where(F.split_part("entity_id", F.lit("."), F.lit(1)).isin("gen", "res", "store", "load"))


@query(f"WITH {_ENERGY} SELECT 'gen.' || s_suppkey AS entity_id, tech AS technology FROM g")
def technology_labels(spark, d):
    return country.labelled(energy_model(spark, d), ["generator_technology_type"]).where("entity_id LIKE 'gen.%'")


@query(f"WITH {_ENERGY} SELECT 'gen.' || s_suppkey AS entity_id, CASE WHEN s_suppkey % 7 = 0 THEN 'tech.' || s_suppkey ELSE class END AS technology FROM g")
def technology_ids(spark, d):
    return country.technology_ids(energy_model(spark, d)).where("entity_id LIKE 'gen.%'")


@query(f"""WITH {_ENERGY}, t AS (SELECT country, CASE s_suppkey % 5 WHEN 0 THEN 'wind_onshore' WHEN 1 THEN 'solar_pv' END AS category, s_acctbal * 2 AS v FROM g WHERE variable UNION ALL SELECT country, 'reservoir_natural_inflow', c_acctbal * 2 FROM res)
 SELECT country, category, CAST(sum(CAST(v AS {M2})) AS DOUBLE) AS total FROM t WHERE category IS NOT NULL GROUP BY 1, 2""")
def renewable_energy_by_country(spark, d):
    return country.renewable_energy(energy_model(spark, d))


@query(f"""WITH {_ENERGY}, t AS (SELECT country, CASE WHEN variable THEN 'nondispatchable_capacity_mw' ELSE 'dispatchable_capacity_mw' END AS category, tech AS technology, s_acctbal AS v FROM g WHERE NOT hydro
 UNION ALL SELECT country, 'nondispatchable_annual_resource_potential_mwh', tech, s_acctbal * 2 FROM g WHERE variable AND s_acctbal <> 0
 UNION ALL SELECT country, CASE WHEN s_suppkey % 9 = 0 THEN 'hydro_reversible_discharge_capacity_mw' ELSE 'hydro_turbine_discharge_capacity_mw' END, NULL, s_acctbal FROM g WHERE hydro
 UNION ALL SELECT country, 'hydro_reversible_charge_capacity_mw', NULL, 10 FROM g WHERE s_suppkey % 9 = 0
 UNION ALL SELECT country, 'storage_energy_capacity_mwh', 'StorageUnit', c_acctbal FROM c WHERE c_custkey % 50 = 1 UNION ALL SELECT country, 'storage_discharge_capacity_mw', 'StorageUnit', 5 FROM c WHERE c_custkey % 50 = 1
 UNION ALL SELECT country, 'storage_charge_capacity_mw', 'StorageUnit', 0 FROM c WHERE c_custkey % 50 = 1
 UNION ALL SELECT country, 'reservoir_capacity_mwh', NULL, c_acctbal FROM res UNION ALL SELECT country, 'reservoir_inflow_mwh', NULL, c_acctbal * 2 FROM res
 UNION ALL SELECT country, 'demand_annual_energy_mwh', NULL, c_acctbal FROM c WHERE c_custkey % 50 > 1)
 SELECT country, category, technology, CAST(sum(CAST(v AS {M2})) AS DOUBLE) AS total FROM t GROUP BY 1, 2, 3""")
def totals_of_twelve_categories(spark, d):
    return country.totals_by_country(energy_model(spark, d))


@query(f"WITH {_ENERGY} SELECT 'gen.' || s_suppkey AS entity_id FROM g WHERE s_suppkey % 9 = 0")
def pumped_generators(spark, d):
    return country.pumped_generators(energy_model(spark, d))


@query(f"WITH {_ENERGY} SELECT bus, code FROM b")
def bus_codes(spark, d):
    return country.bus_codes(energy_model(spark, d))


@query(f"WITH {_ENERGY} SELECT country, count(*) AS n FROM b GROUP BY 1")
def buses_by_country(spark, d):
    return country.buses_by_country(country.bus_codes(energy_model(spark, d)))


@query(f"WITH {_ENERGY} SELECT s AS selector, EXISTS (SELECT 1 FROM b WHERE starts_with(code, s)) AS valid FROM (VALUES ('al'), ('xx'), ('br00'), ('ge9')) t(s)")
def checked_selectors(spark, d):
    return country.checked_selectors(country.bus_codes(energy_model(spark, d)), ["AL", "xx", "nuts2.br00", "ge9"])


@query("SELECT 'profile.' || n_nationkey AS profile_id, CASE WHEN n_nationkey % 3 = 0 THEN 'file:/' || n_nationkey END AS data_reference FROM nation")
def profile_references(spark, d):
    return country.profile_references(energy_model(spark, d))


@query(f"""WITH {_ENERGY} SELECT 'gen.' || s_suppkey AS entity_id, 'profile.' || s_nationkey AS profile FROM g WHERE variable
 UNION ALL SELECT 'load.' || c_custkey, 'profile.' || c_nationkey FROM c WHERE c_custkey % 50 > 1 AND c_custkey % 3 = 0""")
def profile_links(spark, d):
    return navigation.profile_links(energy_model(spark, d))


@query(f"WITH {_ENERGY} SELECT 'line.' || o_orderkey AS entity_id, x.bus AS from_node, y.bus AS to_node FROM orders JOIN b x ON x.n_nationkey = o_custkey % 25 LEFT JOIN b y ON y.n_nationkey = o_orderkey % 30")
def branch_ends(spark, d):
    return navigation.branch_ends(energy_model(spark, d))


@query("""SELECT 'gen.' || s_suppkey AS asset, 'GenerationResult' AS entity_class, 'total_generation' AS attribute_id, s_acctbal AS value FROM supplier WHERE s_suppkey % 8 = 0
 UNION ALL SELECT 'gen.' || s_suppkey, 'PeakResult', 'peak_output', s_acctbal FROM supplier WHERE s_suppkey % 24 = 0""")
def results_of_assets(spark, d):
    return navigation.results_of(energy_model(spark, d)).withColumn("value", F.col("value").cast("double"))


@query(f"""WITH {_ENERGY}, kept AS (SELECT 'ElectricalBus' AS entity_class, bus AS id FROM b WHERE n_nationkey < 10 UNION SELECT 'GeographicalRegion', code FROM b WHERE n_nationkey < 10 AND n_nationkey % 2 = 0
 UNION SELECT class, 'gen.' || s_suppkey FROM g WHERE s_nationkey < 10 UNION SELECT 'StorageUnit', CAST(c_custkey AS VARCHAR) FROM c WHERE c_custkey % 50 = 1 AND c_nationkey < 10 UNION SELECT 'DemandUnit', CAST(c_custkey AS VARCHAR) FROM c WHERE c_custkey % 50 > 1 AND c_nationkey < 10
 UNION SELECT 'HydraulicStorageUnit', id FROM res WHERE id IN (SELECT 'res.' || (s_suppkey % 4 * 50 + 50) FROM g WHERE hydro AND NOT variable AND s_nationkey < 10)
 UNION SELECT 'TransmissionLine', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_custkey % 25 < 10 AND o_orderkey % 30 < 10
 UNION SELECT 'Profile', CAST(s_nationkey AS VARCHAR) FROM g WHERE variable AND s_nationkey < 10 UNION SELECT 'Profile', CAST(c_nationkey AS VARCHAR) FROM c WHERE c_custkey % 50 > 1 AND c_custkey % 3 = 0 AND c_nationkey < 10)
 SELECT entity_class, count(*) AS kept FROM kept GROUP BY 1""")
def subset_of_buses(spark, d):
    m = energy_model(spark, d)
    chosen = table(spark, d, "nation").where("n_nationkey < 10").select("n_nationkey")
    part = country.bus_codes(m).join(chosen, F.substring_index("bus", ".", -1).cast("int") == F.col("n_nationkey"), "left_semi")
    return subset.dropped_counts(m, part).where("kept > 0").select("entity_class", "kept")


# the energy model: rules, exports


@query(f"""WITH {_ENERGY} SELECT 'gen.' || s_suppkey AS entity_id, 'total_generation' AS field_id, CASE WHEN hydro OR s_suppkey % 4 > 0 THEN 'unresolved' WHEN s_suppkey % 8 > 0 THEN 'required' ELSE 'minimum' END AS rule FROM g
 WHERE hydro OR s_suppkey % 8 > 0 OR s_acctbal < 0 UNION ALL SELECT 'gen.' || s_suppkey, 'gain', CASE WHEN s_suppkey % 5 > 0 THEN 'unresolved' ELSE 'required' END FROM g WHERE s_suppkey % 10 > 0""")
def validate_linked(spark, d):
    checks = [{"attribute": "total_generation", "constraints": {"minimum": 0}}, {"attribute": "gain", "view_family": "avr"}]
    profile = {"requirements": [{"entity_class": "GenerationUnit", "checks": checks}]}
    return validation.validate_for_analysis(energy_model(spark, d), profile).select("entity_id", "field_id", "rule")


@query("""WITH n AS (SELECT 'GenerationResult' AS view, count(*) AS n FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT 'PeakResult', count(*) FROM supplier WHERE s_suppkey % 24 = 0)
 SELECT class_name, view, n FROM (VALUES ('GenerationUnit', 'GenerationResult'), ('HydroGenerationUnit', 'GenerationResult'), ('HydroGenerationUnit', 'PeakResult')) t(class_name, view) JOIN n USING (view)""")
def view_map(spark, d):
    m = energy_model(spark, d)
    return _with_counts(m, validation.view_map(m), "view")


@query("SELECT 'gen.' || s_suppkey AS entity_id, 'result.' || s_suppkey AS linked FROM supplier WHERE s_suppkey % 4 = 0")
def linked_results(spark, d):
    return validation.linked_entities(energy_model(spark, d), "dispatch")


@query("SELECT c_custkey FROM customer WHERE c_acctbal < c_nationkey * 1.0 OR (5000 <= c_acctbal AND c_nationkey <> c_custkey)")
def analysis_when_two_names(spark, d):
    rows, fields = _customers(spark, d)
    return rows.where(conditions.compiled("c_acctbal < c_nationkey or (5000 <= c_acctbal and c_nationkey != c_custkey)", fields)).select("c_custkey")


@query(f"""WITH {_ENERGY} SELECT 'NetworkNode' AS all_class, bus AS entity_id, 'ElectricalBus' AS entity_class, n_name AS name FROM b JOIN nation USING (n_nationkey)
 UNION ALL SELECT 'Controller', 'avr.' || s_suppkey, 'SimpleController', '' FROM supplier WHERE s_suppkey % 5 = 0""")
def union_tables(spark, d):
    return writers.union_tables(energy_model(spark, d))


@query("""SELECT 'gen.' || s_suppkey AS entity_id, CASE WHEN s_suppkey % 14 = 0 THEN 'carrier.own' ELSE 'carrier.electricity' END AS target_id FROM supplier WHERE s_suppkey % 14 = 0 OR (s_suppkey % 7 = 0 AND s_suppkey IN (SELECT p_partkey FROM part))""")
def type_denormalised(spark, d):
    m = writers.with_type_relations(energy_model(spark, d))
    return m.rel.where("relation_id = 'hasOutputCarrier' AND entity_id LIKE 'gen.%'").select("entity_id", "target_id")


@query(f"""WITH {_ENERGY} SELECT 'result.' || s_suppkey AS entity_id, 'gen.' || s_suppkey AS reported_on, CASE WHEN s_suppkey % 8 = 0 THEN 1 ELSE 0 END AS n FROM g WHERE s_suppkey % 4 = 0 UNION ALL SELECT bus, NULL, 1 FROM b""")
def hierarchical_bodies(spark, d):
    rows = hierarchical.bodies(energy_model(spark, d)).where("entity_class IN ('GenerationResult', 'ElectricalBus')")
    return rows.select("entity_id", "reported_on", F.coalesce(F.size(F.map_keys("attributes")), F.lit(0)).alias("n"))


@query(f"""WITH {_ENERGY}, t AS (SELECT 'ElectricalBus' AS entity_class, count(*) AS n FROM b UNION ALL SELECT class, count(*) FROM g GROUP BY 1 UNION ALL SELECT 'DemandUnit', count(*) FROM c WHERE c_custkey % 50 > 1)
 SELECT entity_class, n AS created, CASE entity_class WHEN 'ElectricalBus' THEN n WHEN 'DemandUnit' THEN n ELSE 0 END AS attributes FROM t""")
def import_counts(spark, d):
    m = energy_model(spark, d)
    none = m.but(**{t: getattr(m, t).limit(0) for t in ("entity", "attr", "rel")})
    part = m.but(attr=m.attr.where("entity_class IN ('ElectricalBus', 'DemandUnit')"))
    return readers.import_counts(none, part).where("entity_class IN ('ElectricalBus', 'GenerationUnit', 'HydroGenerationUnit', 'DemandUnit')").select("entity_class", "created", "attributes")


@query("SELECT 'gen.' || s_suppkey AS entity_id, 'kind' AS attribute_id, CASE WHEN s_suppkey % 2 = 0 THEN 'reversible' ELSE 'turbine' END AS value FROM supplier")
def legacy_rewrites(spark, d):
    from .model import attribute_rows

    m, rows = star_model(spark, d), table(spark, d, "supplier")
    rows = rows.select(key("gen", "s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, True).otherwise(False).alias("is_reversible"), F.lit("turbine").alias("machine_role"))
    m = m.but(attr=attribute_rows(rows, "GenerationUnit", F.col("id"), {"is_reversible": "is_reversible", "machine_role": "machine_role"}))
    m = mutation.without_legacy(mutation.aliased(m, attributes={"machine_role": "hydro_machine_kind"}))
    return mutation.aliased(m, attributes={"hydro_machine_kind": "kind"}).attr.select("entity_id", "attribute_id", F.col("value_str").alias("value"))


@query(f"""WITH {_ENERGY} SELECT 'carrier.' || CASE WHEN s_suppkey % 14 = 0 THEN 'own' END AS entity_id FROM g WHERE s_suppkey % 14 = 0 UNION SELECT 'carrier.electricity' FROM part WHERE p_partkey % 7 = 0""")
def ensured_carriers(spark, d):
    return mutation.ensure_targets(energy_model(spark, d), "hasOutputCarrier", "Carrier").entity.where("entity_class = 'Carrier'").select("entity_id")


@query("SELECT 'tech.' || p_partkey AS entity_id FROM part WHERE p_partkey % 7 = 0 AND p_partkey % 5 = 0")
def library_closure(spark, d):
    m = energy_model(spark, d)
    only = lambda t, keep: t.where(keep)
    library = m.but(entity=only(m.entity, "entity_id LIKE 'tech.%'"), attr=only(m.attr, "entity_id LIKE 'tech.%'"), rel=only(m.rel, "entity_id LIKE 'tech.%'"))
    rest = m.but(entity=only(m.entity, "entity_id NOT LIKE 'tech.%'"))
    wanted = table(spark, d, "part").where("p_partkey % 5 = 0").select(key("tech", "p_partkey").alias("entity_id"))
    return mutation.with_library_closure(rest, library, wanted).entity.where("is_library").select("entity_id")


# classes by name, regions, networks


#: Words that a part's technology is named by, in the order of its key's last digit.
WORDS = ("Hydro.PHS.Closed-Loop", "hydro.open_loop", "Run_of_River", "pondage", "dam", "Hydrogen.FuelCell", "H2 CCGT", "wind", "reversible_francis", "x.ror")


def of_digit(column: str, values: tuple[str, ...]):
    """The value in the place that the key's remainder names."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(column) % len(values) + 1).cast("int"))


@query("""WITH w(k, word, kind, class, machine, stored, inflow, own) AS (VALUES (0, 'Hydro.PHS.Closed-Loop', 'phs_closed_loop', 'HydroGenerationUnit', 'reversible', true, false, NULL), (1, 'hydro.open_loop', 'phs_open_loop', 'HydroGenerationUnit', 'reversible', true, true, NULL),
 (2, 'Run_of_River', 'run_of_river', 'HydroGenerationUnit', 'turbine', false, true, NULL), (3, 'pondage', 'pondage', 'HydroGenerationUnit', 'turbine', true, true, NULL), (4, 'dam', 'reservoir', 'GenerationUnit', 'turbine', true, false, NULL),
 (5, 'Hydrogen.FuelCell', 'hydro', 'GenerationUnit', 'turbine', false, false, 0.55), (6, 'H2 CCGT', 'hydro', 'GenerationUnit', 'turbine', false, false, 0.58), (7, 'wind', 'hydro', 'GenerationUnit', 'turbine', false, false, NULL),
 (8, 'reversible_francis', 'hydro', 'GenerationUnit', 'reversible', false, false, NULL), (9, 'x.ror', 'run_of_river', 'GenerationUnit', 'turbine', false, true, NULL))
 SELECT p_partkey || '.' || word AS name, kind, class, machine, k < 2 AS pumped, stored, inflow, CAST(CASE WHEN p_size % 3 = 2 THEN 0.9 ELSE coalesce(own, 1) END AS DOUBLE) AS efficiency FROM part JOIN w ON p_partkey % 10 = k""")
def technology_classes(spark, d):
    rows = table(spark, d, "part").select(F.concat_ws(".", "p_partkey", of_digit("p_partkey", WORDS)).alias("name"), of_digit("p_size", ("nan", "1", "0.9")).alias("raw"))
    name, none = F.col("name"), F.lit(None)
    kinds = {"kind": classify.storage_kind(name), "class": classify.asset_class(none, name), "machine": classify.machine_kind(name), "efficiency": classify.efficiency(none, name, F.col("raw"))}
    facts = {"pumped": "pumped", "stored": "stored", "inflow": "natural_inflow"}
    return rows.select("name", *(c.alias(n) for n, c in kinds.items()), *(classify.fact(which, name).alias(n) for n, which in facts.items()))


@query("""WITH t AS (SELECT n_nationkey AS k, lower(substr(n_name, 1, 2)) AS c FROM nation) SELECT CASE k % 5 WHEN 0 THEN 'region.country.' || c WHEN 1 THEN 'Country.' || c WHEN 2 THEN 'region.nuts3.' || c || '123' WHEN 3 THEN 'nuts2.' || c || '10' ELSE 'zone.' || c END AS region,
 CASE WHEN k % 5 < 4 THEN upper(c) END AS country, CASE WHEN k % 5 = 2 THEN c || '123' END AS nuts3 FROM t""")
def region_countries(spark, d):
    code, n = F.lower(F.substring("n_name", 1, 2)), "n_nationkey"
    rows = table(spark, d, "nation").select(F.concat(of_digit(n, ("region.country.", "Country.", "region.nuts3.", "nuts2.", "zone.")), code, of_digit(n, ("", "", "123", "10", ""))).alias("region"))
    return rows.select("region", classify.region_country(F.col("region")).alias("country"), classify.region_nuts3(F.col("region")).alias("nuts3"))


_CARRIER = {"ac": "carrier.electricity", "methane": "carrier.fuel.fossil.gas"}


@query("""WITH w(k, word, carrier, domain) AS (VALUES (0, 'AC', 'carrier.electricity', 'domain.electricity'), (1, 'Methane', 'carrier.fuel.fossil.gas', 'domain.gas'), (2, 'H2 -- Hydrogen', 'carrier.h2.hydrogen', 'domain.hydrogen'), (3, ' Waste Heat ', 'carrier.waste.heat', 'domain.heat'),
 (4, 'Peat', 'carrier.peat', 'domain.peat')) SELECT s_suppkey, carrier, domain FROM supplier JOIN w ON s_suppkey % 5 = k""")
def carriers_of_names(spark, d):
    named = of_digit("s_suppkey", ("AC", "Methane", "H2 -- Hydrogen", " Waste Heat ", "Peat"))
    rows = table(spark, d, "supplier").select("s_suppkey", classify.carrier_id(named, _CARRIER).alias("carrier"))
    return rows.select("s_suppkey", "carrier", classify.domain_id(F.col("carrier")).alias("domain"))


@query(f"""WITH {_BUS}, t AS (SELECT CAST(n_nationkey AS VARCHAR) AS k, rc, country FROM bus) SELECT 'region.nuts3.' || upper(rc) || lpad(k, 3, '0') AS entity_id, 'region.nuts2.' || upper(rc) || left(lpad(k, 3, '0'), 2) AS parent, upper(rc) AS iso_country_code FROM t""")
def region_library(spark, d):
    codes = buses(spark, d).select(F.upper("nuts3").alias("NUTS_ID"), F.lit(3).alias("LEVL_CODE"), F.upper(F.left("nuts3", F.lit(2))).alias("CNTR_CODE"), F.lit(None).cast("string").alias("NAME_LATN"))
    return regions.region_rows(codes).select("entity_id", "parent", "iso_country_code")


@query("""SELECT p_partkey AS name FROM part WHERE p_size % 2 = 1 OR p_size % 3 > 0""")
def usable_generators(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("name"), F.when(F.col("p_size") % 2 == 1, "gas").otherwise("solar-hsat").alias("carrier"), (F.col("p_size") % 3).alias("p_nom"))
    return networks.usable_generators(rows).select("name")


# the energy model rolled up


_ROLLED = f"""{_ENERGY}, x AS (SELECT g.*, b.code, CASE g.country WHEN 'AL' THEN 'disaggregated' WHEN 'BR' THEN 'nuts2' ELSE 'country' END AS level, CASE g.country WHEN 'BR' THEN left(code, 4) ELSE left(code, 2) END AS rc,
 regexp_replace(lower(tech), '[^a-z0-9]+', '.', 'g') || CASE WHEN hydro AND s_suppkey % 9 = 0 THEN '.phs' WHEN hydro THEN '.nonphs' ELSE '' END AS tag FROM g JOIN b USING (bus))"""


def _rolled(spark, d, groups=None, **levels):
    m = energy_model(spark, d)
    mapped = rollup.bus_map(rolled_model.model_buses(m), **(levels or {"overrides": {"AL": "disaggregated", "BR": "nuts2"}}))
    return m, mapped, groups


def _generators(m):
    rows = navigation.wide(m, "GenerationUnit", ["nominal_power_capacity", "maximum_pumping_power"])
    kinds = navigation.wide(m, "GenerationUnit", ["dispatch_type"], number=False).select("entity_id", "dispatch_type")
    return rows.join(kinds, "entity_id").join(navigation.asset_nodes(m), "entity_id").select("entity_class", "entity_id", "node", F.round("nominal_power_capacity", 2).alias("capacity"), F.round("maximum_pumping_power", 2).alias("pumping"), "dispatch_type")


_GENERATORS = f""", k AS (SELECT class, id, node, dispatch, count(*) AS n, min(s_suppkey) AS first FROM z GROUP BY ALL), kind AS (SELECT id, dispatch FROM k QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, first) = 1)
 SELECT class AS entity_class, id AS entity_id, node, round(CAST(sum(CAST(s_acctbal AS {M2})) AS DOUBLE), 2) AS capacity, CAST(nullif(count(CASE WHEN s_suppkey % 9 = 0 THEN 1 END), 0) * 10.0 AS DOUBLE) AS pumping, any_value(kind.dispatch) AS dispatch_type FROM z JOIN kind USING (id) GROUP BY ALL"""


@query(f"""WITH {_ROLLED}, z AS (SELECT *, CASE WHEN level = 'disaggregated' THEN 'gen.' || s_suppkey ELSE 'gen.' || tag || '.agg.' || rc END AS id, CASE WHEN level = 'disaggregated' THEN bus ELSE 'node.' || rc END AS node,
 CASE WHEN variable THEN 'nondispatchable' ELSE 'dispatchable' END AS dispatch FROM x){_GENERATORS}""")
def rolled_with_overrides(spark, d):
    return _generators(rolled_model.rolled_model(*_rolled(spark, d)))


@query(f"""WITH {_ROLLED}, z AS (SELECT *, CASE WHEN starts_with(tech, 'wind') THEN 'gen.wind' || CASE WHEN hydro AND s_suppkey % 9 = 0 THEN '.phs' WHEN hydro THEN '.nonphs' ELSE '' END || '.agg.' || substr(bus, 6) ELSE 'gen.' || s_suppkey END AS id, bus AS node,
 CASE WHEN variable THEN 'nondispatchable' ELSE 'dispatchable' END AS dispatch FROM x){_GENERATORS}""")
def rolled_by_pattern(spark, d):
    return _generators(rolled_model.rolled_model(*_rolled(spark, d, {"wind": ["wind*"]}, level="disaggregated")))


@query(f"""WITH {_ROLLED}, place AS (SELECT id, c_acctbal, coalesce(CASE WHEN c_custkey % 150 = 0 THEN res.bus END, fed.first_node) AS bus, coalesce(pumped, false) AS pumped FROM res LEFT JOIN fed USING (id)),
 y AS (SELECT place.*, b.code, b.country, CASE b.country WHEN 'BR' THEN left(code, 4) ELSE left(code, 2) END AS rc FROM place JOIN b USING (bus)), z AS (SELECT *, CASE WHEN country = 'AL' THEN id ELSE 'storage.hydraulicstorageunit.' || CASE WHEN pumped THEN 'phs' ELSE 'nonphs' END || '.agg.' || rc END AS store FROM y)
 SELECT store AS entity_id, round(CAST(sum(CAST(c_acctbal AS {M2})) AS DOUBLE), 2) AS energy, round(CAST(CASE WHEN bool_or(country = 'AL') OR sum(c_acctbal) > 0 THEN sum(CAST(c_acctbal * 2 AS {M2})) END AS DOUBLE), 2) AS inflow FROM z GROUP BY 1""")
def rolled_reservoirs(spark, d):
    m = rolled_model.rolled_model(*_rolled(spark, d))
    rows = navigation.wide(m, "HydraulicStorageUnit", ["energy_storage_capacity", "annual_natural_inflow_energy"])
    return rows.select("entity_id", F.round("energy_storage_capacity", 2).alias("energy"), F.round("annual_natural_inflow_energy", 2).alias("inflow"))


@query("""WITH l AS (SELECT o_custkey % 25 AS a, o_orderkey % 30 AS b FROM orders)
 SELECT CASE WHEN b >= 25 THEN 'unknown bus' WHEN (a % 3 = 0) = (b % 3 = 0) THEN 'HVDCLink' ELSE 'GenericConversionUnit' END AS kind, count(*) AS n FROM l GROUP BY 1
 UNION ALL SELECT 'ConversionPort', 2 * count(*) FROM l WHERE b < 25 AND (a % 3 = 0) <> (b % 3 = 0) UNION ALL SELECT 'ElectricalBus', count(*) FROM nation UNION ALL SELECT 'Carrier', 1""")
def component_links(spark, d):
    n, o = table(spark, d, "nation"), table(spark, d, "orders")
    buses = n.select(F.col("n_nationkey").cast("string").alias("name"), F.when(F.col("n_nationkey") % 3 == 0, "H2").otherwise("AC").alias("carrier"))
    links = o.select(F.col("o_orderkey").alias("name"), (F.col("o_custkey") % 25).alias("bus0"), (F.col("o_orderkey") % 30).alias("bus1"), F.col("o_totalprice").alias("p_nom"), F.lit("DC").alias("carrier"))
    m, tables = empty_model(spark, Schema.composed([ENERGY_SCHEMA])), {"buses": buses, "links": links}
    counts = networks.from_components(m, tables).entity.groupBy(F.col("entity_class").alias("kind")).agg(F.count("*").alias("n"))
    return counts.union(networks.left_out(m, tables).groupBy("reason").agg(F.count("*")))


# inflows of reservoirs and generators


_INFLOWS = f"""{_ENERGY}, i AS (SELECT 'res.' || c_custkey AS id, NULL::BIGINT AS k, sum(CAST(o_totalprice AS {M2})) AS annual FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 100 = 0 GROUP BY ALL HAVING sum(o_totalprice) <> 0
 UNION ALL SELECT 'gen.' || l_suppkey, l_suppkey, sum(CAST(l_quantity AS {M2})) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_suppkey % 10 < 5 GROUP BY ALL HAVING sum(l_quantity) <> 0),
 draws AS (SELECT 'res.' || (s_suppkey % 4 * 50 + 50) AS id, s_suppkey AS k FROM g WHERE hydro AND NOT variable)"""


def _inflows(spark, d):
    """A day of inflows by the keys of orders and order lines, for half of the reservoirs and half of the generators."""
    of = lambda rows, id_, t, v: rows.select(id_.alias("entity_id"), F.col(t).alias("t"), F.col(v).alias("value"))
    stores = of(table(spark, d, "orders").where("o_custkey % 100 = 0").withColumn("h", F.col("o_orderkey") % 24), key("res", "o_custkey"), "h", "o_totalprice")
    units = of(table(spark, d, "lineitem").where("l_suppkey % 10 < 5"), key("gen", "l_suppkey"), "l_linenumber", "l_quantity")
    return market.assign_inflows(energy_model(spark, d), stores.union(units).groupBy("entity_id", "t").agg(F.sum("value").alias("value")))


@query(f"""WITH {_INFLOWS}, pair AS (SELECT id, min(k) AS first FROM draws GROUP BY 1) SELECT id AS entity_id, CASE WHEN k IS NULL THEN 'annual_natural_inflow_energy' ELSE 'annual_resource_potential' END AS attribute_id, round(CAST(annual AS DOUBLE), 2) AS energy FROM i
 UNION ALL SELECT 'gen.' || first, 'annual_resource_potential', round(CAST(annual AS DOUBLE), 2) FROM i JOIN pair USING (id) WHERE first NOT IN (SELECT k FROM i WHERE k IS NOT NULL)""")
def inflow_energies(spark, d):
    rows = _inflows(spark, d).attr.where("unit = 'MWh'")
    return rows.select("entity_id", "attribute_id", F.round("value_num", 2).alias("energy"))


@query(f"""WITH {_INFLOWS}, lent AS (SELECT draws.id, min(k) AS k FROM i JOIN draws USING (k) WHERE draws.id NOT IN (SELECT id FROM i) AND draws.id IN (SELECT id FROM res) GROUP BY 1)
 SELECT id AS entity_id, 'hasNaturalInflowProfile' AS relation_id, 'profile.inflow.' || id AS profile, 1.0 AS total FROM i WHERE k IS NULL UNION ALL SELECT id, 'hasNaturalInflowProfile', 'profile.inflow.gen.' || k, 1.0 FROM lent
 UNION ALL SELECT 'gen.' || k, 'hasAvailabilityProfile', 'profile.inflow.gen.' || k, 1.0 FROM i WHERE k IS NOT NULL AND k NOT IN (SELECT k FROM draws)""")
def inflow_profiles(spark, d):
    m = _inflows(spark, d)
    totals = m.profile_value.groupBy(F.col("profile_id").alias("profile")).agg(F.round(F.sum("value"), 6).alias("total"))
    return m.rel.where("target_id LIKE 'profile.inflow.%'").select("entity_id", "relation_id", F.col("target_id").alias("profile")).join(totals, "profile")
