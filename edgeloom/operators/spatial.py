"""Which region a point lies in: joins on bands of latitude, no polygon library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KM_PER_DEGREE = 111.2


def _banded(edges: DataFrame, step: float, margin: float) -> DataFrame:
    """Edges (region, x1, y1, x2, y2) once for each band of latitude that they come within `margin` degrees of."""
    low, high = F.least("y1", "y2") - margin, F.greatest("y1", "y2") + margin
    return edges.withColumn("band", F.explode(F.sequence(F.floor(low / step), F.floor(high / step))))


def containing(points: DataFrame, edges: DataFrame, step: float = 1.0) -> DataFrame:
    """(id, region) of points (id, lon, lat) inside a ring of edges: a ray to the east crosses it an odd number of
    times. A point meets only the edges of its band."""
    rows = points.withColumn("band", F.floor(F.col("lat") / step)).join(_banded(edges, step, 0.0), "band")
    across = (F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))
    x = F.col("x1") + (F.col("lat") - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))
    hits = rows.groupBy("id", "region").agg(F.count_if(across & (F.col("lon") < x)).alias("n"))
    return hits.where("n % 2 = 1").select("id", "region")


def _distance(lon: Column, lat: Column) -> Column:
    """Kilometres from a point to an edge, on a plane through the point."""
    shrink = F.cos(F.radians(lat))
    ax, ay = (F.col("x1") - lon) * shrink, F.col("y1") - lat
    dx, dy = (F.col("x2") - F.col("x1")) * shrink, F.col("y2") - F.col("y1")
    along = F.coalesce(-(ax * dx + ay * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
    along = F.least(F.lit(1.0), F.greatest(F.lit(0.0), along))
    return KM_PER_DEGREE * F.sqrt((ax + along * dx) ** 2 + (ay + along * dy) ** 2)


def nearest(points: DataFrame, edges: DataFrame, km: float = 10.0, step: float = 1.0) -> DataFrame:
    """(id, region) of the region with the nearest edge within `km`; of equally near ones the first by name."""
    rows = points.withColumn("band", F.floor(F.col("lat") / step)).join(_banded(edges, step, km / KM_PER_DEGREE), "band")
    near = rows.withColumn("d", _distance(F.col("lon"), F.col("lat"))).where(F.col("d") <= km)
    return near.groupBy("id").agg(F.min(F.struct("d", "region"))["region"].alias("region"))


def located(points: DataFrame, edges: DataFrame, buffer_km: float = 2.2, km: float = 10.0) -> DataFrame:
    """(id, region): inside, else within the buffer or `km` of a region, else null; the first by name of several."""
    inside = containing(points, edges).groupBy("id").agg(F.min("region").alias("inside"))
    near = nearest(points, edges, max(buffer_km, km)).withColumnRenamed("region", "near")
    return points.join(inside, "id", "left").join(near, "id", "left").select("id", F.coalesce("inside", "near").alias("region"))
