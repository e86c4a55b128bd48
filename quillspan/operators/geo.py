"""Gazetteer analytics: filters, department roll-up, nearest places, expansion plans, directories.

Places: (place_id, name, slug, department, region, population, lat, lng).
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.functions.numbers import half_up, haversine_km
from quillspan.workspace import materialize


def places(rows: DataFrame, departments: list[str] | None = None, regions: list[str] | None = None, min_population: int = 0, limit: int | None = None) -> DataFrame:
    """Places of the departments or regions with at least so many inhabitants, largest first."""
    out = rows.filter(F.col("population") >= min_population)
    if departments:
        out = out.filter(F.col("department").isin(*departments))
    if regions:
        out = out.filter(F.col("region").isin(*regions))
    out = out.orderBy(F.desc("population"), "place_id")
    return out.limit(limit) if limit else out


def departments(rows: DataFrame) -> DataFrame:
    """Population and place count of each department, with the coordinates of its most populous place."""
    chief = F.max_by(F.struct("name", "lat", "lng"), F.struct(F.col("population"), -F.col("place_id")))
    return rows.groupBy("department").agg(F.min("region").alias("region"), F.count("*").alias("places"), F.sum("population").cast("bigint").alias("population"), chief.alias("c")).select("department", "region", "places", "population", F.col("c.name").alias("chief_place"), F.col("c.lat").alias("lat"), F.col("c.lng").alias("lng"))


def directory(rows: DataFrame) -> DataFrame:
    """Sorted place names of each department."""
    return rows.groupBy("department").agg(F.count("*").alias("places"), F.array_join(F.sort_array(F.collect_list("name")), "|").alias("names"))


def regions(rows: DataFrame) -> DataFrame:
    """Departments of each region, sorted."""
    return rows.select("region", "department").distinct().groupBy("region").agg(F.array_join(F.sort_array(F.collect_list("department")), ",").alias("departments"))


def with_departments(rows: DataFrame) -> DataFrame:
    """Department rows and place rows in one list, told apart by ``level``."""
    d = departments(rows).select(F.lit("department").alias("level"), F.col("department").alias("code"), F.col("department").alias("name"), "population", "lat", "lng")
    p = rows.select(F.lit("place").alias("level"), F.col("slug").alias("code"), "name", F.col("population").cast("bigint").alias("population"), "lat", "lng")
    return d.unionByName(p)


EARTH_KM = 6371.0


def nearest(rows: DataFrame, k: int = 5, first_km: float = 10.0, growth: int = 2) -> DataFrame:
    """(place_id, neighbour, km, rank): the k nearest other places, by id on equal distance; places without coordinates take no part.

    Positions, not places, look around: places with equal coordinates have the
    same ``k + 1`` nearest, of which each leaves itself out, and only the first
    ``k + 1`` ids of a position can be anyone's neighbours.  Positions meet in
    cubes around points of the sphere in space, which have no meridian and no
    pole: what is not in the 27 cubes around one is at least a cube's side
    away.  Cube by cube size, from one that holds few positions, only positions
    whose last distance is not yet below the side look further, so dense areas
    stay local; the last cubes hold the globe.
    """
    lat, lng = F.radians("lat"), F.radians("lng")
    point = {"px": F.cos(lat) * F.cos(lng), "py": F.cos(lat) * F.sin(lng), "pz": F.sin(lat)}
    here = rows.filter("lat IS NOT NULL AND lng IS NOT NULL").select("place_id", "lat", "lng")
    first = here.withColumn("nth", F.row_number().over(Window.partitionBy("lat", "lng").orderBy("place_id"))).filter(F.col("nth") <= k + 1)
    there = materialize(first.select(F.col("place_id").alias("neighbour"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2"), "nth", *((e * EARTH_KM).alias(n) for n, e in point.items())), "nearest-places")
    # a position goes by its smallest id
    positions = there.filter("nth = 1").select(F.col("neighbour").alias("position"), F.col("lat2").alias("lat"), F.col("lng2").alias("lng"), "px", "py", "pz")
    w = Window.partitionBy("position").orderBy("km", "neighbour")
    around = F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(("dx", "dy", "dz"), d))) for d in product((-1, 0, 1), repeat=3)))
    cubes = lambda side: {c: F.floor(F.col(f"p{c}") / side).cast("int") for c in "xyz"}
    done, todo, side = [], positions, _open_side(positions, cubes, first_km, growth)
    while True:
        cube = cubes(side)
        asking = todo.withColumn("d", F.explode(around)).select("position", "lat", "lng", *((e + F.col(f"d.d{c}")).alias(c) for c, e in cube.items()))
        found = asking.join(there.select("neighbour", "lat2", "lng2", *(e.alias(c) for c, e in cube.items())), list("xyz"))
        found = found.select("position", "neighbour", haversine_km(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2")).alias("km"))
        top = materialize(found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k + 1), "nearest-top")
        if side >= 2 * EARTH_KM:
            done.append(top)
            break
        sure = top.filter((F.col("rank") == k + 1) & (F.col("km") < side)).select("position")
        done.append(top.join(sure, "position", "left_semi"))
        todo = materialize(todo.join(sure, "position", "left_anti"), "nearest-todo")
        if todo.isEmpty():
            break
        side *= growth
    near = reduce(DataFrame.unionByName, done).groupBy("position").agg(F.sort_array(F.collect_list(F.struct("rank", "neighbour", "km"))).alias("near"))
    near = positions.select("position", "lat", "lng").join(near, "position").select("lat", "lng", "near")
    others = F.slice(F.filter("near", lambda x: x["neighbour"] != F.col("place_id")), 1, k)
    each = here.join(near, ["lat", "lng"]).select("place_id", F.posexplode(others).alias("at", "x"))
    return each.select("place_id", F.col("x.neighbour").alias("neighbour"), half_up(F.col("x.km"), 1).alias("km"), (F.col("at") + 1).alias("rank"))


#: Positions that the cube of a position holds on average, at most, when the search begins.
OPEN_CUBE = 8


def _open_side(positions: DataFrame, cubes, side: float, growth: int) -> float:
    """The largest side from ``side`` downwards (a metre at least) whose cubes hold OPEN_CUBE positions at most, as a position sees it."""
    while side > 0.001:
        held = positions.groupBy(*(e.alias(c) for c, e in cubes(side).items())).agg(F.count("*").cast("double").alias("n"))
        squares, total = held.agg(F.sum(F.col("n") * F.col("n")), F.sum("n")).first()
        if not total or squares <= OPEN_CUBE * total:
            break
        side /= growth
    return side


COST_PER_ROW = 0.03
TITLE_TEMPLATE = "{keyword} à __VILLE__ ({departement}, {region})"


def expansion_plan(rows: DataFrame, keywords: list[str], languages: list[str]) -> DataFrame:
    """Keyword x place x language planning rows with title, slug and cost; a table of rows, no texts."""
    spark = rows.sparkSession
    grid = spark.createDataFrame([(k, lang) for k in keywords for lang in languages], "keyword string, language string")
    both = rows.crossJoin(F.broadcast(grid))
    fields = {"ville": F.col("name"), "departement": F.col("department"), "region": F.col("region"), "code_postal": F.lit("")}
    title = T.expand_template(F.replace(F.lit(TITLE_TEMPLATE), F.lit("{keyword}"), F.col("keyword")), fields)
    slug = T.slugify(F.concat_ws(" ", "keyword", "name"))
    return both.select("place_id", "keyword", "language", title.alias("title"), F.concat(F.when(F.col("language") == "fr", "").otherwise(F.concat("language", F.lit("/"))), slug).alias("slug"), F.lit(COST_PER_ROW).alias("estimated_cost"))


def new_plan_rows(plan: DataFrame, actions: DataFrame) -> DataFrame:
    """Plan rows whose keyword has no open action of type geoloc; one row per title."""
    taken = actions.filter((F.col("action_type") == "geoloc") & F.col("status").isin("pending", "validated", "executing")).select(F.col("keyword").alias("title")).distinct()
    w = Window.partitionBy("title").orderBy("place_id", "language")
    return plan.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").join(taken, "title", "left_anti")


def linguistic_variants(pages: DataFrame) -> DataFrame:
    """(core, languages, urls) of pages that differ only in a leading language segment of their path."""
    from quillspan.functions import urls as U

    lang = U.path_language(F.col("url"), "")
    core = F.regexp_replace(F.regexp_replace(U.path(F.col("url")), r"^/(?:fr|en|es|de|it|pt|nl)(?=/|$)", ""), r"^/+|/+$", "")
    return pages.select(core.alias("core"), lang.alias("language")).groupBy("core").agg(F.sort_array(F.collect_set("language")).alias("languages"), F.count("*").alias("pages"))
