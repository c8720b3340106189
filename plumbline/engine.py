"""The library's entry points: from sources to issues, impact and reports."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window, functions as F

from .errors import ImpactError, PathNotFound as PathNotFound
from .operators import graph, resolve
from .plans import detect, views
from .shared import written
from .sources import parse
from .sources.config import Config

#: Severities of the detectors' issues, and the order of their sections.
SEVERITIES = {"CircularDependency": "error", "GodObject": "warn", "HighCoupling": "warn", "BoundaryViolation": "warn", "DeepDependencyChain": "warn", "LowCohesion": "info", "FatModule": "info"}
#: Modules of a cycle that its message names; places of an issue that a report shows.
NAMED, SHOWN = 20, 5


@dataclass(frozen=True)
class Analysis:
    """What an analysis gives.

    modules as ``parse.modules`` has them; edges (src, dst, pos); issues (kind, severity, path, message, advice, key);
    locations (kind, key, path, times), every module an issue names, and how often it crosses a boundary; counts of each module's definitions; and skipped
    (path, parse_error), files that couldn't be parsed.
    """

    modules: DataFrame
    edges: DataFrame
    issues: DataFrame
    locations: DataFrame
    counts: DataFrame
    skipped: DataFrame


def analyze(sources: DataFrame, config: Config | None = None, max_depth: int | None = None, min_cohesion: float | None = None) -> Analysis:
    """Parses ``sources`` (path, content) once, resolves imports and runs the seven detectors.

    Files that can't be parsed are left out. ``max_depth`` and ``min_cohesion`` override the configuration.
    """
    config = config or Config()
    t = config.thresholds
    t = replace(t, max_dependency_depth=t.max_dependency_depth if max_depth is None else max_depth, min_cohesion=t.min_cohesion if min_cohesion is None else min_cohesion)
    parsed = written(parse.modules(sources), "modules")
    m, skipped = parsed.where("parse_error IS NULL").drop("parse_error"), parsed.where("parse_error IS NOT NULL").select("path", "parse_error")
    edges = written(resolve.by_path(m), "edges")
    definitions = m.select("path", F.explode("definitions").alias("d")).select("path", "d.kind", "d.visibility")
    counts = detect.definition_counts(definitions).drop("exports")
    counts = m.select("path", F.size("exports").cast("long").alias("exports")).join(counts, "path", "left").select("path", "exports", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts.columns if c != "path"))
    slim = m.select("path", "name", "lines", "imports")
    hits = detect.boundary_hits(m.select("path", "content"), config.boundaries)
    on_cycles = written(graph.strong_components(edges), "cycles")
    deep = written(detect.deep_chains(edges, t, components=on_cycles), "chains")
    crossed = written(detect.boundary_violations(hits, config.boundaries, t), "crossed")

    def row(df: DataFrame, kind: str, path, message, key=None) -> DataFrame:
        own = path if key is None else key
        return df.select(F.lit(kind).alias("kind"), F.lit(SEVERITIES[kind]).alias("severity"), path.alias("path"), message.alias("message"), views.advice(F.lit(kind)).alias("advice"), own.alias("key"))

    path = F.col("path")
    parts = [
        row(_cycle_names(on_cycles), "CircularDependency", F.col("component"), F.concat(F.lit("cycle: "), "names")),
        row(detect.god_objects(slim, counts, t), "GodObject", path, F.format_string("%d lines with %s", "lines", "responsibilities")),
        row(detect.high_coupling(slim, edges, t, config.expected_high_coupling), "HighCoupling", path, F.format_string("%d imports reach it", "fan_in")),
        row(crossed, "BoundaryViolation", F.lit(None).cast("string"), F.format_string("%s is crossed in %d modules", "boundary", "modules"), F.col("boundary")),
        row(deep, "DeepDependencyChain", F.element_at("nodes", 1), F.format_string("%d modules: %s", "length", "chain"), F.col("chain")),
        row(detect.low_cohesion(slim, t), "LowCohesion", path, F.format_string("score %.2f, %d outside packages: %s", "score", "crates", "top")),
        row(detect.fat_modules(slim, counts, t), "FatModule", path, F.format_string("%d lines, %d private functions", "lines", "private_functions")),
    ]
    issues = parts[0]
    for x in parts[1:]:
        issues = issues.unionByName(x)
    issues = written(issues, "issues")
    at = lambda df, kind, key, times=F.lit(1): df.select(F.lit(kind).alias("kind"), F.col(key).alias("key"), "path", times.cast("long").alias("times"))
    several = at(on_cycles, "CircularDependency", "component")
    several = several.unionByName(at(deep.select("chain", F.explode("nodes").alias("path")), "DeepDependencyChain", "chain"))
    several = several.unionByName(at(detect.boundary_crossers(hits, config.boundaries).join(crossed.select("boundary"), "boundary", "left_semi"), "BoundaryViolation", "boundary", F.col("n")))
    single = issues.where(~F.col("kind").isin("CircularDependency", "DeepDependencyChain", "BoundaryViolation")).select("kind", "key", "path", F.lit(1).cast("long").alias("times"))
    return Analysis(m, edges, issues, written(several.unionByName(single), "locations"), counts, skipped)


def _first(rows: DataFrame, group: list[str], most: int) -> DataFrame:
    """The ``most`` smallest paths of each group, with their rank and the group's ``size``."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy("path"))).where(F.col("rank") <= most)
    return ranked.join(rows.groupBy(*group).agg(F.count("*").alias("size")), group)


def _cycle_names(on_cycles: DataFrame) -> DataFrame:
    """(component, names): a cycle's modules by path, the first NAMED and how many more there are."""
    first = _first(on_cycles, ["component"], NAMED).groupBy("component", "size").agg(F.array_sort(F.collect_list("path")).alias("nodes"))
    more = F.when(F.col("size") > NAMED, F.format_string(" and %d more", F.col("size") - NAMED)).otherwise("")
    return first.select("component", F.concat(F.array_join("nodes", " -> "), more).alias("names"))


def impact(sources: DataFrame, path: str, depth: int | None = None) -> DataFrame:
    """(path, depth) of modules that depend on ``path``; no detector runs."""
    m = written(parse.modules(sources).where("parse_error IS NULL").select("path", "imports"), "modules")
    target = m.where(F.col("path") == path).select("path")
    if target.isEmpty():
        raise ImpactError(path)
    return graph.impact(resolve.by_path(m), target, depth)


def _ranked(issues: DataFrame, min_severity: str) -> DataFrame:
    """Issues of a severity or above with ``kind_rank``, their section, and ``line``, what is said of each."""
    rank = F.lit(len(SEVERITIES))
    for k, kind in enumerate(SEVERITIES):
        rank = F.when(F.col("kind") == kind, k).otherwise(rank)
    line = F.concat(F.lit("- **"), F.col("kind"), F.lit("** "), F.coalesce("path", F.lit("")), F.lit(": "), F.col("message"))
    return detect.at_least(issues, min_severity).withColumns({"kind_rank": rank, "line": line})


def report_lines(issues: DataFrame, min_severity: str = "info") -> DataFrame:
    """(kind_rank, path, line): a Markdown line for each issue, to be ordered by these columns."""
    return _ranked(issues, min_severity).select("kind_rank", "path", "line").orderBy("kind_rank", "path", "line")


def report_sections(found: Analysis, min_severity: str = "info") -> DataFrame:
    """(kind_rank, path, key, pos, line): a report's Markdown lines in the order of these columns.

    A section for each kind with the number of its issues; each issue with its first SHOWN places, where it has several,
    how many more there are, and advice.
    """
    own = _ranked(found.issues, min_severity)
    line = lambda df, pos, text: df.select("kind_rank", F.coalesce("path", F.lit("")).alias("path"), "key", F.lit(pos).alias("pos") if isinstance(pos, int) else pos.alias("pos"), text.alias("line"))
    heads = own.groupBy("kind_rank", "kind", "severity").agg(F.count("*").alias("n")).withColumns({"path": F.lit(""), "key": F.lit("")})
    # places are looked up by kind and key, and stand where their issue stands
    at = _first(found.locations.withColumnRenamed("path", "place").withColumn("path", F.col("place")), ["kind", "key"], SHOWN).where("size > 1")
    places = own.select("kind_rank", "path", "kind", "key").join(at.select("kind", "key", "place", "rank", "size"), ["kind", "key"])
    out = line(heads, 0, F.format_string("\n## %s (%d, %s)\n", "kind", "n", "severity"))
    out = out.unionByName(line(own, 1, F.col("line")))
    out = out.unionByName(line(places, F.col("rank") + 1, F.concat(F.lit("  - in "), "place")))
    out = out.unionByName(line(places.where((F.col("rank") == SHOWN) & (F.col("size") > SHOWN)), SHOWN + 2, F.format_string("  - and %d more", F.col("size") - SHOWN)))
    out = out.unionByName(line(own, SHOWN + 3, F.concat(F.lit("  - advice: "), "advice")))
    return out.orderBy("kind_rank", "path", "key", "pos")


def report_json(issues: DataFrame) -> DataFrame:
    """(json): each issue as a document."""
    return issues.select(F.to_json(F.struct("kind", "severity", "path", "message", "advice")).alias("json"))
