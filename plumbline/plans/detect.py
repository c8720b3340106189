"""Detectors: each gives rows of (kind, severity, path, ...)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..functions import paths
from ..operators.chains import chains
from ..operators.globs import matched
from ..operators.graph import degrees, strong_components
from .budget import token_pack as token_pack
from .indicators import marked_lines

SEVERITY = {"info": 0, "warn": 1, "warning": 1, "error": 2}


@dataclass(frozen=True)
class Thresholds:
    """Limits of the detectors."""

    god_object_lines: int = 500
    coupling_fanin: int = 5
    boundary_violation_min: int = 2
    max_dependency_depth: int = 5
    min_cohesion: float = 0.3
    fat_module_lines: int = 400
    fat_module_private_functions: int = 8
    lines_per_export: float = 100.0


@dataclass(frozen=True)
class Boundary:
    """A kind of outside access that should stay in few modules."""

    name: str
    indicators: list[str]
    allowed_in: list[str] = field(default_factory=list)
    ownership: float = 0.5


#: Files that many others may depend on.
EXPECTED_HIGH_COUPLING = [
    "**/model/**", "**/models/**", "**/types/**", "**/config.rs", "**/config.ts", "**/config.py", "**/lib.rs",
    "**/mod.rs", "**/index.ts", "**/index.js", "**/__init__.py", "**/fs.rs", "**/utils/**", "**/common/**",
]

#: Kinds of outside access, what shows them and where they belong.
BOUNDARIES = [
    Boundary(
        "Persistence",
        ["sqlx::", "diesel::", "sea_orm::", "prisma.", "SELECT ", "INSERT ", "UPDATE ", "DELETE "],
        ["**/db/**", "**/database/**", "**/repository/**", "**/repo/**"],
    ),
    Boundary(
        "Network",
        ["reqwest::", "hyper::", "fetch(", "axios.", "requests.", "http.get", "http.post"],
        ["**/client/**", "**/api/**", "**/http/**", "**/network/**"],
    ),
    Boundary(
        "Filesystem",
        ["std::fs::", "tokio::fs::", "fs.readFile", "fs.writeFile", "fs.readFileSync", "fs.writeFileSync", "fs.promises", "open(", "pathlib.Path(", "shutil."],
        ["**/fs.rs", "**/io.rs", "**/io/**", "**/storage/**"],
    ),
]


def cycles(edges: DataFrame) -> DataFrame:
    """(component, size, members): each strongly connected set of modules, and modules that import themselves."""
    return strong_components(edges).groupBy("component").agg(F.count("*").alias("size"), F.array_join(F.array_sort(F.collect_list("path")), ",").alias("members"))


def definition_counts(definitions: DataFrame) -> DataFrame:
    """Counts of a module's definitions (path, kind, visibility) by kind and visibility."""
    k, v = F.col("kind"), F.col("visibility")
    return definitions.groupBy("path").agg(
        F.count_if(k == "Struct").alias("structs"), F.count_if(k == "Function").alias("functions"), F.count_if(k == "Impl").alias("impls"),
        F.count_if(k == "Trait").alias("traits"), F.count_if(k == "Enum").alias("enums"),
        F.count_if((k == "Function") & (v == "Private")).alias("private_functions"), F.count_if((k == "Function") & (v == "Public")).alias("public_functions"),
        F.count_if(v == "Public").alias("exports"),
    )


def god_objects(modules: DataFrame, counts: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """(path, lines, responsibilities): long modules with at least two sorts of responsibility."""
    sorts = F.array_compact(F.array(F.when(F.col("structs") > 3, "structs"), F.when(F.col("functions") > 10, "functions"), F.when(F.col("traits") > 0, "traits"), F.when(F.col("impls") > 5, "impls")))
    found = modules.where(F.col("lines") >= t.god_object_lines).join(counts, "path").withColumn("responsibilities", sorts)
    return found.where(F.size("responsibilities") > 1).select("path", "lines", F.array_join("responsibilities", ",").alias("responsibilities"))


def fat_modules(modules: DataFrame, counts: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """(path, lines, private_functions, public_functions, lines_per_export): long modules that hide much and offer little."""
    per = F.col("lines") / F.greatest("exports", F.lit(1))
    found = modules.where((F.col("lines") >= t.fat_module_lines) & ~paths.is_test(F.col("path"))).join(counts, "path")
    found = found.where((F.col("private_functions") >= t.fat_module_private_functions) & (per > t.lines_per_export))
    return found.select("path", "lines", "private_functions", "public_functions", F.round(per, 6).alias("lines_per_export"))


def high_coupling(nodes: DataFrame, edges: DataFrame, t: Thresholds = Thresholds(), expected: list[str] | DataFrame | None = None) -> DataFrame:
    """(path, fan_in, fan_in_distinct): modules that many edges reach, but for those expected to be.

    ``expected`` are globs, a few in a list or any number in a table (glob).
    """
    found = degrees(nodes, edges).where(F.col("fan_in") >= t.coupling_fanin).select("path", "fan_in", "fan_in_distinct")
    if isinstance(expected, DataFrame):
        return found.join(matched(found, expected).select("path").distinct(), "path", "left_anti")
    return found.where(~paths.matches_any(F.col("path"), EXPECTED_HIGH_COUPLING if expected is None else expected))


def boundary_hits(sources: DataFrame, boundaries: list[Boundary]) -> DataFrame:
    """(boundary, path, line, indicator): lines of ``sources`` (path, content) with an indicator that no quote sign precedes; as ``marked_lines`` says."""
    return marked_lines(sources, boundaries)


def boundary_crossers(hits: DataFrame, boundaries: list[Boundary]) -> DataFrame:
    """(boundary, path, n): modules that cross a boundary and the number of hits, the owner left out.

    The owner is the module with most hits, of equal ones the smallest path, if its share reaches the limit.
    """
    per = hits.groupBy("boundary", "path").agg(F.count("*").alias("n"))
    total = per.groupBy("boundary").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("n"), "path")).alias("top"))
    limit = F.lit(0.5)
    for b in boundaries:
        limit = F.when(F.col("boundary") == b.name, F.lit(b.ownership)).otherwise(limit)
    owner = (F.col("top.path") == F.col("path")) & (F.col("n") / F.col("total") >= limit)
    return per.join(total, "boundary").where(~owner).select("boundary", "path", "n")


def boundary_violations(hits: DataFrame, boundaries: list[Boundary], t: Thresholds = Thresholds()) -> DataFrame:
    """(boundary, modules, hits): boundaries crossed in several modules, the owner left out."""
    rest = boundary_crossers(hits, boundaries).groupBy("boundary").agg(F.count("*").alias("modules"), F.sum("n").alias("hits"))
    return rest.where(F.col("modules") >= t.boundary_violation_min)


def low_cohesion(modules: DataFrame, t: Thresholds = Thresholds(), imports: DataFrame | None = None) -> DataFrame:
    """(path, score, internal, crates, top): modules (path, name, imports) that import from many outside packages.

    An import is internal if it is relative or names a module of the same package. ``imports`` (path, imported) are
    those of ``modules`` unless given as rows.
    """
    rows = modules.select("path", F.explode("imports").alias("imported")) if imports is None else imports
    own = rows.select("path", paths.package(F.col("path")).alias("package"), "imported")
    siblings = modules.select(paths.package(F.col("path")).alias("package"), F.col("name").alias("sibling")).distinct()
    last = F.substring_index(F.substring_index(F.substring_index("imported", "::", -1), "/", -1), ".", 1)
    met = own.withColumn("sibling", last).join(siblings.withColumn("known", F.lit(True)), ["package", "sibling"], "left")
    inside = paths.is_relative(F.col("imported")) | F.coalesce("known", F.lit(False))
    per = met.groupBy("path", F.when(~inside, paths.crate(F.col("imported"))).alias("crate")).agg(F.count("*").alias("n"))
    outside = F.col("crate").isNotNull()
    each = per.groupBy("path").agg(
        F.coalesce(F.sum(F.when(~outside, F.col("n"))), F.lit(0)).alias("internal"), F.count("crate").alias("crates"),
        F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.when(outside, F.struct((-F.col("n")).alias("n"), "crate")))), 1, 3), lambda x: x["crate"]), ",").alias("top"),
    )
    score = (F.col("internal") + 1) / (F.col("internal") + 1 + F.col("crates"))
    hubs = paths.base_name(F.col("path")).isin("mod.rs", "lib.rs", "main.rs", "index.ts", "index.js", "__init__.py")
    found = each.withColumn("score", score).where(~hubs & (F.col("score") < t.min_cohesion) & (F.col("crates") >= 3))
    return found.select("path", F.round("score", 6).alias("score"), "internal", "crates", "top")


def deep_chains(edges: DataFrame, t: Thresholds = Thresholds(), keep: int = 10, components: DataFrame | None = None) -> DataFrame:
    return chains(edges, t.max_dependency_depth, keep, components)


def at_least(issues: DataFrame, severity: str) -> DataFrame:
    """Issues of this severity or above."""
    rank = F.lit(0)
    for name, n in SEVERITY.items():
        rank = F.when(F.col("severity") == name, n).otherwise(rank)
    return issues.where(rank >= SEVERITY[severity])


def importance(modules: DataFrame, edges: DataFrame, counts: DataFrame) -> DataFrame:
    """(path, score): twice the fan-in, the fan-out, a bonus for files of models, and 1.5 for each struct or enum."""
    name = paths.stem(F.col("path"))
    core = name.contains("model") | name.contains("types") | name.contains("schema") | name.contains("entity")
    kinds = counts.select("path", (F.col("structs") + F.col("enums")).alias("data"))
    score = 2 * F.col("fan_in") + F.col("fan_out") + F.when(core, 10).otherwise(0) + 1.5 * F.coalesce("data", F.lit(0))
    return degrees(modules, edges).join(kinds, "path", "left").select("path", F.round(score, 6).alias("score"))
