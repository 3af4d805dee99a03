"""File scans: projects, infrastructure files and dependency manifests as whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltworks.operators import match

# Extensions of a project's sources, folders that are left out, limits, and languages by extension.
SOURCE_EXTENSIONS = ("ts", "tsx", "js", "jsx", "py", "go", "java", "rb", "cs", "php")
EXCLUDED = ("node_modules", ".git", "dist", "build")
MAX_FILES, MAX_CHARS, PER_TYPE, PER_GLOB = 40, 120_000, 100, 10
LANGUAGES = {
    "ts": ("typescript",), "tsx": ("typescript", "typescriptreact"), "js": ("javascript",), "jsx": ("javascript", "javascriptreact"), "py": ("python",), "java": ("java",), "go": ("go",),
    "rs": ("rust",), "c": ("c",), "cpp": ("cpp", "c++"), "cs": ("csharp",), "php": ("php",), "rb": ("ruby",),
}
# Names of dependency manifests.
MANIFESTS = (
    "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "requirements.txt", "requirements-*.txt", "Pipfile", "Pipfile.lock", "pyproject.toml", "poetry.lock", "setup.py", "pom.xml", "build.gradle",
    "build.gradle.kts", "gradle.lockfile", "go.mod", "go.sum", "Cargo.toml", "Cargo.lock", "Gemfile", "Gemfile.lock", "composer.json", "composer.lock", "*.csproj", "packages.config",
)
MANIFEST_EXCLUDED = (*EXCLUDED, "vendor", "target")


def extension(path: Column) -> Column:
    """Lower case, without the dot; empty where there is none."""
    name = F.substring_index(path, "/", -1)
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def languages(path: Column) -> Column:
    """The names of a path's language; an empty array for an unknown extension."""
    table = F.create_map(*(x for e, names in LANGUAGES.items() for x in (F.lit(e), F.array(*map(F.lit, names)))))
    return F.coalesce(F.element_at(table, extension(path)), F.array().cast("array<string>"))


def excluded(path: Column, folders=EXCLUDED) -> Column:
    """The path goes through one of the folders."""
    return F.arrays_overlap(F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.lit(0), F.size(F.split(path, "/")) - 1)), F.array(*map(F.lit, folders)))


def read_tree(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Whole text files below a path: path, content."""
    reader = spark.read.option("wholetext", True).option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", glob) if glob else reader).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def project(files: DataFrame, max_files: int = MAX_FILES, max_chars: int = MAX_CHARS) -> DataFrame:
    """A project's sources by path: known extensions outside the excluded folders; of the first twice ``max_files``
    candidates those that are not too long, at most ``max_files``."""
    some = files.filter(extension(F.col("path")).isin(*SOURCE_EXTENSIONS) & ~excluded(F.col("path")))
    return some.orderBy("path").limit(2 * max_files).filter(F.length("content") <= max_chars).orderBy("path").limit(max_files)


def infra(files: DataFrame, kind: str, most: int = PER_TYPE) -> DataFrame:
    """At most so many files of one kind, by name and content, in the order of their paths."""
    typed = files.filter(~excluded(F.col("path"))).withColumn("type", match.file_type(F.col("path"), F.col("content")))
    return typed.filter(F.col("type") == kind).orderBy("path").limit(most)


def manifests(files: DataFrame, most: int = PER_GLOB, key: list[str] | None = None) -> DataFrame:
    """Dependency manifests, at most so many of each name (and of each ``key``), each path once."""
    name = F.substring_index("path", "/", -1)
    which = F
    for i, glob in enumerate(MANIFESTS):
        before, star, after = glob.partition("*")
        which = which.when(F.startswith(name, F.lit(before)) & F.endswith(name, F.lit(after)) & (F.length(name) >= len(before + after)) if star else name == glob, i)
    some = files.withColumn("pattern", which).filter(F.col("pattern").isNotNull() & ~excluded(F.col("path"), MANIFEST_EXCLUDED))
    first = Window.partitionBy(*(key or []), "pattern").orderBy("path")
    return some.dropDuplicates(["path"]).withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= most).drop("_n")
