"""Source trees as a table of files: discovery, languages, hashes, vendored bundles, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions import strings

#: Fixed: which extensions a front-end reads.
LANGUAGES = {
    "ts": "ts tsx js jsx mjs cjs mts cts",
    "py": "py",
    "go": "go",
    "rust": "rs",
    "java": "java",
    "php": "php",
    "html": "html htm vue svelte astro njk liquid hbs ejs",
}
#: Fixed: folders and files that are left out.
EXCLUDED_DIRS = "node_modules dist build out coverage vendor target venv __pycache__ tests test __tests__ __mocks__".split()
_TESTS = r"(?:\.(?:test|spec)\.[^/.]+|_test\.(?:go|py)|(?:^|/)test_[^/]*\.py|\.d\.ts)$"


def language(path: Column) -> Column:
    ext, out = F.lower(F.substring_index(path, ".", -1)), F
    for name, exts in LANGUAGES.items():
        out = out.when(ext.isin(exts.split()), name)
    return out.otherwise(None)


def wanted(path: Column) -> Column:
    """Of a known language, in no excluded or hidden folder, and no test or type declaration."""
    folders = "|".join(EXCLUDED_DIRS)
    return language(path).isNotNull() & ~path.rlike(rf"(?:^|/)(?:{folders}|\.[^/]+)/") & ~path.rlike(_TESTS)


def discover(spark: SparkSession, root: str, repository: str, base: str | None = None) -> DataFrame:
    """(repository, path, language, size, hash, content) of a tree's source files; only files that are wanted are decoded.

    ``base``: what comes before the relative path, where the reader's paths look unlike ``root``.
    """
    prefix = (base or root).rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    at = F.instr("path", prefix)
    rel = F.expr(f"substring(path, instr(path, '{prefix}') + {len(prefix)})")
    found = files.where(at > 0).withColumn("path", rel).where(wanted(F.col("path")))
    text = F.col("content").cast("string")
    out = found.select(F.lit(repository).alias("repository"), "path", language(F.col("path")).alias("language"), F.col("length").alias("size"), F.sha2("content", 256).alias("hash"), text.alias("content"))
    return out.where(~strings.looks_vendored(F.col("path"), F.col("size"), F.col("content")))


def dependencies(manifests: DataFrame) -> DataFrame:
    """(repository, path, name) of what manifests (repository, path, content) ask for: package.json, requirements, go.mod, Cargo, pom, composer."""
    name = F.substring_index("path", "/", -1)
    c = F.col("content")
    json_deps = "map<string,string>"

    def keys(*fields: str) -> Column:
        return F.concat(*[F.coalesce(F.map_keys(F.from_json(F.get_json_object(c, f"$.{f}"), json_deps)), F.array().cast("array<string>")) for f in fields])

    def group(pattern: str) -> Column:
        return F.regexp_extract_all(c, F.lit(pattern), F.lit(1))

    deps = (
        F.when(name == "package.json", keys("dependencies", "devDependencies", "peerDependencies"))
        .when(name == "composer.json", keys("require", "require-dev"))
        .when(name.rlike(r"^requirements.*\.txt$"), group(r"(?m)^\s*([A-Za-z0-9][A-Za-z0-9._-]*)"))
        .when(name == "go.mod", group(r"(?m)^\s*(?:require\s+)?([a-z0-9.-]+\.[a-z]+/[^\s]+)\s+v"))
        .when(name == "Cargo.toml", group(r"(?m)^([A-Za-z0-9_-]+)\s*=\s*(?:\"[0-9^~*]|\{)"))
        .when(name == "pom.xml", group(r"<artifactId>([^<]+)</artifactId>"))
        .when(name.rlike(r"^build\.gradle"), group(r"['\"][\w.-]+:([\w.-]+):"))
        .when(name.isin("pyproject.toml", "Pipfile"), F.concat(group(r"(?m)^\s*\"([A-Za-z0-9][A-Za-z0-9._-]*)[^\"]*\",?\s*$"), group(r"(?m)^([A-Za-z0-9][A-Za-z0-9._-]*)\s*=\s*[\"{]")))
    )
    return manifests.select("repository", "path", F.explode(F.array_distinct(deps)).alias("name"))
