"""Workspaces: the datasets of ingested projects as tables, in versions; JSON lines in and out.

    path/data/<ingest>/<table>        what one ingest wrote; never changed afterwards
    path/versions/<number>/manifest   which ingests, without which projects, make up a version

An ingest writes its tables under a new name and then one manifest: that is the moment of publication, so a reader sees
the version before or the one after, and an ingest that breaks off leaves nothing that is read. An update puts its
projects in the place of those with the same file and leaves all other files as they are. A ``Workspace`` holds the
version that it was opened with, whose files stay until two more are published.
"""

from __future__ import annotations

import json
import os
import uuid
import warnings
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millwright.operators.search import write_index
from millwright.operators.sets import union_all
from millwright.operators.windows import last_per_key
from millwright.plans.project import Project

SCHEMA_VERSION = 3
SORTED = {"xrefs": ["base_lc", "symbol_lc"], "symbols": ["name"], "tags": ["name"], "comments": ["target"], "routine_units": ["routine_id", "sequence"]}
#: Columns of point lookups: their Parquet bloom filters let a scan skip row groups whose range of values says nothing.
LOOKED_UP = ("id", "symbol_lc", "base_lc", "name", "routine_id", "target")
KEEP_VERSIONS = 2
MOST_INGESTS = 16  # a version of more is written anew
MANIFEST = "version int, number long, fingerprint string, export_date string, controllers array<string>, source string, created_at string, counts string, ingests array<struct<id: string, dead: array<string>>>"


class WorkspaceError(ValueError):
    """No workspace, or one of another version."""


def _store(spark: SparkSession, path: str):
    """A path of Hadoop and its file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    where, store = _store(spark, path)
    return sorted(x.getPath().getName() for x in store.listStatus(where)) if store.exists(where) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the published versions, ascending."""
    done = lambda n: (lambda where, store: store.exists(where))(*_store(spark, f"{path}/versions/{n}/manifest/_SUCCESS"))
    return [int(n) for n in _names(spark, f"{path}/versions") if n.isdigit() and done(n)]


class Workspace:
    """Datasets as attributes, read from the version that was the newest at opening; columns and rows are pruned by the scan."""

    def __init__(self, spark: SparkSession, path: str, number: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest = self._manifest(number)
        if self.manifest["version"] != SCHEMA_VERSION:
            raise WorkspaceError(f"{path} has version {self.manifest['version']}, not {SCHEMA_VERSION}")

    def _manifest(self, number: int | None) -> dict:
        there = versions(self.spark, self.path)
        if not there or (number is not None and number not in there):
            raise WorkspaceError(f"{self.path} has no manifest")
        row = self.spark.read.schema(MANIFEST).json(f"{self.path}/versions/{there[-1] if number is None else number:012d}/manifest").first()
        return {**row.asDict(True), "counts": json.loads(row["counts"])}

    def _table(self, name: str) -> DataFrame:
        """The rows of a table: those of each ingest without the projects that a later one has replaced."""
        parts = []
        for ingest_ in self.manifest["ingests"]:
            rows = self.spark.read.parquet(f"{self.path}/data/{ingest_['id']}/{name}")
            parts.append(rows.where(~F.col("doc").isin(*ingest_["dead"])) if ingest_["dead"] else rows)
        return union_all(parts) if len(parts) > 1 else parts[0]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self.manifest["counts"]:
            raise AttributeError(name)
        return self._table(name)

    def coverage(self) -> DataFrame:
        return self._table("coverage")

    def search_store(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The search documents, their postings and the statistics of each project, as ingest stored them."""
        return tuple(self._table(f"search/{part}") for part in ("documents", "postings", "statistics"))

    def dataset(self, name: str, kind: str | None = None, limit: int | None = None) -> DataFrame:
        frame = getattr(self, name)
        frame = frame.where(F.col("kind") == kind) if kind else frame
        return frame if limit is None else frame.limit(limit)

    def identity(self) -> dict:
        return {k: self.manifest[k] for k in ("fingerprint", "controllers", "created_at", "version")}


class Stored:
    """The tables that an ingest has written so far, as attributes."""

    def __init__(self, spark: SparkSession, path: str, names):
        self.spark, self.path, self.names = spark, path, set(names)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self.names:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.path}/{name}")


def indexed(frame: DataFrame) -> DataFrame:
    """One row per id: of equal ids the last in document order stays."""
    if "id" not in frame.columns or "pre" not in frame.columns:
        return frame
    return last_per_key(frame, ["doc", "id"], ["pre"])


def _write(frame: DataFrame, path: str, order: list[str] | None = None) -> None:
    """A table, sorted for range pruning, with bloom filters for point lookups."""
    frame = frame.sortWithinPartitions(*order) if order else frame
    writer = frame.write.mode("overwrite")
    for c in LOOKED_UP:
        if c in frame.columns:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)


def _write_ingest(spark: SparkSession, source: str, folder: str) -> list[str]:
    """All tables of the project files under ``source``; the names of the datasets."""
    project = Project.load(spark, source)
    frames = project.datasets()
    for name, frame in frames.items():
        _write(indexed(frame), f"{folder}/{name}", SORTED.get(name))
    _write(project.coverage(), f"{folder}/coverage")
    from millwright.plans.analysis import Analysis

    write_index(Analysis(Stored(spark, folder, frames)).search_documents(), "key", "text", f"{folder}/search", by="doc")
    # One row a project file: what the manifest of any version is made of.
    counted = union_all([spark.read.parquet(f"{folder}/{name}").select("doc", F.lit(name).alias("name")) for name in frames])
    counts = counted.groupBy("doc", "name").agg(F.count("*").alias("n")).groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias("counts"))
    files = spark.read.format("binaryFile").load(source).select(F.col("path").alias("doc"), F.sha2("content", 256).alias("sha"))
    dates = project.nodes.where("depth = 0").select("doc", F.try_element_at("attrs", F.lit("ExportDate")).alias("export_date"))
    names = spark.read.parquet(f"{folder}/controller").groupBy("doc").agg(F.collect_set("name").alias("controllers"))
    files.join(dates, "doc", "left").join(names, "doc", "left").join(counts, "doc", "left").write.mode("overwrite").parquet(f"{folder}/projects")
    return list(frames)


def ingest(spark: SparkSession, source: str, path: str, update: bool = False) -> Workspace:
    """Scan project files, derive all datasets, write them and publish them as a new version.

    The version has these projects alone, or with ``update`` also those of the version before with other files.
    """
    path = path.rstrip("/")
    there = versions(spark, path)
    before = Workspace(spark, path).manifest if update and there else None
    id_ = f"{(there[-1] if there else 0) + 1:06d}-{uuid.uuid4().hex[:8]}"
    names = _write_ingest(spark, source, f"{path}/data/{id_}")
    ingests = [{"id": id_, "dead": []}]
    if before:
        fresh = [r["doc"] for r in spark.read.parquet(f"{path}/data/{id_}/projects").select("doc").collect()]  # names of this ingest's files
        for old in before["ingests"]:
            own = [r["doc"] for r in spark.read.parquet(f"{path}/data/{old['id']}/projects").where(F.col("doc").isin(*fresh)).select("doc").collect()]
            dead = sorted({*old["dead"], *own})
            if spark.read.parquet(f"{path}/data/{old['id']}/projects").where(~F.col("doc").isin(*dead) if dead else F.lit(True)).limit(1).count():
                ingests.append({"id": old["id"], "dead": dead})
    out = publish(spark, path, ingests, names, source, there[-1] if there else 0)
    return compact(out) if len(ingests) > MOST_INGESTS else out


def publish(spark: SparkSession, path: str, ingests: list[dict], names: list[str], source: str, last: int) -> Workspace:
    """Write the manifest of the version after ``last``; another one of the same number, by another ingest, is an error."""
    parts = [spark.read.parquet(f"{path}/data/{i['id']}/projects").where(~F.col("doc").isin(*i["dead"]) if i["dead"] else F.lit(True)) for i in ingests]
    projects = union_all(parts)
    # One row: a hash, a few names and the counts of all tables.
    row = projects.agg(
        F.substring(F.sha2(F.array_join(F.sort_array(F.collect_list("sha")), ""), 256), 1, 12).alias("fingerprint"),
        F.max_by("export_date", export_time(F.col("export_date"))).alias("export_date"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("controllers")))).alias("controllers"),
        *[F.coalesce(F.sum(F.try_element_at("counts", F.lit(n))), F.lit(0)).alias(f"n_{n}") for n in names],
    ).first()
    counts = {n: row[f"n_{n}"] for n in names}
    values = (SCHEMA_VERSION, last + 1, row["fingerprint"], row["export_date"], row["controllers"], source, datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), json.dumps(counts), [(i["id"], i["dead"]) for i in ingests])
    spark.createDataFrame([values], MANIFEST).coalesce(1).write.mode("errorifexists").json(f"{path}/versions/{last + 1:012d}/manifest")
    _forget(spark, path)
    return Workspace(spark, path)


def compact(workspace: Workspace) -> Workspace:
    """The same rows as one ingest in a new version."""
    spark, path = workspace.spark, workspace.path
    number = versions(spark, path)[-1]
    id_ = f"{number + 1:06d}-{uuid.uuid4().hex[:8]}"
    names = list(workspace.manifest["counts"])
    for name in [*names, "coverage", "projects"]:
        _write(workspace._table(name), f"{path}/data/{id_}/{name}", SORTED.get(name))
    documents, postings, statistics = workspace.search_store()
    documents.write.parquet(f"{path}/data/{id_}/search/documents")
    postings.repartitionByRange("term", "key").sortWithinPartitions("term", "key").write.parquet(f"{path}/data/{id_}/search/postings")
    statistics.write.parquet(f"{path}/data/{id_}/search/statistics")
    return publish(spark, path, [{"id": id_, "dead": []}], names, workspace.manifest["source"], number)


def _forget(spark: SparkSession, path: str) -> None:
    """Remove what none of the newest versions reads: older manifests, and ingests that are in no manifest that stays.

    An ingest under way is newer than every published one and stays.
    """
    there = versions(spark, path)
    kept = there[-KEEP_VERSIONS:]
    used = {i["id"] for n in kept for i in Workspace(spark, path, n).manifest["ingests"]}
    for n in there[:-KEEP_VERSIONS]:
        where, store = _store(spark, f"{path}/versions/{n:012d}")
        store.delete(where, True)
    for name in _names(spark, f"{path}/data"):
        if name not in used and int(name.split("-")[0]) <= there[-1]:
            where, store = _store(spark, f"{path}/data/{name}")
            store.delete(where, True)


def write_jsonl(frame: DataFrame, path: str) -> None:
    """JSON lines without nulls, empty strings, lists and maps; zeros and false stay."""
    cols = []
    for f in frame.schema:
        kind = f.dataType.typeName()
        c = F.col(f.name)
        if kind == "string":
            c = F.nullif(c, F.lit(""))
        elif kind in ("array", "map"):
            c = F.when(F.size(c) > 0, c)
        cols.append(c.alias(f.name))
    frame.select(*cols).write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of JSON lines, torn or invalid lines left out; the suffix may be left out; a missing path gives no rows."""
    jvm = spark.sparkContext._jvm
    there = lambda p: bool((where := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where))
    path = next((p for p in (path, f"{path}.jsonl") if there(p)), None)
    if path is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def export_time(text):
    """An export date such as ``Tue Jan 02 10:00:00 2024`` as a timestamp; null where it is none."""
    return F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, r"^\w{3}\s+", ""), r"\s+", " "), F.lit("MMM d HH:mm:ss yyyy"))


def newest(candidates: DataFrame) -> DataFrame:
    """The workspace with the latest export date, then fingerprint, then path, of rows (path, export_date, fingerprint)."""
    return candidates.groupBy().agg(F.max_by("path", F.struct(export_time(F.col("export_date")), "fingerprint", "path")).alias("path"))


def find_workspace(spark: SparkSession, root: str, declared: str | None = None, variable: str = "MILLWRIGHT_WORKSPACE") -> str:
    """The workspace to use: the one that the environment names, else the declared one, else the only one under ``root``.

    A declared workspace is kept even where another has a later export, with a warning.
    """
    if path := os.environ.get(variable):
        return path
    try:
        found = spark.read.schema(MANIFEST).json(f"{root.rstrip('/')}/*/versions/*/manifest").select(F.regexp_extract(F.input_file_name(), r"^(.*)/versions/\d+/manifest/[^/]*$", 1).alias("path"), "number", "export_date", "fingerprint")
        found = found.groupBy("path").agg(F.max_by(F.struct("export_date", "fingerprint"), "number").alias("m")).select("path", "m.*")
        paths = [r["path"] for r in found.orderBy("path").limit(1000).collect()]
    except AnalysisException:
        paths = []
    if declared:
        latest = newest(found).first()["path"] if paths else None
        if latest and latest.rsplit("/", 1)[-1] != declared.rstrip("/").rsplit("/", 1)[-1]:
            warnings.warn(f"{latest} has a later export than the declared {declared}", stacklevel=2)
        return declared
    if len(paths) != 1:
        raise WorkspaceError(f"{len(paths)} workspaces under {root}: name one")
    return paths[0]
