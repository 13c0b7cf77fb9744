"""Graphs on disk: Parquet by document, or JSON lines with a version."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph

#: Fixed value: what readers compare; another major version is refused.
VERSION = "1.1.0"


SCHEMAS = {
    "nodes": "doc_id string, id long, node_type string, props map<string,string>, value double, errors array<string>",
    "edges": "doc_id string, src long, dst long, edge_type string, ord int",
}


def described(g: Graph) -> DataFrame:
    """(table, column, kind, n, n_null): the schema that the rows have, with how many there are and how many hold nothing; one pass over each table."""
    found = None
    for name, df in (("nodes", g.nodes), ("edges", g.edges)):
        fields = {f.name: f.dataType.simpleString().split("<")[0] for f in df.schema.fields}
        one = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in fields])
        rows = F.array(*[F.struct(F.lit(name).alias("table"), F.lit(c).alias("column"), F.lit(k).alias("kind"), F.col("n"), F.col(f"null_{c}").alias("n_null")) for c, k in fields.items()])
        told = one.select(F.explode(rows).alias("r")).select("r.*")
        found = told if found is None else found.unionByName(told)
    return found


def as_json_schema(df: DataFrame, title: str) -> str:
    """The rows' schema as JSON Schema: one object with its properties, those that are never null as required."""
    kinds = {"string": "string", "long": "integer", "integer": "integer", "short": "integer", "double": "number", "float": "number", "boolean": "boolean"}

    def of(kind) -> dict:
        if isinstance(kind, str):
            return {"type": kinds.get(kind, "string")}
        if kind["type"] == "array":
            return {"type": "array", "items": of(kind["elementType"])}
        if kind["type"] == "map":
            return {"type": "object", "additionalProperties": of(kind["valueType"])}
        return {"type": "object", "properties": {f["name"]: of(f["type"]) for f in kind["fields"]}, "required": [f["name"] for f in kind["fields"] if not f["nullable"]]}

    return json.dumps({"$schema": "https://json-schema.org/draft/2020-12/schema", "title": title, **of(df.schema.jsonValue())}, sort_keys=True)


#: What brings a row of a version to the next, oldest first: 0.9.0 called the type ``kind``; 1.0.0 called properties by their whole name and knew no errors.
STEPS = [
    ("0.9.0", "1.0.0", {"node_type": lambda: F.col("kind")}),
    ("1.0.0", VERSION, {"props": lambda: F.col("properties"), "errors": lambda: F.array().cast("array<string>")}),
]
#: Columns that only older versions have.
OLDER = {"kind": "string", "properties": "map<string,string>"}


def migrated(nodes: DataFrame) -> DataFrame:
    """Rows of any mixture of versions as of the present version, each brought up step by step, in one pass.

    A row of a version that no step leads on from is an error when it is read.  Columns that only older
    versions have are dropped; those that no row has are added.
    """
    wanted = OLDER | {"node_type": "string", "props": "map<string,string>", "errors": "array<string>"}
    nodes = nodes.withColumns({c: F.lit(None).cast(kind) for c, kind in wanted.items() if c not in nodes.columns})
    version = F.col("schema_version")
    for at, to, values in STEPS:
        nodes = nodes.withColumns({c: F.when(version == at, v()).otherwise(F.col(c)) for c, v in values.items()} | {"schema_version": F.when(version == at, to).otherwise(version)})
    lost = F.raise_error(F.concat(F.lit("no way from version "), F.coalesce(version, F.lit("null")), F.lit(f" to {VERSION}")))
    return nodes.withColumn("schema_version", F.when(version == VERSION, version).otherwise(lost)).drop(*OLDER)


def report_version(reports: DataFrame, key: str) -> DataFrame:
    """(key, code) of reports (key, version) that readers refuse: no version, one that is none, or of another major one."""
    part = lambda i: F.get(F.split("version", "\\."), i).try_cast("int")
    code = F.when(F.col("version").isNull(), "VERSION_MISSING").when(part(0).isNull() | part(1).isNull(), "VERSION_INVALID").when(part(0) != int(VERSION.split(".")[0]), "VERSION_UNSUPPORTED")
    return reports.select(key, code.alias("code")).where("code is not null")


def write(g: Graph, path: str, form: str = "parquet") -> None:
    """Nodes and edges under the path, each row with the version."""
    for name, df in (("nodes", g.nodes), ("edges", g.edges)):
        df.withColumn("schema_version", F.lit(VERSION)).write.mode("overwrite").format(form).save(f"{path}/{name}")


def read(spark: SparkSession, path: str, form: str = "parquet") -> Graph:
    """The graph under the path; ValueError for rows of another major version."""
    schemas = {name: f"{schema}, schema_version string" for name, schema in SCHEMAS.items()}
    parts = {}
    for name, schema in schemas.items():
        reader = spark.read.format(form)
        df = (reader.schema(schema) if form == "json" else reader).load(f"{path}/{name}")
        if not df.where(F.split("schema_version", "\\.")[0] != VERSION.split(".")[0]).isEmpty():
            raise ValueError(f"{path}/{name} is of another major version than {VERSION}")
        parts[name] = df.drop("schema_version")
    return Graph(parts["nodes"], parts["edges"])


def stable_ids(g: Graph, named: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, id, stable_id): the same in every export of a document.

    A node of a named type is called by that property (``{"Font": "BaseFont"}``), others by a
    digest of their place: ids from the root down.  Nodes of one name are told apart by number; one
    that would then be called as another is by its own name has a digest of its id added.
    """
    from pyspark.sql import Window

    from ..operators import traversal

    paths = traversal.paths_to_root(g.children(), g.nodes.select("doc_id", "id"))
    kind = F.lower("node_type")
    name = F.concat(kind, F.lit("_"), F.substring(F.md5(F.array_join(F.col("path").cast("array<string>"), "/")), 1, 12))
    for t, key in (named or {}).items():
        value = F.try_element_at("props", F.lit(key))
        name = F.when((F.col("node_type") == t) & value.isNotNull(), F.concat(kind, F.lit("_"), value)).otherwise(name)
    own = g.nodes.join(paths, ["doc_id", "id"]).withColumn("name", name)
    number = F.row_number().over(Window.partitionBy("doc_id", "name").orderBy("id"))
    own = own.withColumn("n", number).withColumn("called", F.when(F.col("n") == 1, F.col("name")).otherwise(F.concat_ws("_", "name", "n")))
    again = F.row_number().over(Window.partitionBy("doc_id", "called").orderBy("n", "id"))
    digest = F.concat_ws("_", "called", F.substring(F.md5(F.col("id").cast("string")), 1, 12))
    return own.withColumn("again", again).select("doc_id", "id", F.when(F.col("again") == 1, F.col("called")).otherwise(digest).alias("stable_id"))


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def as_xml(df: DataFrame, name: str = "xml", row: str = "row") -> DataFrame:
    """Each row as one XML text."""
    return df.select(F.to_xml(F.struct(*df.columns), {"rowTag": row}).alias(name))
