"""Foreign property graphs: a data source for dumps, the mapping of their fields, and suggestions for it.

A dump is a folder of files with one JSON object a line, as graph databases export them:
{"type": "node", "id": ..., "labels": [...], "properties": {...}} and
{"type": "relationship", "id": ..., "label": ..., "start": {"id": ...}, "end": {"id": ...}, "properties": {...}}."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

NAME = "property_graph_dump"
NODES = "id string, label string, labels array<string>, properties string"
RELATIONSHIPS = "id string, label string, start_id string, end_id string, properties string"
#: Bytes of a file that a task reads, and rows of a batch.
SPLIT, ROWS = 64 << 20, 5_000
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"

#: Fixed values. Canonical fields with the foreign keys that usually hold them, the likeliest first.
CANDIDATES = {
    "urn": ["urn", "uuid", "id", "uri", "identifier", "nodeId"],
    "display_name": ["displayName", "name", "title", "label", "display_name"],
    "qualified_name": ["qualifiedName", "qualified_name", "fqn", "fullName", "full_name"],
    "description": ["description", "desc", "summary", "about"],
    "tags": ["tags", "labels", "categories"],
}
#: Foreign fields where nothing else is said.
DEFAULTS = {"urn": "urn", "display_name": "displayName", "qualified_name": "qualifiedName", "description": "description", "tags": "tags", "properties": "properties", "layer": "layerAssignment", "source_system": "sourceSystem", "last_synced": "lastSyncedAt", "edge_id": "id", "confidence": "confidence"}


@dataclass
class Piece(InputPartition):
    """A range of bytes of a file; lines that begin in it belong to it."""

    path: str
    start: int
    end: int


class DumpReader(DataSourceReader):
    def __init__(self, options: dict, kind: str):
        self.path, self.kind = options["path"], kind
        self.split = int(options.get("split", SPLIT))
        self.labels: list[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  (Spark's name)
        """Takes equality with a label, or one of several; leaves the rest to Spark."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("label",):
                wanted = [f.value] if isinstance(f, EqualTo) else list(f.value)
                self.labels = wanted if self.labels is None else [x for x in self.labels if x in wanted]
            else:
                yield f

    def partitions(self) -> list[Piece]:
        store, root = fs.FileSystem.from_uri(self.path)
        files = [f for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and not f.base_name.startswith(("_", "."))]
        return [Piece(f.path, at, min(at + self.split, f.size)) for f in sorted(files, key=lambda f: f.path) for at in range(0, f.size, self.split)]

    def lines(self, piece: Piece) -> Iterator[bytes]:
        store, _ = fs.FileSystem.from_uri(self.path)
        with io.BufferedReader(store.open_input_file(piece.path), 1 << 20) as file:
            file.seek(max(0, piece.start - 1))
            at = file.tell() + (len(file.readline()) if piece.start else 0)  # the line that began before is another task's
            while at < piece.end and (line := file.readline()):
                at += len(line)
                yield line

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        rows, schema = [], pa.schema([(n, pa.list_(pa.string()) if n == "labels" else pa.string()) for n in (x.split()[0] for x in (NODES if self.kind == "node" else RELATIONSHIPS).split(", "))])
        for line in self.lines(piece):
            x = json.loads(line) if line.strip() else {}
            if x.get("type") != self.kind:
                continue
            label = next(iter(x.get("labels") or []), None) if self.kind == "node" else x.get("label")
            if self.labels is not None and label not in self.labels:
                continue
            own = {"id": x.get("id"), "label": label, "properties": json.dumps(x.get("properties") or {}, ensure_ascii=False)}
            own |= {"labels": x.get("labels") or []} if self.kind == "node" else {"start_id": (x.get("start") or {}).get("id"), "end_id": (x.get("end") or {}).get("id")}
            rows.append({k: v if v is None or k == "labels" else str(v) for k, v in own.items()})
            if len(rows) == ROWS:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


class Dump(DataSource):
    """Options: path (a folder that tasks reach by the same address), kind (node or relationship), split (bytes of a task)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return NODES if self.options.get("kind", "node") == "node" else RELATIONSHIPS

    def reader(self, schema) -> DumpReader:
        return DumpReader(dict(self.options), self.options.get("kind", "node"))


def read_dump(spark: SparkSession, path: str, kind: str = "node", split: int = SPLIT) -> DataFrame:
    """The nodes (id, label, labels, properties as JSON) or relationships (id, label, start_id, end_id, properties) of a dump. A
    filter on label is pushed to the reader, which then skips other lines unread but for that."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(Dump)
    return spark.read.format(NAME).option("path", path if "://" in path else f"file://{path}").option("kind", kind).option("split", split).load()


def foreign_field(mapping: dict[str, str], canonical: str) -> str:
    """The foreign name of a canonical field: the mapping's, else the usual one, else the same."""
    return mapping.get(canonical) or DEFAULTS.get(canonical, canonical)


def _props(column: str) -> Column:
    return F.coalesce(F.from_json(column, "map<string,string>"), F.create_map().cast("map<string,string>"))


def map_nodes(raw: DataFrame, mapping: dict[str, str], levels: DataFrame, type_field: str | None = None, collect: bool = True) -> DataFrame:
    """Nodes (urn, entity_type, level, display_name, qualified_name, description, tags, properties, layer, source_system,
    last_synced, foreign_id) of raw ones (id, labels, properties as JSON).

    The type is the first label, or a property (type_field); `unknown` where there is none, and its level is that of levels
    (type_id, level), or null. Tags are a JSON array, in a string or not; anything else is no tags. The properties field, a JSON
    object in a string or not, gives the properties; with `collect` all other unmapped keys go along, the field's own winning.
    A missing urn or name is empty."""
    f = lambda name: F.col("p")[foreign_field(mapping, name)]
    empty = F.create_map().cast("map<string,string>")
    kind = F.col("p")[type_field] if type_field else F.get("labels", F.lit(0))
    inner = F.coalesce(F.from_json(f("properties"), "map<string,string>"), empty)
    used = [foreign_field(mapping, n) for n in DEFAULTS if n not in ("edge_id", "confidence")] + [type_field] * bool(type_field)
    rest = F.map_filter("p", lambda k, v: ~k.isin(used) & ~F.map_contains_key("inner", k)) if collect else empty
    tags = F.filter(F.coalesce(F.from_json(f("tags"), "array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull())
    rows = raw.select(F.col("id").alias("foreign_id"), "labels", _props("properties").alias("p")).withColumn("inner", inner)
    out = rows.select(F.coalesce(f("urn"), F.lit("")).alias("urn"), F.coalesce(kind, F.lit("unknown")).alias("entity_type"), F.coalesce(f("display_name"), F.lit("")).alias("display_name"), f("qualified_name").alias("qualified_name"), f("description").alias("description"), tags.alias("tags"), F.map_concat("inner", rest).alias("properties"), f("layer").alias("layer"), f("source_system").alias("source_system"), f("last_synced").alias("last_synced"), "foreign_id")
    return out.join(levels.select(F.col("type_id").alias("entity_type"), "level"), "entity_type", "left").select("urn", "entity_type", "level", "display_name", "qualified_name", "description", "tags", "properties", "layer", "source_system", "last_synced", "foreign_id")


def map_edges(raw: DataFrame, nodes: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Edges (id, source_urn, target_urn, edge_type, confidence, properties) of raw ones (id, label, start_id, end_id, properties) between
    mapped nodes. An edge without an id of its own is named by its ends and type; one with an end that is no node is left out."""
    end = lambda side: nodes.select(F.col("foreign_id").alias(f"{side}_id"), F.col("urn").alias(f"{side}_urn"))
    both = raw.withColumn("p", _props("properties")).join(end("start"), "start_id").join(end("end"), "end_id")
    own = lambda name: F.col("p")[foreign_field(mapping, name)]
    inner = F.coalesce(F.from_json(F.col("p")[mapping["edge_properties"]], "map<string,string>"), F.create_map().cast("map<string,string>")) if mapping.get("edge_properties") else F.create_map().cast("map<string,string>")
    return both.select(F.coalesce(own("edge_id"), F.concat_ws("|", "start_urn", "label", "end_urn")).alias("id"), F.col("start_urn").alias("source_urn"), F.col("end_urn").alias("target_urn"), F.col("label").alias("edge_type"), own("confidence").try_cast("double").alias("confidence"), inner.alias("properties"))


def property_keys(raw: DataFrame) -> DataFrame:
    """label, key, n: how many nodes of a label have a key."""
    return raw.select(F.explode("labels").alias("label"), F.explode(F.map_keys(_props("properties"))).alias("key")).groupBy("label", "key").agg(F.count("*").alias("n"))


def suggested(keys: DataFrame) -> DataFrame:
    """label, field, key: for each canonical field the likeliest key that nodes of the label have, and with a null label that
    any nodes have. keys: label, key."""
    known = keys.sparkSession.createDataFrame([(f, k, i) for f, ks in CANDIDATES.items() for i, k in enumerate(ks)], "field string, key string, place int")
    met = keys.select("label", "key").distinct().join(F.broadcast(known), "key")  # a few rows of CANDIDATES
    return met.groupingSets([["label", "field"], ["field"]], "label", "field").agg(F.min_by("key", "place").alias("key"))


def write_dump(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A dump of nodes (urn, entity_type, display_name, tags, properties) and edges, as read_dump reads it."""
    own = F.map_concat(F.coalesce("properties", F.create_map().cast("map<string,string>")), F.create_map(F.lit("urn"), F.col("urn"), F.lit("displayName"), F.col("display_name"), F.lit("tags"), F.to_json("tags")))
    node = F.to_json(F.struct(F.lit("node").alias("type"), F.col("urn").alias("id"), F.array("entity_type").alias("labels"), own.alias("properties")))
    end = lambda side: F.struct(F.col(f"{side}_urn").alias("id"))
    edge = F.to_json(F.struct(F.lit("relationship").alias("type"), "id", F.col("edge_type").alias("label"), end("source").alias("start"), end("target").alias("end"), F.struct("id", "confidence").alias("properties")))
    nodes.select(node.alias("value")).union(edges.select(edge)).write.text(path)
