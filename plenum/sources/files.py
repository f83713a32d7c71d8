"""Scene and graph documents, JSON lines, CSV, spreadsheets, directory discovery."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RAW = "wall_id string, ax double, ay double, bx double, by double, height double, thickness double"
ENTITY = f"id string, kind string, label string, x double, y double, z double, yaw_rad double, width double, depth double, height double, confirmed boolean, confidence double, source string, notes string, yaw_deg double, raw struct<{', '.join(c.replace(' ', ':') for c in RAW.split(', '))}>"
SCENE = f"schema_version string, units string, bounds struct<min_x:double,max_x:double,min_y:double,max_y:double>, entities array<struct<{ENTITY.replace(' string', ':string').replace(' double', ':double').replace(' boolean', ':boolean').replace(' struct<', ':struct<')}>>, skipped_lines array<struct<line_number:int,line:string,reason:string>>"
RECORD = "doc_id string, year int, date string, title string, transcript_raw string, url string, status string, source_xlsx string, row_index int"
HEADERS = {"video date": "date", "video title": "title", "video transcript": "transcript_raw", "video url": "url", "transcript status": "status"}


def scenes(spark: SparkSession, path: str) -> DataFrame:
    """room (the file's folder) and the fields of the scene documents under a path."""
    rows = spark.read.schema(SCENE).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return rows.select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("room"), F.col("_metadata.file_path").alias("source"), "*")


def scene_entities(scene_rows: DataFrame) -> DataFrame:
    """Entities with defaults for what is missing; equal ids keep the first place and the last values."""
    rows = scene_rows.select("room", F.posexplode("entities").alias("pos", "e")).select("room", (F.col("pos") + 1).alias("ord"), "e.*")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    rows = rows.select("room", "ord", "id", F.coalesce("kind", F.lit("unknown")).alias("kind"), F.coalesce("label", "kind", F.lit("")).alias("label"), "x", "y", *(zero(c) for c in ("z", "width", "depth", "height")), F.coalesce("yaw_rad", F.lit(0.0)).alias("yaw"), F.col("raw.wall_id").alias("wall_id"), "raw")
    names = [c for c in rows.columns if c not in ("room", "ord", "id")]
    grouped = rows.groupBy("room", "id").agg(F.min("ord").alias("first"), F.max_by(F.struct(*names), "ord").alias("last"))
    return grouped.select("room", F.col("first").alias("ord"), "id", "last.*")


def scene_walls(entity_rows: DataFrame) -> DataFrame:
    """Segments of walls that have both ends."""
    ends = [F.col(f"raw.{c}").alias(c) for c in ("ax", "ay", "bx", "by")]
    rows = entity_rows.where("kind = 'wall' AND raw.ax IS NOT NULL AND raw.ay IS NOT NULL AND raw.bx IS NOT NULL AND raw.by IS NOT NULL")
    return rows.select("room", "ord", "id", *ends, F.coalesce("height", "raw.height", F.lit(0.0)).alias("height"), F.coalesce("raw.thickness", F.lit(0.0)).alias("thickness"))


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON lines file or folder; none if there isn't any.  Blank lines are skipped."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)


def write_edges_csv(edges: DataFrame, path: str) -> list[str]:
    """source, target, type and whatever else any edge has, in the order of columns; gives the header."""
    named = edges.withColumnsRenamed({"src": "source", "dst": "target"})
    first = ["source", "target", "type"]
    others = [c for c in named.columns if c not in first]
    has = named.agg(*(F.coalesce(F.bool_or(F.col(c).isNotNull()), F.lit(False)).alias(c) for c in others)).first() if others else {}
    header = first + [c for c in others if has[c]]
    write_csv(named.select(header), path)
    return header


EDGE = "src string, dst string, type string, distance_m double, angle_error_deg double, angle_diff_deg double, overlap_m2 double, clearance_m double, yaw_diff_deg double, coverage double, length_m double, score double"
GRAPH = (
    "schema_version string, nodes array<struct<id:string,kind:string,label:string,x:double,y:double,z:double,yaw:double,width:double,depth:double,height:double>>, "
    f"edges array<struct<{', '.join(c.replace(' ', ':') for c in EDGE.split(', '))}>>, zones array<struct<zone_id:string,type:string,anchor_id:string,members:array<string>,x:double,y:double>>, "
    "principle_checks array<struct<principle:string,target:string,status:string,score:double,evidence:array<string>,against:array<string>>>, summary map<string,string>"
)


def graphs(spark: SparkSession, path: str) -> DataFrame:
    """room (the file's folder, or room= of its path), source and the fields of the graph documents under a path, one a file or a line."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("source"), F.explode(F.split("value", r"\n(?=\{)")).alias("text"))
    folder = F.url_decode(F.regexp_replace(F.element_at(F.split("source", "/"), -2), "^room=", ""))
    return files.where(F.trim("text") != "").select(folder.alias("room"), "source", F.from_json("text", GRAPH).alias("g")).select("room", "source", "g.*")


def graph_tables(graph_rows: DataFrame) -> dict[str, DataFrame]:
    """Rows of nodes, edges, zones and checks of graph documents, by room; ord is the place in the list."""
    def rows(name: str) -> DataFrame:
        return graph_rows.select("room", F.posexplode(name).alias("pos", "v")).select("room", (F.col("pos") + 1).alias("ord"), "v.*")

    return {name: rows(name) for name in ("nodes", "edges", "zones", "principle_checks")}


def safe_stem(name: Column, default: str = "scene") -> Column:
    """A name for files: runs of anything but ASCII letters, digits, _ and - become one _."""
    return F.regexp_replace(F.when(F.coalesce(name, F.lit("")) == "", F.lit(default)).otherwise(name), "[^A-Za-z0-9_-]+", "_")


def extras_stem(name: Column) -> Column:
    """The stem of what is made of a prediction's file, without its prefix."""
    return F.regexp_replace(safe_stem(name, "predict"), "^predict_?", "")


def graph_documents(nodes: DataFrame, edges: DataFrame, zones: DataFrame, checks: DataFrame, summary: DataFrame) -> DataFrame:
    """room and the scene graph as a JSON text."""
    def listed(df: DataFrame, name: str, order: list[str]) -> DataFrame:
        fields = [c for c in df.columns if c != "room"]
        keys = [F.col(c).alias(f"__{i}") for i, c in enumerate(order)]
        rows = df.groupBy("room").agg(F.sort_array(F.collect_list(F.struct(*keys, F.struct(*fields).alias("v")))).alias("l"))
        return rows.select("room", F.transform("l", lambda x: x["v"]).alias(name))

    out = summary.select("room", F.struct(*(c for c in summary.columns if c != "room")).alias("summary"))
    for df, name, order in ((nodes, "nodes", ["id"]), (edges, "edges", ["src", "dst", "type"]), (zones, "zones", ["zone_order", "zone"]), (checks, "principle_checks", ["rule_order", "target"])):
        out = out.join(listed(df, name, order), "room", "left")
    return out.select("room", F.to_json(F.struct(F.lit("scene_graph_v1").alias("schema_version"), "nodes", "edges", "zones", "principle_checks", "summary")).alias("document"))


def discovered(spark: SparkSession, root: str, name: str = "scene.json", recursive: bool = False) -> DataFrame:
    """room, path and mtime of scene files one level below a root, or at any level; a file at the root itself is none."""
    pattern = spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    below = F.regexp_extract(F.col("path"), "^(?:[a-z]+:)?/*" + re.escape(base.lstrip("/")) + "/(.+)/[^/]+$", 1)
    rows = pattern.select(below.alias("room"), "path", F.col("modificationTime").alias("mtime")).where("room <> ''")
    return (rows if recursive else rows.where(~F.contains("room", F.lit("/")))).orderBy("room")


def stable_doc_id(url, date, title, row_index):
    from ..operators.text import stable_id

    return stable_id(url, date, title, row_index)


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def sheet_rows(content: bytes, member: str = "xl/worksheets/sheet1.xml") -> list[dict[str, str]]:
    """Rows of a workbook's first sheet by lower-cased header; cells are placed by their column letters."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in item.iter(f"{{{_NS['m']}}}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        if member not in names:
            return []
        tree = ElementTree.fromstring(book.read(member))

    def text(cell) -> str:
        if cell.get("t") == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(f"{{{_NS['m']}}}t"))
        value = cell.find("m:v", _NS)
        if value is None or value.text is None:
            return ""
        if cell.get("t") == "s":
            place = int(value.text)
            return shared[place] if 0 <= place < len(shared) else ""
        return value.text

    column = lambda cell: "".join(c for c in cell.get("r") or "" if c.isalpha())
    rows = tree.findall(".//m:sheetData/m:row", _NS)
    if not rows:
        return []
    headers = {column(c): text(c).strip().lower() for c in rows[0].findall("m:c", _NS)}
    return [{headers[k]: text(c).strip() for c in row.findall("m:c", _NS) if headers.get(k := column(c))} for row in rows[1:]]


def transcripts(spark: SparkSession, path: str, name: str = "dm_shorts_*.xlsx") -> DataFrame:
    """Records of all workbooks of a folder, with a stable id, the year of the file's name and the row in the sheet."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", name).load(path).select("path", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ("file", "row_index", "date", "title", "transcript_raw", "url", "status")
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [{HEADERS.get(k, k): v for k, v in r.items()} for r in sheet_rows(content)]
                columns = [[file] * len(rows), list(range(2, len(rows) + 2)), *([r.get(f, "") for r in rows] for f in fields[2:])]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if f == "row_index" else pa.string()) for c, f in zip(columns, fields, strict=True)], names=list(fields))

    rows = files.mapInArrow(read, "file string, row_index int, date string, title string, transcript_raw string, url string, status string")
    book = F.element_at(F.split("file", "/"), -1)
    rows = rows.withColumn("source_xlsx", book).withColumn("year", F.regexp_extract(book, r"(\d{4})", 1).try_cast("int"))
    return rows.select(stable_doc_id(F.col("url"), F.col("date"), F.col("title"), F.col("row_index")).alias("doc_id"), "year", "date", "title", "transcript_raw", "url", "status", "source_xlsx", "row_index")


def ingest_counts(spark: SparkSession, path: str, name: str = "dm_shorts_*.xlsx") -> DataFrame:
    """One row: files, rows_seen (below the headers) and rows_emitted of the workbooks of a folder."""
    from ..operators.scoring import beside

    files = spark.read.format("binaryFile").option("pathGlobFilter", name).load(path).select("path", "content")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": pa.array([len(sheet_rows(c)) for c in batch.column(1).to_pylist()], pa.int64())})

    rows = files.mapInArrow(counted, "rows long").agg(F.count("*").alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows_seen"))
    return beside(rows, transcripts(spark, path, name).agg(F.count("*").alias("rows_emitted")))


def resolved_paths(spark: SparkSession, globbed: list[str], manifest: str | None = None) -> DataFrame:
    """Paths of globs, then of a manifest's lines (a path, or JSON with scene_graph or path; relative to it), each once."""
    jvm = spark._jvm.org.apache.hadoop.fs
    found: list[str] = []
    for pattern in globbed:
        target = jvm.Path(pattern)
        statuses = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
        found += sorted(s.getPath().toUri().getPath() for s in statuses or [])
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(found)], "seq long, path string")
    if manifest:
        folder = manifest.rsplit("/", 1)[0]
        text = F.trim("value")
        lines = spark.read.text(manifest).where((text != "") & ~text.startswith("#")).withColumn("seq", F.monotonically_increasing_id() + len(found))
        value = F.coalesce(F.get_json_object(text, "$.scene_graph"), F.get_json_object(text, "$.path"), text)
        rows = rows.unionByName(lines.select("seq", F.when(value.startswith("/"), value).otherwise(F.concat(F.lit(folder + "/"), value)).alias("path")))
    first = Window.partitionBy("path").orderBy("seq")
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").select("seq", "path")
