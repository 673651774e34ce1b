"""Readers with explicit schemas. All paths go through Spark, so any store works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = "struct<xmin:double,ymin:double,xmax:double,ymax:double,x:double,y:double,w:double,h:double>"
ANNOTATIONS = f"types array<string>, imgs map<string,struct<path:string,id:string,objects:array<struct<bbox:{BOX},category:string>>>>"
COCO = "images array<struct<id:bigint,width:int,height:int,file_name:string>>, annotations array<struct<image_id:bigint,category_id:bigint,bbox:array<double>,ignore:boolean>>, categories array<struct<id:bigint,name:string>>"
PANORAMA = "id string, path string, split_orig string, width int, height int, objects array<struct<category:string,xyxy:array<double>>>"


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """id, path, objects of a nested annotation file; objects without a category (or ``?``) go."""
    raw = spark.read.schema(ANNOTATIONS).json(path, multiLine=True)
    rows = raw.select(F.explode("imgs").alias("key", "img"))
    named = F.filter("img.objects", lambda o: o["category"].isNotNull() & (o["category"] != "?"))
    return rows.select(F.coalesce("img.id", "key").alias("id"), "img.path", named.alias("objects"))


def objects_of(records: DataFrame) -> DataFrame:
    """id, category, bbox: one row per object."""
    return records.select("id", F.explode("objects").alias("o")).select("id", "o.category", "o.bbox")


def coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images, annotations, categories of a COCO file."""
    raw = spark.read.schema(COCO).json(path, multiLine=True)
    return tuple(raw.select(F.explode(c).alias("r")).select("r.*") for c in ("images", "annotations", "categories"))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON object a line; blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def _tile(suffix: str):
    """The tile of a file: its folder ``tile=<name>``, else its name without the suffix."""
    folder = F.regexp_extract("_metadata.file_path", r"/tile=([^/]+)/[^/]*$", 1)
    return F.when(folder != "", folder).otherwise(F.regexp_extract("_metadata.file_name", rf"^(.*){suffix}$", 1))


def yolo_labels(spark: SparkSession, path: str) -> DataFrame:
    """tile, class_id, cx, cy, w, h of a folder of label files; lines of fewer than five fields are skipped."""
    raw = spark.read.text(path, pathGlobFilter="*.txt", recursiveFileLookup=True)
    lines = raw.select(_tile(r"\.txt").alias("tile"), F.split(F.trim("value"), r"\s+").alias("f")).where(F.size("f") >= 5)
    return lines.select("tile", F.col("f")[0].cast("int").alias("class_id"), *[F.col("f")[i + 1].cast("double").alias(n) for i, n in enumerate(("cx", "cy", "w", "h"))])


def ignore_boxes(spark: SparkSession, path: str, tiles: DataFrame) -> DataFrame:
    """Every tile with its ignore boxes; a tile without a sidecar file has none."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).where(F.col("_metadata.file_name").endswith(".ignore.json") | F.col("_metadata.file_path").contains("/tile="))
    read = raw.select(_tile(r"\.ignore\.json").alias("tile"), F.from_json("value", "array<array<double>>").alias("ignores"))
    return tiles.join(read, "tile", "left").withColumn("ignores", F.coalesce("ignores", F.array().cast("array<array<double>>")))


def tiles(spark: SparkSession, images_path: str, labels_path: str, ignores_path: str) -> DataFrame:
    """tile, content, labels, ignores: images with what their sidecar files say; none is an empty array."""
    found = spark.read.parquet(images_path)
    per = yolo_labels(spark, labels_path).groupBy("tile").agg(F.array_sort(F.collect_list(F.struct("class_id", "cx", "cy", "w", "h"))).alias("labels"))
    with_labels = found.join(per, "tile", "left").withColumn("labels", F.coalesce("labels", F.array().cast(per.schema["labels"].dataType)))
    return ignore_boxes(spark, ignores_path, with_labels)


def count_images(spark: SparkSession, path: str) -> int:
    """Files that end in .jpg; only the listing is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jpg").load(path).select("path").count()


def with_masks(tiles: DataFrame, masks: DataFrame) -> DataFrame:
    """Adds mask, the valid silhouette kept for a tile (null where there is none)."""
    return tiles.join(masks.where("status = 'ok'").select("tile", "mask"), "tile", "left")


def images(spark: SparkSession, path: str, sample: int | None = None, seed: int = 42) -> DataFrame:
    """path and content of images; a sample is drawn by hash of the path, the same in every run.

    Paths are drawn first, and only the drawn files are opened.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").rlike(r"\.(jpg|jpeg|png)$"))
    if sample is None:
        return files.select("path", "content")
    drawn = files.select("path").orderBy(F.xxhash64(F.lit(seed), "path"), "path").limit(sample)
    return spark.read.format("binaryFile").load([r.path for r in drawn.collect()]).select("path", "content") if sample <= 10_000 else files.join(drawn, "path", "left_semi").select("path", "content")


def training_curve(spark: SparkSession, path: str, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Columns of a results CSV under canonical names: an exact match first, then a substring; blanks and nan are null."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    picked = []
    for name, wanted in aliases.items():
        found = next((c for w in wanted for c in raw.columns if c == w), None) or next((c for w in wanted for c in raw.columns if w in c), None)
        value = F.lit(None).cast("double") if found is None else F.when(~F.lower(F.trim(F.col(f"`{found}`"))).isin("", "nan"), F.col(f"`{found}`").cast("double"))
        picked.append(value.alias(name))
    return raw.select(picked)


def run_reports(spark: SparkSession, path: str) -> DataFrame:
    """AP reports partitioned by arm, seed and split; only the folders that a filter names are read."""
    return spark.read.parquet(path)


def find_annotation_file(spark: SparkSession, root: str) -> str | None:
    """The shallowest JSON (then by name) whose first 4 KB mention images or objects, else the first JSON."""
    heads = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(root)
    head = F.decode(F.substring("content", 1, 4096), "UTF-8")
    likely = head.contains('"imgs"') | head.contains('"objects"')
    row = heads.select("path", (~likely).alias("other"), F.size(F.split("path", "/")).alias("depth")).orderBy("other", "depth", "path").first()
    return row["path"] if row else None
